import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

#: The driver's tables, for tests that compare whole queries.
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "4g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def rows():
    """The rows of a DataFrame as sorted tuples."""
    def plain(v):
        if hasattr(v, "asDict"):
            return tuple(plain(x) for x in v)
        return [plain(x) for x in v] if isinstance(v, list) else v

    return lambda df: sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
