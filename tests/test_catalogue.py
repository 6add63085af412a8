import math

import duckdb
import pytest

from rillwork.plans.catalogue import ORACLE_SQL, QUERIES

from .conftest import SMALL

#: The slowest replays are compared by the driver and in test_incremental.
SLOW = {"delta_pairwise", "delta_window3", "delta_pipeline"}


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else repr(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_cap_over_the_whole_table(spark):
    found = QUERIES["capped_by_user_and_day"](spark, SMALL).collect()
    con = duckdb.connect()
    groups = con.execute(f"SELECT count(*) FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM '{SMALL}/events.parquet')").fetchone()[0]
    assert len(found) == groups
    assert any(r["capped"] == 50 for r in found) and any(r["capped"] < 50 for r in found)
