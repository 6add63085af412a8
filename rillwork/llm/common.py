"""What the operators of this package share: shared storage, code on executors, literals."""

from __future__ import annotations

import atexit
import io
import json
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructField, StructType

from ..sources.storage import materialize, shared_dir

__all__ = ["ascii_lower", "column", "give_back", "json_table", "materialize", "packed", "read", "rows_frame", "schema_with", "shared_dir", "ship_code", "small", "unpacked"]

PACKAGE = Path(__file__).resolve().parents[1]


#: Spark's limit of the bytes that go to Python at once, and what it is lowered to where a session has left it alone: texts are long.
BATCH_LIMIT, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def ship_code(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once for each application, and bound the batches that Python gets."""
    if spark.conf.get(BATCH_LIMIT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_rillwork_shipped", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    folder = tempfile.mkdtemp(prefix="rillwork-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "rillwork_code.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    sc._rillwork_shipped = True


def give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, which shrinks their heaps: a stage's Python workers may need the memory that the heap of the stage before still holds.

    A task for each slot; a JVM that ignores explicit collections, or gets no task, keeps its heap, and nothing else differs."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small driver-side list as a DataFrame, through a JSON literal: no RDD and no Python workers."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    items = F.from_json(F.lit(text), f"array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in schema.split(','))}>>")
    return spark.range(1).select(F.explode(items).alias("_r")).select("_r.*")


def json_table(spark: SparkSession, lines: Iterable[str], schema: str) -> DataFrame:
    """JSON lines of the driver as a table in the shared folder: for what is too long for a literal."""
    path = f"{shared_dir(spark)}/lines.json"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    held: list[str] = []
    size = 0
    for line in chain(lines, [None]):
        if line is None or size > 4 << 20:
            out.write(bytearray("".join(held).encode()))
            held, size = [], 0
        if line is not None:
            held.append(line + "\n")
            size += len(line)
    out.close()
    return spark.read.schema(schema).json(path)


def column(name: str) -> Column:
    """A column by its very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: Iterable[str], out: str = "row") -> Column:
    """The columns as one struct, so that none can clash with an operator's own columns."""
    return F.struct(*[column(c).alias(c) for c in names] or [F.lit(None).cast("int").alias("none")]).alias(out)


def unpacked(names: Iterable[str], held: str = "row") -> list[Column]:
    return [F.col(held).getField(c).alias(c) for c in names]


def schema_with(df: DataFrame, names: Iterable[str], more: dict[str, str]) -> StructType:
    """The fields of these columns, then new ones by name and type."""
    out = StructType([StructField(c, df.schema[c].dataType) for c in names])
    for c, kind in more.items():
        out = out.add(c, kind)
    return out


#: Tables of at most so many bytes, strings and arrays counted in full, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: the length of strings and binaries, 8 for each plain value and 16 for each element's own parts."""
    def size(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType | BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, StructType):
            return sum((size(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
        if isinstance(kind, ArrayType):
            if isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType):
                return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + size(x, kind.elementType)), F.lit(16))
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
        if isinstance(kind, MapType):
            raise TypeError("maps are not broadcast")
        return F.lit(8)

    return sum((size(column(f.name), f.dataType) for f in df.schema.fields), F.lit(16))


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its rows take BROADCAST_BYTES at most, by their own sizes."""
    used = df.agg(F.coalesce(F.sum(row_bytes(df).cast("long")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if used <= BROADCAST_BYTES else df


#: The ASCII capital letters and their small forms; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
