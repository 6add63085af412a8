"""The batch meaning of the set and bag operators, on plain DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Predicate = Column | str | Callable


def by_series(f: Callable) -> Callable:
    """Marks a Python function that takes many rows at once, as a pandas DataFrame: a predicate gives a boolean Series, an image a DataFrame."""
    f.by_series = True
    return f


def condition(df: DataFrame, predicate: Predicate, errors: str = "raise") -> Column:
    """A predicate as a column; null means no. A Python function of a row (a dict), or of many (``by_series``), runs in a pandas UDF.

    ``errors="false"`` counts a failing function of a row as no; otherwise the failure is raised.
    """
    if isinstance(predicate, str):
        predicate = F.expr(predicate)
    if isinstance(predicate, Column):
        return F.coalesce(predicate.cast("boolean"), F.lit(False))

    if getattr(predicate, "by_series", False):
        many = F.pandas_udf(lambda rows: predicate(rows).fillna(False).astype(bool), "boolean")
        return many(F.struct(*[F.col(f"`{c}`") for c in df.columns]))

    @F.pandas_udf("boolean")
    def test(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.to_dict("records"):
            try:
                out.append(bool(predicate(r)))
            except Exception:
                if errors != "false":
                    raise
                out.append(False)
        return pd.Series(out)

    return test(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def source(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """A set: one row for each key (all columns by default)."""
    return df.dropDuplicates(list(key) if key else df.columns)


def last_op_wins(ops: DataFrame, key: Sequence[str], seq: str, present: Column | str) -> DataFrame:
    """The rows of an op log that are present after it: the last op of each key decides.

    One aggregation with map-side combine, no sort of a key's ops."""
    present = F.expr(present) if isinstance(present, str) else present
    rest = [c for c in ops.columns if c not in key]
    last = F.max_by(F.struct(present.alias("__p"), *rest), F.col(seq)).alias("__l")
    return ops.groupBy(*key).agg(last).where("__l.__p").select(*key, *[F.col(f"__l.{c}").alias(c) for c in rest])


def effective_ops(ops: DataFrame, key: Sequence[str], seq: str, present: Column | str) -> DataFrame:
    """The ops that change something, with ``__w`` of 1 or -1: inserts of what is absent, deletes of what is present."""
    present = F.expr(present) if isinstance(present, str) else present
    marked = ops.withColumn("__p", present.cast("boolean"))
    before = F.coalesce(F.lag("__p").over(Window.partitionBy(*key).orderBy(seq)), F.lit(False))
    return marked.withColumn("__before", before).where(F.col("__p") != F.col("__before")).withColumn("__w", F.when(F.col("__p"), 1).otherwise(-1).cast("long")).drop("__p", "__before")


def filter_set(df: DataFrame, predicate: Predicate, distinct: bool = True, errors: str = "raise") -> DataFrame:
    """The rows that pass, each once; ``distinct=False`` where the input is a set already."""
    found = df.where(condition(df, predicate, errors))
    return found.distinct() if distinct else found


def map_bag(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Images, as many as rows."""
    return df.select(*columns)


def map_python(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Images by a Python function of a row (a dict) that gives a tuple or one value, or of many rows (``by_series``), in Arrow batches."""
    if getattr(f, "by_series", False):
        return df.mapInPandas(lambda frames: map(f, frames), schema)

    def run(frames):
        for frame in frames:
            rows = [f(r) for r in frame.to_dict("records")]
            yield pd.DataFrame([r if isinstance(r, tuple) else (r,) for r in rows], columns=names)

    names = df.sparkSession.createDataFrame([], schema).columns
    return df.mapInPandas(run, schema)


def count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def reduce(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Folds as aggregates: a sum of nothing is null unless coalesced, as with ``total``."""
    return df.agg(*[a.alias(k) for k, a in aggregates.items()])


def total(c: Column | str) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def group_sizes(df: DataFrame, key: Column | str, name: str = "k", count_name: str = "n", unique: bool = False) -> DataFrame:
    """The groups with rows in them, and how many different rows each has; a null key is a group. Rows known to be ``unique`` are only counted."""
    key = F.col(key) if isinstance(key, str) else key
    return (df if unique else df.distinct()).groupBy(key.alias(name)).agg(F.count("*").alias(count_name))


def group_keys(df: DataFrame, key: Column | str, name: str = "k") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.alias(name)).distinct()


def get_group(df: DataFrame, key: Column | str, value, unique: bool = False) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    found = df.where(key.eqNullSafe(F.lit(value)))
    return found if unique else found.distinct()


def join(left: DataFrame, right: DataFrame, left_key: Column | str, right_key: Column | str) -> DataFrame:
    """Inner equi-join of computed keys, null meeting null; all columns of both sides, as many rows as pairs.

    Spark picks the strategy by size and splits skewed partitions; nothing is broadcast by hand.
    """
    lk = F.col(left_key) if isinstance(left_key, str) else left_key
    rk = F.col(right_key) if isinstance(right_key, str) else right_key
    a, b = left.withColumn("__lk", lk), right.withColumn("__rk", rk)
    return a.join(b, F.col("__lk").eqNullSafe(F.col("__rk"))).drop("__lk", "__rk")
