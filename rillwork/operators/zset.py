"""Weighted sets: a DataFrame of payload columns and a weight ``__w``.

In a state weights are positive (a set has only ones); in a delta they are of either sign. All
functions are plain aggregations on the payload, nulls being equal to each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "__w"


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != W]


def weigh(df: DataFrame, weight: int = 1) -> DataFrame:
    """Rows with a weight each."""
    return df.withColumn(W, F.lit(weight).cast("long"))


def consolidate(df: DataFrame) -> DataFrame:
    """One row for each payload, weights added, zeros gone."""
    return df.groupBy(*payload(df)).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def add(*parts: DataFrame) -> DataFrame:
    return consolidate(reduce(DataFrame.unionByName, parts))


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(W, -F.col(W))


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """The delta that makes ``new`` from ``old``."""
    return add(new, negate(old))


def to_set(state: DataFrame) -> DataFrame:
    """Weight one for what has a positive weight."""
    return consolidate(state).where(F.col(W) > 0).withColumn(W, F.lit(1).cast("long"))


def expand(state: DataFrame) -> DataFrame:
    """Each payload as often as its weight says, without the weight."""
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(W)))
    return state.where(F.col(W) > 0).select(*payload(state), times.alias("__i")).drop("__i")


def elements(state: DataFrame) -> DataFrame:
    """The different payloads present."""
    return to_set(state).drop(W)


def same(a: DataFrame, b: DataFrame, columns: list[str]):
    """A null-safe equi-join condition: Spark still plans it as a hash or merge join."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def touched(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The rows of a state whose payload is in a delta."""
    keys = delta.select(*payload(delta)).distinct()
    return state.join(keys, same(state, keys, payload(delta)), "left_semi")
