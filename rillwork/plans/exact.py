"""Sums that stay exact while values come and go: whole numbers, decimals, and doubles as scaled whole numbers.

A double is a whole number of 2 ** -1074, so adding and taking back doubles loses nothing; NaN and the infinities are counted apart and leave the
sum again when they are deleted. Only the result is rounded, once.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType

from ..operators.zset import W
from .deltas import Delta

#: A double is a whole number of 2 ** -UNIT.
UNIT = 1074
_WIDE = decimal.Context(prec=200)


@dataclass(frozen=True)
class Sum:
    """A sum so far: ``units`` of the kind's smallest part, and how often NaN and the infinities are in it."""

    units: int = 0
    count: int = 0
    nan: int = 0
    up: int = 0
    down: int = 0

    def __add__(self, other: Sum) -> Sum:
        return Sum(self.units + other.units, self.count + other.count, self.nan + other.nan, self.up + other.up, self.down + other.down)

    def special(self) -> float | None:
        if self.nan or self.up and self.down:
            return math.nan
        return math.inf if self.up else -math.inf if self.down else None

    def total(self, kind: DataType) -> Any:
        """0 over nothing."""
        if isinstance(kind, DoubleType | FloatType):
            return quotient(self, 1)
        return _WIDE.scaleb(decimal.Decimal(self.units), -kind.scale) if isinstance(kind, DecimalType) else self.units

    def mean(self, kind: DataType) -> Any:
        """None over nothing."""
        if not self.count:
            return None
        if isinstance(kind, DoubleType | FloatType):
            return quotient(self, self.count)
        return _WIDE.divide(self.total(kind), self.count) if isinstance(kind, DecimalType) else self.units / self.count


def quotient(s: Sum, n: int) -> float:
    """The double nearest to the sum over n."""
    if (odd := s.special()) is not None:
        return odd
    try:
        return s.units / (n << UNIT)
    except OverflowError:
        return math.inf if s.units > 0 else -math.inf


def added(values: Iterable[tuple[Any, int]], kind: DataType) -> Sum:
    """Of (value, weight) pairs; nulls count as nothing."""
    units = n = nan = up = down = 0
    floating, scale = isinstance(kind, DoubleType | FloatType), kind.scale if isinstance(kind, DecimalType) else None
    for v, w in values:
        if v is None:
            continue
        n += w
        if floating:
            if v != v:
                nan += w
            elif v in (math.inf, -math.inf):
                up, down = (up + w, down) if v > 0 else (up, down + w)
            else:
                top, bottom = v.as_integer_ratio()
                units += w * (top << UNIT - bottom.bit_length() + 1)
        else:
            units += w * (v if scale is None else int(_WIDE.scaleb(v, scale)))
    return Sum(units, n, nan, up, down)


def of_delta(delta: Delta, c: Column, kind: DataType) -> Sum:
    """The sum of a column over a weighted set; a table's in one job, of which a few thousand rows at most reach the driver."""
    if isinstance(kind, NullType):
        return Sum()
    if not isinstance(kind, DoubleType | FloatType | DecimalType | ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"no numbers: {kind.simpleString()}")
    if delta.rows is not None:
        return added(delta.values(c), kind)
    frame = delta.frame().select(c.alias("v"), F.col(W).alias("w")).where("v is not null")
    if not isinstance(kind, DoubleType | FloatType):
        exact = F.col("v") if isinstance(kind, DecimalType) else F.col("v").cast("decimal(28,0)")
        scale = kind.scale if isinstance(kind, DecimalType) else 0
        found = frame.groupBy("w").agg(F.sum(exact).alias("s"), F.count("*").alias("n")).collect()  # a row for each different weight
        return Sum(sum(r["w"] * int(_WIDE.scaleb(r["s"], scale)) for r in found), sum(r["w"] * r["n"] for r in found))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole mantissas, added for each exponent in two halves, which a long holds."""
        for batch in batches:
            v, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part, exponent = np.frexp(np.where(np.isfinite(v), v, 0.0))
            whole = np.ldexp(part, 53).astype(np.int64)
            exponent = np.where(np.isnan(v), 5000, np.where(v == np.inf, 5001, np.where(v == -np.inf, 5002, exponent)))
            kinds, of = np.unique(exponent, return_inverse=True)
            high, low, n = (np.zeros(len(kinds), object) for _ in range(3))
            for held, x in ((high, whole >> 27), (low, whole & (1 << 27) - 1), (n, np.ones_like(whole))):
                np.add.at(held, of, x.astype(object) * w.astype(object))
            text = lambda x: pa.array([str(i) for i in x])
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), text(high), text(low), text(n)], names=["e", "high", "low", "n"])

    number = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = frame.select(F.col("v").cast("double"), "w").mapInArrow(cut, "e int, high string, low string, n string").groupBy("e").agg(number("high"), number("low"), number("n")).collect()
    units, odd, n = 0, {5000: 0, 5001: 0, 5002: 0}, 0
    for r in found:
        n += int(r["n"])
        if r["e"] in odd:
            odd[r["e"]] = int(r["n"])
        else:
            units += (int(r["high"]) << 27) + int(r["low"]) << UNIT + r["e"] - 53 if UNIT + r["e"] >= 53 else (int(r["high"]) << 27) + int(r["low"]) >> 53 - UNIT - r["e"]
    return Sum(units, n, odd[5000], odd[5001], odd[5002])
