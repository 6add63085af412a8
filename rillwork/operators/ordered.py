"""Operators on a sort order: positions, pairs of neighbours, sliding windows, rolling aggregates.

A plain window would put all rows of the table, or of a group, in one task. So larger tables are cut into ranges of the order (of group and
order, where there are groups), each range gets copies of the few rows before and after it as guests, and the window function runs within ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize

#: Rows of a range; a table of at most so many is one range.
RANGE_ROWS = 200_000
#: How often a row is there before and after a change.
OLD, NEW = "__old", "__new"


@dataclass(frozen=True)
class Key:
    """A sort key: nulls come first, or last if descending."""

    column: Column
    descending: bool = False

    def sort(self, backwards: bool = False) -> Column:
        return self.column.desc_nulls_last() if self.descending != backwards else self.column.asc_nulls_first()


KeyLike = Column | str | Key


def desc(key: Column | str) -> Key:
    return Key(F.col(key) if isinstance(key, str) else key, True)


def order_by(keys: Sequence[KeyLike], tiebreak: Sequence[str] = ()) -> list[Key]:
    as_key = lambda k: k if isinstance(k, Key) else Key(F.col(k) if isinstance(k, str) else k)
    return [as_key(k) for k in [*keys, *tiebreak]]


def columns(order: Sequence[Key], backwards: bool = False) -> list[Column]:
    return [k.sort(backwards) for k in order]


def ranges(df: DataFrame, order: Sequence[Key], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """``df`` with ``__b``, the number of its range from 0 without gaps, and how many ranges there are.

    Several ranges are written, so that their borders, which Spark samples, are fixed."""
    n = df.count()
    if n <= range_rows:
        return df.withColumn("__b", F.lit(0)), 1
    cut = materialize(df.repartitionByRange(math.ceil(n / range_rows), *columns(order)).withColumn("__p", F.spark_partition_id()))
    used = sorted(r["__p"] for r in cut.select("__p").distinct().collect())
    number = F.array(*[F.lit(p) for p in used])
    return cut.withColumn("__b", F.array_position(number, F.col("__p")).cast("int") - 1).drop("__p"), len(used)


def _lend(edge: DataFrame, n: int, reach: int, step: int) -> DataFrame:
    """How many rows each range takes from which others: ``reach`` in all, if there are as many on that side."""
    held = {r["__b"]: r["n"] for r in edge.groupBy("__b").agg(F.count("*").alias("n")).collect()}  # a row for each range
    rows = []
    for home in range(n):
        need, at = reach, home + step
        while need > 0 and 0 <= at < n:
            take = min(need, held.get(at, 0))
            if take:
                rows.append((home, at, take))
            need, at = need - take, at + step
    return edge.sparkSession.createDataFrame(rows, "__home int, __from int, __take int")


def with_guests(df: DataFrame, order: Sequence[Key], before: int = 0, after: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` in ranges ``__b``, each with the ``before`` rows ahead of it and the ``after`` rows behind it; ``__guest`` marks these."""
    cut, n = ranges(df, order, range_rows)
    hosts = cut.withColumn("__guest", F.lit(False))
    if n == 1:
        return hosts
    parts = [hosts]
    for reach, step, sense in ((after, 1, columns(order)), (before, -1, columns(order, True))):
        if not reach:
            continue
        edge = cut.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(*sense))).where(F.col("__k") <= reach)
        guests = edge.join(F.broadcast(_lend(edge, n, reach, step)), (F.col("__b") == F.col("__from")) & (F.col("__k") <= F.col("__take")))
        parts.append(guests.withColumn("__b", F.col("__home")).drop("__k", "__home", "__from", "__take").withColumn("__guest", F.lit(True)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tally(df: DataFrame, order: Sequence[KeyLike], most: int, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """Rows whose counts before and after a change, ``OLD`` and ``NEW``, are given in parts: put together, in ranges ``__b`` below the number returned.

    ``most`` is no less than the rows of ``df``. The order has all columns, so equal rows meet in a range; they are summed there, without a shuffle of their own."""
    names = [c for c in df.columns if c not in (OLD, NEW)]

    def summed(d: DataFrame, *by: str) -> DataFrame:
        sums = d.groupBy(*by, *[f"`{n}`" for n in names]).agg(F.sum(OLD).alias(OLD), F.sum(NEW).alias(NEW))
        return sums.where((F.col(OLD) > 0) | (F.col(NEW) > 0))

    if most <= range_rows:
        return summed(df).withColumn("__b", F.lit(0)), 1
    n = math.ceil(most / range_rows)
    spread = df.repartitionByRange(n, *columns(order_by(order))).withColumn("__b", F.spark_partition_id())
    return materialize(summed(spread, "__b")), n


def ahead(sizes: dict[int, Sequence[int]], n: int) -> list[list[int]]:
    """For each range its number and the sums over those before it; the last one has the sums over all."""
    width = len(next(iter(sizes.values()), ()))
    out = [[0] * (width + 1)]
    for b in range(n):
        out.append([b + 1, *[a + s for a, s in zip(out[-1][1:], sizes.get(b, [0] * width), strict=True)]])
    return out


def moves(df: DataFrame, order: Sequence[KeyLike], most: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """What takes the list of the rows before a change (``tally``) to that after it: ``op``, ``idx`` and ``step``.

    First rows are ``removed`` from the end on, each at its position then; then rows are ``inserted`` from the start on. Of equal rows the last ones go or come."""
    order = order_by(order)
    cut, n = tally(df, order, most, range_rows)
    gone, came = F.greatest(F.col(OLD) - F.col(NEW), F.lit(0)), F.greatest(F.col(NEW) - F.col(OLD), F.lit(0))
    counts = {"o": F.col(OLD), "n": F.col(NEW), "gone": gone, "came": came}
    sizes = {r["__b"]: r[1:] for r in cut.groupBy("__b").agg(*[F.sum(c).alias(k) for k, c in counts.items()]).collect()}
    *bases, totals = ahead(sizes, n)
    base = df.sparkSession.createDataFrame(bases, "__base int, " + ", ".join(f"__a_{k} long" for k in counts)) if sizes else None
    if base is None:
        return cut.select(*[c for c in df.columns if c not in (OLD, NEW)], F.lit("").alias("op"), F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("step"))
    w = Window.partitionBy("__b").orderBy(*columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumns({f"__r_{k}": F.sum(c).over(w) - c for k, c in counts.items()}).where(F.col(OLD) != F.col(NEW))
    placed = placed.join(F.broadcast(base), F.col("__b") == F.col("__base"))
    at = lambda k: F.col(f"__r_{k}") + F.col(f"__a_{k}") + F.col("__c")
    placed = placed.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.abs(F.col(OLD) - F.col(NEW)) - 1)))
    less = F.col(OLD) > F.col(NEW)
    return placed.select(
        *[c for c in df.columns if c not in (OLD, NEW)], F.when(less, "removed").otherwise("inserted").alias("op"),
        F.when(less, at("o") + F.col(NEW)).otherwise(at("n") + F.col(OLD)).alias("idx"),
        F.when(less, F.lit(totals[3] - 1) - at("gone")).otherwise(F.lit(totals[3]) + at("came")).alias("step"))


def changed_windows(df: DataFrame, order: Sequence[KeyLike], size: int, most: int, by: Sequence[str] = (), range_rows: int = RANGE_ROWS, unique: bool = False, weight: str = "__w") -> DataFrame:
    """Windows of ``size`` rows as structs w0, w1, ... that a change (``tally``) takes away, with weight -1, or brings, with weight 1.

    Both orders are followed in one pass, and a window that stays is never given out. ``unique`` rows are there once at most, before and after."""
    order, reach = [*order_by(by), *order_by(order)], size - 1
    cut, n = tally(df, order, most, range_rows)
    names = [c for c in df.columns if c not in (OLD, NEW)]
    if not unique:
        cut = cut.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(OLD, NEW))))
        cut = cut.withColumns({OLD: (F.col("__i") <= F.col(OLD)).cast("long"), NEW: (F.col("__i") <= F.col(NEW)).cast("long")}).drop("__i")
    rows = cut.withColumn("__guest", F.lit(False))
    if n > 1 and reach:
        for side, other in ((OLD, NEW), (NEW, OLD)):
            edge = cut.where(F.col(side) > 0).withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(*columns(order)))).where(F.col("__k") <= reach)
            edge = materialize(edge.withColumn(other, F.lit(0).cast("long")))
            guests = edge.join(F.broadcast(_lend(edge, n, reach, 1)), (F.col("__b") == F.col("__from")) & (F.col("__k") <= F.col("__take")))
            rows = rows.unionByName(guests.withColumn("__b", F.col("__home")).drop("__k", "__home", "__from", "__take").withColumn("__guest", F.lit(True)))
    w = Window.partitionBy("__b", *by).orderBy(*columns(order))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = rows.withColumns({"__o0": F.when(F.col(OLD) > 0, row), "__n0": F.when(F.col(NEW) > 0, row)})
    found = rows.withColumns({f"__{s}{k}": F.expr(f"lead(__{s}0, {k}) ignore nulls").over(w) for s in "on" for k in range(1, size)}).where(~F.col("__guest"))
    was, now = (F.col(f"__{s}0").isNotNull() & F.col(f"__{s}{reach}").isNotNull() for s in "on")
    stays = was & now
    for k in range(1, size):
        stays = stays & F.col(f"__o{k}").eqNullSafe(F.col(f"__n{k}"))
    one = lambda s, there, sign: F.when(there, F.struct(*[F.col(f"__{s}{k}").alias(f"w{k}") for k in range(size)], F.lit(sign).cast("long").alias(weight)))
    return found.where((was | now) & ~stays).select(F.explode(F.array_compact(F.array(one("o", was, -1), one("n", now, 1)))).alias("x")).select("x.*")


def entries(df: DataFrame, order: Sequence[KeyLike], tiebreak: Sequence[str] = (), idx: str = "idx", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with its position from 0 in the order; rows of equal keys are told apart by ``tiebreak``."""
    order = order_by(order, tiebreak)
    cut, n = ranges(df, order, range_rows)
    if n == 1:
        return df.withColumn(idx, F.row_number().over(Window.orderBy(*columns(order))).cast("long") - 1)
    sizes = {r["__b"]: r["n"] for r in cut.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    ahead, rows = 0, []
    for b in range(n):
        rows.append((b, ahead))
        ahead += sizes.get(b, 0)
    base = df.sparkSession.createDataFrame(rows, "__base int, __ahead long")
    local = F.row_number().over(Window.partitionBy("__b").orderBy(*columns(order))).cast("long") - 1
    return (cut.withColumn(idx, local).join(F.broadcast(base), F.col("__b") == F.col("__base"))
            .withColumn(idx, F.col(idx) + F.col("__ahead")).drop("__b", "__base", "__ahead"))


def leads(df: DataFrame, order: Sequence[KeyLike], size: int, tiebreak: Sequence[str] = (), by: Sequence[str] = (), range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """Windows of ``size`` consecutive rows as structs w0, w1, ...; for ``by`` also these columns, and windows within their groups only.

    Groups of a table of at most ``range_rows`` rows (or of any, if that is None) go to a task each; beyond, a group of any size is spread over ranges."""
    if size < 1:
        raise ValueError("a window has one row at least")
    order = order_by(order, tiebreak)
    row = F.struct(*df.columns)
    if by and (range_rows is None or df.count() <= range_rows):
        w = Window.partitionBy(*by).orderBy(*columns(order))
        out = df.select(*by, row.alias("w0"), *[F.lead(row, k).over(w).alias(f"w{k}") for k in range(1, size)])
        return out.where(F.col(f"w{size - 1}").isNotNull())
    order = [*order_by(by), *order]
    held = with_guests(df, order, after=size - 1, range_rows=RANGE_ROWS if range_rows is None else range_rows)
    w = Window.partitionBy("__b").orderBy(*columns(order))
    out = held.select(*by, F.col("__guest"), row.alias("w0"), *[F.lead(row, k).over(w).alias(f"w{k}") for k in range(1, size)])
    out = out.where(~F.col("__guest") & F.col(f"w{size - 1}").isNotNull()).drop("__guest")
    for c in by:  # a window that crosses into the next group is none
        out = out.where(F.col(f"w{size - 1}").getField(c).eqNullSafe(F.col("w0").getField(c)))
    return out


def pairwise(df: DataFrame, order: Sequence[KeyLike], tiebreak: Sequence[str] = (), by: Sequence[str] = (), range_rows: int = RANGE_ROWS, unique: bool = False) -> DataFrame:
    """Pairs of neighbours in the order as structs left and right; equal pairs once. Rows known to be ``unique`` have unique pairs, so nothing is shuffled for that."""
    found = leads(df, order, 2, tiebreak, by, range_rows).withColumnsRenamed({"w0": "left", "w1": "right"})
    return found if unique else found.distinct()


def window(df: DataFrame, order: Sequence[KeyLike], size: int, tiebreak: Sequence[str] = (), by: Sequence[str] = (), range_rows: int = RANGE_ROWS, unique: bool = False) -> DataFrame:
    """Sliding windows of exactly ``size`` rows as an array of structs; equal windows once, ``unique`` as in pairwise."""
    found = leads(df, order, size, tiebreak, by, range_rows)
    found = found.select(*by, F.array(*[f"w{k}" for k in range(size)]).alias("window"))
    return found if unique else found.distinct()


def rolling(df: DataFrame, order: Sequence[KeyLike], size: int, aggregates: dict[str, Column], tiebreak: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with aggregates over each row and the ``size`` - 1 before it."""
    order = order_by(order, tiebreak)
    held = with_guests(df, order, before=size - 1, range_rows=range_rows)
    w = Window.partitionBy("__b").orderBy(*columns(order)).rowsBetween(1 - size, 0)
    return held.withColumns({k: a.over(w) for k, a in aggregates.items()}).where(~F.col("__guest")).drop("__b", "__guest")
