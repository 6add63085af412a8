"""Weighted sets that are computed: few rows are held by the driver, more are a table in the shared folder.

A ``Delta`` never changes, nor does a ``Store``: adding to a store gives a new one that shares the old parts. So an operator first
computes all that follows from a change and then moves on by plain assignments; if a job fails in between, nothing has happened.

What the driver holds is a local relation to Spark, whose filters and projections the optimizer evaluates without a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce as fold
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.conversion import LocalDataToArrowConversion
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BooleanType, ByteType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

from ..operators.zset import W, consolidate
from ..sources.storage import materialize

#: What the driver holds of one weighted set at most: rows, and bytes by the optimizer's estimate.
HELD_ROWS, HELD_BYTES = 20_000, 8 << 20
#: Held deltas, and written parts, that a store has before it puts some together; keys that are looked up by a list of values.
RECENT, PARTS, LISTED = 16, 6, 200
#: Written tables of more rows are sorted by the key, so that a look-up reads few pages of them; smaller ones are read whole.
SORT_ROWS = 500_000

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
_ORDERED = (*_WHOLE, BooleanType, DateType, DecimalType, StringType, TimestampType, TimestampNTZType)


_TOKENS = count(1)


def canon(value: Any) -> Any:
    """A value by which equal values, as Spark groups them, are equal and can be a key: NaN equals itself."""
    if isinstance(value, float):
        return "NaN" if value != value else value
    if isinstance(value, list | tuple):
        return tuple(map(canon, value))
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, dict):
        return frozenset((canon(k), canon(v)) for k, v in value.items())
    return value


def _hashable(kind: DataType) -> bool:
    return all(_hashable(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else isinstance(kind, _ORDERED)


def key_maker(types: Iterable[DataType]) -> Callable[[tuple], tuple]:
    if all(map(_hashable, types)):
        return tuple
    return lambda values: tuple(map(canon, values))


def weighted(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(W, LongType())])


def local(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """Rows as a local relation, which needs no job to be filtered, projected or collected."""
    loose = StructType([StructField(f.name, f.dataType) for f in schema.fields])
    table = LocalDataToArrowConversion.convert(list(rows), loose, False) if rows else to_arrow_schema(loose).empty_table()
    return spark.createDataFrame(table, loose)


def literal(value: Any, kind: DataType) -> Column:
    """A value that was read from a column of this type. Times go as text, so no zone of the driver plays a part."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, StructType):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def estimate(df: DataFrame) -> int:
    """Bytes of a plan's result, as the optimizer estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Delta:
    """A weighted set: ``n`` rows, each payload once, held (``rows``: payload, then weight) or in a table."""

    def __init__(self, spark: SparkSession, schema: StructType, rows: list[tuple] | None = None, table: DataFrame | None = None, n: int = 0, order: Sequence[str] = ()):
        self.spark, self.schema, self.rows, self.table = spark, schema, rows, table  # of held rows a plan over a local relation
        self.n = n if rows is None else len(rows)
        self.order = tuple(order)  # columns that the table's files are sorted by
        self._keys: dict[int, list[tuple]] = {}

    def frame(self) -> DataFrame:
        if self.table is None:
            self.table = local(self.spark, self.rows, weighted(self.schema))
        return self.table

    def values(self, *columns: Column) -> list[tuple]:
        """Held rows only: these columns of each, and its weight last."""
        return [tuple(r) for r in self.frame().select(*[c.alias(f"v{k}") for k, c in enumerate(columns)], W).collect()]


def summed(rows: Iterable[tuple], schema: StructType) -> list[tuple]:
    """One row for each payload, weights added, zeros gone."""
    key, held = key_maker(f.dataType for f in schema.fields), {}
    for r in rows:
        k = key(r[:-1])
        old = held.get(k)
        held[k] = r if old is None else (*old[:-1], old[-1] + r[-1])
    return [tuple(r) for r in held.values() if r[-1]]


def hold(df: DataFrame, schema: StructType, few: bool = False, order: Sequence[str] = (), single: bool = False, many: bool = False) -> Delta:
    """A plan of payload and weight, computed. With ``few`` it follows from held rows; so probably does one that the optimizer takes for small: it is
    collected, up to a limit. All others, and those known to be ``many``, are written, once, and come to the driver only if they turn out to be small.
    ``single`` says that no payload is there twice."""
    spark, df = df.sparkSession, df.select(*schema.names, W)
    if HELD_ROWS and (few or not many and estimate(df) <= HELD_BYTES):
        found = df.limit(HELD_ROWS + 1).collect()
        if len(found) <= HELD_ROWS:
            return Delta(spark, schema, summed(found, schema))
    df = df if single else consolidate(df)
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = materialize(df)
    n = table.count()
    if n <= HELD_ROWS and estimate(table) <= HELD_BYTES:
        return Delta(spark, schema, [tuple(r) for r in table.collect()])
    return Delta(spark, schema, table=table, n=n, order=order)


def row_wise(df: DataFrame, of: Delta, schema: StructType, single: bool = False) -> Delta:
    """What a projection or filter makes of held rows: payload and weight in this order. With ``single`` each payload is there once, and the plan is kept for what follows."""
    rows = [tuple(r) for r in df.collect()]
    return Delta(of.spark, schema, rows, table=df) if single else Delta(of.spark, schema, summed(rows, schema))


def merged(deltas: Sequence[Delta]) -> Delta | None:
    """The sum of several deltas."""
    deltas = [d for d in deltas if d.n]
    if len(deltas) < 2:
        return deltas[0] if deltas else None
    first = deltas[0]
    if all(d.rows is not None for d in deltas) and sum(d.n for d in deltas) <= HELD_ROWS:
        return Delta(first.spark, first.schema, summed((r for d in deltas for r in d.rows), first.schema))
    return hold(fold(DataFrame.unionByName, [d.frame() for d in deltas]), first.schema)


class Part:
    """A written table of a store, with the key's columns, and a Bloom filter of its keys (8 MB at most), made when it is first asked."""

    def __init__(self, table: DataFrame, n: int):
        self.table, self.n = table, n
        self._filter: Any = None

    def may_hold(self, keys: list[tuple], columns: list[str], types: list[DataType]) -> bool:
        """False if surely none of these keys is here."""
        if not self.n:
            return False
        whole = len(types) == 1 and isinstance(types[0], _WHOLE)
        if self._filter is None:
            hashed = self.table.select((F.coalesce(F.col(columns[0]).cast("long"), F.lit(0)) if whole else F.xxhash64(*columns)).alias("h"))
            self._filter = hashed._jdf.stat().bloomFilter("h", max(self.n, 1000), 0.01)
        if whole:
            wanted = [k[0] or 0 for k in keys]
        else:
            asked = local(self.table.sparkSession, keys, StructType([StructField(f"s{i}", t) for i, t in enumerate(types)]))
            wanted = [r[0] for r in asked.select(F.xxhash64(*asked.columns)).collect()]
        return any(self._filter.mightContainLong(v) for v in wanted)


class Store:
    """A weighted set that grows by deltas and finds rows by key: columns, or expressions of columns.

    Large parts are sorted by the key, so a look-up by values reads the pages that can hold them. Parts of like size are put together, so each row is
    written again about as often as the logarithm of the number of deltas.
    """

    def __init__(self, spark: SparkSession, schema: StructType, key: Sequence[str | Column], parts: tuple[Part, ...] = (), recent: tuple[Delta, ...] = (), sought: bool = True):
        self.spark, self.schema, self.key, self.parts, self.recent = spark, schema, list(key), parts, recent
        self.sought = sought  # whether rows are looked up by key: else written deltas are parts as they are
        self.token = next(_TOKENS)
        self.plain = all(isinstance(k, str) for k in key)
        self.columns = list(key) if self.plain else [f"__k{i}" for i in range(len(key))]
        empty = spark.createDataFrame([], weighted(schema))
        self.types = [f.dataType for f in empty.select(*[k if isinstance(k, str) else k.alias(c) for k, c in zip(self.key, self.columns, strict=True)]).schema.fields] if key else []
        self.key_of = key_maker(self.types)

    @property
    def rows(self) -> int:
        """No fewer than there are."""
        return sum(p.n for p in self.parts) + sum(d.n for d in self.recent)

    @property
    def held(self) -> bool:
        return not self.parts

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df if self.plain else df.withColumns(dict(zip(self.columns, self.key, strict=True)))

    def _part(self, df: DataFrame, n: int, written: bool = False) -> Part:
        """A table, written anew, and sorted if it is large, unless a small one is written already."""
        if n <= SORT_ROWS or not self.sought:
            return Part(self._keyed(df), n) if written else Part(self._keyed(table := materialize(df)), table.count())
        able = [c for c, t in zip(self.columns, self.types, strict=True) if isinstance(t, _ORDERED)]
        keyed = self._keyed(df)
        if able:
            keyed = keyed.repartitionByRange(*able).sortWithinPartitions(*able)
        table = materialize(keyed, **{"parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "5000"})
        return Part(table, table.count())

    def added(self, delta: Delta | None) -> Store:
        """This store and a delta; what has to be written is written now."""
        if delta is None or not delta.n:
            return self
        parts, recent = list(self.parts), [*self.recent]
        if delta.rows is not None:
            recent.append(delta)
            if len(recent) > RECENT or sum(d.n for d in recent) > HELD_ROWS:
                one = Delta(self.spark, self.schema, summed((r for d in recent for r in d.rows), self.schema))
                recent = [one] if one.n else []
                if one.n > HELD_ROWS:
                    parts.append(self._part(one.frame(), one.n))
                    recent = []
        elif self.plain and delta.order == tuple(self.columns):
            parts.append(Part(delta.frame(), delta.n))
        else:
            parts.append(self._part(delta.frame(), delta.n, written=True))
        if len(parts) > PARTS:
            parts.sort(key=lambda p: -p.n)
            few = parts[PARTS // 2:]
            parts[PARTS // 2:] = [self._part(consolidate(fold(DataFrame.unionByName, [p.table.select(*self.schema.names, W) for p in few])), sum(p.n for p in few))]
        return self._with(tuple(parts), tuple(recent))

    def _with(self, parts: tuple, recent: tuple) -> Store:
        out = object.__new__(Store)
        out.__dict__.update(self.__dict__, parts=parts, recent=recent)
        return out

    def raw(self) -> DataFrame:
        """All rows, a payload in several of them where deltas have changed it, with the key's columns."""
        frames = [p.table for p in self.parts] + [self._keyed(d.frame()) for d in self.recent]
        return fold(DataFrame.unionByName, frames) if frames else self._keyed(local(self.spark, [], weighted(self.schema)))

    def all_held(self) -> list[tuple]:
        return summed((r for d in self.recent for r in d.rows), self.schema)

    def frame(self) -> DataFrame:
        """The weighted set."""
        names = [*self.schema.names, W]
        if self.held:
            return self.recent[0].frame() if len(self.recent) == 1 else local(self.spark, self.all_held(), weighted(self.schema))
        raw = self.raw().select(*names)
        return raw if len(self.parts) == 1 and not self.recent else consolidate(raw)

    def snapshot(self) -> Delta | None:
        """All of it as one delta."""
        if self.held:
            rows = self.all_held()
            return Delta(self.spark, self.schema, rows) if rows else None
        return Delta(self.spark, self.schema, table=self.frame(), n=self.rows)

    def keys_of(self, delta: Delta) -> list[tuple]:
        """The key of each held row."""
        if self.token not in delta._keys:
            if self.plain:
                at = [self.schema.names.index(c) for c in self.columns]
                found = [self.key_of(tuple(r[i] for i in at)) for r in delta.rows]
            else:
                found = [self.key_of(v[:-1]) for v in delta.values(*self.key)]
            delta._keys[self.token] = found
        return delta._keys[self.token]

    def find(self, values: Iterable[tuple]) -> dict[tuple, list[tuple]] | None:
        """Rows (payload, weight) by key for these keys, in one job at most; None if they are too many for the driver."""
        raw = list(values)
        wanted = {self.key_of(v): v for v in raw}
        got = [(k, r) for d in self.recent for k, r in zip(self.keys_of(d), d.rows, strict=True) if k in wanted]
        names, keys = self.schema.names, list(wanted.values())
        parts = [p for p in self.parts if keys and (len(keys) > LISTED or p.may_hold(keys, self.columns, self.types))]
        if parts:
            table = fold(DataFrame.unionByName, [p.table for p in parts])
            for k, (c, kind) in enumerate(zip(self.columns, self.types, strict=True)):
                if isinstance(kind, _ORDERED):
                    own = {v[k] for v in keys}
                    some = sorted(v for v in own if v is not None)
                    held = F.lit(False) if not some else F.col(c).isin([literal(v, kind) for v in some]) if len(some) <= LISTED else F.col(c).between(literal(some[0], kind), literal(some[-1], kind))
                    table = table.where(held | F.col(c).isNull() if None in own else held)
            if len(keys) > LISTED:
                sought = local(self.spark, keys, StructType([StructField(f"__s{i}", t) for i, t in enumerate(self.types)]))
                table = table.join(F.broadcast(sought), fold(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(self.columns)]), "left_semi")
            found = table.select(*names, W, *[F.col(c).alias(f"__f{i}") for i, c in enumerate(self.columns)]).limit(HELD_ROWS + 1).collect()
            if len(found) > HELD_ROWS:
                return None
            width = len(names) + 1
            got += [(k, tuple(r[:width])) for r in found if (k := self.key_of(tuple(r[width:]))) in wanted]
        out: dict[tuple, list[tuple]] = {}
        for k, r in got:
            out.setdefault(k, []).append(r)
        return {k: s for k, rows in out.items() if (s := rows if len(rows) == 1 and rows[0][-1] else summed(rows, self.schema))}

    def touched(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in ``keys`` (columns as ``columns``); only these are shuffled to be put together."""
        renamed = keys.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(self.columns)]).distinct()
        on = fold(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(self.columns)])
        return consolidate(self.raw().join(renamed, on, "left_semi").select(*self.schema.names, W))

    def keys_in(self, df: DataFrame) -> DataFrame:
        """The key's columns of a frame of this schema."""
        return df.select(*[(F.col(k) if isinstance(k, str) else k).alias(c) for k, c in zip(self.key, self.columns, strict=True)])

