"""Collections that change, in a runtime's graph: each operator turns the deltas before it into a delta of its own.

A source gathers inserts and deletes until something is read, then hands over what they change as one
consolidated delta. Every operator has a version cell; reading it takes in the deltas its inputs
have logged since, and an empty result leaves the version as it was, so what depends on it is not
computed.

A delta of few rows is worked out on the driver, against the rows of a state that its keys find; a large one by one Spark plan. Either way all is computed
and kept first; only then do read offsets, states and logs move, together, by plain assignments. So a job that fails leaves everything as it was, and the
next read tries again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce as fold
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StructType

from ..operators import ordered, relational
from ..operators.zset import W, consolidate, elements, expand, weigh
from ..sources.storage import materialize
from . import deltas
from .deltas import Delta, Store, hold, key_maker, literal, local, merged, row_wise, summed
from .exact import Sum, of_delta
from .graph import Cell, Runtime

#: Rows of a state up to which its windows are made again as a whole: finding the stretch would cost more jobs than it saves.
SMALL_ROWS = 20_000
#: A delta of over a part in so many of a state concerns most of its order or its groups: all is read, without looking for the part.
NEAR = 8
#: Keys that ``Grouped.keys`` gives as a list at most.
MOST_KEYS = 1_000_000

Move = Callable[[], None]


def as_col(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


class Reader:
    """How far a reader of a log has come; None: it begins with all that is there."""

    def __init__(self) -> None:
        self.at: int | None = None


class Collection:
    """A collection in a runtime. ``is_set`` tells whether equal rows count once."""

    def __init__(self, runtime: Runtime, schema: StructType, is_set: bool, inputs: Sequence[Collection] = (), label: str | None = None, key: Sequence[str] | None = None):
        self.runtime, self.is_set, self.inputs = runtime, is_set, list(inputs)
        self.schema = StructType([f for f in schema.fields if f.name != W])
        self.empty = local(runtime.spark, [], deltas.weighted(self.schema))
        self.store = Store(runtime.spark, self.schema, key or self.schema.names, sought=not inputs)  # only a source looks for rows of its own
        #: Deltas from number ``first`` on; those that all readers have taken in are dropped.
        self.log: list[Delta] = []
        self.first = 0
        self.readers: list[Reader] = []
        self.version = 0
        self._own = [c.reader() for c in self.inputs]
        self.version_node: Cell = (runtime.create_query(self._advance, label or type(self).__name__) if inputs
                                   else runtime.create_input(0, label or type(self).__name__))

    # -- advancing

    def reader(self) -> Reader:
        self.readers.append(Reader())
        return self.readers[-1]

    def unread(self, reader: Reader) -> tuple[Delta | None, int]:
        """What a reader has not taken in, as one delta, and how far that goes. Nothing moves."""
        end = self.first + len(self.log)
        if reader.at is None:
            return self.store.snapshot(), end
        return merged(self.log[reader.at - self.first:]), end

    def forget(self) -> None:
        """Drop what all readers have taken in."""
        end = self.first + len(self.log)
        done = min((end if r.at is None else r.at for r in self.readers), default=end)
        del self.log[:done - self.first]
        self.first = done

    def _advance(self, rt: Runtime) -> int:
        for c in self.inputs:
            rt.get(c.version_node)
        new = [c.unread(r) for c, r in zip(self.inputs, self._own, strict=True)]
        out, store, move = None, self.store, None
        if any(d is not None for d, _ in new):
            out, move = self._change(*[d for d, _ in new])
            store = self.store.added(out)
        # all is computed and kept: from here on nothing can fail
        for r, (_, end) in zip(self._own, new, strict=True):
            r.at = end
        if move:
            move()
        self._take(out, store)
        for c in self.inputs:
            c.forget()
        return self.version

    def _change(self, *new: Delta | None) -> tuple[Delta | None, Move | None]:
        """The delta that follows from those of the inputs, and what to do once it is taken."""
        raise NotImplementedError

    def _take(self, delta: Delta | None, store: Store) -> bool:
        self.store = store
        if delta is None or not delta.n:
            return False
        self.log.append(delta)
        self.version += 1
        return True

    # -- reading

    def state(self) -> DataFrame:
        """The weighted set now."""
        self.runtime.get(self.version_node)
        return self.store.frame()

    def rows(self) -> DataFrame:
        """All rows, a bag's as often as they are there."""
        return expand(self.state())

    def elements(self) -> DataFrame:
        """The different rows."""
        return self.state().drop(W) if self.is_set else elements(self.state())

    # -- operators

    def filter(self, predicate: relational.Predicate, errors: str = "raise") -> Collection:
        return Filter(self, predicate, errors)

    def map(self, *columns: Column | str, deterministic: bool = True) -> Collection:
        """Images as columns. Where these are not deterministic, a row's image is kept and taken back as it was."""
        return Map(self, columns, deterministic)

    def join(self, right: Collection, left_key: Column | str, right_key: Column | str) -> Collection:
        """Pairs of equal keys, null meeting null, as structs ``left`` and ``right``."""
        return Join(self, right, left_key, right_key)

    def group_by(self, key: Column | str) -> Grouped:
        return Grouped(self, key)

    def sort_by_key(self, *keys: ordered.KeyLike) -> Sorted:
        return Sorted(self, keys)

    def count(self, label: str | None = None) -> Cell:
        rows = lambda d: sum(r[-1] for r in d.rows) if d.rows is not None else d.frame().agg(F.sum(W)).first()[0]
        return self._cell(0, lambda n, d: n + rows(d), lambda n: n, label or "count")

    def sum(self, c: Column | str, label: str | None = None) -> Cell:
        """0 over nothing; nulls count as nothing. Exact, whatever comes and goes: doubles are rounded once, in the result."""
        return self._running(as_col(c), lambda s, kind: s.total(kind), label or "sum")

    def avg(self, c: Column | str, label: str | None = None) -> Cell:
        """None over nothing; exact as ``sum`` is."""
        return self._running(as_col(c), lambda s, kind: s.mean(kind), label or "avg")

    def _cell(self, start: Any, step: Callable[[Any, Delta], Any], result: Callable[[Any], Any], label: str) -> Cell:
        """A value that each delta takes further."""
        reader, held = self.reader(), [start]

        def compute(rt: Runtime) -> Any:
            rt.get(self.version_node)
            new, end = self.unread(reader)
            value = held[0] if new is None else step(held[0], new)
            held[0], reader.at = value, end
            self.forget()
            return result(value)

        return self.runtime.create_query(compute, label)

    def _running(self, c: Column, result: Callable[[Sum, DataType], Any], label: str) -> Cell:
        kind = self.empty.select(c.alias("v")).schema[0].dataType
        return self._cell(Sum(), lambda so_far, d: so_far + of_delta(d, c, kind), lambda s: result(s, kind), label)

    def max(self, c: Column | str, label: str | None = None) -> Cell:
        return self._extreme(c, F.max, 1, label or "max")

    def min(self, c: Column | str, label: str | None = None) -> Cell:
        return self._extreme(c, F.min, -1, label or "min")

    def _extreme(self, c: Column | str, pick: Callable[[Column], Column], sign: int, label: str) -> Cell:
        """None over nothing. Inserts need the delta only; a delete of the extreme value reads the state again. NaN is above all numbers, as in Spark's order."""
        c = as_col(c)
        place = lambda v: (v != v, v if v == v else 0)
        beyond = lambda a, b: (place(a) > place(b)) if sign > 0 else (place(a) < place(b))

        def step(best: Any, d: Delta) -> Any:
            row = d.frame().agg(pick(F.when(F.col(W) > 0, c)).alias("added"), pick(F.when(F.col(W) < 0, c)).alias("gone")).first() if d.rows is None else None
            if row is None:
                values = [v for v in d.values(c) if v[0] is not None]
                far = lambda vs: (max(vs, key=place) if sign > 0 else min(vs, key=place)) if vs else None
                added, gone = far([v for v, w in values if w > 0]), far([v for v, w in values if w < 0])
            else:
                added, gone = row["added"], row["gone"]
            if gone is not None and (best is None or not beyond(best, gone)):
                return self.store.frame().agg(pick(c).alias("m")).first()["m"]
            return added if added is not None and (best is None or beyond(added, best)) else best

        return self._cell(None, step, lambda v: v, label)

    def reduce(self, *aggregates: Column, label: str | None = None) -> Cell:
        """Any Spark aggregates over all rows, computed again when the collection has changed: a scalar, or a Row of several."""
        def compute(rt: Runtime) -> Any:
            rt.get(self.version_node)
            row = expand(self.store.frame()).agg(*aggregates).first()
            return row[0] if len(aggregates) == 1 else row

        return self.runtime.create_query(compute, label or "reduce")

    def fold(self, f: Callable[[list[dict]], Any], label: str | None = None) -> Cell:
        """A Python function of all rows as dicts, in no order; for what no aggregate expresses, on collections that fit the driver."""
        def compute(rt: Runtime) -> Any:
            rt.get(self.version_node)
            return f([r.asDict() for r in expand(self.store.frame()).toLocalIterator()])

        return self.runtime.create_query(compute, label or "fold")


class Source(Collection):
    """A set that is changed from outside, by row or by DataFrame. With ``key`` rows are the same if these columns are."""

    def __init__(self, runtime: Runtime, schema: StructType | str, key: Sequence[str] | None = None, label: str | None = None):
        if isinstance(schema, str):
            schema = runtime.spark.createDataFrame([], schema).schema
        super().__init__(runtime, schema, True, label=label, key=key)
        self.key = list(key) if key else self.schema.names
        self._ops: list[tuple] = []  # rows, whether each is an insert
        runtime.before_read.append(self._hand_over)

    def _op(self, row: Any, present: bool) -> None:
        with self.runtime._lock:
            values = tuple(row[n] for n in self.schema.names) if isinstance(row, dict) else tuple(row) if isinstance(row, tuple | list) else (row,)
            if len(values) != len(self.schema.names):
                raise ValueError("a row has a value for each column")
            self._ops.append((values, present))
            self.runtime.waiting = True

    def insert(self, row: Any) -> None:
        self._op(row, True)

    def delete(self, row: Any) -> None:
        self._op(row, False)

    def discard_pending(self) -> int:
        """Forget the rows inserted and deleted since the last read; how many they were."""
        with self.runtime._lock:
            n, self._ops = len(self._ops), []
            return n

    def apply(self, ops: DataFrame, present: Column | str, seq: Column | str) -> None:
        """A log of ops, later than all before: rows of the schema, whether each is an insert, and their order.

        If it fails, nothing of it is taken in."""
        with self.runtime._lock:
            self._hand_over()
            self._accept(*self._effective(self._log(ops, present, seq)))

    def load(self, rows: DataFrame) -> None:
        """Insert all rows."""
        with self.runtime._lock:
            self._hand_over()
            self._accept(*self._effective(self._log(rows, F.lit(True), F.lit(0)), only=True))

    def remove(self, rows: DataFrame) -> None:
        """Delete all rows, of which only the key counts."""
        with self.runtime._lock:
            self._hand_over()
            self._accept(*self._effective(self._log(rows, F.lit(False), F.lit(0)), only=False))

    def _log(self, ops: DataFrame, present: Column | str, seq: Column | str) -> DataFrame:
        return ops.select(*self.schema.names, as_col(present).cast("boolean").alias("__p"), as_col(seq).alias("__seq"))

    def prepare(self, ops: DataFrame, present: Column | str, seq: Column | str) -> tuple[Delta, Move]:
        """What rows changed by hand and then a log of ops change, together, and how to take it in. Until then nothing has happened."""
        with self.runtime._lock:
            first, store = self._by_row(self._ops)
            taken = len(self._ops)
            second, store = self._effective(self._log(ops, present, seq), store=store)
            both = merged([d for d in (first, second) if d is not None]) or Delta(self.runtime.spark, self.schema, [])

            def move() -> None:
                with self.runtime._lock:
                    del self._ops[:taken]
                    self._accept(both, store)

            return both, move

    def _accept(self, delta: Delta | None, store: Store) -> None:
        if self._take(delta, store):
            self.runtime.set(self.version_node, self.version)
        self.forget()

    def _hand_over(self) -> None:
        """What the rows inserted and deleted since change."""
        if self.runtime._stack or not self._ops:
            return
        taken = len(self._ops)
        delta, store = self._by_row(self._ops)
        del self._ops[:taken]
        self._accept(delta, store)

    def _by_row(self, ops: list[tuple]) -> tuple[Delta | None, Store]:
        if not ops:
            return None, self.store
        if len(ops) <= deltas.HELD_ROWS and (out := self._of_rows([(values, present, n) for n, (values, present) in enumerate(ops)], self.store)):
            return out
        rows = [(*values, present, n) for n, (values, present) in enumerate(ops)]
        schema = StructType([*self.schema.fields]).add("__p", "boolean").add("__seq", "long")
        return self._effective(self.runtime.spark.createDataFrame(rows, schema))

    def _of_rows(self, ops: list[tuple], store: Store) -> tuple[Delta | None, Store] | None:
        """The last op of each key against what is there: an insert of what is present and a delete of what is absent change nothing.

        A first insert gives the row that is present until the next delete; so of each key the first insert after its last delete counts. Inserts of the same
        place in the order are told apart by their text. None if the driver cannot hold it."""
        at = [self.schema.names.index(c) for c in self.key]
        gone: dict[tuple, Any] = {}
        new: dict[tuple, tuple] = {}
        raw: dict[tuple, tuple] = {}
        for values, present, seq in ops:
            k = store.key_of(v := tuple(values[i] for i in at))
            raw.setdefault(k, v)
            if not present and (k not in gone or seq > gone[k]):
                gone[k] = seq
        for values, present, seq in ops:
            k = store.key_of(tuple(values[i] for i in at))
            if present and (k not in gone or seq > gone[k]) and (k not in new or (seq, repr(values)) < (new[k][0], repr(new[k][1]))):
                new[k] = seq, values
        old = store.find(raw.values())
        if old is None:
            return None
        rows = []
        for k in raw:
            was = old.get(k, [])
            if k in gone:
                rows += [(*r[:-1], -1) for r in was]
            if k in new and (k in gone or not was):
                rows.append((*new[k][1], 1))
        delta = Delta(self.runtime.spark, self.schema, summed(rows, self.schema))
        return (delta if delta.n else None), store.added(delta)

    def _effective(self, ops: DataFrame, only: bool | None = None, store: Store | None = None) -> tuple[Delta | None, Store]:
        """What a log of ops changes; ``only`` tells that all are inserts, or deletes."""
        store, names = self.store if store is None else store, self.schema.names
        size = deltas.estimate(ops)
        if deltas.HELD_ROWS and size <= deltas.HELD_BYTES:
            found = ops.limit(deltas.HELD_ROWS + 1).collect()
            if len(found) <= deltas.HELD_ROWS and (out := self._of_rows([(tuple(r[:-2]), bool(r["__p"]), r["__seq"]) for r in found], store)):
                return out
        key = lambda c: F.struct(*self.key).alias(c)
        seen = ops.select(F.struct(*names).alias("__r"), key("__key"), "__p", "__seq")
        if only is False:
            out = store.touched(ops.select(*self.key)).withColumn(W, F.lit(-1).cast("long"))
        else:
            first = F.min(F.struct("__seq", "__r"))
            if only:
                last = seen.groupBy("__key").agg(first["__r"].alias("__new")).withColumns({"__ins": F.lit(True), "__del": F.lit(False)})
            else:
                seen = seen.withColumn("__gone", F.max(F.when(~F.col("__p"), F.col("__seq"))).over(Window.partitionBy("__key")))
                after = F.col("__p") & (F.col("__gone").isNull() | (F.col("__seq") > F.col("__gone")))
                last = seen.groupBy("__key").agg(F.min(F.when(after, F.struct("__seq", "__r")))["__r"].alias("__new"), F.max(after).alias("__ins"), F.max(F.col("__gone").isNotNull()).alias("__del"))
                last = materialize(last)
            if store.rows:
                keys = last.select("__key.*") if not only else ops.select(*self.key)
                old = store.touched(keys).select(F.struct(*names).alias("__old"), key("__okey"))
                last = last.join(old, F.col("__key") == F.col("__okey"), "left")
            else:
                last = last.withColumn("__old", F.lit(None).cast(self.schema))
            signs = F.array(F.when(F.col("__old").isNotNull() & F.col("__del"), F.struct(F.col("__old").alias("r"), F.lit(-1).cast("long").alias("w"))),
                            F.when(F.col("__ins") & (F.col("__old").isNull() | F.col("__del")), F.struct(F.col("__new").alias("r"), F.lit(1).cast("long").alias("w"))))
            out = last.select(F.explode(F.array_compact(signs)).alias("x")).select("x.r.*", F.col("x.w").alias(W))
        sort = size > 4 * deltas.HELD_BYTES and all(isinstance(t, deltas._ORDERED) for t in store.types)
        delta = hold(out, self.schema, order=self.key if sort else (), single=only is not None, many=True)
        return (delta if delta.n else None), store.added(delta)


class Filter(Collection):
    def __init__(self, upstream: Collection, predicate: relational.Predicate, errors: str):
        super().__init__(upstream.runtime, upstream.schema, True, [upstream])
        self.predicate, self.errors = predicate, errors
        self.weights = None if upstream.is_set else Store(upstream.runtime.spark, self.schema, self.schema.names)

    def _change(self, d: Delta) -> tuple[Delta | None, Move | None]:
        frame, plain = d.frame(), isinstance(self.predicate, Column | str)
        passed = frame.where(relational.condition(frame if plain else frame.select(*self.schema.names), self.predicate, self.errors))
        if d.rows is not None and plain:
            kept = row_wise(passed, d, self.schema, single=True)
        elif d.rows is None and plain and passed._jdf.queryExecution().analyzed().deterministic():
            kept = Delta(d.spark, self.schema, table=passed, n=passed.count(), order=d.order)  # no copy of what is written already
            if kept.n <= deltas.HELD_ROWS:
                kept = hold(passed, self.schema, few=True)
        else:
            kept = hold(passed, self.schema, few=d.rows is not None, single=True)
        if self.weights is None or not kept.n:
            return kept, None
        return as_set(self, kept)


def as_set(owner: Any, d: Delta) -> tuple[Delta, Move]:
    """A bag's delta as its set's, by the weights (``owner.weights``) of the rows it touches; how the weights take it in."""
    weights: Store = owner.weights
    out = None
    if d.rows is not None:
        old = weights.find(r[:-1] for r in d.rows)
        if old is not None:
            rows = []
            for r, k in zip(d.rows, weights.keys_of(d), strict=True):
                was = sum(o[-1] for o in old.get(k, []))
                if change := (was + r[-1] > 0) - (was > 0):
                    rows.append((*r[:-1], change))
            out = Delta(d.spark, d.schema, rows)
    if out is None:
        was = weights.touched(d.frame().select(*d.schema.names)).withColumn("__o", F.col(W)) if weights.rows else None
        both = d.frame().select(*d.schema.names, W, F.lit(0).cast("long").alias("__o"))
        both = both if was is None else both.unionByName(was)
        sums = both.groupBy(*d.schema.names).agg(F.sum(W).alias("__n"), F.sum("__o").alias("__o"))
        change = (F.col("__n") > 0).cast("long") - (F.col("__o") > 0).cast("long")
        out = hold(sums.select(*d.schema.names, change.alias(W)).where(F.col(W) != 0), d.schema, single=True)
    grown = weights.added(d)

    def move() -> None:
        owner.weights = grown

    return out, move


class Map(Collection):
    def __init__(self, upstream: Collection, columns: Sequence[Column | str], deterministic: bool):
        super().__init__(upstream.runtime, upstream.empty.select(*columns).schema, False, [upstream])
        self.columns = list(columns)
        names = upstream.schema.names
        self.images = None if deterministic else Store(upstream.runtime.spark, upstream.empty.select(*names, F.struct(*columns).alias("__image")).schema, names)

    def _change(self, d: Delta) -> tuple[Delta | None, Move | None]:
        if self.images is None:
            images = d.frame().select(*self.columns, W)
            return (hold(consolidate(images), self.schema, single=True) if d.rows is None else row_wise(images, d, self.schema)), None
        names, images = self.inputs[0].schema.names, self.images
        rows = d.frame().select(*names)
        known = images.touched(rows).drop(W)
        on = fold(lambda a, b: a & b, [F.col(f"`{n}`").eqNullSafe(F.col(f"__m{i}")) for i, n in enumerate(names)])
        marked = lambda df, *more: df.select(*[F.col(f"`{n}`").alias(f"__m{i}") for i, n in enumerate(names)], *more)
        fresh = d.frame().where(F.col(W) > 0).select(*names).join(marked(known), on, "left_anti")
        # images of rows that are gone are kept: a row that comes back has the image it had
        made = hold(weigh(fresh.distinct().withColumn("__image", F.struct(*self.columns))), images.schema, single=True)
        grown = images.added(made)
        all_images = known.unionByName(made.frame().drop(W))
        met = d.frame().join(marked(all_images, "__image"), on).select("__image.*", W)

        def move() -> None:
            self.images = grown

        return hold(met, self.schema), move


_NUMBERS = (ByteType, ShortType, IntegerType, LongType)


class Join(Collection):
    """dL x R before + L after x dR, weights multiplied. A join is linear on both sides, so a delta meets the parts of a side as they are."""

    def __init__(self, left: Collection, right: Collection, left_key: Column | str, right_key: Column | str):
        schema = StructType().add("left", left.schema).add("right", right.schema)
        super().__init__(left.runtime, schema, False, [left, right])
        spark = left.runtime.spark
        self.sides = [Store(spark, c.schema, [as_col(k)]) for c, k in ((left, left_key), (right, right_key))]
        a, b = (s.types[0] for s in self.sides)
        self.by_driver = a == b or isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS)

    def _met(self, k: int, d: Delta, others: Store) -> list[tuple] | None:
        """Pairs of a held delta of side k with what its keys find on the other side."""
        if d.rows is None or not self.by_driver:
            return None
        own = d.values(*self.sides[k].key)
        found = others.find({v[:-1] for v in own})
        if found is None:
            return None
        out = []
        for r, v in zip(d.rows, own, strict=True):
            for o in found.get(others.key_of(v[:-1]), []):
                pair = (r[:-1], tuple(o[:-1])) if k == 0 else (tuple(o[:-1]), r[:-1])
                out.append((*pair, r[-1] * o[-1]))
                if len(out) > deltas.HELD_ROWS:
                    return None
        return out

    def _pairs(self, k: int, d: Delta, others: Store) -> DataFrame:
        def side(i: int, df: DataFrame, key: Column) -> DataFrame:
            return df.select(key.alias(f"__j{i}"), F.struct(*self.inputs[i].schema.names).alias(("left", "right")[i]), F.col(W).alias(f"__w{i}"))

        mine, theirs = side(k, d.frame(), self.sides[k].key[0]), side(1 - k, others.raw(), F.col(others.columns[0]))
        met = mine.join(theirs, F.col("__j0").eqNullSafe(F.col("__j1")))
        return met.select("left", "right", (F.col("__w0") * F.col("__w1")).alias(W))

    def _change(self, dl: Delta | None, dr: Delta | None) -> tuple[Delta | None, Move | None]:
        left, right = self.sides
        now = [left.added(dl), right.added(dr)]
        held: list[tuple] = []
        frames: list[DataFrame] = []
        for k, d, others in ((0, dl, right), (1, dr, now[0])):
            if d is None:
                continue
            pairs = self._met(k, d, others)
            if pairs is None:
                frames.append(self._pairs(k, d, others))
            else:
                held += pairs

        def move() -> None:
            self.sides = now

        if not frames:
            return Delta(self.runtime.spark, self.schema, summed(held, self.schema)), move
        if held:
            frames.append(local(self.runtime.spark, held, deltas.weighted(self.schema)))
        return hold(fold(DataFrame.unionByName, frames), self.schema), move


class Grouped(Collection):
    """A set with a key. Groups are views, always current."""

    def __init__(self, upstream: Collection, key: Column | str):
        super().__init__(upstream.runtime, upstream.schema, True, [upstream])
        self.key = as_col(key)
        spark = upstream.runtime.spark
        self.weights = None if upstream.is_set else Store(spark, self.schema, self.schema.names)
        self.seen = Store(spark, self.empty.select(self.key.alias("k")).schema, ["k"])

    def _change(self, d: Delta) -> tuple[Delta | None, Move | None]:
        out, move = (d, None) if self.weights is None else as_set(self, d)
        keys = out.frame().where(F.col(W) > 0).groupBy(self.key.alias("k")).agg(F.lit(1).cast("long").alias(W)) if out.rows is None else None
        if keys is None:
            new = Delta(out.spark, self.seen.schema, [(*v, 1) for v in {self.seen.key_of(x[:-1]): x[:-1] for x in out.values(self.key) if x[-1] > 0}.values()])
        else:
            new = hold(keys, self.seen.schema, single=True)
        seen = self.seen.added(new)

        def both() -> None:
            if move:
                move()
            self.seen = seen

        return out, both

    def key_rows(self, ever_seen: bool = False) -> DataFrame:
        """The keys (column k) of groups with rows; or of all that ever had some."""
        state = self.state()
        return (self.seen.frame() if ever_seen else state.select(self.key.alias("k"))).select("k").distinct()

    def keys(self, ever_seen: bool = False) -> list:
        """``key_rows`` as a list; more than MOST_KEYS raise a ValueError."""
        found = self.key_rows(ever_seen).limit(MOST_KEYS + 1).collect()
        if len(found) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} keys: use key_rows")
        return [r[0] for r in found]

    def sizes(self) -> DataFrame:
        return self.state().groupBy(self.key.alias("k")).agg(F.count("*").alias("n"))

    def aggregate(self, *aggregates: Column) -> DataFrame:
        return self.state().groupBy(self.key.alias("k")).agg(*aggregates)

    def get_group(self, value: Any) -> Collection:
        return Filter(self, self.key.eqNullSafe(F.lit(value)), "raise")

    def sort_by_key(self, *keys: ordered.KeyLike) -> Sorted:
        """Each group in its own order."""
        return Sorted(self, keys, self.key)


class Sorted:
    """A collection in ascending order of keys, then of all columns, so ties have one order. Positions are made when read."""

    def __init__(self, upstream: Collection, keys: Sequence[ordered.KeyLike], by: Column | None = None):
        self.upstream, self.by = upstream, by
        self.keys = [*keys, *upstream.schema.names]
        self.version_node = upstream.version_node

    def entries(self) -> DataFrame:
        """All rows with their position ``idx`` from 0."""
        return ordered.entries(self.upstream.rows(), self.keys)

    def feed(self) -> PositionFeed:
        """The changes from now on by position."""
        return PositionFeed(self)

    def pairwise(self) -> Collection:
        """Neighbours as structs ``left`` and ``right``."""
        return Windows(self, 2, lambda w: [F.col("w0").alias("left"), F.col("w1").alias("right")])

    def window(self, size: int) -> Collection:
        """Runs of ``size`` rows as an array ``window``."""
        return Windows(self, size, lambda w: [F.array(*w).alias("window")])


def both_sides(before: DataFrame, new: Delta, names: list[str]) -> DataFrame:
    """The rows of a state and a delta to it, with how often each adds to what is there before and after."""
    was = before.select(*[F.col(f"`{n}`") for n in names], F.col(W).alias(ordered.OLD), F.col(W).alias(ordered.NEW))
    return was.unionByName(new.frame().select(*[F.col(f"`{n}`") for n in names], F.lit(0).cast("long").alias(ordered.OLD), F.col(W).alias(ordered.NEW)))


class PositionFeed:
    """What changes in a sorted collection, as steps for a list: (version, step, op, idx, the row's columns).

    Done in order of ``step``, they make the list of the version before into that of this one: ``removed`` from the end on, each at its position then, and
    ``inserted`` from the start on. The first poll inserts all rows that are there. A poll follows both orders in one pass over the rows, by ranges."""

    def __init__(self, order: Sorted):
        if order.by is not None:
            raise ValueError("positions are those of a whole collection")
        self.order, self.reader = order, order.upstream.reader()
        self.before = Store(order.upstream.runtime.spark, order.upstream.schema, order.upstream.schema.names)
        self.version = 0

    def poll(self) -> DataFrame:
        """The steps since the last poll; none if nothing has changed."""
        up = self.order.upstream
        with up.runtime._lock:
            up.runtime.get(up.version_node)
            new, end = up.unread(self.reader)
            now, version = up.store, up.version
            steps = StructType().add("version", "long").add("step", "long").add("op", "string").add("idx", "long")
            out = local(up.runtime.spark, [], StructType([*steps.fields, *up.schema.fields]))
            if new is not None:
                out = materialize(self._steps(new, self.before, version).select(*out.columns))
            self.before, self.version, self.reader.at = now, version, end
            up.forget()
            return out

    def _steps(self, new: Delta, old: Store, version: int) -> DataFrame:
        steps = ordered.moves(both_sides(old.raw(), new, self.order.upstream.schema.names), self.order.keys, old.rows + new.n)
        return steps.withColumn("version", F.lit(version).cast("long"))


class Follower:
    """A list that only follows a feed's steps, as a table of ``idx`` from 0 and the rows' columns.

    A row that stays moves by what is removed and inserted before it. Both are counted in blocks of positions, so no task holds more than a block of
    the list, and the driver a number for each block. A step that removes another row than the list has there is an error."""

    def __init__(self, spark: SparkSession, schema: StructType):
        self.spark, self.schema, self.n = spark, schema, 0
        self.table = local(spark, [], StructType([*StructType().add("idx", "long").fields, *schema.fields]))

    def rows(self) -> DataFrame:
        return self.table

    def take(self, steps: DataFrame) -> None:
        """The steps of one poll."""
        size, columns = ordered.RANGE_ROWS, ["idx", *self.schema.names]
        block = lambda c: F.expr(f"int({c} div {size})").alias("__k")
        removed = {r["__k"]: r["n"] for r in steps.where("op = 'removed'").groupBy(block("idx")).agg(F.count("*").alias("n")).collect()}
        gone = sum(removed.values())
        new = steps.where("op = 'inserted'")
        if not self.n:
            if gone:
                raise ValueError("a row is removed from an empty list")
            table = materialize(new.select(*columns))
            self.table, self.n = table, table.count()
            return
        gaps = new.groupBy((F.col("idx") - F.col("step") + gone).alias("__r")).agg(F.count("*").alias("__c"))
        if gone:
            blocks = -(-self.n // size)
            bases = ordered.ahead({b: [size - removed.get(b, 0)] for b in range(blocks)}, blocks)[:-1]
            both = self.table.select(*columns, F.lit(0).alias("__g")).unionByName(steps.where("op = 'removed'").select(*columns, F.lit(1).alias("__g")))
            w = Window.partitionBy("__k").orderBy("idx", "__g")
            seen = both.withColumn("__k", block("idx")).withColumns({
                "__x": F.struct(*columns), "__s": F.sum(1 - 2 * F.col("__g")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                "__last": F.lag(F.struct(*columns)).over(w), "__next": (F.lead("__g").over(w) == 1) & (F.lead("idx").over(w) == F.col("idx"))})
            other = (F.col("__g") == 1) & ~F.col("__last").eqNullSafe(F.col("__x"))
            stay = seen.where(F.when(other, F.raise_error(F.lit("another row was removed")).cast("boolean")).otherwise((F.col("__g") == 0) & ~F.coalesce("__next", F.lit(False))))
            base = self.spark.createDataFrame(bases, "__home int, __ahead long")
            stay = stay.join(F.broadcast(base), F.col("__k") == F.col("__home")).withColumn("__r", F.col("__s") - 1 + F.col("__ahead"))
        else:
            stay = self.table.withColumn("__r", F.col("idx"))
        came = {r["__k"]: [r["n"]] for r in gaps.groupBy(block("__r")).agg(F.sum("__c").alias("n")).collect()}
        if came:
            base = self.spark.createDataFrame(ordered.ahead(came, max(max(came), (self.n - gone) // size) + 1)[:-1], "__home int, __ahead long")
            both = stay.select("__r", *self.schema.names, F.lit(0).cast("long").alias("__c")).unionByName(gaps, allowMissingColumns=True)
            w = Window.partitionBy("__k").orderBy("__r", F.col("__c").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            moved = both.withColumn("__k", block("__r")).withColumn("__s", F.sum("__c").over(w)).where("__c = 0")
            moved = moved.join(F.broadcast(base), F.col("__k") == F.col("__home")).withColumn("idx", F.col("__r") + F.col("__s") + F.col("__ahead"))
        else:
            moved = stay.withColumn("idx", F.col("__r"))
        self.table = materialize(moved.select(*columns).unionByName(new.select(*columns)))
        self.n += sum(n for n, in came.values()) - gone


class Windows(Collection):
    """Only what can have changed is read: the rows between the first and the last changed place and size - 1 more on
    either side, or the groups that changed; the windows there before and after give the delta."""

    def __init__(self, order: Sorted, size: int, shape: Callable[[list[str]], list[Column]]):
        if size < 1:
            raise ValueError("a window has one row at least")
        upstream = order.upstream
        self.order, self.size, self.shape = order, size, shape
        names, spark = upstream.schema.names, upstream.runtime.spark
        one = upstream.empty.select(*[F.struct(*names).alias(f"w{k}") for k in range(size)])
        super().__init__(upstream.runtime, one.select(*shape(one.columns)).schema, True, [upstream])
        self.before = Store(spark, upstream.schema, names)
        self.weights = None if upstream.is_set else Store(spark, self.schema, self.schema.names)

    def _change(self, d: Delta) -> tuple[Delta | None, Move | None]:
        old, now = self.before, self.inputs[0].store
        few = old.rows + d.n <= min(SMALL_ROWS, deltas.HELD_ROWS)
        bag = self._windows([old.frame(), now.frame()]) if few else self._changed(d, old, now)
        # of a set each window is there once, as its first row is: what changes is all there is to know
        change = hold(bag, self.schema, few=few, single=self.weights is None and not few)
        out, grow = (change, None) if not change.n or self.weights is None else as_set(self, change)

        def move() -> None:
            self.before = now
            if grow:
                grow()

        return out, move

    def _windows(self, sides: list[DataFrame]) -> DataFrame:
        """The windows of the new state with weight 1 and those of the old one with weight -1."""
        tagged = [expand(s).withColumn("__side", F.lit(k)) for k, s in enumerate(sides)]
        rows, by = tagged[0].unionByName(tagged[1]), ["__side"]
        if self.order.by is not None:
            rows, by = rows.withColumn("__g", self.order.by), [*by, "__g"]
        found = ordered.leads(rows, self.order.keys, self.size, by=by, range_rows=None)
        return self._shaped(found, (F.col("__side") * 2 - 1).cast("long"))

    def _shaped(self, found: DataFrame, weight: Column) -> DataFrame:
        names = self.inputs[0].schema.names
        clean = found.select(weight.alias("__weight"), *[F.struct(*[F.col(f"w{k}").getField(n).alias(n) for n in names]).alias(f"w{k}") for k in range(self.size)])
        return clean.select(*self.shape([f"w{k}" for k in range(self.size)]), F.col("__weight").alias(W))

    def _changed(self, d: Delta, old: Store, now: Store) -> DataFrame:
        """The windows that come and go, in one pass over the rows of both states, or over those that a change of a few rows can concern."""
        names, by, most = self.inputs[0].schema.names, self.order.by, old.rows + d.n
        rows = both_sides(old.raw(), d, names)
        if by is not None:
            rows = rows.withColumn("__g", by)
        if NEAR * d.n < old.rows:
            if by is not None:
                groups = d.frame().select(by.alias("__tg")).distinct()
                rows = rows.join(groups, F.col("__g").eqNullSafe(F.col("__tg")), "left_semi")
            else:
                values, inside = self._stretch(d, old, now)
                rows = rows.withColumns(values).where(inside).drop(*values)
            most = rows.count()
        found = ordered.changed_windows(rows, self.order.keys, self.size, most, by=[] if by is None else ["__g"], unique=self.weights is None, weight="__ww")
        return self._shaped(found, F.col("__ww"))

    def _stretch(self, d: Delta, old: Store, now: Store) -> tuple[dict[str, Column], Column]:
        """Columns of a row's place in the order, and which places a change can concern."""
        keys, names, reach = ordered.order_by(self.order.keys), self.inputs[0].schema.names, self.size - 1
        values = [k.column.alias(f"__o{i}") for i, k in enumerate(keys)]
        sense = lambda back: [ordered.Key(F.col(f"__o{i}"), k.descending).sort(back) for i, k in enumerate(keys)]
        places = d.frame().select(*values)
        types = [f.dataType for f in places.schema.fields]
        if d.rows is not None:
            found = places.orderBy(*sense(False)).collect()
            first, last = found[0], found[-1]
        else:
            first, last = places.orderBy(*sense(False)).first(), places.orderBy(*sense(True)).first()
        key = key_maker(f.dataType for f in self.inputs[0].schema.fields)

        def away(store: Store, cond: Column, back: bool) -> Any:
            """The place ``reach`` rows away from the stretch. A row may be there several times, so as many different rows are enough."""
            outside = store.raw().select(*names, W, *values).where(cond)
            most = 4 * reach + 16  # of rows as they are written, in which a row that was deleted is still there
            seen = outside.orderBy(*sense(back)).limit(most).collect()
            held: dict[tuple, list] = {}
            for r in seen:
                held.setdefault(key(tuple(r[:len(names)])), [0, r])[0] += r[W]
            groups = list(held.values()) if len(seen) < most else list(held.values())[:-1]  # the last one may go on
            live = [r for n, r in groups if n > 0]
            if len(live) < reach and len(seen) == most:
                live = consolidate(outside.select(*names, W)).select("*", *values).orderBy(*sense(back)).limit(reach).collect()
            return live[min(reach, len(live)) - 1] if live else None

        # outside of the stretch the old and the new state are the same
        low = (away(now, _before(keys, types, first), True) if reach else None) or first
        high = (away(now, _before(keys, types, last, after=True), False) if reach else None) or last
        return {f"__o{i}": k.column for i, k in enumerate(keys)}, ~_before(keys, types, low) & ~_before(keys, types, high, after=True)


def _before(keys: Sequence[ordered.Key], types: Sequence[DataType], place: Any, after: bool = False) -> Column:
    """Whether a row with columns __o0, __o1, ... sorts before (or after) a place."""
    out, equal = F.lit(False), F.lit(True)
    for i, k in enumerate(keys):
        c, v = F.col(f"__o{i}"), place[f"__o{i}"]
        at = literal(v, types[i])
        if k.descending != after:
            # larger values come first; null is the smallest
            ahead = c.isNotNull() if v is None else c.isNotNull() & (c > at)
        else:
            ahead = F.lit(False) if v is None else c.isNull() | (c < at)
        out = out | (equal & ahead)
        equal = equal & c.eqNullSafe(at)
    return out


def collection(runtime: Runtime, schema: StructType | str, key: Sequence[str] | None = None, label: str | None = None) -> Source:
    """A new empty source in a runtime."""
    return Source(runtime, schema, key, label)


__all__ = ["Collection", "Follower", "Grouped", "PositionFeed", "Sorted", "Source", "collection"]
