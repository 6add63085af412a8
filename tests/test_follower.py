"""Lists that follow a feed, and what changes of an order cost."""

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.operators import ordered
from rillwork.plans import deltas, incremental
from rillwork.plans.catalogue import QUERIES
from rillwork.plans.graph import Runtime
from rillwork.plans.incremental import Follower, Source

from .conftest import SMALL


def test_feed_is_followed_without_the_driver(spark, monkeypatch):
    """No list of all rows on the driver, where each insert would move all behind it."""
    def no(*_):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", no)
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", no)
    found = QUERIES["delta_sort_feed"](spark, SMALL)
    assert found.count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


@pytest.mark.parametrize("size", [12, 200_000])
def test_follower(spark, monkeypatch, size):
    """Rows of a bag go and come at the start, at the end and between, over blocks and ranges of few rows."""
    monkeypatch.setattr(deltas, "HELD_ROWS", 3)
    monkeypatch.setattr(ordered, "RANGE_ROWS", size)
    monkeypatch.setattr(ordered.moves, "__defaults__", (size,))
    rng = random.Random(5)
    c = Source(Runtime(spark), "id long, v long", ["id"])
    bag = c.map(F.when(F.col("v") > 0, F.col("v")).alias("v"))
    feed, follower, state = bag.sort_by_key(ordered.desc("v")).feed(), Follower(spark, bag.schema), {}
    for epoch in range(5):
        for _ in range(25 if epoch < 3 else 3):
            i = rng.randrange(40)
            if rng.random() < 0.4:
                c.delete((i, None))
                state.pop(i, None)
            else:
                v = rng.randrange(6)
                c.insert((i, v))
                state.setdefault(i, v)
        follower.take(feed.poll())
        got = [r["v"] for r in follower.rows().orderBy("idx").collect()]
        assert [r["idx"] for r in follower.rows().orderBy("idx").collect()] == list(range(len(state))) and follower.n == len(state)
        assert got == sorted((v or None for v in state.values()), key=lambda v: -(v or 0))
    wrong = feed.order.entries().select(F.lit(9).cast("long").alias("version"), F.lit(0).cast("long").alias("step"), F.lit("removed").alias("op"), "idx", F.lit(77).cast("long").alias("v")).where("idx = 1")
    with pytest.raises(Exception, match="another row was removed"):
        follower.take(wrong)


def test_windows_of_a_set_are_written_once(spark, monkeypatch):
    """A change of a set's windows is one table; it is not weighed again nor kept in a second order."""
    monkeypatch.setattr(deltas, "HELD_ROWS", 3)
    monkeypatch.setattr(incremental, "SMALL_ROWS", 0)
    monkeypatch.setattr(deltas, "SORT_ROWS", 50)
    written = []

    def counted(df, **options):
        out = write(df, **options)
        written.append(out.count())
        return out

    write = deltas.materialize
    for module in (deltas, incremental, ordered):
        monkeypatch.setattr(module, "materialize", counted)
    c = Source(Runtime(spark), "id long, g long, t long", ["id"])
    pairs, groups = c.sort_by_key("t").pairwise(), c.group_by("g").sort_by_key("t").window(3)
    c.load(spark.range(300).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 7 % 300).alias("t")))
    for windows, n in ((pairs, 299), (groups, 296)):
        c.runtime.get(windows.inputs[0].version_node)
        written.clear()
        assert windows.elements().count() == n and sum(written) == n


@pytest.mark.parametrize("near, size", [(0, 7), (8, 7), (8, 200_000)])
def test_changed_windows(spark, rows, monkeypatch, near, size):
    """Windows of sets, bags and groups after changes, over ranges of few rows."""
    monkeypatch.setattr(deltas, "HELD_ROWS", 3)
    monkeypatch.setattr(incremental, "SMALL_ROWS", 0)
    monkeypatch.setattr(incremental, "NEAR", near)
    monkeypatch.setattr(ordered.changed_windows, "__defaults__", ((), size, False, "__w"))
    rng = random.Random(8)
    c = Source(Runtime(spark), "id long, g long, t long", ["id"])
    pairs, bag, groups = c.sort_by_key(ordered.desc("t")).pairwise(), c.map("t").sort_by_key("t").window(3), c.group_by("g").sort_by_key("t").window(3)
    held = {}
    for epoch in range(3):
        for _ in range(30 if epoch < 2 else 2):
            i = rng.randrange(30)
            if rng.random() < 0.3:
                c.delete((i, None, None))
                held.pop(i, None)
            else:
                row = (i, rng.choice([0, 0, 0, 1, None]), rng.choice([None, *range(6)]))
                c.insert(row)
                held.setdefault(i, row)
        low = lambda v: (v is not None, v or 0)
        down = sorted(held.values(), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert rows(pairs.elements()) == sorted(zip(down, down[1:]), key=repr)
        up = sorted((r[2] for r in held.values()), key=low)
        assert rows(bag.elements()) == sorted([([(a,), (b,), (d,)],) for a, b, d in {*zip(up, up[1:], up[2:])}], key=repr)
        want = []
        for g in {r[1] for r in held.values()}:
            own = sorted((r for r in held.values() if r[1] == g), key=lambda r: (low(r[2]), r[0]))
            want += [([*w],) for w in zip(own, own[1:], own[2:])]
        assert rows(groups.elements()) == sorted(want, key=repr)
