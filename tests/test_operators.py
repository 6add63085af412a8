import random

import pytest
from pyspark.sql import functions as F

from rillwork.operators import ordered, relational, zset
from rillwork.sources.changelog import DeltaLog, effective_deltas


def test_zset(spark, rows):
    a = spark.createDataFrame([("x", 2), (None, 1), ("y", 1)], "k string, __w long")
    b = spark.createDataFrame([("x", 1), (None, 1), ("z", 3)], "k string, __w long")
    assert rows(zset.add(a, b)) == sorted([("x", 3), (None, 2), ("y", 1), ("z", 3)], key=repr)
    assert rows(zset.diff(a, b)) == sorted([("x", 1), ("y", 1), ("z", -3)], key=repr)
    assert rows(zset.expand(a)) == sorted([("x",), ("x",), (None,), ("y",)], key=repr)
    assert rows(zset.to_set(a)) == sorted([("x", 1), (None, 1), ("y", 1)], key=repr)
    assert rows(zset.touched(a, b)) == sorted([("x", 2), (None, 1)], key=repr)
    assert rows(zset.consolidate(a.unionByName(zset.negate(a)))) == []


@pytest.mark.parametrize("size, range_rows", [(1, 7), (2, 5), (3, 1), (4, 3), (3, 1000)])
def test_windows_over_ranges(spark, rows, size, range_rows):
    values = random.Random(size).sample(range(100), 23) + [None]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    order = [None, *sorted(v for v in values if v is not None)]
    got = ordered.window(df, ["v"], size, range_rows=range_rows)
    want = [([(x,) for x in order[i:i + size]],) for i in range(len(order) - size + 1)]
    assert rows(got) == sorted(want, key=repr)
    places = ordered.entries(df, ["v"], range_rows=range_rows)
    assert rows(places) == sorted([(v, i) for i, v in enumerate(order)], key=repr)
    down = ordered.entries(df, [ordered.desc("v")], range_rows=range_rows)
    assert rows(down) == sorted([(v, i) for i, v in enumerate(order[::-1])], key=repr)


@pytest.mark.parametrize("range_rows", [4, 1000])
def test_rolling(spark, rows, range_rows):
    df = spark.createDataFrame([(i, i * i) for i in range(30)], "i long, v long").repartition(4)
    got = ordered.rolling(df, ["i"], 6, {"s": F.sum("v"), "n": F.count("*")}, range_rows=range_rows).select("i", "s", "n")
    assert rows(got) == sorted([(i, sum(k * k for k in range(max(0, i - 5), i + 1)), min(6, i + 1)) for i in range(30)], key=repr)


def test_short_and_equal_windows(spark, rows):
    two = spark.createDataFrame([(1,), (2,)], "v long")
    assert rows(ordered.window(two, ["v"], 3)) == []
    assert rows(ordered.pairwise(two.limit(1), ["v"])) == []
    same = spark.createDataFrame([(1,), (1,), (1,)], "v long")
    assert rows(ordered.pairwise(same, ["v"])) == [((1,), (1,))]  # a set
    with pytest.raises(ValueError):
        ordered.window(two, ["v"], 0)


def test_last_op_and_effective_ops(spark, rows):
    rng = random.Random(3)
    log = [(i, rng.randrange(4), rng.random() < 0.6) for i in range(60)]
    df = spark.createDataFrame(log, "seq long, k long, ins boolean").repartition(3)
    state, deltas = set(), []
    for _, k, ins in log:
        if ins != (k in state):
            (state.add if ins else state.remove)(k)
            deltas.append((len(deltas) + 1, k, 1 if ins else -1))
    assert rows(relational.last_op_wins(df, ["k"], "seq", "ins").select("k")) == sorted([(k,) for k in state], key=repr)
    got = effective_deltas(df, ["k"], "seq", "ins").select("version", "k", "__w")
    assert rows(got) == sorted(deltas, key=repr)


def test_nulls_are_values(spark, rows):
    left = spark.createDataFrame([(1, None), (2, 7), (3, None)], "a long, k long")
    right = spark.createDataFrame([(None, "n"), (7, "s"), (7, "t")], "k2 long, b string")
    got = relational.join(left, right, "k", "k2").select("a", "b")
    assert rows(got) == sorted([(1, "n"), (3, "n"), (2, "s"), (2, "t")], key=repr)
    assert rows(relational.group_sizes(left, "k")) == sorted([(None, 2), (7, 1)], key=repr)
    assert rows(relational.get_group(left, "k", None)) == sorted([(1, None), (3, None)], key=repr)


def test_predicates(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "v long")
    assert rows(relational.filter_set(df, "v > 1")) == [(2,)]
    assert rows(relational.filter_set(df, "v > 1", distinct=False)) == [(2,), (2,)]
    assert rows(relational.filter_set(df.where("v is not null"), lambda r: r["v"] == 2)) == [(2,)]
    failing = lambda r: 1 / (r["v"] - 1) > 0
    assert rows(relational.filter_set(df.where("v is not null"), failing, errors="false")) == [(2,)]
    with pytest.raises(Exception, match="division"):
        relational.filter_set(df.where("v is not null"), failing).collect()
    assert rows(relational.map_python(df.where("v = 1"), lambda r: (r["v"], "x"), "a long, b string")) == [(1, "x")]


def test_aggregates_of_nothing(spark):
    none = spark.createDataFrame([], "v long")
    row = relational.reduce(none, total=relational.total("v"), high=F.max("v"), n=F.count("*")).first()
    assert tuple(row) == (0, None, 0)


def test_delta_log(spark, rows, tmp_path):
    log = DeltaLog(spark, f"file://{tmp_path}/log")
    d = lambda *r: spark.createDataFrame(list(r), "k long, __w long")
    assert log.state() is None and log.last() == -1
    assert log.append(0, d((1, 1), (2, 1))) and log.append(1, d((1, -1), (3, 1)))
    assert not log.append(1, d((9, 1)))
    assert rows(log.state()) == [(2, 1), (3, 1)]
    log.compact()
    assert log.committed()["base"] == 1 and not log.append(0, d((9, 1)))
    assert log.append(2, d((2, -1)))
    assert rows(DeltaLog(spark, f"file://{tmp_path}/log").state()) == [(3, 1)]
    assert rows(log.deltas(after=1)) == [(2, -1, 2)]
