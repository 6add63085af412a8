"""A job, a write or a commit that fails once: nothing is lost, nothing is taken twice."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from rillwork.plans import deltas, incremental
from rillwork.plans.graph import QueryFailed, Runtime
from rillwork.plans.incremental import Source
from rillwork.sources.changelog import DeltaLog
from rillwork.streaming.runner import EpochRunner

ACTIONS = ("collect", "count", "first")


class Breaker:
    """Makes the n-th action from now on fail, as a lost executor does; ``hit`` tells whether it came to that."""

    def __init__(self, patch):
        self.left, self.hit = None, False
        for name in ACTIONS:
            patch.setattr(DataFrame, name, self.wrapped(getattr(DataFrame, name)))
        for module in (deltas, incremental):
            patch.setattr(module, "materialize", self.wrapped(module.materialize))

    def arm(self, n):
        self.left, self.hit = n, False

    def wrapped(self, f):
        def run(*a, **k):
            if self.left is not None:
                self.left -= 1
                if self.left < 0:
                    self.left, self.hit = None, True
                    raise OSError("an executor is lost")
            return f(*a, **k)

        return run


def operators(c, d):
    bag = c.map((F.col("v") / 2).cast("long").alias("h"), F.col("x"))
    return {
        "filter": c.filter("v % 3 = 0"), "bag": bag, "bag filter": bag.filter("h > 0"), "join": c.join(d, F.abs("v"), F.abs("v")), "window": c.sort_by_key("v").window(3),
        "group": bag.group_by("h"), "pairs": c.group_by(F.signum("v")).sort_by_key("v").pairwise(),
    }


def wanted(a, b):
    half = lambda v: int(v / 2)
    o = sorted(a)
    runs = lambda x, n: {tuple(x[i:i + n]) for i in range(len(x) - n + 1)}
    row = lambda v: (v, v / 8)
    sign = lambda v: (v > 0) - (v < 0)
    return {
        "filter": [row(v) for v in o if v % 3 == 0], "bag": [(half(v), v / 8) for v in o], "bag filter": {(half(v), v / 8) for v in o if half(v) > 0},
        "join": [(row(x), row(y)) for x in a for y in b if abs(x) == abs(y)], "window": [([row(x) for x in w],) for w in runs(o, 3)], "group": {(half(v), v / 8) for v in o},
        "pairs": [(row(x), row(y)) for s in (-1, 0, 1) for x, y in runs([v for v in o if sign(v) == s], 2)],
    }


@pytest.mark.parametrize("held", [20_000, 4, 0])
def test_each_operator_survives_a_failure_anywhere(spark, rows, held, monkeypatch):
    monkeypatch.setattr(deltas, "HELD_ROWS", held)
    monkeypatch.setattr(deltas, "PARTS", 3)
    rng = random.Random(held)
    rt = Runtime(spark)
    c, d = Source(rt, "v long, x double"), Source(rt, "v long, x double")
    nodes = operators(c, d)
    cells = {"n": c.count(), "sum": c.sum("x"), "mean": c.avg("v"), "high": c.max("v"), "low": nodes["bag"].min("h"), "joined": nodes["join"].count()}
    breaker = Breaker(monkeypatch)
    a, b = set(), set()
    names = list(nodes) + list(cells)
    failed = 0
    for epoch in range(3 if held else 2):
        for _ in range(rng.randrange(3, 9)):
            v, ins, (s, m) = rng.randrange(-9, 9), rng.random() < 0.7, rng.choice([(c, a), (c, a), (d, b)])
            (s.insert if ins else s.delete)((v, v / 8))
            (m.add if ins else m.discard)(v)
        for at, name in enumerate(names):
            breaker.arm((epoch + at) % 3)
            target = nodes[name].version_node if name in nodes else cells[name]
            try:
                rt.get(target)
            except (OSError, QueryFailed):
                failed += 1
            breaker.left = None
        want = wanted(a, b)
        for name, node in nodes.items():
            assert rows(node.rows()) == sorted(want[name], key=repr), (epoch, name)
        got = {k: rt.get(cell) for k, cell in cells.items()}
        assert got == {"n": len(a), "sum": sum(a) / 8, "mean": sum(a) / len(a) if a else None, "high": max(a, default=None), "low": min((int(v / 2) for v in a), default=None), "joined": len(want["join"])}
    assert failed > 3


def test_a_failed_apply_takes_nothing(spark, rows, monkeypatch):
    rt = Runtime(spark)
    c = Source(rt, "v long")
    n = c.filter("v > 1").count()
    c.insert(5)
    assert rt.get(n) == 1
    breaker = Breaker(monkeypatch)
    ops = spark.createDataFrame([(5, False, 1), (7, True, 2), (8, True, 3)], "v long, p boolean, s long")
    c.insert(6)
    breaker.arm(0)
    with pytest.raises(OSError):
        c.apply(ops, "p", "s")
    assert rt.get(n) == 2  # the row inserted by hand is not lost
    c.apply(ops, "p", "s")
    assert rt.get(n) == 3 and rows(c.elements()) == [(6,), (7,), (8,)]


def test_errors_of_jobs_are_no_values(spark):
    rt = Runtime(spark)
    fails, runs = [OSError("lost")], []

    def compute(r):
        runs.append(1)
        if fails:
            raise fails.pop()
        return 4

    q = rt.create_query(compute)
    twice = rt.create_query(lambda r: r.get(q) * 2)
    with pytest.raises(QueryFailed):
        rt.get(twice)
    assert rt.get(twice) == 8 and len(runs) == 2
    # an error of the query itself is kept, until a retry is asked for
    why = [ValueError("no")]
    bad = rt.create_query(lambda r: runs.append(2) or (_ for _ in ()).throw(why[0]) if why else 1)
    over = rt.create_query(lambda r: r.get(bad) + 1)
    for _ in range(2):
        with pytest.raises(QueryFailed):
            rt.get(over)
    assert runs.count(2) == 1
    why.clear()
    with pytest.raises(QueryFailed):
        rt.get(over)
    assert rt.retry(over) == 2


def test_a_result_that_comes_after_a_failure_is_compared_with_the_one_before(spark):
    rt = Runtime(spark)
    a, fails, runs = rt.create_input(1), [], []
    q = rt.create_query(lambda r: (fails.pop()() if fails else min(r.get(a), 5)))
    label = rt.create_query(lambda r: runs.append(1) or r.get(q))
    rt.set(a, 7)
    assert rt.get(label) == 5

    def lost():
        raise OSError("lost")

    rt.set(a, 9)
    fails.append(lost)
    with pytest.raises(OSError):
        raise_cause(rt, q)
    assert rt.get(label) == 5 and len(runs) == 1


def raise_cause(rt, cell):
    try:
        rt.get(cell)
    except QueryFailed as e:
        raise e.__cause__ from None


SCHEMA = "op string, v long, seq long"


def pipeline(spark, path, seen, fails=None):
    def build(rt, source):
        return {"n": source.count(), "rt": rt}

    def publish(epoch, targets):
        if fails:
            fails.pop()
            raise OSError("publishing failed")
        seen[epoch] = targets["rt"].get(targets["n"])

    return EpochRunner(spark, "v long", path, build, publish, compact_every=2)


def test_a_batch_whose_log_fails_comes_again(spark, tmp_path, monkeypatch):
    path, seen = f"file://{tmp_path}/log", {}
    runner = pipeline(spark, path, seen)
    batch = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    runner.on_batch(batch(("insert", 1, 1)), 0)
    append = DeltaLog.append
    monkeypatch.setattr(DeltaLog, "append", lambda *a: (_ for _ in ()).throw(OSError("full")))
    runner.source.insert(50)  # by hand, before the batch
    with pytest.raises(OSError):
        runner.on_batch(batch(("insert", 2, 2), ("insert", 3, 3)), 1)
    assert runner.log.state().count() == 1 and runner.epoch == 0
    monkeypatch.setattr(DeltaLog, "append", append)
    runner.on_batch(batch(("insert", 2, 2), ("insert", 3, 3)), 1)
    assert seen[1] == 4 and runner.log.state().count() == 4
    again = pipeline(spark, path, {})
    assert again.runtime.get(again.targets["n"]) == 4
    assert again.source.log == [] or again.source.version == 1


def test_a_batch_that_was_not_published_is_published_when_it_comes_again(spark, tmp_path):
    seen, fails = {}, []
    runner = pipeline(spark, f"file://{tmp_path}/log", seen, fails)
    ops = spark.createDataFrame([("insert", 1, 1)], SCHEMA)
    fails.append(1)
    with pytest.raises(OSError):
        runner.on_batch(ops, 0)
    assert seen == {}
    runner.on_batch(ops, 0)
    runner.on_batch(ops, 0)
    assert seen == {0: 1} and runner.runtime.get(runner.gauge.changes) in (0, 1)


def test_commits_are_whole_or_not_there(spark, tmp_path, rows):
    log = DeltaLog(spark, f"file://{tmp_path}/log")
    delta = lambda *r: spark.createDataFrame(list(r), "v long, __w long")
    assert log.append(0, delta((1, 1), (2, 1))) and log.append(1, delta((1, -1)))
    held = log.deltas()  # a reader that comes to it later
    # a crash between create and close, and one before the rename
    (Path(tmp_path) / "log/commits/7.json").write_text('{"base": -1, "epo')
    (Path(tmp_path) / "log/commits/8.draft-x").write_text(json.dumps({"base": 99}))
    assert log.last() == 1 and rows(log.state()) == [(2, 1)]
    assert not log.append(1, delta((9, 1)))
    log.compact()
    assert held.count() == 3 and rows(log.state()) == [(2, 1)]
    assert log.append(2, delta((3, 1)))
    log.compact()
    assert rows(log.state()) == [(2, 1), (3, 1)] and not (Path(tmp_path) / "log/epoch-0").exists()


@pytest.mark.parametrize("held", [20_000, 0])
def test_sums_of_doubles_are_exact_under_deletes(spark, held, monkeypatch):
    monkeypatch.setattr(deltas, "HELD_ROWS", held)
    rt = Runtime(spark)
    c = Source(rt, "id long, x double", ["id"])
    total, mean, high, low = c.sum("x"), c.avg("x"), c.max("x"), c.min("x")
    assert rt.get(total) == 0 and rt.get(mean) is None
    for i, x in enumerate([1.0, 1e17, math.inf, math.nan, None, 5e-324, -0.1, -math.inf]):
        c.insert((i, x))
    assert math.isnan(rt.get(total)) and math.isnan(rt.get(high)) and rt.get(low) == -math.inf
    c.delete((3, None))
    c.delete((7, None))
    assert rt.get(total) == math.inf and rt.get(high) == math.inf and rt.get(low) == -0.1
    c.delete((1, None))
    c.delete((2, None))
    assert rt.get(total) == math.fsum([1.0, 5e-324, -0.1]) and rt.get(mean) == math.fsum([1.0, 5e-324, -0.1]) / 3 and rt.get(high) == 1.0
    for i in (0, 6):
        c.delete((i, None))
    assert rt.get(total) == 5e-324


@pytest.mark.parametrize("held", [20_000, 0])
def test_sums_of_decimals_and_longs(spark, held, monkeypatch):
    from decimal import Decimal

    monkeypatch.setattr(deltas, "HELD_ROWS", held)
    rt = Runtime(spark)
    c = Source(rt, "id long, d decimal(30,10), n long", ["id"])
    d, n, m = c.sum("d"), c.sum("n"), c.avg("d")
    big, top = Decimal("12345678901234567890.0123456789"), (1 << 63) - 1
    for i in range(3):
        c.insert((i, big, top))
    assert rt.get(d) == Decimal("37037036703703703670.0370370367") and rt.get(n) == 3 * top
    c.delete((0, None, None))
    assert rt.get(m) == big and rt.get(n) == 2 * top


def test_many_keys_are_looked_up_in_parts(spark, rows, monkeypatch):
    """Sorted parts, lists of values, ranges, nulls and put-together parts."""
    monkeypatch.setattr(deltas, "HELD_ROWS", 30)
    monkeypatch.setattr(deltas, "LISTED", 5)
    monkeypatch.setattr(deltas, "PARTS", 3)
    rt = Runtime(spark)
    c = Source(rt, "k string, v double", ["k"])
    bag = c.map("v")
    kept = bag.filter("v is null or v >= 0 or isnan(v)")
    state = {}
    rng = random.Random(1)
    for epoch in range(12):
        for _ in range(40):
            k = rng.choice([None, *(f"key {i}" for i in range(60))])
            if rng.random() < 0.3:
                c.delete((k, 0.0))
                state.pop(k, None)
            else:
                v = rng.choice([None, math.nan, 0.0, -0.0, 1.5, -1.5, float(rng.randrange(30))])
                c.insert((k, v))
                state.setdefault(k, v)
        if epoch % 3 == 2:
            name = lambda v: None if v is None else "nan" if v != v else v + 0.0
            assert sorted(((r["k"], name(r["v"])) for r in c.rows().collect()), key=repr) == sorted(((k, name(v)) for k, v in state.items()), key=repr)
            assert {name(r["v"]) for r in kept.rows().collect()} == {name(v) for v in state.values() if v is None or v != v or v >= 0}
    assert 0 < len(c.store.parts) <= 4


def test_logs_do_not_grow(spark):
    rt = Runtime(spark)
    c = Source(rt, "v long")
    f = c.filter("v > 0")
    n = f.count()
    for v in range(6):
        c.insert(v)
        rt.get(n)
    late = c.count()
    assert rt.get(late) == 6 and rt.get(n) == 5
    assert len(c.log) == 0 and len(f.log) == 0 and c.version == 6
