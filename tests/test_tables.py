"""Readers, keyed tables, positional changes, groups over ranges, and cells that others read at the same time."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from rillwork.operators import ordered
from rillwork.plans import deltas
from rillwork.plans.demos import Portfolio
from rillwork.plans.graph import Runtime
from rillwork.plans.incremental import Source
from rillwork.sources.changelog import read_ops
from rillwork.sources.tables import KeyedTable
from rillwork.streaming.runner import Gauge


@pytest.mark.parametrize("form, options", [("parquet", {}), ("csv", {"header": True, "inferSchema": True}), ("json", {}), ("orc", {})])
def test_ops_of_any_format(spark, rows, tmp_path, form, options):
    ops = spark.createDataFrame([(1, 10, "insert"), (2, 20, "insert"), (3, 10, "delete")], "seq long, v long, op string")
    path = f"file://{tmp_path}/{form}"
    ops.write.format(form).options(**{k: v for k, v in options.items() if k == "header"}).save(path)
    c = Source(Runtime(spark), "v long")
    c.apply(read_ops(spark, path, form, **options).select(F.col("seq").cast("long"), F.col("v").cast("long"), "op"), "op = 'insert'", "seq")
    assert rows(c.elements()) == [(20,)]


def test_keyed_table(spark, rows, tmp_path):
    held = KeyedTable(spark, f"file://{tmp_path}/visits", "id long, name string, time double", ["id"])
    make = lambda *r: spark.createDataFrame(list(r), "id long, name string, time double")
    assert held.rows().count() == 0
    assert held.upsert(make((1, "a", 8.0), (2, "b", 9.0), (2, "a", 9.5), (None, "n", None)))
    assert rows(held.rows()) == sorted([(1, "a", 8.0), (2, "b", 9.0), (None, "n", None)], key=repr)
    assert held.upsert(make((1, "a", 10.0), (3, "c", 7.0)), epoch=5)
    assert not held.upsert(make((1, "z", 0.0)), epoch=5)
    held.delete(make((None, None, None), (9, None, None)).select("id"))
    held.compact()
    assert rows(held.rows()) == [(1, "a", 10.0), (2, "b", 9.0), (3, "c", 7.0)]
    again = KeyedTable(spark, f"file://{tmp_path}/visits", "id long, name string, time double", ["id"])
    c = Source(Runtime(spark), again.schema, ["id"])
    c.load(again.rows())
    assert c.runtime.get(c.count()) == 3


@pytest.mark.parametrize("held", [20_000, 3])
def test_positions_of_changes(spark, monkeypatch, held):
    monkeypatch.setattr(deltas, "HELD_ROWS", held)
    rng = random.Random(6)
    c = Source(Runtime(spark), "id long, v long", ["id"])
    feeds = [(c.map("v").sort_by_key(ordered.desc("v")).feed(), []), (c.sort_by_key("v").feed(), [])]
    state = {}
    for epoch in range(4):
        for _ in range(rng.randrange(6)):
            i = rng.randrange(12)
            if rng.random() < 0.4:
                c.delete((i, None))
                state.pop(i, None)
            else:
                v = rng.randrange(5)
                c.insert((i, v))
                state.setdefault(i, v)
        for feed, lst in feeds:
            steps = feed.poll().orderBy("step").collect()
            for r in steps:
                row = tuple(r[n] for n in feed.order.upstream.schema.names)
                if r["op"] == "inserted":
                    lst.insert(r["idx"], row)
                else:
                    assert lst.pop(r["idx"]) == row
        assert feeds[0][1] == sorted(((v,) for v in state.values()), reverse=True)
        assert feeds[1][1] == sorted(state.items(), key=lambda x: (x[1], x[0]))
    assert feeds[0][0].poll().count() == 0


def test_windows_of_groups_over_ranges(spark, rows):
    """One group holds most rows: it is spread over ranges, and no window crosses into another group."""
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, t long, i long").repartition(5)
    want = []
    for g in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2]))
        want += [(g, *[r[2] for r in own[k:k + 3]]) for k in range(len(own) - 2)]
    for size in (7, 40, None):
        found = ordered.leads(df, ["t"], 3, ["i"], by=["g"], range_rows=size)
        assert rows(found.select("g", "w0.i", F.col("w1.i").alias("j"), F.col("w2.i").alias("k"))) == sorted(want, key=repr)
    cut, n = ordered.ranges(df, ordered.order_by(["g", "t", "i"]), 20)
    assert n > 8 and cut.where("g = 'hot'").select("__b").distinct().count() > 8


def test_clean_cells_are_read_while_a_job_runs(spark):
    rt = Runtime(spark)
    a, b = rt.create_input(1), rt.create_input(0)
    clean = rt.create_query(lambda r: r.get(a) + 1)
    assert rt.get(clean) == 2
    going, done = threading.Event(), threading.Event()

    def slow(r):
        r.get(b)
        going.set()
        done.wait(20)
        return "late"

    q = rt.create_query(slow)
    worker = threading.Thread(target=lambda: rt.get(q))
    worker.start()
    going.wait(20)
    began = time.monotonic()
    assert rt.get(clean) == 2 and rt.get(a) == 1
    assert time.monotonic() - began < 5 and not done.is_set()
    done.set()
    worker.join()
    assert rt.get(q) == "late"


def test_readers_never_see_time_go_back(spark):
    rt = Runtime(spark)
    n = rt.create_input(0)
    twice = rt.create_query(lambda r: 2 * r.get(n))
    rt.get(twice)
    stop, wrong = threading.Event(), []

    def read():
        last = 0
        while not stop.is_set():
            low = rt.get(n)
            v = rt.get(twice)
            if v < last or v < 2 * low:
                wrong.append((last, low, v))
            last = v

    readers = [threading.Thread(target=read) for _ in range(4)]
    for t in readers:
        t.start()
    for k in range(1, 400):
        rt.set(n, k)
    time.sleep(0.2)
    stop.set()
    for t in readers:
        t.join()
    assert not wrong and rt.get(twice) == 798


def test_removed_cells(spark):
    rt = Runtime(spark)
    a = rt.create_input(1)
    q = rt.create_query(lambda r: r.get(a))
    rt.get(q)
    with pytest.raises(ValueError, match="read by others"):
        rt.remove(a)
    rt.remove(q)
    rt.remove(a)
    assert rt.node_count == 0 and rt.graph_snapshot() == []
    new = rt.create_input(9)
    assert new.id in (a.id, q.id) and new.generation == 1 and rt.get(new) == 9
    for stale in (a, q):
        with pytest.raises(ValueError, match="removed"):
            rt.get(stale)


def test_portfolio_and_gauge(spark):
    rt = Runtime(spark)
    p = Portfolio(rt, [("A", 10.0, 8.0, 2.0, "tech"), ("B", 5.0, 10.0, 4.0, "fin"), ("C", 1.0, 1.0, 1.0, "tech")])
    assert (rt.get(p.total), rt.get(p.best), rt.get(p.sectors["tech"])) == (41.0, 25.0, 21.0)
    rt.set(p.prices["B"], 20.0)
    _, trace = rt.get_traced(p.best)
    assert rt.get(p.best) == 100.0 and trace.nodes_recomputed == 1
    assert rt.get(Portfolio(rt, []).best) == float("-inf")
    g = Gauge(rt)
    g.add(5, 0.05)
    assert rt.get(g.rate) == 0.0
    g.add(5, 0.2)
    assert rt.get(g.changes) == 10 and abs(rt.get(g.rate) - 40) < 1e-6
