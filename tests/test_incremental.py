import random

import pytest
from pyspark.sql import functions as F

from rillwork.plans import incremental
from rillwork.plans.demos import Dashboard, TravelDay, daily_premiums, travel_segments
from rillwork.plans.graph import Runtime
from rillwork.plans.incremental import Source


@pytest.fixture()
def rt(spark):
    return Runtime(spark)


def values(df):
    return sorted((r[0] for r in df.collect()), key=repr)


def test_count_filter_map_reduce(rt):
    c = Source(rt, "v long")
    n, even = c.count(), c.filter("v % 2 = 0").count()
    piped = c.filter("v > 0").filter("v < 10").map((F.col("v") * 2).alias("w")).count()
    total, high = c.sum("v"), c.max("v")
    assert [rt.get(x) for x in (n, even, piped, total, high)] == [0, 0, 0, 0, None]
    for v in (-5, 3, 15, 7, 2):
        c.insert(v)
    assert [rt.get(x) for x in (n, even, piped, total, high)] == [5, 1, 3, 22, 15]
    c.delete(15)
    c.delete(99)  # absent
    c.insert(3)  # present
    assert [rt.get(x) for x in (n, even, piped, total, high)] == [4, 1, 3, 7, 7]
    assert rt.get(c.reduce(F.count("*"), F.min("v")))[1] == -5
    assert rt.get(c.fold(lambda rows: sum(r["v"] for r in rows))) == 7
    assert rt.get(c.avg("v")) == 7 / 4


def test_noop_changes_nothing(rt):
    c = Source(rt, "v long")
    runs = []
    q = rt.create_query(lambda r: runs.append(1) or r.get(c.version_node))
    c.insert(1)
    assert rt.get(q) == 1
    c.insert(1)
    c.delete(5)
    assert rt.get(q) == 1 and len(runs) == 1
    c.insert(2)
    c.delete(2)  # gone before anyone looked
    assert rt.get(q) == 1


@pytest.mark.parametrize("small", [20_000, 0])
def test_flagship_with_cutoff(rt, small, monkeypatch):
    monkeypatch.setattr(incremental, "SMALL_ROWS", small)
    c = Source(rt, "t long")
    gaps = c.sort_by_key("t").pairwise().map((F.col("right.t") - F.col("left.t")).alias("gap"))
    total, runs = gaps.sum("gap"), []
    label = rt.create_query(lambda r: runs.append(1) or f"total {r.get(total)}")
    for t in (10, 30, 50):
        c.insert(t)
    assert rt.get(label) == "total 40"
    c.insert(20)
    assert rt.get(label) == "total 40" and len(runs) == 1
    c.delete(30)
    c.insert(100)
    assert rt.get(label) == "total 90"
    c.delete(10)
    assert rt.get(label) == "total 80" and len(runs) == 3


def test_key_columns_replace_a_row(rt, rows):
    c = Source(rt, "id long, name string", key=["id"])
    c.insert((1, "a"))
    c.insert((1, "b"))  # the same element: present
    assert rows(c.elements()) == [(1, "a")]
    c.delete((1, "whatever"))
    c.insert((1, "c"))
    assert rows(c.elements()) == [(1, "c")]
    c.insert({"id": None, "name": None})
    assert rows(c.elements()) == [(1, "c"), (None, None)]


def test_groups(rt, rows):
    c = Source(rt, "v long")
    g = c.group_by("v % 3")
    for v in (1, 2, 4, 6):
        c.insert(v)
    ones = g.get_group(1)
    assert sorted(g.keys()) == [0, 1, 2] and values(ones.elements()) == [1, 4] and rt.get(ones.count()) == 2
    c.delete(2)
    c.delete(4)
    assert sorted(g.keys()) == [0, 1] and sorted(g.keys(ever_seen=True)) == [0, 1, 2] and values(ones.elements()) == [1]
    assert rows(g.sizes()) == [(0, 1), (1, 1)]


def test_bags_keep_what_is_left(rt, rows):
    """Duplicates made by a map, then filtered, joined and sorted: one delete takes one copy."""
    c = Source(rt, "id long, v long")
    bag = c.map("v")
    kept, order, joined = bag.filter("v > 0"), bag.sort_by_key("v"), bag.join(bag, "v", "v")
    pairs = order.pairwise()
    for r in ((1, 5), (2, 5), (3, 8)):
        c.insert(r)
    assert values(bag.rows()) == [5, 5, 8] and values(kept.elements()) == [5, 8] and joined.rows().count() == 5
    assert rows(pairs.elements()) == [((5,), (5,)), ((5,), (8,))]
    c.delete((1, 5))
    assert values(bag.rows()) == [5, 8] and values(kept.elements()) == [5, 8] and joined.rows().count() == 2
    assert rows(pairs.elements()) == [((5,), (8,))] and rows(order.entries()) == [(5, 0), (8, 1)]
    c.delete((2, 5))
    assert values(kept.elements()) == [8] and joined.rows().count() == 1 and rows(pairs.elements()) == []


def test_images_that_differ_each_time_are_taken_back(rt):
    c = Source(rt, "v long")
    m = c.map("v", F.uuid().alias("u"), deterministic=False)
    c.insert(1)
    c.insert(2)
    first = {r["v"]: r["u"] for r in m.rows().collect()}
    c.delete(1)
    c.insert(3)
    then = {r["v"]: r["u"] for r in m.rows().collect()}
    assert set(then) == {2, 3} and then[2] == first[2]


@pytest.mark.parametrize("seed, small", [(1, 20_000), (2, 0)])
def test_random_ops_equal_a_recomputation(rt, rows, seed, small, monkeypatch):
    monkeypatch.setattr(incremental, "SMALL_ROWS", small)
    rng = random.Random(seed)
    c, d = Source(rt, "v long"), Source(rt, "v long")
    bag = c.map((F.col("v") / 2).cast("long").alias("h"))
    nodes = {
        "filter": c.filter("v % 3 = 0"), "bag": bag, "bag filter": bag.filter("h > 0"), "join": c.join(d, F.abs("v"), F.abs("v")),
        "window": c.sort_by_key("v").window(3), "pairs of a bag": bag.sort_by_key("h").pairwise(), "group pairs": c.group_by(F.signum("v")).sort_by_key("v").pairwise(),
        "descending": c.sort_by_key(-F.col("v")).pairwise(),
    }
    a, b = set(), set()
    for _ in range(3):
        for _ in range(rng.randrange(1, 8)):
            v, ins, (s, m) = rng.randrange(-9, 9), rng.random() < 0.65, rng.choice([(c, a), (c, a), (d, b)])
            (s.insert if ins else s.delete)(v)
            (m.add if ins else m.discard)(v)
        halves = [int(v / 2) for v in sorted(a)]
        o = sorted(a)
        runs = lambda x, n: {tuple(x[i:i + n]) for i in range(len(x) - n + 1)}
        want = {
            "filter": [(v,) for v in o if v % 3 == 0], "bag": [(h,) for h in halves], "bag filter": [(h,) for h in {h for h in halves if h > 0}],
            "join": [((x,), (y,)) for x in a for y in b if abs(x) == abs(y)], "window": [([(x,) for x in w],) for w in runs(o, 3)],
            "pairs of a bag": [((x,), (y,)) for x, y in runs(sorted(halves), 2)],
            "group pairs": [((x,), (y,)) for g in ([v for v in o if v < 0], [v for v in o if v == 0], [v for v in o if v > 0]) for x, y in runs(g, 2)],
            "descending": [((x,), (y,)) for x, y in runs(o[::-1], 2)],
        }
        for name, node in nodes.items():
            assert rows(node.rows()) == sorted(want[name], key=repr), name


def test_dashboard(rt):
    d = Dashboard(rt)
    assert rt.get(d.health) == "healthy"
    for i in range(20):
        d.requests.insert((i, i, "GET", "/", 500 if i < 2 else 200, 100))
    assert rt.get(d.error_rate) == 10 and rt.get(d.health) == "degraded" and rt.get(d.slow) == 0
    value, trace = rt.get_traced(d.health)
    assert value == "degraded" and trace.nodes_recomputed == 0


def test_travel_day(spark, rt):
    day = TravelDay(rt)
    assert rt.get(day.premium) == 0
    visits = [{"id": i, "client_name": f"c{i}", "address": None, "time": 8.0 + i, "duration_mins": 30, "lat": 52.5 + d, "lng": 13.4} for i, d in enumerate((0.0, 0.1, 0.02, 0.3))]
    for v in visits:
        day.visits.insert(v)

    def by_batch(rows):
        df = spark.createDataFrame([tuple(v.values()) for v in rows], TravelDay.SCHEMA).withColumn("day", F.lit(1))
        found = travel_segments(df, ["day"])
        return daily_premiums(found, ["day"]).first()["premium"], found.count()

    assert abs(rt.get(day.premium) - by_batch(visits)[0]) < 1e-9 and day.trips.rows().count() == 3
    day.move(visits[1], 20.0)
    visits[1]["time"] = 20.0
    assert abs(rt.get(day.premium) - by_batch(visits)[0]) < 1e-9
    day.visits.insert(visits[0] | {"id": 9, "time": 23.0, "lat": 60.0})
    assert rt.get(day.uncapped) > 50 and rt.get(day.premium) == 50
