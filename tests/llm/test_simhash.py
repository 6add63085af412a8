import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rillwork.llm import simhash
from rillwork.llm.components import components

from .conftest import BASE


def fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(points, distance):
    """Least member reachable, by brute force; points: (id, fingerprint)."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(points):
        for j, (_, b) in enumerate(points[:i]):
            if (a ^ b).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(points):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[find(i)] for i in range(len(points))]


def test_whole_operator(docs, no_docs, picked):
    points = [(i, fingerprint(t)) for i, t, _, _ in BASE]
    want = sorted([(i, f"{f:016x}", g) for (i, f), g in zip(points, groups(points, 4), strict=True)], key=repr)
    assert picked(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    clash = docs.withColumns({c: F.lit(k) for k, c in enumerate(("component_id", "node", "root", "_fp", "_node", "print", "value", "least", "id", "row"))})
    assert picked(simhash.near_duplicates(clash), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(no_docs).count() == 0


def clustered(rng, n, distance):
    """Distinct fingerprints: some alone, chains, and a dense cluster; bits 0 to 7 all alike or nearly, to correlate."""
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64) & ~0xFF
        out.add(c)
        for _ in range(rng.choice([0, 0, 3, 40])):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, distance + 2)))
            out.add(c)
    return [x - (1 << 64) if x >> 63 else x for x in out]


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_links_connect_what_brute_force_connects(spark, distance):
    rng = random.Random(distance)
    values = clustered(rng, 300, distance)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    edges = simhash.links(df, distance, "v")
    assert all((((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= distance) for r in edges.collect())
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    values.sort()
    want = groups([(v, v & (1 << 64) - 1) for v in values], distance)
    assert [got.get(v, v) for v in values] == want


@pytest.mark.parametrize("distance", [2, 4])
def test_large_buckets_are_divided(spark, monkeypatch, distance):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 20)
    rng = random.Random(9)
    low = [v & 0xFFFFFFFF for v in clustered(rng, 300, distance)]
    values = sorted({v | 0x12345678 << 32 for v in low} | set(clustered(rng, 100, distance)))  # most are alike in half of their bits
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    edges = simhash.links(df, distance, "v")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = groups([(v, v & (1 << 64) - 1) for v in values], distance)
    assert [got.get(v, v) for v in values] == want


def test_thresholds_cover_every_way_to_differ():
    shares = [simhash.distance_shares(np.random.default_rng(k).integers(0, 9, 1 << simhash.BLOCK)) for k in range(64 // simhash.BLOCK)]
    for n in (10, 10_000, 10_000_000, 10**10):
        for distance in (0, 2, 4, 7):
            plan = simhash.plan(n, shares, distance)
            assert sum(t + 1 for _, t in plan) == distance + 1
            assert sorted(b for part, _ in plan for b in part) == list(range(64 // simhash.BLOCK))
    h = np.array([3, 0, 1, 2] * (1 << simhash.BLOCK - 2))
    near = [0.0] * (simhash.BLOCK + 1)
    for i, a in enumerate(h):
        for j, b in enumerate(h):
            near[(i ^ j).bit_count()] += a * b / h.sum() ** 2
    assert np.allclose(simhash.distance_shares(h), near)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)] + [(5, 5), (None, 3), (7, 6)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r["node"]: r["root"] for r in components(df).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen = {}
    for start in sorted(near):
        todo = [start] if start not in seen else []
        while todo:
            v = todo.pop()
            if v not in seen:
                seen[v] = start
                todo += near[v]
    assert got == {v: r for v, r in seen.items()}
    assert components(df.where("false")).count() == 0
