import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillwork.llm import jaccard, simhash
from rillwork.llm.common import materialize
from rillwork.llm.components import components

from .conftest import BASE
from .test_phrase_index import expected as hits_by_hand
from .test_pipeline import folder, pairs  # noqa: F401


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """Least id reachable over links of 0.8 or more, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[find(i)] for i in range(len(rows))]


def corpus():
    """Texts with copies of 0 to 8 changed words, chains of changes, and a passage that many hold."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(4))
    common, out = [word() for _ in range(40)], []
    for i in range(60):
        text = [word() for _ in range(rng.choice([3, 5, 6, 30, 120, 400]))]
        if i % 3 == 0:
            text += common
        out.append(text)
        for _ in range(rng.randrange(4)):
            text = list(text)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(len(text))] = word()
            out.append(text)
    rows = [(i, " ".join(t)) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, no_docs):
    rows = corpus() + [(1000 + (i or 0), t) for i, t, _, _ in BASE]
    want = sorted(zip([i for i, _ in rows], groups(rows), strict=True))
    assert 60 < len({g for _, g in want}) < len(rows) - 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in jaccard.near_copies(df).collect()) == want
    assert jaccard.near_copies(no_docs).count() == 0
    with pytest.raises(ValueError):
        jaccard.near_copies(df, similarity="1.2")


def test_sketches_of_all_sizes():
    rng = np.random.default_rng(3)
    for n in (1, 5, 900, 1024, 1030, 4100, 20_000):
        base = rng.integers(0, 1 << 64, n + n // 9, np.uint64)
        sets = [np.unique(x) for x in (base[:n], base, base[n // 9:], rng.integers(0, 1 << 64, n, np.uint64))]
        found = jaccard.possible_links(np.array([len(x) for x in sets]), [jaccard.sketch(x) for x in sets], 4, 5)
        assert sorted({i for pair in found for i in pair}) == [0, 1, 2]  # the unrelated one passes at no size
        assert jaccard.true_links(sets, 4, 5) == found


def test_stage_catches_what_four_bits_leave(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.dedup_near(spark, df, "").collect())
    assert got == sorted(set(groups(rows)))


def test_stages_with_near_copies(spark, folder):  # noqa: F811
    """The stages from near_dedup on, against brute force at a similarity of 0.8."""
    base, items = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, base))
        steps.append(docs)
    _, lined, near, clean, coded = steps
    rows = sorted(pairs(lined), key=lambda r: (r[0] is not None, r[0] or 0))
    kept = set(groups([(n, t) for n, (_, t) in enumerate(rows)]))
    assert sorted(pairs(near), key=repr) == sorted({rows[n] for n in kept}, key=repr)
    ids = {i for i, _ in pairs(near)}
    assert 8 in ids and 220 not in ids  # a copy with one more word
    hits = hits_by_hand(pairs(near), items, 8)
    gone = {h[0] for h in hits if h[5]}
    assert gone and {i for i, _ in pairs(clean)} == ids - gone
    assert all(h[2] == 0 for h in hits_by_hand(pairs(clean), items, 8))
    same = coded.join(clean.select(F.col("doc_id").alias("d"), F.sha2("text", 256).alias("s")), F.col("d").eqNullSafe(F.col("doc_id"))).where("s = decoded_sha256")
    assert same.count() == coded.count() == clean.count()


def test_simhash_links_of_the_stage(spark, monkeypatch):
    """The stage's links come from SimHashes within DISTANCE bits, confirmed with whole sets, as brute force gives them; the exact way adds what is left."""
    asked, confirmed = [], []
    links, confirm = simhash.links, jaccard.fingerprint_links

    def spied(prints, distance, col):
        asked.append(distance)
        return links(prints, distance, col)

    def kept(sets, *rest):
        held = {r["node"]: (r["print"] & (1 << 64) - 1, frozenset(np.frombuffer(r["held"], np.uint64).tolist())) for r in sets.collect()}
        confirmed.append((held, materialize(confirm(sets, *rest))))
        return confirmed[-1][1]

    monkeypatch.setattr(simhash, "links", spied)
    monkeypatch.setattr(jaccard, "fingerprint_links", kept)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.dedup_near(spark, df, "").collect())
    assert got == sorted(set(groups(rows))) and asked == [jaccard.DISTANCE]
    held, near = confirmed[0]
    want, missed = [], 0
    for a, (x, s) in held.items():
        for b, (y, t) in held.items():
            if a < b and 10 * len(s & t) >= 8 * len(s | t):
                if (x ^ y).bit_count() <= jaccard.DISTANCE:
                    want.append((a, b))
                else:
                    missed += 1
    assert want and missed
    brute = spark.createDataFrame(want, "a long, b long")
    assert sorted(map(tuple, components(near).collect())) == sorted(map(tuple, components(brute).collect()))
    for r in near.collect():
        assert 10 * len(held[r["a"]][1] & held[r["b"]][1]) >= 8 * len(held[r["a"]][1] | held[r["b"]][1])
    for x, s in held.values():
        assert x == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s))


def test_buckets_leave_out_what_is_linked():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, 300, np.uint64)
    sets = [np.unique(base[i:i + 260]) for i in range(4)]
    given = np.array([len(x) for x in sets]), [jaccard.sketch(x) for x in sets], 4, 5
    assert jaccard.possible_links(*given, np.zeros(4, np.int64)) == []
    assert {frozenset(x) for x in jaccard.possible_links(*given, np.array([7, 7, 7, 9]))} == {frozenset((0, 3)), frozenset((1, 3)), frozenset((2, 3))}
