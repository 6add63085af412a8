import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rillwork.llm import quality_cnn
from rillwork.llm.quality_cnn import CHUNK, FILTERS, WIDTH, Model

from .conftest import BASE


def model(seed=1):
    rng = np.random.default_rng(seed)
    return Model(rng.normal(0, 1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 1, FILTERS).astype(np.float32), rng.normal(0, 1, 2 * FILTERS).astype(np.float32), 0.1)


def slow_score(m, data):
    n = (len(data) + WIDTH - 1 + CHUNK - 1) // CHUNK
    padded = data + bytes(n * CHUNK + WIDTH - 1 - len(data))
    chunks = []
    for k in range(n):
        rows = [sum(m.tables[w][padded[k * CHUNK + i + w]].astype(float) for w in range(WIDTH)) for i in range(CHUNK)]
        chunks.append(np.maximum(np.max(rows, axis=0) + m.bias, 0))
    x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(x @ m.weights + m.offset)))


def test_scores_equal_a_plain_network():
    rng = random.Random(3)
    texts = [b"", b"a", *(bytes(rng.randrange(256) for _ in range(n)) for n in (3, CHUNK - WIDTH, CHUNK - WIDTH + 1, CHUNK, CHUNK + 1, 900))]
    got = quality_cnn.predict(model(), texts)
    assert np.allclose(got, [slow_score(model(), t) for t in texts], atol=1e-4)
    assert np.allclose(got, [quality_cnn.predict(model(), [t])[0] for t in texts], atol=1e-6)


def corpus(n):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 7)))
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randrange(20, 200))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return rows


def test_learns_and_keeps_the_held_out_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "STEPS", 120)
    rows = corpus(240)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, y if i not in held else 1 - y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    m = quality_cnn.fit(docs, labels)  # labels of held-out rows are wrong here, and must not matter
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score(docs, m).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if i in held]
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)
    again = quality_cnn.fit(docs.repartition(5), labels)
    assert np.array_equal(again.tables, m.tables) and again.offset == m.offset


def test_edge_cases(spark, docs, no_docs, picked):
    labels = spark.createDataFrame([(0, 1), (6, 1)], "doc_id long, quality int")
    one = quality_cnn.fit(docs, labels)  # a single label
    scored = quality_cnn.score(docs.withColumns({"score": F.lit("x"), "row": F.lit(1), "a.b": F.lit(2)}), one)
    assert scored.count() == len(BASE) and {round(r["score"], 6) for r in scored.collect()} == {0.99}
    none = quality_cnn.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality_cnn.score(docs, none).collect()} == {0.5}
    assert quality_cnn.score(no_docs, one).count() == 0
    assert picked(docs.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("h")), "doc_id", "h") == sorted([(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in BASE], key=repr)
    assert all(0 <= r["score"] <= 1 for r in quality_cnn.score(docs, model()).collect())


def test_gradient_is_exact():
    """Against finite differences, for every kind of parameter, on texts of one chunk and of several."""
    rng = np.random.default_rng(8)
    docs = [quality_cnn.windows_of(bytes(rng.integers(97, 105, n).astype(np.uint8))) for n in (0, 100, 3 * CHUNK, 40 * CHUNK + 7)]
    labels = np.array([0.0, 1, 1, 0])
    params = [rng.normal(0, 0.5, (WIDTH, 256, FILTERS)), rng.normal(-1, 1, FILTERS), rng.normal(0, 1, 2 * FILTERS), np.array([0.2])]
    _, grads = quality_cnn.gradients(params, docs, labels)
    for p, g in zip(params, grads, strict=True):
        places = [np.unravel_index(k, p.shape) for k in (np.argsort(-np.abs(g).ravel())[:12].tolist() + rng.integers(0, p.size, 8).tolist())]
        for at in places:
            held, step = p[at], 1e-6
            losses = []
            for sign in (1, -1):
                p[at] = held + sign * step
                losses.append(quality_cnn.gradients(params, docs, labels)[0])
            p[at] = held
            assert abs((losses[0] - losses[1]) / (2 * step) - g[at]) < 1e-6, (p.shape, at)


def test_training_reads_whole_texts(spark):
    """What tells the labels apart stands at the end of long texts only."""
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(n))
    rows = [(i, filler(3000) + (" QQQQ!!" if i % 2 else " end of it"), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = quality_cnn.sample(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    by_text = {t.encode(): y for _, t, y in rows}
    assert len(found) > 50 and all(by_text[t] == y for t, y in found)
    assert sum(len(quality_cnn.windows_of(t)) for t, _ in found) >= sum(len(t) // CHUNK for t, _ in found)


def test_sample_is_bounded_and_uniform(spark):
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))  # one id in all rows
    docs = docs.unionByName(docs).unionByName(spark.createDataFrame([(2, None), (3, "x" * 5000), (4, "y")], "doc_id int, text string"))
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 1)] + [(2, 0), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    found = quality_cnn.sample(docs, labels, max_rows=200, max_text=4000)
    assert len(found) == 200 and len(set(found)) == 200 and (b"x" * 5000, 1) not in found
    numbers = [int(t[5:]) for t, _ in found if t.startswith(b"text ")]
    assert 1200 < sum(numbers) / len(numbers) < 1800
    few = quality_cnn.sample(docs, labels, max_bytes=100)
    assert few == quality_cnn.sample(docs.repartition(7), labels)[:len(few)] and 0 < sum(len(t) for t, _ in few) <= 100
    none = quality_cnn.sample(docs.where("false"), labels)
    assert none == [] and quality_cnn.sample(docs, labels.where("false")) == []
