import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillwork.llm import quality_cnn
from rillwork.llm.common import materialize

from .test_line_dedup import expected as lines_by_hand
from .test_phrase_index import expected as hits_by_hand


@pytest.fixture()
def folder(spark, tmp_path, monkeypatch):
    """A small corpus: good and bad documents, copies, near copies, shared lines, passages of a benchmark."""
    monkeypatch.setattr(quality_cnn, "STEPS", 150)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [(i, sentence(12)) for i in range(4)]
    rows, passage = [], sentence(55)
    for i in range(150):
        text = "\n".join(sentence(12) for _ in range(rng.randrange(2, 8)))
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 11 == 1:
            text += "\nA line that very many have"
        elif i % 13 == 4:
            text += "\n" + passage
        elif i % 17 == 2:
            text += "\n" + items[0][1] + "\n" + items[1][1]
        elif i % 17 == 3:
            text += "\n" + items[2][1] + " and on"
        rows.append((i, text))
    rows += [(200 + k, rows[7][1]) for k in range(12)] + [(220, rows[8][1] + " end"), (230, None), (231, ""), (7, rows[7][1]), (None, sentence(40))]
    base = f"file://{tmp_path}"
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(150)], "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, items


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_equal_brute_force(spark, folder):
    base, items = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, base))
        steps.append(docs)
    good, lined, near, clean, coded = steps
    assert all(s.columns == columns for s in steps[:-1])
    assert all(s.where("n_chars != length(text)").count() == 0 for s in (lined, near, clean))
    # the classifier: planted bad documents go, good ones stay
    kept = {i for i, _ in pairs(good)}
    wrong = [i for i in range(150) if (i in kept) != (i % 5 > 0) and zlib.crc32(str(i).encode()) % 5]
    assert len(wrong) <= 3
    assert sorted(((i, t) for i, _, _, t in lines_by_hand(pairs(good), 10, 1, True, corpus_pipeline.LONG_WORDS, corpus_pipeline.COPY_SHARE)), key=repr) == sorted(pairs(lined), key=repr)
    # one row of each group
    rows = sorted(pairs(lined), key=lambda r: (r[0] is not None, r[0] or 0))
    from .test_jaccard import groups

    by_group = groups([(n, t) for n, (_, t) in enumerate(rows)])
    assert sorted(pairs(near), key=repr) == sorted({rows[n] for n in set(by_group)}, key=repr)
    hits = hits_by_hand(pairs(near), items, 8)
    gone = {h[0] for h in hits if h[5]}
    assert gone and {i for i, _ in pairs(clean)} == {i for i, _ in pairs(near)} - gone
    assert all(h[2] == 0 for h in hits_by_hand(pairs(clean), items, 8))
    untouched = {h[0] for h in hits if h[2] == 0}
    assert {r for r in pairs(clean) if r[0] in untouched} == {r for r in pairs(near) if r[0] in untouched}
    assert coded.count() == clean.count() and coded.where("octet_length(ids) != 4 * n_tokens").count() == 0
    same = coded.join(clean.select(F.col("doc_id").alias("d"), F.sha2("text", 256).alias("s")), F.col("d").eqNullSafe(F.col("doc_id"))).where("s = decoded_sha256")
    assert same.count() == coded.count()
    whole = corpus_pipeline.run(spark, base)
    assert sorted(map(repr, (tuple(r) for r in whole.drop("ids").collect()))) == sorted(map(repr, (tuple(r) for r in coded.drop("ids").collect())))


def test_empty_table(spark, folder):
    base, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, base))
        assert docs.count() == 0


def test_heavy_stages_begin_with_collected_heaps(spark, docs):
    """Else an executor holds the heap of the stage before beside the Python workers of this one."""
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if not any(x in b.getName() for x in ("Young", "Concurrent", "Scavenge", "Copy")))

    for stage in (corpus_pipeline.encode, corpus_pipeline.dedup_near):
        before = collections()
        stage(spark, docs, "")
        assert collections() > before
