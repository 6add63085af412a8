import random
import re

from pyspark.sql import functions as F

from rillwork.llm import phrase_index

from .conftest import BASE

ITEMS = [(0, "quick brown fox jumps over the lazy dog near"), (1, "second LINE second-line"), (2, ""), (3, None), (4, "again"), (5, "word7 the word8 the word9 the word10 the word11 the"),
         (6, "and again and again and again"), (10, "text second"), (6, "and again and again and again"), (12, "absent words here")]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def expected(docs, items, size):
    wins = {(str(i), tuple(w[k:k + size])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - size + 1))}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), len(found) >= 2))
    return sorted(out, key=repr)


def result(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in found.collect()), key=repr)


def test_contamination(spark, docs, no_docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plain = [(i, t) for i, t, _, _ in BASE]
    for size in (3, 8):
        assert result(phrase_index.contamination(docs, items, size)) == expected(plain, ITEMS, size)
    assert phrase_index.contamination(no_docs, items).count() == 0
    none = phrase_index.contamination(docs, items.where("false"))
    assert result(none) == expected(plain, [], 8)
    clash = docs.withColumns({"pos": F.lit(1), "tid": F.lit(2), "term": F.lit("x"), "_row": F.lit(0), "wid": F.lit(0)})
    assert result(phrase_index.contamination(clash, items.withColumn("wid", F.lit(7)))) == expected(plain, ITEMS, 8)
    import rillwork.llm.common as common
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert result(phrase_index.contamination(docs, items)) == expected(plain, ITEMS, 8)
    assert result(phrase_index.contamination(docs, items, slop=2)) == expected(plain, ITEMS, 8)


def near_by_hand(docs, phrase, slop):
    """From the definition: occurrences of the anchor with every other word at most ``slop`` words from its place."""
    texts = [words(t) for _, t in docs]
    phrase = words(phrase)
    often = {w: sum(t.count(w) for t in texts) for w in phrase}
    if not all(often.values()):
        return []
    a = min(range(len(phrase)), key=lambda k: (often[phrase[k]], k))
    out = []
    for (d, _), t in zip(docs, texts, strict=True):
        for at in [k for k, w in enumerate(t) if w == phrase[a]]:
            if all(any(w == phrase[k] and abs(p - (at + k - a)) <= slop for p, w in enumerate(t)) for k in range(len(phrase)) if k != a):
                out.append((d, at - a + 1))
    return sorted(out)


def test_proximity(spark):
    rng = random.Random(4)
    rows = [(0, "alpha x beta y y gamma"), (1, "alpha beta gamma"), (2, "gamma beta alpha"), (3, "alpha x x x beta gamma"), (4, "alpha beta"), (5, None), (6, "gamma gamma beta beta alpha")]
    rows += [(10 + i, " ".join(rng.choice("alpha beta gamma delta x y z".split()) for _ in range(rng.randrange(60)))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = phrase_index.PositionalIndex(docs, None)
    for phrase in ("alpha beta gamma", "delta alpha", "beta", "x y x z", "absent alpha"):
        phrases, _ = phrase_index.windows(spark.createDataFrame([(0, phrase)], "item_id long, text string"), 4)
        for slop in (0, 1, 4, 20):
            found = index.near(phrases, slop) if slop else index.exact(phrases)
            got = sorted((r["_id"], r["start"]) for r in found.join(index.rows, "_row").select("_id", "start").collect())
            assert got == near_by_hand(rows, phrase, slop), (phrase, slop)
        close, exact = index.both(phrases, 1)
        assert close.count() == len(near_by_hand(rows, phrase, 1)) and exact.count() == len(near_by_hand(rows, phrase, 0))


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(0, "Keep This, then the QUICK brown fox; and on."), (1, "the quick brown fox"), (2, "...clean...")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "The quick brown fox")], "item_id long, text string")
    found = phrase_index.contamination(docs, items).join(docs, "doc_id")
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(phrase_index.without_spans(F.col("text"), F.col("spans"))).alias("t")).collect()}
    assert got == {0: "Keep This, then; and on.", 1: "", 2: "...clean..."}
