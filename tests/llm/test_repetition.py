import random

import numpy as np
from pyspark.sql import functions as F

from rillwork.llm import repetition

from .conftest import BASE


def spans_by_hand(t):
    out = []
    for i in range(len(t)):
        best = 0
        for j in range(len(t)):
            k = 0
            while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_spans_equal_brute_force():
    rng = random.Random(0)
    for _ in range(400):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(14))] for _ in range(rng.randrange(1, 5))]
        tokens = np.array([x for t in texts for x in t], np.int64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        assert repetition.lcp_spans(tokens, of).tolist() == [s for t in texts for s in spans_by_hand(t)]


def measured(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    spans = spans_by_hand(words)
    held = lambda least: {p for i, s in enumerate(spans) if s >= least for p in range(i, i + s)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held(3)), max(spans, default=0), sum(len(words[p]) for p in held(5)))


def test_columns_and_edge_cases(docs, no_docs, picked):
    docs = docs.where("n_chars is null or n_chars < 20000")
    got = picked(repetition.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "covered_chars")
    assert got == sorted([(i, *measured(t or "")) for i, t, _, _ in BASE if len(t or "") < 20000], key=repr)
    assert repetition.quality_rules(no_docs).count() == 0
    clash = docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(-1))
    assert picked(repetition.quality_rules(clash), "doc_id", "n_words") == picked(repetition.quality_rules(docs), "doc_id", "n_words")


def test_verdict(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = [word() for _ in range(200)]
    long_repeat = [*clean, *clean[:61]]
    covered = clean[:20] + [w for _ in range(6) for w in clean[100:106]] + clean[:20]
    docs = spark.createDataFrame([(0, " ".join(clean)), (1, " ".join(long_repeat)), (2, " ".join(covered)), (3, " ".join(clean[:49])), (4, " ".join(clean[:5] * 20)), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition.quality_rules(docs).collect()}
    assert got[0] == (False, True) and got[1] == (False, False) and got[2][1] is False
    assert got[3] == got[4] == got[5] == (True, False)
    got = {r["doc_id"]: r["kept"] for r in repetition.quality_rules(docs, max_longest=61, max_covered_percent=50).collect()}
    assert got[1]
