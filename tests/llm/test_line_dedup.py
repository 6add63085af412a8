import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.llm import line_dedup

from .conftest import BASE


def keys(text):
    return [x.strip(" \t\n\x0b\x0c\r") for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split("\n")]


def expected(rows, min_docs, min_chars, first=False, long_words=None, copy_share=None):
    where = {}
    for i, t in rows:
        for k in set(keys(t or "")):
            if len(k) >= min_chars:
                where.setdefault(k, []).append((i, keys(t or "").index(k)))
    common = {k for k, w in where.items() if len(w) >= min_docs or long_words and len(w) > 1 and len(k.encode().split()) > long_words}
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [k in common and not (first and min(where[k], key=order) == (i, n)) for n, k in enumerate(keys(t or ""))]
        sizes = [len(x.encode().split()) for x in lines]
        if copy_share and any(gone) and sum(n for n, g in zip(sizes, gone, strict=True) if g) >= copy_share * sum(sizes):
            gone = [False] * len(lines)
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


MORE = [(100 + i, f"Shared Line\nown line {i}\n  shared line\t\n\nsecond line\nÉ\n" + ("rare" if i < 2 else "")) for i in range(12)]


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("min_docs, min_chars, bits", [(2, 1, None), (3, 6, 64), (12, 1, 1 << 12)])
def test_both_ways_equal_brute_force(spark, picked, first, limit, min_docs, min_chars, bits):
    rows = [(i, t) for i, t, _, _ in BASE] + MORE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = line_dedup.line_dedup(df, min_docs=min_docs, min_chars=min_chars, keep_first_by="doc_id" if first else None, filter_bits=bits, broadcast_bytes=limit)
    assert picked(found, "doc_id", "n_lines", "n_dropped", "kept_text") == expected(rows, min_docs, min_chars, first)


def test_tables_and_columns(docs, no_docs, picked):
    clash = docs.withColumns({"n_lines": F.lit("x"), "key": F.lit(1), "place": F.lit(1), "ident": F.lit(1)})
    for limit in (1 << 20, 0):
        got = line_dedup.line_dedup(clash, min_docs=2, broadcast_bytes=limit)
        assert picked(got, "doc_id", "n_lines", "n_dropped", "kept_text") == expected([(i, t) for i, t, _, _ in BASE], 2, 1)
        assert {"key", "place", "ident", "lang"} <= set(got.columns)
    assert line_dedup.line_dedup(no_docs).count() == 0
    with pytest.raises(ValueError):
        line_dedup.line_dedup(docs, min_docs=1)


def test_filters_miss_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 64, 4000, np.uint64)
    f = line_dedup.Filter(1 << 14)
    f.add(hashes)
    assert f.holds(hashes).all()
    monkeypatch.setattr(line_dedup, "TOLD", 5)
    lines = [f"line {i % 700}" for i in range(1000)] + ["hot"] * 500
    docs = spark.createDataFrame([(x,) for x in lines], "text string").repartition(6)
    want = set(line_dedup.doc_hashes([f"line {i}\nhot" for i in range(300)], 1)[2].view(np.int64).tolist())
    for bits in (None, 64):  # a full filter suspects more
        found = {r["h"] for r in line_dedup.repeated(docs, 1500, 1, bits).collect()}
        assert want <= found and (bits or len(found) < len(want) + 60)
    few = line_dedup.repeated(docs, 1 << 40, 1, 1 << 12)  # as many ranges as there may be
    assert want <= {r["h"] for r in few.collect()}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_long_lines_of_two_documents(spark, limit):
    line = lambda n: "\t ".join(f"W{k}" for k in range(n))
    fifty, over = line(50), line(51)
    rows = [(1, f"a\n{over}\nb"), (2, f" {over.lower()} \nc\n{fifty}"), (3, f"{fifty}\n{over}\nd\n{over}"), (4, f"{line(60)}\n{line(60)}"), (None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.line_dedup(df, keep_first_by="doc_id", broadcast_bytes=limit, long_words=50).collect()}
    assert got == {1: rows[0][1], 2: f"c\n{fifty}", 3: f"{fifty}\nd", 4: rows[3][1], None: "e"}


def test_copies_are_left_whole(spark):
    """A row that would lose four fifths of its words keeps all lines; one that loses fewer does not."""
    over = " ".join(f"w{k}" for k in range(60))
    rest = lambda n, c: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, f"{over}\n{rest(30, 'a')}"), (2, f"{over}\n{rest(15, 'b')}"), (3, f"{over}\n{rest(16, 'c')}"), (4, over), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1 << 20, 0):
        got = {r["doc_id"]: (r["kept_text"], r["n_dropped"]) for r in line_dedup.line_dedup(df, keep_first_by="doc_id", broadcast_bytes=limit, long_words=50, copy_share=0.8).collect()}
        assert got == {1: (rows[0][1], 0), 2: (rows[1][1], 0), 3: (rest(16, "c"), 1), 4: (over, 0), 5: ("", 0)}
