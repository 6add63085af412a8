import hashlib
import random
import zlib
from array import array
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rillwork.llm import bpe, token_store
from rillwork.llm.word_cache import WordCache, blocks, cut

from .conftest import BASE

PARTS = ["a", "b", " ", "  ", "\n", "the", " the", "ing", "1", "23", "é", "ß", "'s", "'ll", "!", "###", "<|endoftext|>", "\t", "中", "😀", "\x85", "\xa0", "\x1c", "\u3000", "aaaa", "====", " '", "\r\n", "\u2028"]


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer[0])
    return t, lambda x: array("I", t.encode(x, add_special_tokens=False).ids).tobytes()


def test_both_encoders_equal_the_library(tokenizer, library):
    t, encode = library
    source = Path(tokenizer[0]).read_bytes()
    own = bpe.PrefixBpe(source, tokenizer[1])
    caches = [WordCache(lambda parts: [own.encode(p).tobytes() for p in parts], limit=40), token_store.library_cache(source)]
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(2500)]
    for k in range(0, len(texts), 100):
        want = [encode(x) for x in texts[k:k + 100]]
        for c in caches:
            assert c.encode(texts[k:k + 100]) == want
        assert [own.decode(x) for x in want] == [t.decode(list(array("I", x)), skip_special_tokens=False) for x in want]


def test_parts_that_end_in_white_space_stay_apart(tokenizer, library):
    texts = ["a '\r\n", "b <|endoftext|> c", "d\n<|endoftext|>", "e x\t", "f\ng\n", "h .\x85", "i <|endoftext|>"]
    for order in (texts, texts[::-1], texts * 2):
        token_store._CACHES.clear()
        assert token_store.library_cache(Path(tokenizer[0]).read_bytes()).encode(order) == [library[1](x) for x in order]


def test_each_prefix_has_the_one_last_token(tokenizer, library):
    own = bpe.PrefixBpe(Path(tokenizer[0]).read_bytes(), tokenizer[1])
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("aehinorst") for _ in range(rng.randrange(1, 14)))
        assert own.encode_piece(word.encode()) == list(array("I", library[1](word)))
        assert b"".join(own.bytes_of[i] for i in own.encode_piece(word.encode())) == word.encode()
    assert not any(not own.stands(i) for i in range(0, 50_000, 97))


def test_a_long_piece_is_linear(tokenizer, library):
    own = bpe.PrefixBpe(Path(tokenizer[0]).read_bytes(), tokenizer[1])
    for x in ("ab" * 30_000 + "a" * 30_000, "=" * 50_000):
        assert own.encode(x).tobytes() == library[1](x)


def whole(parts):
    return parts[0] + "".join(p if p[:1] == "\n" else " " + p for p in parts[1:])


def test_cutting():
    for x in ("", " ", "a", " a", "a ", "a b", "a  b c", "a\n b c", "a \nb", "a\tb c", "a\u3000 b c", "a b\nc d"):
        assert whole(cut(x)) == x
    for x in ("a\nb", "a\n\nb c", "\na b\n", "a\nb\n", "a\r\nb c\nd", "a.\nb\n c"):
        assert whole(cut(x)) == x
    assert cut("a  b c") == ["a  b", "c"] and cut("a.\nB c") == ["a.", "\nB", "c"] and cut("a\n\nb\tc\nd") == ["a\n\nb\tc", "\nd"]
    assert [range(10)[s] for s in blocks(["x" * 3] * 10, 7)] == [range(0, 2), range(2, 4), range(4, 6), range(6, 8), range(8, 10)]
    assert list(blocks([])) == []


def test_op5(docs, no_docs, tokenizer, library, picked):
    want = sorted([(i, len(library[1](t or "")) // 4, hashlib.sha256(library[1](t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in BASE], key=repr)
    clash = docs.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    for d in (docs, clash):
        assert picked(bpe.digests(d, *tokenizer), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    got = bpe.encode(docs, *tokenizer, ids_col="ids", decoded_col="back")
    assert got.where("not (back <=> coalesce(text, ''))").count() == 0 and got.count() == len(BASE)
    assert bpe.digests(no_docs, *tokenizer).count() == 0


def test_op4(spark, docs, no_docs, tokenizer, library, picked, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(docs.withColumn("part", F.lit("x")), path, tokenizer[0], end_id=2)
    got = picked(token_store.checksums(token_store.read(spark, path)), "doc_id", "start", "n_tokens", "ids_crc32")
    by = {}
    for i, t, _, _ in BASE:
        by.setdefault(i, []).append(library[1](t or "") + array("I", [2]).tobytes())
    start, want = 0, []
    for i in sorted(by, key=lambda x: (x is not None, x or 0)):
        for x in by[i]:
            want.append((i, start, len(x) // 4, zlib.crc32(x)))
            start += len(x) // 4
    assert got == sorted(want, key=repr)
    token_store.write(no_docs, f"{path}0", tokenizer[0], end_id=2)
    assert token_store.checksums(token_store.read(spark, f"{path}0")).count() == 0
    # the format: ids by dictionary, counts by deltas, and indexes for selective reads
    files = sorted(Path(f"{tmp_path}/store").glob("*.parquet"))
    meta = pq.ParquetFile(files[-1]).metadata
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    ids = next(c for p, c in columns.items() if p.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["part_start"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    plan = token_store.read(spark, path).where("doc_id = 4").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,4)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_other_tokenizers_are_refused(docs, tokenizer, tmp_path):
    import json

    spec = json.loads(open(tokenizer[0], "rb").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level"):
            token_store.write(docs, f"file://{tmp_path}/store", str(path), 2)


def test_pieces_without_the_short_cut(tokenizer, library, monkeypatch):
    """The prefix tables alone, also for pieces that are entries of the vocabulary."""
    own = bpe.PrefixBpe(open(tokenizer[0], "rb").read(), tokenizer[1])
    rng = random.Random(3)
    words = [b.decode() for b in list(own.bytes_of.values())[::97] if b.isascii() and b.decode().isprintable()] + ["".join(rng.choice("theinganor") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    own.ids_of = {}
    for w in words:
        for piece in own.find(w):
            assert own.encode_piece(piece.encode()) == list(array("I", library[1](piece)))


def test_workers_let_go_what_they_keep(tokenizer, library):
    from rillwork.llm import word_cache

    source = Path(tokenizer[0]).read_bytes()
    first = token_store.library_cache(source)
    assert token_store.library_cache(source) is first and token_store._CACHES
    word_cache.let_go()
    assert not token_store._CACHES and not bpe._MODELS
    assert token_store.library_cache(source).encode(["a b"]) == [library[1]("a b")]


def test_each_different_part_is_looked_up_once(tokenizer, library):
    """A block's words are numbered first, so the cache is asked once for each, however often they stand there."""
    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    asked = []
    cache = token_store.library_cache(Path(tokenizer[0]).read_bytes())
    cache.young = Counted(cache.young)
    texts = ["one two two one\nthree", "", "two", "one two three two two", "a  b", "\x00 \x00 two", "é\né"]
    assert cache.encode(texts * 3, b"end!") == [library[1](x) + b"end!" for x in texts * 3]
    assert asked.count("two") == 1 and asked.count("one") == 1 and asked.count("three") == 1
    assert cache.encode([]) == [] and cache.encode([""]) == [b""]


def test_a_column_is_cut_as_its_texts():
    import pyarrow as pa

    from rillwork.llm import word_cache

    rng = random.Random(6)
    texts = ["".join(rng.choice([*PARTS, " ", " ", "​", "\x00", "᠎", "ꀀ"]) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, ""]
    for kind in (pa.string(), pa.large_string()):
        parts, heads, inner = word_cache.cut_column(pa.array(texts, kind).slice(5))
        rows, at = parts.to_pylist(), [*heads.tolist(), len(parts)]
        assert [rows[i:j] for i, j in zip(at, at[1:], strict=False)] == [cut(t or "") for t in texts[5:]]
        assert sorted([*heads.tolist(), *inner.tolist()]) == list(range(len(rows)))


def test_a_word_is_one_part_with_and_without_a_sign(tokenizer, library):
    token_store._CACHES.clear()
    cache = token_store.library_cache(Path(tokenizer[0]).read_bytes())
    texts = ["x word word, word. word!", "x word,word , word.\nword; word's word?!", "x 3,000 é, Ünï. word,, word. <|endoftext|>. word:s", ", a", "a,", "", "x ª. ŵ ɐ, 中, é, á."]
    assert cache.encode(texts * 2) == [library[1](x) for x in texts * 2]
    assert {w for w in cache.young if w.startswith("word")} == {"word", "word's"}
    rng = random.Random(7)
    texts = ["x" + "".join(rng.choice([*PARTS, ",", ".", ";", ":", "?", "Word", "ö", " ", " "]) for _ in range(rng.randrange(25))) for _ in range(3000)]
    assert cache.encode(texts) == [library[1](x) for x in texts]
