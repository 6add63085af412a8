"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The merge procedure gives each prefix of a piece one encoding, so one last token. For a prefix that
ends at byte i, the vocabulary entries that end there are read off an automaton of suffix links
over all entries; an entry t is the prefix's last token just when the last token of what precedes t
may stand before t, that is, when merging the two tokens' bytes gives these two tokens back. The
last token of every prefix is stored, and following them back from the end gives the exact ids.
Time is linear in the piece, however long.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, packed, schema_with, ship_code, unpacked
from .word_cache import WordCache, kept, text_blocks, trim


def byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary writes each byte: Latin-1's printable
    characters stand for themselves, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: What one model keeps at most: pairs tested, edges of tokens, and parts of texts in a generation of its cache (together about 60 MB).
PAIRS, EDGES, PARTS = 200_000, 10_000, 150_000


class PrefixBpe:
    """A byte-level BPE model from the JSON of the tokenizers library; ``pattern`` cuts the pieces.

    Merges must stand in training order (a pair after the merges that make its parts), as trained
    models have them.
    """

    def __init__(self, source: bytes, pattern: str):
        import ahocorasick
        import regex

        spec = json.loads(source)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        ids = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: to_bytes(t) for t, i in ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, made = (ids[a], ids[b]), ids[a + b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(made, (*pair, r))
        self.ids_of = {b: i for i, b in self.bytes_of.items()}
        self.specials: dict[str, int] = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"added token with matching rules: {t['content']}")
            self.specials[t["content"]] = t["id"]
        names = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.find = regex.compile(pattern).findall
        self.length = [0] * (max(self.bytes_of) + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, b in self.bytes_of.items():
            self.length[i] = len(b)
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.decoded = {**self.bytes_of, **{i: t.encode() for t, i in self.specials.items()}}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge (0: first, 1: last) of a token's bytes as it is merged, smallest first; with the rank of the merge that ends each."""
        kept = self.edges[side]
        if (found := kept.get(token)) is None:
            found, t, end = [], token, 1 << 60
            while True:
                found.append((t, end))
                if t not in self.parts:
                    break
                end = self.parts[t][2]
                t = self.parts[t][side]
            found.reverse()
            if len(kept) < EDGES:
                kept[token] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b: no merge across the border comes first."""
        left, right, rank = self.edge(a, 1), self.edge(b, 0), self.rank
        i = j = 0
        while True:
            x, x_ends = left[i]
            y, y_ends = right[j]
            across = rank.get((x, y))
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def stands(self, token: int) -> bool:
        """Whether a token's bytes are encoded as this token."""
        if (known := self.whole.get(token)) is None:
            if token in self.parts:
                a, b, _ = self.parts[token]
                known = self.stands(a) and self.stands(b)
                if known:
                    made_at = self.rank.pop((a, b))  # all but the last merge
                    known = self.may_follow(a, b)
                    self.rank[a, b] = made_at
            else:
                known = len(self.bytes_of[token]) == 1
            self.whole[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids_of.get(piece)
        if whole is not None and self.stands(whole):  # then it is the last token of the last prefix
            return [whole]
        n, length, pairs = len(piece), self.length, self.pairs
        last = array("i", [-1]) * (n + 1)
        for end, t in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            at = end - length[t]
            if at:
                before = last[at]
                if before < 0:
                    continue
                key = before << 24 | t
                ok = pairs.get(key)
                if ok is None:
                    ok = self.stands(t) and self.may_follow(before, t)
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    pairs[key] = ok
                if ok:
                    last[end] = t
            elif self.stands(t):
                last[end] = t
        out = []
        while n:
            t = last[n]
            if t < 0:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(t)
            n -= length[t]
        out.reverse()
        return out

    def encode(self, text: str) -> array:
        out = array("I")
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append(self.specials[part])
            elif part:
                for piece in self.find(part):
                    out.extend(self.encode_piece(piece.encode()))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.decoded.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_MODELS: dict[tuple, tuple[PrefixBpe, WordCache]] = kept()


def model(source: bytes, pattern: str, parts: int = PARTS) -> tuple[PrefixBpe, WordCache]:
    """One model and cache for each Python worker."""
    key = (hashlib.sha256(source).digest(), pattern, parts)
    if key not in _MODELS:
        bpe = PrefixBpe(source, pattern)
        _MODELS[key] = bpe, WordCache(lambda found: [bpe.encode(p).tobytes() for p in found], limit=parts)
    return _MODELS[key]


def encode(docs: DataFrame, tokenizer: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with a binary column of the text's ids as little-endian unsigned 32-bit integers.

    Special tokens' strings in a text become their ids, as the tokenizers library has it. A null or
    empty text has no ids. Repeated rows stay, other columns pass through; those named as an output
    column are replaced. With ``decoded_col`` the ids are also decoded to text again. Any text
    length works; the tokenizer file is read on the driver and broadcast (a few MB).
    """
    return _mapped(docs, tokenizer, pattern, text_col, ids_col, decoded_col, False)


def digests(docs: DataFrame, tokenizer: str, pattern: str, text_col: str = "text", ids_col: str | None = None, parts: int = PARTS) -> DataFrame:
    """As ``encode`` with decoding, but with n_tokens, ids_sha256 and decoded_sha256 in place of the texts, and with the ids only if ``ids_col`` names them.

    A worker keeps the ids of ``parts`` parts of texts in each of two generations, at about 200 bytes a part: more of them cost memory and save time."""
    return _mapped(docs, tokenizer, pattern, text_col, ids_col, None, True, parts)


def _mapped(docs: DataFrame, tokenizer: str, pattern: str, text_col: str, ids_col: str | None, decoded_col: str | None, digest: bool, parts: int = PARTS) -> DataFrame:
    spark = docs.sparkSession
    ship_code(spark)
    source = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    outputs = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digest else {}
    outputs |= {c: k for c, k in ((ids_col, "binary"), (decoded_col, "string")) if c}
    added = list(outputs)
    kept = [c for c in docs.columns if c not in added and not (digest and c == text_col)]
    rows = docs.select(packed(kept), column(text_col).cast("string").alias("text"))
    inner = {f"out{k}": kind for k, kind in enumerate(outputs.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = model(source.value, pattern, parts)
        for batch in batches:
            for s, texts in text_blocks(batch.column(1)):
                ids = cache.encode(texts)
                more = []
                if digest:
                    more = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                            pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids])]
                if ids_col:
                    more.append(pa.array(ids, pa.binary()))
                if decoded_col:
                    more.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), *more], names=["row", *inner])
        trim()

    found = rows.mapInArrow(run, schema_with(rows, ["row"], inner))
    return found.select(*unpacked(kept), *[F.col(k).alias(c) for k, c in zip(inner, outputs, strict=True)])
