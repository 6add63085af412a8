"""Line dedup with two kinds of Bloom filters: of lines seen once, and of lines seen twice.

Hashes of lines, 8 bytes each, go to owners of hash ranges. Each owner has a once-seen filter of its own range, and what comes
to it again, or was seen twice by a task already, is a suspect. The suspects, which are few, make the twice-seen filter that all tasks get.
Only lines that this filter holds are shuffled, as text, for an exact count of documents and the choice of the first occurrence. More lines than
the filters are made for cost more suspects, never a wrong result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, packed, schema_with, ship_code, unpacked
from .word_cache import blocks

#: Bits of the once-seen filters for each document, and the least and most bits of one (8 MB), of which there are MOST_RANGES at most.
BITS_PER_DOC, LEAST_BITS, MOST_BITS, MOST_RANGES = 256, 1 << 12, 1 << 26, 1 << 16
#: Bits of the twice-seen filter for each suspect, and its least and most bits (32 MB).
BITS_PER_SUSPECT, LEAST_TWICE, MOST_TWICE = 16, 1 << 16, 1 << 28
#: The filter travels in segments of so many bits. Hashes that a task has told to be repeated and keeps, so as not to tell them again.
SEGMENT, TOLD = 1 << 20, 200_000
#: Confirmed keys of at most so many bytes, as digests with their first places, are broadcast; more are joined.
BROADCAST_BYTES = 16 << 20
SALTS = 16


def keys_of(text: bytes) -> list[bytes]:
    """A key for each line: white space stripped at both ends, A-Z lower-cased (in bytes both mean ASCII only)."""
    return [x.strip() for x in text.lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


class Filter:
    """A Bloom filter of a power of two bits, two bits a hash."""

    def __init__(self, bits: int, held: bytes | None = None):
        self.bits = bits
        self.held = np.zeros(bits // 8, np.uint8) if held is None else np.frombuffer(held, np.uint8)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return (hashes & mask).astype(np.int64), (hashes >> np.uint64(22) & mask).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.held, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        a, b = ((self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in self.places(hashes))
        return a & b


def pow2(n: int, least: int, most: int) -> int:
    return 1 << (min(most, max(least, n)) - 1).bit_length()


def doc_hashes(texts: list[str], min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different keys of each text, the number of the text, and the hash."""
    keys, of = [], []
    for i, t in enumerate(texts):
        own = {k for k in keys_of(t.encode()) if long_enough(k, min_chars)}
        keys += own
        of += [i] * len(own)
    h = xxhash.xxh3_64_intdigest
    return keys, np.array(of, np.int64), np.fromiter((h(k) for k in keys), np.uint64, len(keys))


def repeated(docs: DataFrame, n_docs: int, min_chars: int, filter_bits: int | None = None) -> DataFrame:
    """(h): the hashes of all lines, from the text in the first column of ``docs``, that two documents have, and a few others."""
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_docs * BITS_PER_DOC // MOST_BITS))
    ranges = min(MOST_RANGES, ranges)
    bits = filter_bits or pow2(n_docs * BITS_PER_DOC // ranges, LEAST_BITS, MOST_BITS)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, np.uint64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for s in blocks(texts):
                seen, counts = np.unique(doc_hashes(texts[s], min_chars)[2], return_counts=True)
                new = ~np.isin(seen, told)
                seen, again = seen[new], counts[new] > 1
                told = np.union1d(told, seen[again]) if len(told) < TOLD else seen[again]
                owner = (seen >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16)
                yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array(seen.view(np.int64)), pa.array(again)], names=["owner", "h", "again"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once = -1, Filter(bits)
        for batch in batches:
            owners, hashes, again = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)] if len(owners) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if owners[i] != at:
                    at = owners[i]
                    once.held[:] = 0
                seen, of, counts = np.unique(hashes[i:j], return_inverse=True, return_counts=True)
                twice = (counts > 1) | (np.bincount(of, again[i:j], len(seen)) > 0) | once.holds(seen)
                once.add(seen)
                yield pa.RecordBatch.from_arrays([pa.array(seen[twice].view(np.int64))], names=["h"])

    dealt = docs.mapInArrow(tell, "owner int, h long, again boolean").repartition("owner").sortWithinPartitions("owner")
    return dealt.mapInArrow(own, "h long").distinct()


def twice_seen(hashes: DataFrame, bits: int) -> bytes:
    """The filter of the column h; ``bits`` / 8 bytes reach the driver."""
    size = min(SEGMENT, bits) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(bits)
        for batch in batches:
            f.add(batch.column(0).to_numpy().view(np.uint64))
        for k in range(0, bits // 8, size):
            if f.held[k:k + size].any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k // size], pa.int32()), "held": [zlib.compress(f.held[k:k + size], 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(size, np.uint8)
        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int32()), "held": [held.tobytes()]})
                    at, held = k, np.zeros(size, np.uint8)
                held |= np.frombuffer(zlib.decompress(x), np.uint8)
        if at is not None:
            yield pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int32()), "held": [held.tobytes()]})

    told = "segment int, held binary"
    merged = hashes.mapInArrow(fill, told).repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, told)
    out = bytearray(bits // 8)
    for r in merged.toLocalIterator():
        out[r["segment"] * size:(r["segment"] + 1) * size] = r["held"]
    return bytes(out)


def first_places(confirmed: DataFrame) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Digests in two halves, ascending, with the place and the line of each key's first occurrence."""
    table = confirmed.select("key", "place", "line").toArrow()
    halves = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    places, lines = (table.column(c).take(pa.array(order)) for c in ("place", "line"))
    pack = lambda c: c.to_pylist() if c.null_count or c.type in (pa.string(), pa.large_string()) else c.to_numpy()
    return halves[order, 0], halves[order, 1], pack(places), pack(lines)


def found_at(high: np.ndarray, low: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Where each digest (two halves) stands, or -1."""
    out = np.full(len(digests), -1, np.int64)
    if not len(high) or not len(digests):
        return out
    at = np.searchsorted(high, digests[:, 0])
    live = np.arange(len(digests))
    while len(live):  # more than once only where first halves are equal
        live = live[at[live] < len(high)]
        live = live[high[at[live]] == digests[live, 0]]
        same = low[at[live]] == digests[live, 1]
        out[live[same]] = at[live[same]]
        live = live[~same]
        at[live] += 1
    return out


_OUTPUT = {"n_lines": "long", "n_dropped": "long", "kept_text": "string"}


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first_by: str | None = None,
               filter_bits: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, long_words: int | None = None, copy_share: float | None = None) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, its lines without those of keys found in ``min_docs`` documents or more.

    A document is a row: repeated rows count as documents each, and a key counts once in a row however often it
    occurs there. Keys shorter than ``min_chars`` code points never count, so empty lines stay. A null
    or empty text is one empty line and stays an empty text. With ``keep_first_by``, the name of an integer or
    string column, the first occurrence of a key (least value there, then least line; of tied rows all) stays. With ``long_words``,
    two documents are enough for a key of more than so many words (between ASCII white space). With ``copy_share``, a row of which so large a
    share of the words, or more, would go is a copy rather than a text with a repeated passage: it keeps all its lines. Columns
    named as an output column are replaced, others pass through. An empty table gives an empty one.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    ship_code(spark)
    names = [c for c in docs.columns if c not in _OUTPUT]
    types = dict(docs.dtypes)
    place = column(keep_first_by) if keep_first_by else F.lit(0)
    rest = [c for c in names if c != text_col]
    held = docs.select(packed(rest), column(text_col).cast("string").alias("text"), place.alias("place"))
    rows = held.select("text", "place")
    hashes = materialize(repeated(held.select("text"), docs.count(), min_chars, filter_bits))
    bits = filter_bits or pow2(hashes.count() * BITS_PER_SUSPECT, LEAST_TWICE, MOST_TWICE)
    twice = spark.sparkContext.broadcast(twice_seen(hashes, bits))
    place_type = types[keep_first_by] if keep_first_by else "int"
    arrow_place = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[place_type]

    def suspected(each_line: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = Filter(bits, twice.value)
            for batch in batches:
                texts = [t or "" for t in batch.column(0).to_pylist()]
                places = batch.column(1).to_pylist()
                for s in blocks(texts):
                    keys, of, hashes = doc_hashes(texts[s], min_chars)
                    hit = seen.holds(hashes)
                    found: list[tuple] = []
                    wanted: dict[int, set[bytes]] = {}
                    for j in np.flatnonzero(hit).tolist():
                        wanted.setdefault(int(of[j]) + s.start, set()).add(keys[j])
                    for i, own in wanted.items():
                        raw = texts[i].encode()
                        if not (each_line or keep_first_by):
                            found += [(k, places[i], 0, b"") for k in own]
                            continue
                        digest = {k: hashlib.md5(k).digest() for k in own} if each_line else {k: k for k in own}
                        ident = xxhash.xxh3_128_digest(raw + b"\0" + repr(places[i]).encode())
                        met = set()
                        for n, k in enumerate(keys_of(raw)):
                            if k in own and (each_line or k not in met):
                                met.add(k)
                                found.append((digest[k], places[i], n, ident))
                    if found:
                        k, p, n, d = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(p, arrow_place), pa.array(n, pa.int32()), pa.array(d, pa.binary())], names=["key", "place", "line", "ident"])
        return run

    told = f"key binary, place {place_type}, line int, ident binary"
    found = rows.mapInArrow(suspected(False), told).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("place", "line")).alias("first"))
    enough = F.col("n") >= min_docs
    if long_words is not None:
        enough = enough | (F.col("n") >= 2) & (F.size(F.split(F.col("key").cast("string"), r"[\x20\x09-\x0D]+")) > long_words)
    # from here on a key is its digest of 128 bits
    confirmed = materialize(found.where(enough).select(F.unhex(F.md5("key")).alias("key"), "first.place", "first.line"))
    size = confirmed.agg(F.coalesce(F.sum(F.lit(32) + (F.coalesce(F.octet_length("place"), F.lit(0)) + 8 if place_type == "string" else 0)), F.lit(0)).alias("b")).first()["b"]
    schema = schema_with(held, ["row", "text"], _OUTPUT)

    def answer(batch: pa.RecordBatch, texts: list[str | None], drops: Callable[[int, list[bytes]], set[int]], s: slice) -> pa.RecordBatch:
        n_lines, n_dropped, kept = [], [], []
        for i in range(s.start, s.stop):
            raw = (texts[i] or "").encode()
            lines = raw.split(b"\n")
            gone = drops(i, lines)
            if gone and copy_share is not None:
                sizes = [len(x.split()) for x in lines]
                if sum(sizes[n] for n in gone) >= copy_share * sum(sizes):
                    gone = set()
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            kept.append(b"\n".join([x for n, x in enumerate(lines) if n not in gone]).decode() if gone else texts[i] or "")
        more = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(batch.slice(s.start, s.stop - s.start).columns[:2] + more, names=["row", "text", *_OUTPUT])

    def opened(found: DataFrame) -> DataFrame:
        columns = dict(zip(rest, unpacked(rest), strict=True)) | {text_col: F.col("text").alias(text_col)}
        return found.select(*[columns[c] for c in names], *_OUTPUT)

    if size <= broadcast_bytes:
        table = spark.sparkContext.broadcast(first_places(confirmed))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, (high, low, of, at) = Filter(bits, twice.value), table.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                places = batch.column(2).to_pylist()
                for s in blocks([t or "" for t in texts]):
                    keys, number, hashes = doc_hashes(texts[s] if None not in texts[s] else [t or "" for t in texts[s]], min_chars)
                    hit = np.flatnonzero(seen.holds(hashes))
                    digests = np.frombuffer(b"".join(hashlib.md5(keys[j]).digest() for j in hit.tolist()), ">u8").reshape(-1, 2).astype(np.uint64)
                    gone: dict[int, dict[bytes, int]] = {}
                    for j, k in zip(hit.tolist(), found_at(high, low, digests).tolist(), strict=True):
                        if k >= 0:
                            gone.setdefault(int(number[j]) + s.start, {})[keys[j]] = k

                    def drops(i: int, lines: list[bytes]) -> set[int]:
                        own = gone.get(i)  # noqa: B023
                        if not own:
                            return set()
                        return {n for n, x in enumerate(keys_of((texts[i] or "").encode())) if x in own and not (keep_first_by and (of[own[x]], at[own[x]]) == (places[i], n))}  # noqa: B023

                    yield answer(batch, texts, drops, s)

        return opened(held.mapInArrow(apply, schema))

    # Too many keys to broadcast: lines meet them in a join, salted since a key may be in very many lines.
    # What is dropped follows from a row's text (and place) alone, so a digest of these is enough to join back.
    salted = confirmed.select("key", F.col("place").alias("_fp"), F.col("line").alias("_fl"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    lines = rows.mapInArrow(suspected(True), told).dropDuplicates(["ident", "line"]).withColumn("_salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int"))
    gone = lines.join(salted, ["key", "_salt"])
    if keep_first_by:
        gone = gone.where(~(F.col("place").eqNullSafe(F.col("_fp")) & (F.col("line") == F.col("_fl"))))
    gone = materialize(gone.groupBy(F.col("ident").alias("of")).agg(F.collect_list("line").alias("gone")))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [xxhash.xxh3_128_digest((t or "").encode() + b"\0" + repr(p).encode()) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary())], names=["row", "text", "ident"])

    marked = held.mapInArrow(identify, schema_with(held, ["row", "text"], {"ident": "binary"}))
    joined = marked.join(gone, F.col("ident") == F.col("of"), "left").select("row", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for s in blocks([t or "" for t in texts]):
                yield answer(batch, texts, lambda i, _: set(lists[i] or ()), s)  # noqa: B023

    return opened(joined.mapInArrow(cut, schema))
