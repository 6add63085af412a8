"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints of 64 bits link when they differ in few bits. The bits are put into partitions,
correlated ones together. If partition i may differ in t_i bits, with the sum of all t_i + 1 one
more than the allowed distance, every link agrees within t_i in some partition i. The t_i (-1: not
probed) are chosen by dynamic programming on the estimated number of candidates, and so is the number of
partitions. Each distinct fingerprint is put into the bucket of its value and of the values near it; buckets
are checked in numpy and give a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, packed, schema_with, ship_code, small, unpacked
from .components import components
from .word_cache import text_blocks

BITS, SEED, BLOCK = 64, 42, 4
#: Hashes whose bits are counted at once.
PIECE = 4_096
#: Cost of a probe row against one candidate check, in the same unit.
PROBE_COST, CHECK_COST = 100.0, 1.0
#: Buckets up to this many rows are checked by shifts, larger ones by a sweep; those of more than SPLIT_ROWS rows are divided among tasks first.
SMALL_BUCKET, SPLIT_ROWS = 32, 20_000


def fingerprints_of(texts: list[str], width: int) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is in more than half of the shingle hashes."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for t in texts:
        words = t.encode().lower().split()
        n = len(words)
        if n <= width:
            if n:
                hashes.append(digest(b" ".join(words), SEED))
            counts.append(1 if n else 0)
            continue
        line = b" ".join(words)
        ends = np.fromiter(map(len, words), np.int64, n).cumsum() + np.arange(n)
        starts = [0, *(ends[:n - width] + 1).tolist()]
        hashes += [digest(line[i:j], SEED) for i, j in zip(starts, ends[width - 1:].tolist(), strict=True)]
        counts.append(n - width + 1)
    return majority(np.array(hashes, "<u8"), np.array(counts, np.int64))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits that more than half of them have; of no hashes: zero. Their bits are spread PIECE hashes at a time."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    ends = counts[full].cumsum()
    ones = np.zeros((len(full), BITS), np.int32)
    for s in range(0, len(hashes), PIECE):
        now = np.ascontiguousarray(hashes[s:s + PIECE], "<u8")
        bits = np.unpackbits(now.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(ends, s + len(now)))
        ones[first:last + 1] += np.add.reduceat(bits, np.r_[0, ends[first:last] - s], axis=0, dtype=np.int32)
    if len(full):
        out[full] = np.packbits(2 * ones.astype(np.int64) > counts[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint(docs: DataFrame, text_col: str = "text", width: int = 4, out_col: str = "fingerprint") -> DataFrame:
    """``docs`` without the text and with the fingerprint as a long. No words (null or empty text): zero."""
    ship_code(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, out_col)]
    rows = docs.select(packed(kept), column(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, texts in text_blocks(batch.column(1)):
                found = fingerprints_of(texts, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, len(found)), pa.array(found)], names=["row", "print"])

    return rows.mapInArrow(run, schema_with(rows, ["row"], {"print": "long"})).select(*unpacked(kept), F.col("print").alias(out_col))


# --- partitions and thresholds ---------------------------------------------------------------------------


def bits_of(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(agree: np.ndarray) -> list[list[int]]:
    """Bits in blocks of BLOCK: each block starts with the free pair of the greatest correlation and takes what is closest to it."""
    free, out = set(range(BITS)), []
    strength = np.abs(agree).astype(float)
    np.fill_diagonal(strength, 0)
    while free:
        left = sorted(free)
        inner = strength[np.ix_(left, left)]
        i, j = np.unravel_index(int(inner.argmax()), inner.shape)
        block = sorted({left[i], left[j]})
        while len(block) < BLOCK:
            rest = [b for b in left if b not in block]
            block.append(max(rest, key=lambda b: (strength[b, block].sum(), -b)))
        free -= set(block)
        out.append(block)
    return out


def distance_shares(histogram: np.ndarray) -> np.ndarray:
    """The share of pairs at each distance from 0 to BLOCK, from the counts of a block's 2 ** BLOCK values (by a Walsh transform)."""
    x = histogram.astype(float)
    size = len(x)
    h = 1
    y = x.copy()
    while h < size:
        y = y.reshape(-1, 2, h)
        y = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(-1)
        h *= 2
    y = y * y
    h = 1
    while h < size:
        y = y.reshape(-1, 2, h)
        y = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(-1)
        h *= 2
    weight = np.array([int(v).bit_count() for v in range(size)])
    pairs = np.bincount(weight, weights=y / size, minlength=BLOCK + 1)
    return np.maximum(pairs, 0) / max(1.0, x.sum() ** 2)


def plan(n: int, shares: list[np.ndarray], distance: int) -> list[tuple[list[int], int]]:
    """Partitions as lists of block numbers, each with its threshold (-1: not probed), of the least estimated cost."""
    blocks_n = len(shares)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, min(blocks_n, distance + 1) + 1):
        sizes = [blocks_n // m + (i < blocks_n % m) for i in range(m)]
        at, parts = 0, []
        for k in sizes:
            parts.append(list(range(at, at + k)))
            at += k
        costs = []
        for part in parts:
            law = np.ones(1)
            for b in part:
                law = np.convolve(law, shares[b])[: distance + 2]
            near, width = np.cumsum(law), BLOCK * len(part)
            costs.append([0.0] + [n * PROBE_COST * (1 + sum(comb(width, k) for k in range(1, t + 1)) / 2) + n * n * near[min(t, len(near) - 1)] / 2 * CHECK_COST
                                  for t in range(distance + 1)])
        # least cost of giving out distance + 1 shares of t_i + 1
        table: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (distance + 1)
        for cost in costs:
            table = [min(((table[s - g][0] + cost[g], [*table[s - g][1], g - 1]) for g in range(s + 1)), key=lambda x: x[0]) for s in range(distance + 2)]
        if table[-1][0] < best[0]:
            best = table[-1][0], list(zip(parts, table[-1][1], strict=True))
    return best[1]


# --- buckets ---------------------------------------------------------------------------------------------


def extract(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for k, b in enumerate(bits):
        out |= (values >> b & 1) << k
    return out


def apart(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """The number of differing bits (of a negative number numpy counts the bits of its absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def sweep(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct values: what is reached is not compared again."""
    left, out = values, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = apart(left, at) <= distance
            if near.any():
                got = left[near]
                out.append((np.full(len(got), at), got))
                front.extend(got)
                left = left[~near]
    return out


def runs_of(bits: list[int], distance: int) -> list[list[int]]:
    """The bits outside a partition in distance + 1 runs: two values of one bucket that link are alike in one of them."""
    return [r.tolist() for r in np.array_split(np.array([b for b in range(BITS) if b not in set(bits)]), distance + 1)]


def shifted_links(keys: np.ndarray, values: np.ndarray, exact: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All links within runs of equal keys, for short runs; two probes are not compared."""
    out, at, d = [], np.arange(len(keys) - 1), 1
    while len(at):
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        a, b = values[at], values[at + d]
        ok = (apart(a, b) <= distance) & (exact[at] | exact[at + d]) & (a != b)
        if ok.any():
            out.append((a[ok], b[ok]))
        d += 1
    return out


def links(prints: DataFrame, distance: int = 4, col: str = "fingerprint") -> DataFrame:
    """(a, b): links between different values of the long column ``col`` of ``prints`` (distinct values), enough to
    connect whatever values within ``distance`` bits connect."""
    spark = prints.sparkSession
    ship_code(spark)
    prints = prints.select(F.col(col).alias("v"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            signs = bits_of(batch.column(0).to_numpy()).astype(np.float32) * 2 - 1
            total += signs.T @ signs
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(BITS * BITS)), "s": pa.array(total.ravel())})

    agree = np.zeros(BITS * BITS)
    for r in prints.mapInArrow(count, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():  # 4,096 numbers
        agree[r["k"]] = r["s"]
    n = int(agree[0])
    if n < 2 or not distance:
        return spark.createDataFrame([], "a long, b long")
    blocks_bits = grouped_bits(agree.reshape(BITS, BITS))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(blocks_bits), 1 << BLOCK), np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy()
            for i, bits in enumerate(blocks_bits):
                held[i] += np.bincount(extract(v, bits), minlength=1 << BLOCK)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(held.size)), "s": pa.array(held.ravel())})

    held = np.zeros(len(blocks_bits) << BLOCK)
    for r in prints.mapInArrow(tally, "k long, s long").groupBy("k").agg(F.sum("s").alias("s")).collect():  # 256 numbers
        held[r["k"]] = r["s"]
    layout = [([b for k in part for b in blocks_bits[k]], t) for part, t in plan(n, [distance_shares(h) for h in held.reshape(len(blocks_bits), -1)], distance) if t >= 0]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for s in range(0, len(whole), 2_000):
                v = whole[s:s + 2_000]
                for i, (bits, t) in enumerate(layout):
                    own = extract(v, bits)
                    yield rows(i, own, v, True)
                    for flips in range(1, t + 1):
                        for mask in map(sum, combinations([1 << k for k in range(len(bits))], flips)):
                            up = (own ^ mask) > own  # of two values one mask apart, the smaller one probes
                            yield rows(i, own[up] ^ mask, v[up], False)

    def rows(i: int, value: np.ndarray, v: np.ndarray, exact: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(v), i, np.int32)), "value": pa.array(value), "v": pa.array(v), "exact": pa.array(np.full(len(v), exact))})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(parts: list) -> pa.RecordBatch:
            a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})

        rest: list[tuple[np.ndarray, ...]] = []
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                key = batch.column(0).to_numpy().astype(np.int64) << 48 ^ batch.column(1).to_numpy()
                rest.append((key, batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)))
                if rest[0][0][0] == key[-1]:  # one bucket goes on
                    continue
            if not rest:
                continue
            key, v, exact = (np.concatenate(x) for x in zip(*rest, strict=True))
            cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))  # keys ascend; the last bucket may go on
            rest = [] if batch is None else [(key[cut:], v[cut:], exact[cut:])]
            key, v, exact = key[:cut], v[:cut], exact[:cut]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if cut else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, cut])
            found = []
            for k in np.flatnonzero(sizes > SMALL_BUCKET).tolist():
                found += sweep(np.unique(v[starts[k]:starts[k] + sizes[k]]), distance)
            few = np.repeat(sizes <= SMALL_BUCKET, sizes)
            found += shifted_links(key[few], v[few], exact[few], distance)
            if found:
                yield joined(found)

    divisions = [runs_of(bits, distance) for bits, _ in layout]

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row of a large bucket once for each run of the other bits, in the bucket of its value there too."""
        for batch in batches:
            part, value, v = (batch.column(k).to_numpy() for k in range(3))
            exact = batch.column(3)
            for p in np.unique(part).tolist():
                of = np.flatnonzero(part == p)
                for r, bits in enumerate(divisions[p]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), p + len(layout) * (r + 1), np.int32)), pa.array(value[of] << len(bits) | extract(v[of], bits)),
                                                      pa.array(v[of]), exact.take(pa.array(of))], names=["part", "value", "v", "exact"])

    told = "part int, value long, v long, exact boolean"
    buckets = prints.mapInArrow(spread, told)
    if all(len(bits) + max(map(len, runs)) < 48 for (bits, _), runs in zip(layout, divisions, strict=True)):  # else a bucket is all but a value
        crowd = materialize(buckets.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS).select(F.col("part").alias("p"), F.col("value").alias("x")))
        if crowd.limit(1).count():
            large = (F.col("part") == F.col("p")) & (F.col("value") == F.col("x"))
            buckets = buckets.join(small(crowd), large, "left_anti").unionByName(buckets.join(small(crowd), large, "left_semi").mapInArrow(divide, told))
    dealt = buckets.repartition("part", "value").sortWithinPartitions("part", "value")
    return dealt.mapInArrow(check, "a long, b long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4,
                    out: tuple[str, str] = ("fingerprint", "component_id")) -> DataFrame:
    """``docs`` without the text, with the fingerprint (16 hex digits) and the least id reachable over links.

    Texts without words have fingerprint zero and link like others. Rows of equal fingerprints are one node, however many they are, and are
    joined back with the node's one row. Repeated rows stay; null ids take part but are never a component's id unless all its ids are null.
    Columns named as an output column are replaced, others keep their names and values. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in (text_col, *out)]
    rows = docs.select(packed(kept), column(id_col).alias("id"), column(text_col).alias("text"))
    prints = materialize(fingerprint(rows, "text", width, "print"))
    nodes = materialize(prints.groupBy(F.col("print").alias("value")).agg(F.min("id").alias("least")))
    found = materialize(components(materialize(links(nodes, distance, "value"))))
    at = nodes.join(found, F.col("value") == F.col("node"), "left").select("value", F.coalesce("root", "value").alias("top"), "least")
    tops = at.groupBy(F.col("top").alias("of")).agg(F.min("least").alias("component"))
    of = at.join(tops, F.col("top") == F.col("of")).select("value", "component")
    joined = prints.join(of, F.col("print") == F.col("value"))
    return joined.select(*unpacked(kept), F.lower(F.lpad(F.hex("print"), 16, "0")).alias(out[0]), F.col("component").alias(out[1]))
