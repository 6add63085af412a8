"""Near copies: SimHash links of word shingles confirmed by exact Jaccard similarity, and an exact way for what they miss.

Each set of shingles has a SimHash, and links within DISTANCE bits come from ``simhash.links`` (partitions by the
generalised pigeonhole principle). Each is confirmed with the whole sets. No distance that partitions can search reaches
every pair of a similarity of p / q, so what the confirmed links leave apart goes on: shingles are hashed to 64 bits
and ordered by hash. Two sets of a similarity of p / q or more share a hash among the first n - ceil(n p / q) + 1 of
each, so sets that share none there are never compared, and no link is missed. In buckets of one hash that hold sets of
two classes or more, sizes and parity sketches (whose differing bits are never more than the elements that differ) give
a spanning forest of possible links between classes. The groups it connects are then swept with the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, ship_code, small
from .components import components
from .word_cache import let_go, text_blocks

#: Least bits of a sketch; a larger set has as many bits as elements or more, so unrelated ones always differ in enough.
SKETCH_BITS = 512
#: Bits by which the fingerprints of a SimHash link differ at most.
DISTANCE = 8
#: Nodes that a task remembers, so as not to write their sets again.
KNOWN_NODES = 1_000_000


def shingles(text: str, width: int) -> np.ndarray:
    """The different hashes of ``width`` consecutive words, ascending; of fewer words, the one of them all."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh3_64_intdigest(line)], np.uint64)
    ends = np.fromiter(map(len, words), np.int64, n).cumsum() + np.arange(n)
    starts = [0, *(ends[:n - width] + 1).tolist()]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(line[i:j]) for i, j in zip(starts, ends[width - 1:].tolist(), strict=True)], np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """For each value of the hash modulo the bits (a power of two), whether an odd number of hashes has it."""
    bits = max(SKETCH_BITS, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among 0 to n - 1; ``near(i, others)`` says which others link to i."""
    left, out = np.arange(n), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            ok = near(at, left)
            if ok.any():
                got = left[ok].tolist()
                out += [(at, x) for x in got]
                front += got
                left = left[~ok]
    return out


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of words) of the same sets with fewer bits."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def possible_links(sizes: np.ndarray, sketches: list[bytes], p: int, q: int, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of what may link by size and sketch; sets of one class, which are linked already, are not compared."""
    widths = np.array([len(x) // 8 for x in sketches], np.int64)
    drawn, place = {}, np.zeros(len(sizes), np.int64)
    for w in np.unique(widths).tolist():
        of = np.flatnonzero(widths == w)
        place[of] = np.arange(len(of))
        drawn[w] = np.frombuffer(b"".join(sketches[i] for i in of.tolist()), np.uint64).reshape(len(of), w)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        a, b = sizes[at], sizes[others]
        ok = q * np.minimum(a, b) >= p * np.maximum(a, b)
        if classes is not None:
            ok &= classes[others] != classes[at]
        for w in np.unique(widths[others[ok]]).tolist():
            of = np.flatnonzero(ok & (widths[others] == w))
            least = min(w, int(widths[at]))
            own = folded(drawn[int(widths[at])][place[at]][None], least)
            differ = np.bitwise_count(folded(drawn[w][place[others[of]]], least) ^ own).sum(axis=1, dtype=np.int64)
            ok[of] = (p + q) * differ <= (q - p) * (a + b[of])
        return ok

    return forest(len(sizes), near)


def true_links(sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of similarity p / q or more among sets of one element or more."""
    sizes = np.array([len(s) for s in sets], np.int64)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        own, b = sets[at], sizes[others]
        ok = q * np.minimum(len(own), b) >= p * np.maximum(len(own), b)
        if ok.any():
            b = b[ok]
            flat = np.concatenate([sets[i] for i in others[ok].tolist()])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(b) - b, dtype=np.int64)
            ok[ok] = (p + q) * both >= p * (len(own) + b)
        return ok

    return forest(len(sets), near)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The rows of each value of the first column, as lists of columns; equal values follow one another."""
    at, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = columns[0]
        cuts = [0, *(np.flatnonzero(np.diff(np.array(keys, np.int64))) + 1).tolist(), len(keys)] if keys else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held is not None and keys[i] == at:
                for h, c in zip(held, columns, strict=True):
                    h += c[i:j]
                continue
            if held is not None:
                yield held
            at, held = keys[i], [c[i:j] for c in columns]
    if held is not None:
        yield held


def _edges(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Links as batches, each once in a batch."""
    rows: set[tuple[int, int]] = set()
    for a, b in found:
        rows.add((a, b) if a < b else (b, a))
        if len(rows) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b"])
            rows = set()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b"])


def fingerprint_links(sets: DataFrame, p: int, q: int, distance: int) -> DataFrame:
    """(a, b): nodes whose SimHashes are equal or linked within ``distance`` bits and whose sets have a similarity of p / q or more.

    ``sets`` has node, n (over 0), print and held, a node perhaps more than once. Fingerprints that several sets have are told apart by the least node."""
    known = materialize(sets.groupBy("node").agg(F.first("print").alias("value")))
    prints = materialize(known.groupBy("value").agg(F.min("node").alias("least")))
    found = small(materialize(simhash.links(prints, distance, "value").distinct()))
    ends = [prints.select(F.col("value").alias(c), F.col("least").alias(f"{c}_node")) for c in ("a", "b")]
    across = found.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    within = known.join(prints, "value").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = materialize(across.unionByName(within))
    ends = pairs.select(F.xxhash64("a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("node"))
    held = sets.select("node", "held").join(small(materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())), "node", "left_semi").dropDuplicates(["node"])
    dealt = ends.join(held, "node").select("pair", "node", "held").repartition("pair").sortWithinPartitions("pair", "node")
    return dealt.mapInArrow(_confirm(p, q), "a long, b long")


def _confirm(p: int, q: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """True links within the groups that the first column tells; then the node and its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            for _, nodes, held in _runs(batches):
                for i, j in true_links([np.frombuffer(x, np.uint64) for x in held], p, q):
                    yield nodes[i], nodes[j]

        yield from _edges(found())

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: str = "0.8", out_col: str = "component_id",
                distance: int = DISTANCE) -> DataFrame:
    """The id column of each row, with the least id reachable over links: pairs of texts whose sets of ``width``
    consecutive words (ASCII lower-cased, split at ASCII white space) have a Jaccard similarity of ``similarity`` or more.

    Texts with fewer words have one shingle of them all; texts without words are alike. Repeated rows stay. Links
    of SimHashes within ``distance`` bits are confirmed first, then every other link is found; only equal 64-bit hashes of different shingles could falsify one.
    """
    share = Fraction(similarity)
    p, q = share.numerator, share.denominator
    if not 0 < p <= q:
        raise ValueError("similarity must be over 0 and 1 at most")
    spark = docs.sparkSession
    ship_code(spark)
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A node for each row; its set with the first row of a task that has it."""
        let_go()
        seen: set[int] = set()
        for batch in batches:
            for s, texts in text_blocks(batch.column(1)):
                sets = [shingles(t, width) for t in texts]
                nodes = [xxhash.xxh3_64_intdigest(x) for x in sets]
                first = [x not in seen and not seen.add(x) for x in nodes]
                if len(seen) > KNOWN_NODES:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, len(sets)), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int32()),
                                                  pa.array(simhash.majority(np.concatenate(sets), np.array([len(x) for x in sets])).view(np.int64)),
                                                  pa.array([sketch(x) if f else None for x, f in zip(sets, first, strict=True)], pa.binary()),
                                                  pa.array([x.tobytes() if f else None for x, f in zip(sets, first, strict=True)], pa.binary())], names=["_id", "node", "n", "print", "sketch", "held"])

    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t")).mapInArrow(
        cut, f"_id {id_type}, node long, n int, print long, sketch binary, held binary"))
    sets = rows.where("held is not null").select("node", "n", "print", "sketch", "held")
    near = materialize(fingerprint_links(sets.where("n > 0"), p, q, distance))
    classes = small(materialize(components(near).select("node", F.col("root").alias("class"))))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, tokens = [], [], []
            for node, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and node not in seen:  # copies in one task give one set
                    seen.add(node)
                    hashes = np.frombuffer(held, np.int64)
                    tokens.append(hashes[:len(hashes) - -(-len(hashes) * p // q) + 1])
                    nodes.append(node)
                    sizes.append(len(tokens[-1]))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(nodes, np.int64), sizes))], names=["token", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of two sets or more. The rows of a token may go on in the next batch.

        Tokens that the very same sets have make one bucket, so it takes its name from the sets; a task tells it once."""
        rest, told = np.zeros((2, 0), np.int64), set()
        for batch in _then_none(batches):
            if batch is not None:
                rest = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
                if not rest.shape[1] or rest[0, 0] == rest[0, -1]:
                    continue
            end = rest.shape[1] if batch is None else int(np.searchsorted(rest[0], rest[0, -1]))
            now, rest = rest[:, :end], rest[:, end:]
            if end:
                now = now[:, np.r_[True, (now[:, 1:] != now[:, :-1]).any(axis=0)]]
                same = now[0, 1:] == now[0, :-1]
                now = now[:, np.r_[False, same] | np.r_[same, False]]
                starts = np.flatnonzero(np.r_[True, now[0, 1:] != now[0, :-1]]) if now.shape[1] else np.zeros(0, np.int64)
                names, kept = [], []
                for nodes in np.split(now[1], starts[1:]) if len(starts) else []:
                    name = xxhash.xxh3_128_intdigest(nodes.tobytes())
                    if name not in told:
                        if len(told) >= KNOWN_NODES:
                            told.clear()
                        told.add(name)
                        names.append(np.full(len(nodes), np.uint64(name & (1 << 64) - 1)).view(np.int64))
                        kept.append(nodes)
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(kept))], names=["token", "node"])

    dealt = sets.select("node", "held").mapInArrow(prefixes, "token long, node long").repartition("token").sortWithinPartitions("token", "node")
    tokens = materialize(dealt.mapInArrow(shared, "token long, node long").distinct())

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            for _, nodes, sizes, sketches, of in _runs(batches):
                for i, j in possible_links(np.array(sizes, np.int64), sketches, p, q, np.array(of, np.int64)):
                    yield nodes[i], nodes[j]

        yield from _edges(found())

    classed = materialize(tokens.join(classes, "node", "left").select("token", "node", F.coalesce("class", "node").alias("class")))
    mixed = materialize(classed.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("token"))
    apart = materialize(classed.join(small(mixed), "token", "left_semi"))
    drawn = sets.join(small(materialize(apart.select("node").distinct())), "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"])
    buckets = apart.join(drawn, "node").select("token", "node", "n", "sketch", "class").repartition("token").sortWithinPartitions("token")
    maybe = materialize(components(materialize(buckets.mapInArrow(bucket, "a long, b long"))))
    whole = sets.select("node", "held").join(small(maybe), "node").dropDuplicates(["node"]).select("root", "node", "held")
    found = whole.repartition("root").sortWithinPartitions("root").mapInArrow(_confirm(p, q), "a long, b long")
    linked = materialize(components(near.unionByName(materialize(found))))
    least = rows.groupBy("node").agg(F.min("_id").alias("_least"))
    at = materialize(least.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("_root"), "_least"))
    of = at.join(at.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias(out_col)), F.col("_root") == F.col("_r")).select(F.col("node").alias("_node"), out_col)
    return rows.join(of, F.col("node") == F.col("_node")).select(F.col("_id").alias(id_col), out_col)


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None
