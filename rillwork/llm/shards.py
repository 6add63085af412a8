"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The source blocks are the partitions that the rows lie in. How many rows of block p go to shard k is drawn from the
multivariate hypergeometric law, as a uniform permutation of all rows would send them. Each block
is permuted where it lies and cut by its row of the matrix, the pieces are exchanged, once, and each shard is permuted
again. The data path is DataFrame operations; the driver draws only the matrix, of MAX_CELLS numbers at most.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import json_table, materialize, packed, unpacked

#: Numbers of the matrix (blocks x shards; 32 MB are broadcast at most) and parts of all shards together.
MAX_CELLS, MAX_PARTS = 1 << 22, 1 << 20
#: Rows that a part of a shard should hold.
PART_ROWS = 20_000
#: Numpy draws from urns of fewer than so many balls.
NUMPY_URN = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw: how many of ``n`` taken without replacement are good, by inversion over all values of a probability that a double can hold."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = 40 + int(14 * math.sqrt(n * share * (1 - share)))
    at = np.arange(max(lo, mode - reach), min(hi, mode + reach) + 1, dtype=np.float64)
    k = at[:-1]
    log = np.r_[0.0, np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))]
    mass = np.cumsum(np.exp(log - log.max()))
    return int(at[min(len(at) - 1, np.searchsorted(mass, rng.random() * mass[-1], side="right"))])


def drawn(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows, taken at random from ``left[k]`` rows for each shard k, are for each shard."""
    if left.sum() < NUMPY_URN:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    rest, out = int(left.sum()), np.zeros_like(left)
    for k, have in enumerate(left.tolist()):
        rest -= have
        out[k] = hypergeometric(rng, have, rest, n) if rest else n
        n -= int(out[k])
    return out


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows sum to ``counts``, columns to ``sizes``; distributed as under a uniform permutation.

    The blocks are halved again and again, and each half's share of every shard is drawn at once."""
    if sum(counts) != sum(sizes):
        raise ValueError("counts and sizes differ")
    rng, rows = np.random.default_rng(seed), np.array(counts, np.int64)
    out = np.zeros((len(rows), len(sizes)), np.int64)
    todo = [(0, len(rows), np.array(sizes, np.int64))] if len(rows) else []
    while todo:
        lo, hi, left = todo.pop()
        if hi - lo == 1:
            out[lo] = left
            continue
        mid = (lo + hi) // 2
        first = drawn(rng, left, int(rows[lo:mid].sum()))
        todo += [(lo, mid, first), (mid, hi, left - first)]
    return out


def shard(df: DataFrame, n_shards: int = 16, seed: int = 7, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with an int shard and a long slot, gapless from 0 in each shard.

    All rows take part: null values, empty texts and repeated rows are rows like others, as rows
    and not their values are shuffled; so equal texts are no group here. Shard sizes differ by one
    at most; with fewer rows than shards some shards are empty. Input columns named as the two
    output columns are replaced, others keep their names and values. The permuted rows are written to the shared folder, so what
    follows stays the same when a task runs again; the same partitions of the same rows give the same result. A row finds
    its shard among n_shards bounds of its block.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    blocks = df.select(packed(kept)).coalesce(max(1, MAX_CELLS // n_shards))  # no exchange: neighbours are put together
    shuffled = blocks.withColumn("key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).sortWithinPartitions("key")
    # the number of the partition, and in the lower 33 bits the place in it
    rows = materialize(shuffled.select("row", F.monotonically_increasing_id().alias("at")))
    block, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    held = rows.groupBy(block.cast("int").alias("block")).agg(F.count("*").alias("n")).collect()  # a row for each block
    total = sum(r["n"] for r in held)
    if not total:
        return rows.select(*unpacked(kept), F.lit(0).alias(shard_col), F.lit(0).cast("long").alias(slot_col)).where("false")
    held.sort(key=lambda r: r["block"])
    sizes = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    ends = communication_matrix([r["n"] for r in held], sizes, seed).cumsum(axis=1)
    cuts = json_table(spark, (json.dumps({"block": r["block"], "ends": e.tolist()}) for r, e in zip(held, ends, strict=True)), "block int, ends array<bigint>")
    # The second permutation is the order of a 63-bit key; parts of equal key ranges number their rows apart.
    bits = max(0, min(math.ceil(math.log2(max(1, total / n_shards / PART_ROWS))), int(math.log2(max(1, MAX_PARTS / n_shards)))))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "at"), 1)
    target = F.size(F.filter("ends", lambda e: e <= place))
    placed = (rows.join(F.broadcast(cuts), block.cast("int") == F.col("block"))
              .select("row", "at", target.alias("shard"), key.alias("key"), (F.shiftright(key, 63 - bits) if bits else F.lit(0).cast("long")).alias("part")))
    ahead = Window.partitionBy("of").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(F.col("shard").alias("of"), F.col("part").alias("of_part")).agg(F.count("*").alias("n"))  # MAX_PARTS rows at most
               .withColumn("off", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "at")).cast("long") - 1)
    out = numbered.join(F.broadcast(offsets), (F.col("shard") == F.col("of")) & (F.col("part") == F.col("of_part")))
    return out.select(*unpacked(kept), F.col("shard").alias(shard_col), (F.col("off") + F.col("nth")).alias(slot_col))
