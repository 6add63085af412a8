import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.llm import shards

from .conftest import BASE


def test_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n, draws = 7, 5, 6, 20_000
    seen = Counter(shards.hypergeometric(rng, good, bad, n) for _ in range(draws))
    for k in range(1, 7):
        p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
        assert abs(seen[k] / draws - p) < 0.015
    big = [shards.hypergeometric(rng, 10**11, 3 * 10**11, 10**7) for _ in range(50)]
    assert abs(sum(big) / 50 / (10**7 / 4) - 1) < 0.001
    assert shards.hypergeometric(rng, 0, 5, 3) == 0 and shards.hypergeometric(rng, 5, 0, 3) == 3


@pytest.mark.parametrize("urn", [10**9, 0])
def test_matrix(monkeypatch, urn):
    monkeypatch.setattr(shards, "NUMPY_URN", urn)
    m = shards.communication_matrix([5, 0, 9, 3], [6, 6, 5], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 3] and m.sum(axis=0).tolist() == [6, 6, 5] and (m >= 0).all()
    # two blocks of 2 and 3 rows, shards of 3 and 2: block 0 sends k rows to shard 0 with the hypergeometric chance
    seen = Counter(int(shards.communication_matrix([2, 3], [3, 2], s)[0, 0]) for s in range(4000))
    for k in range(3):
        assert abs(seen[k] / 4000 - math.comb(3, k) * math.comb(2, 2 - k) / math.comb(5, 2)) < 0.03
    with pytest.raises(ValueError):
        shards.communication_matrix([1], [2], 0)


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_shards_and_slots(spark, monkeypatch, cells):
    monkeypatch.setattr(shards, "PART_ROWS", 10)
    monkeypatch.setattr(shards, "MAX_CELLS", cells)  # fewer blocks than partitions
    even = spark.range(0, 1003, 1, 5)
    df = even.where("id < 900").unionByName(spark.range(900, 901, 1, 1)).unionByName(spark.range(901, 1003, 1, 3)).unionByName(spark.range(0, 0, 1, 2))  # uneven and empty partitions
    df = df.select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("slot"))
    got = shards.shard(df, 16).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 1003 and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    for k in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.collect())
    again = shards.shard(df, 16).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    # neighbours do not stay together
    place = {r["doc_id"]: r["shard"] for r in got if r["doc_id"] is not None}
    same = sum(place[i] == place[i + 1] for i in range(1, 1000, 3))
    assert same < 60


def test_all_rows_are_as_likely_anywhere(spark):
    """Where one row goes, over many seeds: each shard about as often."""
    df = spark.range(0, 12, 1, 3)
    seen = Counter(r["shard"] for s in range(24) for r in shards.shard(df, 3, seed=s).where("id = 4").collect())
    assert len(seen) == 3 and min(seen.values()) >= 2


def test_few_rows(docs, no_docs):
    got = shards.shard(docs, 16).collect()
    assert len(got) == len(BASE) and max(Counter(r["shard"] for r in got).values()) == 1 and all(r["slot"] == 0 for r in got)
    assert shards.shard(no_docs, 16).count() == 0 and shards.shard(no_docs, 16).columns[-2:] == ["shard", "slot"]
    one = shards.shard(docs, 1).collect()
    assert sorted(r["slot"] for r in one) == list(range(len(BASE)))
