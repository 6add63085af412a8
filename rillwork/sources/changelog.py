"""Versioned change logs: op logs in, effective weighted deltas out, kept as Parquet by epoch."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import entries
from ..operators.relational import effective_ops
from ..operators.zset import consolidate

VERSION, EPOCH = "__version", "__epoch"


def effective_deltas(ops: DataFrame, key: Sequence[str], seq: str, present: Column | str, version: str = "version") -> DataFrame:
    """The ops that change something, with ``__w`` and their version: 1, 2, 3, ... in order of ``seq``.

    The version is a position in the whole log, which is numbered in ranges, not in one task.
    """
    found = entries(effective_ops(ops, key, seq, present), [seq], idx=version)
    return found.withColumn(version, F.col(version) + 1)


def read_ops(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """An op log or table in any format that Spark reads: parquet, orc, csv, json, jdbc."""
    return spark.read.format(form).options(**options).load(path) if form != "jdbc" else spark.read.format("jdbc").options(**options).load()


class DeltaLog:
    """Effective deltas under ``path``, one folder for each epoch, and a base that compaction has made of the oldest.

    What counts is the last whole commit file, of ``commits/<number>.json``: each is written under another name and then renamed, and an older one is
    never changed. So a crash at any point leaves the commit before it. Writing an epoch again that was not committed replaces it, so a repeated batch does no
    harm. Folders that a compaction has replaced stay until the compaction after it, for readers that still hold them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[int]:
        """The numbers of the commit files, the last one first."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def committed(self) -> dict:
        """{"base": epochs up to it are in the base, "base_path": ..., "epochs": [...], "old": folders that may go}."""
        for n in self._commits():
            text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/commits/{n}.json", wholetext=True).collect())
            try:
                return json.loads(text)
            except ValueError:  # not written to its end
                continue
        return {"base": -1, "base_path": None, "epochs": [], "old": []}

    def _commit(self, state: dict) -> None:
        found = self._commits()
        n = found[0] + 1 if found else 0
        fs, draft = self._fs(f"{self.path}/commits/{n}.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"{self.path}/commits/{n}.json")[1]):
            raise OSError(f"commit {n} of {self.path} could not be made: another writer?")
        for k in found[2:]:
            fs.delete(self._fs(f"{self.path}/commits/{k}.json")[1], False)

    def append(self, epoch: int, delta: DataFrame) -> bool:
        """Store an epoch's delta; False if it was committed before."""
        state = self.committed()
        if epoch <= state["base"] or epoch in state["epochs"]:
            return False
        delta.write.mode("overwrite").parquet(f"{self.path}/epoch-{epoch}")
        self._commit(state | {"epochs": [*state["epochs"], epoch]})
        return True

    def last(self) -> int:
        state = self.committed()
        return max([state["base"], *state["epochs"]])

    def deltas(self, after: int = -1) -> DataFrame | None:
        """All deltas of epochs after ``after``, with ``__epoch``; the base counts as its last epoch."""
        state = self.committed()
        parts = [self.spark.read.parquet(f"{self.path}/epoch-{e}").withColumn(EPOCH, F.lit(e)) for e in state["epochs"] if e > after]
        if state["base_path"] and state["base"] > after:
            parts.insert(0, self.spark.read.parquet(state["base_path"]).withColumn(EPOCH, F.lit(state["base"])))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def state(self) -> DataFrame | None:
        """The weighted set that all deltas add up to."""
        found = self.deltas()
        return None if found is None else consolidate(found.drop(EPOCH))

    def compact(self) -> None:
        """Put all committed epochs into a new base, where inserts and deletes have cancelled out."""
        state = self.committed()
        if not state["epochs"]:
            return
        last = max([state["base"], *state["epochs"]])
        base = f"{self.path}/base-{last}-{uuid.uuid4().hex}"
        self.state().write.parquet(base)
        now_old = [f"{self.path}/epoch-{e}" for e in state["epochs"]] + ([state["base_path"]] if state["base_path"] else [])
        self._commit({"base": last, "base_path": base, "epochs": [], "old": now_old})
        for folder in state.get("old", []):
            fs, p = self._fs(folder)
            fs.delete(p, True)
