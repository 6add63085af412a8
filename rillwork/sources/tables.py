"""Tables with a key, outside of the engine: rows are loaded, upserted and deleted by key, by hand or by a stream's epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.zset import W, consolidate, negate, same, weigh
from .changelog import DeltaLog


class KeyedTable:
    """A table under ``path`` with one row for each key, kept as a log of what each change takes away and brings.

    A change costs what it touches: the rows it replaces are found by a semi-join on the key, and only the difference is written. ``compact`` makes one
    base of all. A change with an ``epoch`` that was stored before does nothing, so a stream may repeat its batches. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str]):
        self.spark, self.key = spark, list(key)
        self.schema = spark.createDataFrame([], schema).schema
        self.log = DeltaLog(spark, path)

    def rows(self) -> DataFrame:
        state = self.log.state()
        return self.spark.createDataFrame([], self.schema) if state is None else state.select(*self.schema.names)

    def upsert(self, rows: DataFrame, epoch: int | None = None) -> bool:
        """Insert rows, or put them in the place of those with their key. Of rows that share a key the greatest stays."""
        new = rows.select(*self.schema.names)
        rest = [c for c in self.schema.names if c not in self.key]
        if rest:
            new = new.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("__r")).select(*self.key, "__r.*").select(*self.schema.names)
        else:
            new = new.distinct()
        return self._store(new, new, epoch)

    def delete(self, keys: DataFrame, epoch: int | None = None) -> bool:
        """Take away the rows with these keys."""
        return self._store(keys, None, epoch)

    def _store(self, keys: DataFrame, new: DataFrame | None, epoch: int | None) -> bool:
        done = self.log.last()
        if epoch is not None and epoch <= done:
            return False
        parts = [] if new is None else [weigh(new)]
        deltas = self.log.deltas()
        if deltas is not None:
            wanted = keys.select(*self.key).distinct()
            old = deltas.select(*self.schema.names, W)
            parts.append(negate(consolidate(old.join(wanted, same(old, wanted, self.key), "left_semi"))))
        delta = weigh(self.spark.createDataFrame([], self.schema)) if not parts else parts[0]
        for p in parts[1:]:
            delta = delta.unionByName(p)
        return self.log.append(done + 1 if epoch is None else epoch, consolidate(delta))

    def compact(self) -> None:
        self.log.compact()
