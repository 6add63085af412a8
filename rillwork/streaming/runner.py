"""Epochs from a stream of ops: each micro-batch becomes one delta of a source, and the targets are read.

Built-in streaming aggregations take inserts only, so retractions go through ``foreachBatch``. The
batch number is the epoch. What it changes, with rows changed by hand before it, is worked out as one delta, which is stored in a delta log; only then
does the source take it in, and it is published. If any of this fails, what follows has not happened, and the batch can come again; a new process rebuilds the
pipeline from the log before it goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.zset import W
from ..plans.graph import Runtime
from ..plans.incremental import Source
from ..sources.changelog import DeltaLog

#: What a pipeline is given to build itself on, and what is done with each epoch.
Build = Callable[[Runtime, Source], dict]
Publish = Callable[[int, dict], None]


class Gauge:
    """Throughput as cells of a runtime: changes a second, over all the time that was told."""

    #: Shorter times are not shown: a rate over them would jump.
    LEAST_SECONDS = 0.1

    def __init__(self, runtime: Runtime, label: str = "throughput"):
        self.runtime = runtime
        self._n, self._seconds = 0, 0.0
        self.changes = runtime.create_input(0, f"{label}: changes")
        self.seconds = runtime.create_input(0.0, f"{label}: seconds")
        self.rate = runtime.create_query(lambda rt: rt.get(self.changes) / rt.get(self.seconds) if rt.get(self.seconds) else 0.0, f"{label}: changes a second")

    def add(self, changes: int, seconds: float) -> None:
        self._n += changes
        self._seconds += seconds
        if self._seconds > self.LEAST_SECONDS:
            self.runtime.set(self.changes, self._n)
            self.runtime.set(self.seconds, self._seconds)


class EpochRunner:
    """``build(runtime, source)`` makes the pipeline and gives its targets; ``publish(epoch, targets)`` reads and stores them.

    Publishing may happen again for the last epoch after a failure, so it should overwrite by epoch.
    """

    def __init__(self, spark: SparkSession, schema: StructType | str, log_path: str, build: Build, publish: Publish, key: list[str] | None = None, compact_every: int = 50):
        self.spark, self.publish, self.compact_every = spark, publish, compact_every
        self.runtime = Runtime(spark)
        self.source = Source(self.runtime, schema, key, label="stream")
        self.log = DeltaLog(spark, log_path)
        self.targets = build(self.runtime, self.source)
        self.epoch = self.published = self.log.last()
        #: Ops of each epoch, and the seconds it took.
        self.gauge = Gauge(self.runtime)
        held = self.log.state()
        if held is not None:
            self.source.load(held.drop(W))
            self.publish(self.epoch, self.targets)

    def on_batch(self, ops: DataFrame, batch: int, present: Column | str = "op = 'insert'", seq: Column | str = "seq") -> None:
        """Take in an epoch. One that comes again changes nothing, but is published if that had failed."""
        began = time.monotonic()
        if batch > self.epoch:
            delta, take = self.source.prepare(ops, present, seq)
            self.log.append(batch, delta.frame())
            take()
            self.epoch = batch
            self.gauge.add(delta.n, time.monotonic() - began)
        if batch == self.epoch and self.published < batch:
            self.publish(batch, self.targets)
            self.published = batch
            if self.compact_every and (batch + 1) % self.compact_every == 0:
                self.log.compact()

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True, present: Column | str = "op = 'insert'", seq: Column | str = "seq") -> StreamingQuery:
        """Run over a stream of ops (the source's columns, and what ``present`` and ``seq`` need)."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.on_batch(df, n, present, seq))
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_op_stream(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A folder of op files as a stream."""
    reader = spark.readStream.format(form).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)
