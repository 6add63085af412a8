from pyspark.sql import functions as F

from rillwork.streaming.runner import EpochRunner, read_op_stream

SCHEMA = "op string, v long, seq long"


def test_epochs_survive_a_restart(spark, tmp_path):
    ops, log, check = (f"file://{tmp_path}/{n}" for n in ("ops", "log", "check"))
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(ops)
    seen: dict[int, tuple] = {}

    def build(rt, source):
        gaps = source.sort_by_key("v").pairwise().map((F.col("right.v") - F.col("left.v")).alias("gap"))
        return {"n": source.count(), "total": gaps.sum("gap"), "rt": rt}

    def publish(epoch, targets):
        seen[epoch] = targets["rt"].get(targets["n"]), targets["rt"].get(targets["total"])

    def run():
        runner = EpochRunner(spark, "v long", log, build, publish, compact_every=2)
        q = runner.start(read_op_stream(spark, ops, SCHEMA, max_files=1), check)
        q.awaitTermination()
        return runner

    put([("insert", 10, 1), ("insert", 30, 2), ("insert", 50, 3)])
    run()
    assert seen == {0: (3, 40)}
    put([("insert", 100, 4), ("delete", 10, 5)])
    runner = run()  # a new process would build the same from the log
    assert seen[1] == (3, 70)
    runner.on_batch(spark.createDataFrame([("insert", 7, 9)], SCHEMA), 1)  # a batch that comes again
    assert runner.runtime.get(runner.targets["n"]) == 3
    put([("delete", 30, 6), ("delete", 50, 7), ("delete", 100, 8)])
    run()
    assert seen[2] == (0, 0)
