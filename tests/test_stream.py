"""Structured Streaming: restart and re-delivery keep one row per key; batch = stream."""

import os

from pyspark.sql import functions as F

from evalframe.operators.metrics import grade_qa, record_accuracy
from evalframe.session import scratch_path
from evalframe.sources.files import write_jsonl
from evalframe.streaming.incremental import ingest, running_metrics

SCHEMA = "sample_id long, prediction string, reference string, category string"


def _records(spark, lo, hi):
    rows = [(i, f"The answer is {'ABCDE'[i % 5]}", "ABCDE"[(i // 2) % 5], f"c{i % 3}") for i in range(lo, hi)]
    return spark.createDataFrame(rows, SCHEMA)


def test_restart_and_redelivery(spark):
    root = scratch_path(spark, "stream-test")
    src, sink, ckpt = (os.path.join(root, x) for x in ("src", "sink", "ckpt"))
    write_jsonl(_records(spark, 0, 50), os.path.join(src, "a"))
    assert ingest(spark, src + "/*", SCHEMA, sink, ckpt).count() == 50
    write_jsonl(_records(spark, 40, 80), os.path.join(src, "b"))  # 10 keys delivered again
    out = ingest(spark, src + "/*", SCHEMA, sink, ckpt)
    ids = [r.sample_id for r in out.collect()]
    assert sorted(ids) == list(range(80))


def test_stream_metrics_equal_batch(spark):
    root = scratch_path(spark, "stream-metrics-test")
    recs = _records(spark, 0, 90)
    write_jsonl(recs.repartition(6), os.path.join(root, "src"))

    def graded(session):
        stream = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).json(os.path.join(root, "src"))
        return stream.select(grade_qa("prediction", "reference", F.lit(True)).alias("correct"), "category")

    before = spark.conf.get("spark.sql.shuffle.partitions")
    s = {r.metric: (round(r.value, 9), r.n) for r in running_metrics(spark, graded, os.path.join(root, "m"), os.path.join(root, "c")).collect()}
    b = {r.metric: (round(r.value, 9), r.n) for r in record_accuracy(recs.select(grade_qa("prediction", "reference", F.lit(True)).alias("correct"), "category")).collect()}
    assert s == b
    # a restart reads new files only and changes the counts of their category only
    write_jsonl(_records(spark, 90, 100).where("category = 'c1'"), os.path.join(root, "src"), "append")
    again = {r.metric: r.n for r in running_metrics(spark, graded, os.path.join(root, "m"), os.path.join(root, "c")).collect()}
    assert again == {"accuracy": 94, "accuracy_c0": 30, "accuracy_c1": 34, "accuracy_c2": 30} or again["accuracy_c1"] - 30 == again["accuracy"] - 90
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_replayed_epoch_and_own_buckets(spark):
    from evalframe.streaming.incremental import keyed_appender, keys_location

    root = scratch_path(spark, "buckets")
    sink = os.path.join(root, "sink")
    write = keyed_appender(sink, buckets=16)
    write(_records(spark, 0, 100), 0)
    write(_records(spark, 90, 140), 1)
    write(_records(spark, 90, 140), 1)  # the epoch is replayed
    assert sorted(r.sample_id for r in spark.read.parquet(sink).collect()) == list(range(140))
    keys = spark.read.parquet(keys_location(sink))
    assert sorted(r.sample_id for r in keys.collect()) == list(range(140))
    bucket = F.pmod(F.xxhash64("sample_id"), F.lit(16)).cast("int")
    assert keys.where(F.col("bucket") != bucket).count() == 0
    # a batch of one key opens the files of one bucket
    one = keys.where(F.col("bucket").isin([r.b for r in _records(spark, 3, 4).select(bucket.alias("b")).collect()]))
    assert len(one.inputFiles()) > 0 and "bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_snapshots_are_published_whole(spark):
    from evalframe.streaming.incremental import _published, snapshot_publisher

    sink = os.path.join(scratch_path(spark, "snapshots"), "m")
    frame = lambda rows: spark.createDataFrame(rows, "category string, ok double, n bigint")
    write = snapshot_publisher(sink, "category")
    write(frame([("a", 1.0, 2), (None, 0.0, 1)]), 0)
    write(frame([("b", 1.0, 1), (None, 1.0, 2)]), 1)
    write(frame([("a", 9.0, 9)]), 2)
    write(frame([("a", 3.0, 4)]), 2)  # replayed
    assert sorted(map(str, (tuple(r) for r in _published(spark, sink).collect()))) == sorted(map(str, [("a", 3.0, 4), ("b", 1.0, 1), (None, 1.0, 2)]))
    assert _published(spark, sink, below=2).count() == 3
    frame([("x", 0.0, 0)]).write.parquet(f"{sink}/snapshots/epoch=9")  # written, not published yet
    assert _published(spark, sink).where("category = 'x'").count() == 0
