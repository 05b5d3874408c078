"""Incremental record ingest, grading and metrics with Structured Streaming.

New record files are picked up by a file source; each micro-batch is written
with ``foreachBatch`` into an epoch partition of the sink (dynamic partition
overwrite), after an anti-join against the keys of earlier epochs. A replayed
epoch therefore replaces its own output instead of duplicating it, and a key
that arrives twice is stored once — without keeping any streaming state.
Grading is a stateless projection; running metrics keep one small state row
per category.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.operators.infer import generate
from evalframe.operators.metrics import METRIC_SCHEMA
from evalframe.plans.run import record_frame
from evalframe.sources.files import read_if_exists


#: hash buckets of the stored keys
KEY_BUCKETS = 64


def keys_location(sink: str) -> str:
    """Where the keys of a keyed sink are kept, by hash bucket and epoch."""
    return sink.rstrip("/") + "_keys"


def keyed_appender(
    sink: str, key: str = "sample_id", then: Callable[[DataFrame], DataFrame] | None = None, buckets: int = KEY_BUCKETS
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: append rows whose key is not yet in the sink, idempotently per epoch.
    ``then`` is applied to the new rows only (it must keep the key).

    The keys are stored a second time, alone, in folders by hash bucket: a
    micro-batch is compared with the keys of its own buckets and opens no other
    file and no stored row. Keys are written after the rows, from the rows; a
    replay of an epoch leaves the epoch's own keys aside and replaces both.
    ``buckets`` is fixed by the first batch of a sink.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        prior = read_if_exists(spark.read.parquet, keys_location(sink))
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.dropDuplicates([key])
        held = None
        if prior is not None:
            held = rows = rows.persist()  # read for its buckets and for its rows
            own = [r["bucket"] for r in rows.select(bucket.alias("bucket")).distinct().collect()]
            stored = prior.where(F.col("bucket").isin(own) & (F.col("epoch") != epoch_id)).select(key)
            rows = rows.join(stored, key, "left_anti")
        if then is not None:
            rows = then(rows)
        (
            rows.withColumn("epoch", F.lit(epoch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(sink)
        )
        if held is not None:
            held.unpersist()
        kept = read_if_exists(spark.read.parquet, sink)
        if kept is not None:
            keys = kept.where(F.col("epoch") == epoch_id).select(key, "epoch", bucket.alias("bucket"))
            keys.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(keys_location(sink))

    return write


def run_available(stream: DataFrame, checkpoint: str, foreach: Callable[[DataFrame, int], None]) -> None:
    """Process everything available now, in micro-batches, then stop."""
    q = stream.writeStream.foreachBatch(foreach).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def ingest(
    spark: SparkSession,
    source: str,
    schema,
    sink: str,
    checkpoint: str,
    key: str = "sample_id",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int = 64,
) -> DataFrame:
    """Stream new JSONL record files from ``source`` into the keyed sink; returns the sink."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    if transform is not None:
        stream = transform(stream)
    run_available(stream, checkpoint, keyed_appender(sink, key))
    return spark.read.parquet(sink)


def session_like(spark: SparkSession, **settings) -> SparkSession:
    """A session of its own on the same context, with the caller's settings and ``settings`` on top."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    for name, value in settings.items():
        own.conf.set(name, value)
    return own


def _published(spark: SparkSession, sink: str, below: int | None = None) -> DataFrame | None:
    """Newest published snapshot (older than epoch ``below``), or None."""
    pointer = read_if_exists(spark.read.parquet, f"{sink}/published")
    if pointer is None:
        return None
    if below is not None:
        pointer = pointer.where(F.col("epoch") < below)
    newest = pointer.agg(F.max("epoch").alias("epoch")).first()["epoch"]
    return None if newest is None else spark.read.parquet(f"{sink}/snapshots/epoch={newest}")


def snapshot_publisher(sink: str, key: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for update-mode state: each epoch writes a snapshot of its own (the last
    published one with the changed keys replaced) and then publishes its number, so a reader always
    finds a whole snapshot. A replayed epoch starts from the same earlier snapshot."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        prior = _published(spark, sink, below=epoch_id)
        changed = batch
        if prior is not None:
            null_safe = F.col(f"p.{key}").eqNullSafe(F.col(f"b.{key}"))
            changed = batch.unionByName(prior.alias("p").join(batch.select(key).alias("b"), null_safe, "left_anti"))
        changed.coalesce(1).write.mode("overwrite").parquet(f"{sink}/snapshots/epoch={epoch_id}")
        spark.range(1).select(F.lit(epoch_id).cast("bigint").alias("epoch")).write.mode("append").parquet(f"{sink}/published")

    return write


def metrics_snapshot(spark: SparkSession, sink: str) -> DataFrame:
    """(metric, value, n) of the newest published counts: overall over all records plus one row per non-empty category."""
    counts = _published(spark, sink)
    if counts is None:
        counts = spark.createDataFrame([], "category string, ok double, n bigint")
    overall = counts.agg(
        F.lit("accuracy").alias("metric"),
        F.coalesce(F.sum("ok") / F.sum("n"), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
    )
    per_cat = counts.where(F.col("category").isNotNull() & (F.col("category") != "")).select(
        F.concat(F.lit("accuracy_"), "category").alias("metric"), (F.col("ok") / F.col("n")).alias("value"), F.col("n").cast("bigint").alias("n")
    )
    return overall.unionByName(per_cat).select(*[c.split()[0] for c in METRIC_SCHEMA.split(", ")])


def running_metrics(
    spark: SparkSession,
    stream: Callable[[SparkSession], DataFrame],
    sink: str,
    checkpoint: str,
    correct: str = "correct",
    category: str = "category",
    state_partitions: int = 8,
) -> DataFrame:
    """Running accuracy: streaming sum/count per category (update mode), combined into
    (metric, value, n) rows by ``metrics_snapshot``.

    ``stream`` builds the graded stream in the session it is given. The state
    holds one row per category, so that session has ``state_partitions`` shuffle
    partitions (a stream keeps the number of its first run); the caller's
    session is left as it is, also while the stream runs.
    """
    own = session_like(spark, **{"spark.sql.shuffle.partitions": str(state_partitions)})
    agg = stream(own).groupBy(F.col(category).alias("category")).agg(
        F.sum(F.coalesce(F.col(correct).cast("double"), F.lit(0.0))).alias("ok"), F.count(F.lit(1)).alias("n")
    )
    q = agg.writeStream.outputMode("update").foreachBatch(snapshot_publisher(sink, "category")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return metrics_snapshot(spark, sink)


def generate_stream(
    spark: SparkSession,
    source: str,
    schema,
    task,
    predictor_factory: Callable,
    sink: str,
    checkpoint: str,
    files_per_batch: int = 64,
    **generate_options,
) -> DataFrame:
    """Incremental generation: sample files arriving under ``source`` are turned into
    model input, answered by the model stage and stored as records in the keyed
    sink, one micro-batch at a time; a restart continues with files not yet
    processed. A sample that arrives again is left out before the model is called;
    a replayed micro-batch calls the model again but stores its records once."""
    samples = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)

    def records_of(new: DataFrame) -> DataFrame:
        return generate(record_frame(task, new), "messages", predictor_factory, carry=["sample_id", "reference", "evaluation_sample"], **generate_options)

    run_available(samples, checkpoint, keyed_appender(sink, "sample_id", records_of))
    return spark.read.parquet(sink)
