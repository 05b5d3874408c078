"""Structured Streaming queries over `events` delivered as daily record files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from evalframe.catalog import sqltext as S
from evalframe.catalog.registry import query
from evalframe.operators.metrics import grade_qa
from evalframe.session import scratch_path, table
from evalframe.sources.files import write_jsonl
from evalframe.catalog.prompts_q import sql_fill
from evalframe.functions.prompts import QA_OPEN_TEMPLATE
from evalframe.operators.stand_in_models import choice_model
from evalframe.plans.tasks import get_task
from evalframe.streaming.incremental import generate_stream, ingest, running_metrics

EVENT_RECORD_SCHEMA = "sample_id bigint, prediction string, reference string, category string, day string"
_PRED = "'The answer is ' || chr(65 + CAST(user_id % 5 AS INT))"
_REF = "chr(65 + CAST(event_id % 5 AS INT))"


def _deliver(spark, sf_dir, root):
    """Event records as JSONL files, one folder per day, plus a re-delivered copy of the
    click records (same keys again, as after an upstream retry)."""
    ev = table(spark, sf_dir, "events")
    recs = ev.select(
        F.col("event_id").alias("sample_id"),
        F.expr(_PRED).alias("prediction"),
        F.expr(_REF).alias("reference"),
        F.col("event_type").alias("category"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    recs.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("day").json(os.path.join(root, "records"))
    return recs


def _stream_ingest(spark, sf_dir, transform=None):
    root = scratch_path(spark, "stream")
    recs = _deliver(spark, sf_dir, root)
    source = os.path.join(root, "records")
    sink, ckpt = os.path.join(root, "sink"), os.path.join(root, "checkpoint")
    ingest(spark, source, EVENT_RECORD_SCHEMA, sink, ckpt, transform=transform)
    # re-delivery: the click records arrive again as new files; the restarted query
    # only reads the new files and the keyed sink drops the repeated keys
    again = recs.where(F.col("category") == "click").drop("day")
    write_jsonl(again, os.path.join(source, "day=redelivered"), "overwrite")
    return root, ingest(spark, source, EVENT_RECORD_SCHEMA, sink, ckpt, transform=transform)


@query(
    "stream_ingest",
    oracle=f"SELECT event_id AS sample_id, {_PRED} AS prediction, event_type AS category FROM events",
)
def q_stream_ingest(spark, sf_dir):
    """Incremental ingest of record files with restart and re-delivery: every key stored once."""
    _, sink = _stream_ingest(spark, sf_dir)
    return sink.select("sample_id", "prediction", "category")


_OK = S.choice_correct(_PRED, _REF)


@query(
    "stream_grade",
    oracle=f"SELECT event_id AS sample_id, CAST({_OK} AS DOUBLE) AS correct, event_type AS category FROM events",
)
def q_stream_grade(spark, sf_dir):
    """Incremental grading: records graded (choice correctness) inside the stream as a
    stateless projection, then stored once per key."""

    def grade(df):
        return df.select("sample_id", grade_qa("prediction", "reference", F.lit(True)).alias("correct"), "category")

    _, sink = _stream_ingest(spark, sf_dir, transform=grade)
    return sink.select("sample_id", "correct", "category")


@query(
    "stream_metrics",
    oracle=f"""WITH g AS (SELECT nullif(event_type, '') AS cat, CAST({_OK} AS DOUBLE) AS ok FROM events)
SELECT CASE WHEN grouping(cat) = 1 THEN 'accuracy' ELSE 'accuracy_' || cat END AS metric, round(avg(ok), 6) AS value, count(*) AS n
FROM g GROUP BY GROUPING SETS ((), (cat)) HAVING grouping(cat) = 1 OR cat IS NOT NULL""",
)
def q_stream_metrics(spark, sf_dir):
    """Running accuracy over the graded record stream: per-category sums and counts kept
    as streaming state, overall and per-category accuracy derived from them."""
    root = scratch_path(spark, "stream-metrics")
    _deliver(spark, sf_dir, root)

    def graded(session):
        stream = session.readStream.schema(EVENT_RECORD_SCHEMA).option("maxFilesPerTrigger", 64).json(os.path.join(root, "records"))
        return stream.select(grade_qa("prediction", "reference", F.lit(True)).alias("correct"), "category")

    m = running_metrics(spark, graded, os.path.join(root, "counts"), os.path.join(root, "checkpoint"))
    return m.select("metric", F.round("value", 6).alias("value"), "n")


_TOKENS = S.token_count(sql_fill(QA_OPEN_TEMPLATE, question="coalesce(text, '')"))


@query(
    "stream_generate",
    oracle=f"SELECT doc_id AS sample_id, 'The answer is ' || chr(65 + CAST(({_TOKENS}) % 5 AS INT)) AS prediction, 1 AS attempts FROM documents",
)
def q_stream_generate(spark, sf_dir):
    """Incremental generation: document questions arrive as sample files in two waves
    (English first, then the rest); each restart of the stream answers only the new
    files, and every sample is stored once."""
    root = scratch_path(spark, "stream-generate")
    source, sink, ckpt = (os.path.join(root, x) for x in ("samples", "records", "checkpoint"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("question"), F.lit("").alias("answer"), "lang"
    )
    schema = "sample_id bigint, question string, answer string"
    task = get_task("choice_qa")
    write_jsonl(docs.where(F.coalesce(F.col("lang") == "en", F.lit(False))).drop("lang"), os.path.join(source, "wave=1"))
    generate_stream(spark, source, schema, task, choice_model, sink, ckpt)
    write_jsonl(docs.where(~F.coalesce(F.col("lang") == "en", F.lit(False))).drop("lang"), os.path.join(source, "wave=2"))
    records = generate_stream(spark, source, schema, task, choice_model, sink, ckpt)
    return records.select("sample_id", "prediction", "attempts")
