"""End-to-end plans: generate predictions for a task, then grade them.

Both plans are idempotent and resumable by key: work is the anti-join of
the input with what is already persisted, model output is written exactly
once (Spark's commit protocol keeps retried tasks from duplicating rows) and
everything downstream reads the persisted table, never the inference plan.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalframe.operators.infer import GenerationConfig, RetryPolicy, generate
from evalframe.operators.joins import pending
from evalframe.operators.metrics import metrics_long
from evalframe.plans.tasks import TaskSpec, newest_verdicts
from evalframe.session import materialize
from evalframe.sources.files import evaluated_records, load_records, read_if_exists, read_jsonl, with_sample_idx, write_jsonl
from evalframe.sources.ledger import GRADE_PASS, RUN_PASS, VERSION, newest, next_pass, record_version
from evalframe.sources.runs import (
    EVALUATED_ROOT,
    RECORDS_SUFFIX,
    RESULT_SUFFIX,
    UNKNOWN_BACKEND,
    UNKNOWN_MODEL,
    append_evaluation,
    evaluated_key,
    evaluated_path,
    evaluation_name,
    find_run,
    latest_runs,
    result_path,
    run_key,
    run_summaries,
    summary_row,
    write_runs,
)


def _persisted(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """Persisted JSON Lines table, or None when nothing was written yet."""
    return read_if_exists(lambda p: read_jsonl(spark, p, schema), path)


def record_frame(task: TaskSpec, samples: DataFrame) -> DataFrame:
    """Model input plus what each record keeps: (sample_id, messages, reference, evaluation_sample)."""
    return samples.select(
        "sample_id",
        task.messages(samples).alias("messages"),
        task.reference(samples).alias("reference"),
        task.payload(samples).alias("evaluation_sample"),
    )


class GenerationFailed(RuntimeError):
    """Some samples got no answer; every other one is stored."""


#: commits of one generation pass
CHUNKS = 4


def run_generation(
    spark: SparkSession,
    task: TaskSpec,
    samples: DataFrame,
    predictor_factory: Callable,
    records_path: str,
    *,
    limit: int | None = None,
    config: GenerationConfig | None = None,
    retry: RetryPolicy | None = None,
    on_error: str = "fail",
    partitions: int | None = None,
    concurrency: int = 1,
    chunks: int = CHUNKS,
    observation: Observation | None = None,
) -> DataFrame:
    """Generate a prediction for every sample without a good persisted record.

    ``samples`` needs ``sample_id`` (and ``sample_idx`` when ``limit`` is set:
    the first ``limit`` samples in ingest order). The pending samples are
    written once, dealt by hash into ``chunks``; each chunk is generated and
    appended to ``records_path`` by a job of its own, so a run that dies keeps
    the chunks it finished. All chunks are processed whatever fails in one.

    Records are an attempt ledger: one row per sample and pass (``run_pass``),
    with the error of a call that failed; failed samples are tried again by
    the next run. With ``on_error="fail"`` a pass with failures ends in
    ``GenerationFailed`` after everything else is stored. Returns the newest
    good record of each sample (its newest failed one where none is good).

    ``observation`` gets the counts of ``validation_metrics`` over the samples
    as the run reads them, without a scan of its own.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    if chunks < 1:
        raise ValueError("chunks must be at least 1")
    if limit is not None:
        samples = samples.where(F.col("sample_idx") < limit)
    if observation is not None:
        samples = samples.observe(observation, *validation_metrics(task, samples))
    frame = record_frame(task, samples)

    def records_of(todo: DataFrame, number: int) -> DataFrame:
        gen = generate(
            todo,
            "messages",
            predictor_factory,
            carry=["sample_id", "reference", "evaluation_sample"],
            config=config,
            retry=retry,
            on_error="null",
            partitions=partitions,
            concurrency=concurrency,
        )
        return gen.select("sample_id", "prediction", "reference", "evaluation_sample", "attempts", "error", F.lit(number).cast("bigint").alias(RUN_PASS))

    schema = records_of(frame, 0).schema
    existing = _persisted(spark, records_path, schema)
    number = next_pass(existing, RUN_PASS)
    todo = frame if existing is None else pending(frame, existing.where("error is null"))
    parts = [todo]
    if chunks > 1 or observation is not None:
        dealt = todo.withColumn("_chunk", F.pmod(F.xxhash64("sample_id"), F.lit(chunks)).cast("int"))
        dealt = materialize(dealt, "pending", by="_chunk")
        parts = [dealt.where(F.col("_chunk") == i).drop("_chunk") for i in range(chunks)]
    broken = []
    for part in parts:
        try:
            write_jsonl(records_of(part, number), records_path, mode="append")
        except Exception as exc:  # a lost job costs its own chunk only
            broken.append(exc)
    stored = _persisted(spark, records_path, schema)
    if on_error == "fail" and stored is not None:
        failed = stored.where((F.col(RUN_PASS) == number) & F.col("error").isNotNull())
        row = failed.agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error")).first()
        if row["n"]:
            raise GenerationFailed(f"{row['n']} samples failed, for example with {row['error']}; all others are stored in {records_path}") from (broken or [None])[0]
    if broken:
        raise broken[0]
    records = current_records(stored)
    return records if limit is None else records.join(samples.select("sample_id"), "sample_id", "left_semi")


def current_records(records: DataFrame) -> DataFrame:
    """One record per sample: the newest good attempt, else the newest failed one.
    Records without an ``error`` field have one attempt each and stay as they are."""
    if "error" not in records.columns:
        return records
    number = F.col(RUN_PASS) if RUN_PASS in records.columns else F.lit(0)
    return newest(records, ["sample_id"], F.struct(F.col("error").isNull(), F.coalesce(number, F.lit(0)), "attempts")).select(*records.columns)


def details_location(graded_path: str) -> str:
    """Where the criterion ledger (judged rubric criteria) of a graded table lives."""
    return graded_path.rstrip("/") + "_details"


def criterion_results_of(spark: SparkSession, graded_path: str) -> DataFrame:
    """Judged criteria behind the newest persisted evaluation of each sample: (sample_id,
    criterion_idx, criterion, weight, reply, criteria_met, error). Verdicts of records that
    have changed since, or that have no evaluation yet, are left out."""
    details = spark.read.parquet(details_location(graded_path))
    key_type = details.schema["sample_id"].dataType.simpleString()
    graded = read_jsonl(spark, graded_path, f"sample_id {key_type}, {VERSION} string, {GRADE_PASS} bigint")
    keep = newest(graded, ["sample_id"], F.col(GRADE_PASS)).select("sample_id", VERSION)
    verdicts = newest_verdicts(details.join(keep, ["sample_id", VERSION], "left_semi"))
    return verdicts.select("sample_id", "criterion_idx", "criterion", "weight", "reply", "criteria_met", "error")


def evaluate_run(
    spark: SparkSession,
    task: TaskSpec,
    records: DataFrame,
    graded_path: str,
    judge: Callable | None = None,
    **judge_options,
) -> tuple[DataFrame, DataFrame]:
    """Grade every record whose present version has no complete persisted evaluation, then aggregate.

    Grades are appended to ``graded_path`` as (sample_id, record_version,
    grade_pass, evaluation) rows (separate layout); metrics come only from
    persisted grades of the records as they are now. A record that has changed
    is graded again, and so is one whose evaluation is not complete
    (``TaskSpec.complete``; for rubrics: a judge call failed), calling the judge
    only for what is missing. ``judge_options`` (partitions, concurrency,
    on_error, retry) shape the judge's calls. Returns (records with evaluation,
    metrics).
    """
    if records.isEmpty():
        raise ValueError("No per-sample records found to evaluate")
    versioned = records.withColumn(VERSION, record_version(records))

    def graded_of(rows: DataFrame, details: str | None, number: int, **options) -> DataFrame:
        grades = task.grade(rows, judge, details, **options)
        if VERSION not in grades.columns:  # a task of its own may return the key only
            grades = grades.join(rows.select("sample_id", VERSION), "sample_id")
        return grades.select("sample_id", VERSION, F.lit(number).cast("bigint").alias(GRADE_PASS), "evaluation")

    schema = graded_of(versioned.limit(0), None, 0).schema
    persisted = _persisted(spark, graded_path, schema)
    number = next_pass(persisted, GRADE_PASS)
    todo = versioned
    if persisted is not None:
        done = persisted.where(task.complete(F.col("evaluation"))) if task.complete else persisted
        todo = versioned.join(done.select("sample_id", VERSION), ["sample_id", VERSION], "left_anti")
    write_jsonl(graded_of(todo, details_location(graded_path), number, **judge_options), graded_path, mode="append")
    graded = read_jsonl(spark, graded_path, schema)
    if task.complete:  # one version may have been graded more than once
        graded = newest(graded, ["sample_id", VERSION], F.col(GRADE_PASS))
    merged = versioned.join(graded.drop(GRADE_PASS), ["sample_id", VERSION], "left").select(*records.columns, "evaluation")
    judged = judge is not None or not task.graded_by_model
    return merged, task.aggregate(merged, judged)


def _problems(task: TaskSpec, samples: DataFrame) -> dict[str, Column]:
    """What can be wrong with a sample, by name."""
    empty = lambda c: c.isNull() | (c == "")
    messages = task.messages(samples)
    said = F.exists(messages, lambda m: (m["role"] != "system") & F.exists(m["content"], lambda p: ~empty(F.coalesce(p["text"], p["url"]))))
    return {
        "no_key": F.col("sample_id").isNull() if "sample_id" in samples.columns else F.lit(False),
        "no_input": ~F.coalesce(said, F.lit(False)),
        "no_reference": empty(task.reference(samples)),
        "no_payload": task.payload(samples).isNull(),
    }


def validation_metrics(task: TaskSpec, samples: DataFrame) -> list[Column]:
    """Aggregates that check samples: num_samples, null_{column} for every column, and the number of
    samples without a key, an input text, a reference or a payload (no_...)."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in samples.columns]
    return [F.count(F.lit(1)).alias("num_samples"), *nulls, *[F.count_if(c).alias(name) for name, c in _problems(task, samples).items()]]


def failing_rows(task: TaskSpec, samples: DataFrame) -> DataFrame:
    """Samples with a problem, and the names of their problems in ``problems``."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in _problems(task, samples).items()]))
    return samples.withColumn("problems", found).where(F.size("problems") > 0)


def validate_samples(task: TaskSpec, samples: DataFrame, order: str = "sample_id") -> DataFrame:
    """Dataset check in one aggregate job: number of samples, number of model-input
    messages of the first sample (by ``order``), the fields that sample has
    (non-null columns) and ``checks``, the counts of ``validation_metrics`` by
    name. One row; a broken dataset fails the job."""
    cols = [c for c in samples.columns if c != order]
    first = F.min_by(F.struct(F.size(task.messages(samples)).alias("n_messages"), *[F.col(c) for c in cols]), F.col(order))
    counts = validation_metrics(task, samples)
    names = samples.agg(*counts).columns
    agg = samples.agg(*counts, first.alias("_first")).withColumn(
        "checks", F.create_map(*[x for c in names[1:] for x in (F.lit(c), F.col(f"`{c}`"))])
    )
    present = F.array(F.lit(order), *[F.when(F.col("_first")[c].isNotNull(), F.lit(c)) for c in cols])
    return agg.select(
        "num_samples",
        F.col("_first.n_messages").alias("first_prompt_messages"),
        F.array_compact(present).alias("first_sample_keys"),
        "checks",
    )


def _lit_map(d: dict):
    """A literal ``map<string,string>`` Column of a Python dict (values rendered with ``str``)."""
    items = [F.lit(x) for k, v in sorted(d.items()) for x in (str(k), None if v is None else str(v))]
    return F.create_map(*items).cast("map<string,string>")


def _key_of(spark: SparkSession, task_name: str, backend: str | None, model: str | None, task_config: dict | None, config: GenerationConfig, limit: int | None) -> dict:
    """Run key, result path and evaluation-ready fields of one parameter set (a one-row job)."""
    # the temperature is rendered by Python's float repr, as in result file names
    key = run_key(_lit_map({k: v for k, v in (task_config or {}).items() if v is not None and v not in ("", [], {}, ())}), F.lit(config.max_tokens), limit=F.lit(limit).cast("int"), temperature_text=str(float(config.temperature)))
    row = spark.range(1).select(
        key.alias("run_key"),
        result_path(F.lit(task_name), F.lit(backend), F.lit(model), key).alias("result_path"),
    ).first()
    return {"run_key": row.run_key, "result_path": row.result_path, "task_config": task_config or {}}


def run_task(
    spark: SparkSession,
    task: TaskSpec,
    samples: DataFrame,
    predictor_factory: Callable,
    root: str,
    *,
    backend: str | None,
    model: str | None,
    task_config: dict | None = None,
    config: GenerationConfig | None = None,
    limit: int | None = None,
    partitions: int | None = None,
    concurrency: int = 1,
    retry: RetryPolicy | None = None,
    on_error: str = "fail",
    chunks: int = CHUNKS,
) -> DataFrame:
    """Generate (resumably) and record a run: records under
    ``root/records/{task}/{backend}/{model}/{run_key}.jsonl``, one summary row
    (metrics empty until evaluated) in ``root/runs``."""
    cfg = config or GenerationConfig()
    key = _key_of(spark, task.name, backend, model, task_config, cfg, limit)
    records_path = os.path.join(root, "records", key["result_path"][: -len(RESULT_SUFFIX)] + RECORDS_SUFFIX)
    records = run_generation(
        spark, task, samples, predictor_factory, records_path,
        limit=limit, config=cfg, partitions=partitions, concurrency=concurrency, retry=retry, on_error=on_error, chunks=chunks,
    )
    n = records.count()
    summary = spark.range(1).select(
        *summary_row(
            F.lit(task.name), F.lit(backend), F.lit(model), _lit_map(key["task_config"]),
            F.lit(cfg.max_tokens), F.lit(float(cfg.temperature)), F.lit(limit).cast("int"), None, F.lit(n),
            metadata=F.create_map(
                F.lit("sample_results_path"), F.lit(records_path),
                F.lit("record_schema"), F.lit(records.schema.json()),
            ),
        )
    )
    write_runs(summary, os.path.join(root, "runs"))
    return latest_runs(spark.read.parquet(os.path.join(root, "runs")).where(F.col("result_path") == key["result_path"]))


def evaluate_task(
    spark: SparkSession,
    task: TaskSpec,
    root: str,
    *,
    backend: str | None,
    model: str | None,
    task_config: dict | None = None,
    config: GenerationConfig | None = None,
    limit: int | None = None,
    judge: Callable | None = None,
    grader_backend: str | None = None,
    grader_model: str | None = None,
    **judge_options,
) -> DataFrame:
    """Locate a run by its parameters, grade its records (resumably), aggregate, and
    append the evaluation to ``root/evaluations``; returns the metrics."""
    cfg = config or GenerationConfig()
    identity = _key_of(spark, task.name, backend, model, task_config, cfg, limit)
    key = identity["run_key"]
    run = latest_runs(find_run(spark, os.path.join(root, "runs"), task.name, backend or UNKNOWN_BACKEND, model or UNKNOWN_MODEL, key)).first()
    records_path = run.metadata["sample_results_path"]
    stored = run.metadata.get("record_schema")
    # records are read with the schema they were written with (inference would
    # turn empty arrays and all-null fields into strings)
    records = current_records(read_jsonl(spark, records_path, StructType.fromJson(json.loads(stored)) if stored else None))
    marker = spark.range(1).select(evaluated_key(F.lit(key), F.lit(grader_backend), F.lit(grader_model)).alias("k")).first().k
    # grades of one model must never serve another: the path names task, backend and model
    graded_path = os.path.join(root, "graded", os.path.dirname(identity["result_path"]), marker)
    _, metrics = evaluate_run(spark, task, records, graded_path, judge=judge, **judge_options)
    name = spark.range(1).select(evaluation_name(F.lit(task.name), F.lit(grader_backend), F.lit(grader_model)).alias("n")).first().n
    grader = {k: v for k, v in (("backend", grader_backend), ("model", grader_model)) if v}
    append_evaluation(spark, os.path.join(root, "evaluations"), identity["result_path"], name, metrics, grader, run.num_samples)
    return metrics


@dataclass
class TaskRun:
    """One task of a run over several: its samples, and the options of ``run_task`` / ``evaluate_task`` that are its own."""

    task: TaskSpec
    samples: DataFrame
    predictor_factory: Callable
    run_options: dict = field(default_factory=dict)
    judge_options: dict | None = field(default_factory=dict)  # None: predictions only, not evaluated


#: options that name a run; ``evaluate_task`` needs them too
_IDENTITY = ("task_config", "config", "limit")


def run_tasks(spark: SparkSession, runs: list[TaskRun], root: str, *, backend: str | None, model: str | None, **shared) -> DataFrame:
    """Run and evaluate several tasks in order, each like ``run_task`` and ``evaluate_task`` with ``shared``
    and its own options. A task may come again; its later run counts.

    Returns the metrics of every evaluated run as one frame: (run_no, task_name, metric, value, n), run_no from 1
    in the order given. Samples of all tasks stay distributed; only run-level rows are shared.
    """
    out = None
    for number, one in enumerate(runs, 1):
        options = shared | one.run_options
        run_task(spark, one.task, one.samples, one.predictor_factory, root, backend=backend, model=model, **options)
        if one.judge_options is None:
            continue
        identity = {k: v for k, v in options.items() if k in _IDENTITY}
        metrics = evaluate_task(spark, one.task, root, backend=backend, model=model, **identity, **one.judge_options)
        tagged = materialize(metrics, "task-metrics").select(F.lit(number).alias("run_no"), F.lit(one.task.name).alias("task_name"), "metric", "value", "n")
        out = tagged if out is None else out.unionByName(tagged)
    return spark.createDataFrame([], "run_no int, task_name string, metric string, value double, n bigint") if out is None else out


def summary(spark: SparkSession, root: str) -> DataFrame:
    """Listing (task, metric, value, num_samples) of the last run of every task below ``root``, with the
    metrics of its newest evaluation (``status`` = ``predictions_saved`` where there is none).

    One grouped pass over the run rows: the last run of a task is the one with the highest sequence number.
    """
    log = os.path.join(root, "evaluations")
    there = read_if_exists(spark.read.parquet, log) is not None
    folded = run_summaries(spark, os.path.join(root, "runs"), log if there else None)
    last = newest(folded.select("task_name", "seq", "metrics", "num_samples"), ["task_name"], F.col("seq"))
    return metrics_long(last.withColumnRenamed("task_name", "task"))


def evaluate_file(
    spark: SparkSession,
    task: TaskSpec,
    records_path: str,
    schema,
    *,
    summary_path: str | None = None,
    summary_schema=None,
    in_place: bool = False,
    output_dir: str = EVALUATED_ROOT,
    judge: Callable | None = None,
    grader_backend: str | None = None,
    grader_model: str | None = None,
    **judge_options,
) -> tuple[str, DataFrame]:
    """Grade saved records that no run table knows: a record file (JSON Lines), or a legacy summary of
    parallel arrays, which is turned into a record file first.

    Records without ``sample_id`` are identified by their position. Grades are resumable like those of a
    run; the evaluated records are written below ``output_dir``, in place (every record with its
    ``evaluation``) or apart (key and evaluation only). Returns (where, metrics).
    """
    records = load_records(spark, records_path, summary_path, schema, summary_schema)
    if records is None:
        raise FileNotFoundError(f"neither records {records_path} nor a summary {summary_path} exist")
    if "sample_id" not in records.columns:
        records = with_sample_idx(records, "sample_id")
    path = F.lit(summary_path or records_path)
    where = spark.range(1).select(evaluated_path(path, F.lit(grader_backend), F.lit(grader_model), output_dir).alias("p")).first()["p"]
    where = where[: -len(RESULT_SUFFIX)] + RECORDS_SUFFIX
    graded, metrics = evaluate_run(spark, task, records, where + "_grades", judge=judge, **judge_options)
    write_jsonl(evaluated_records(records, graded.where("evaluation is not null"), in_place=in_place), where)
    return where, metrics
