"""Run bookkeeping: run keys, evaluation names, summary rows and the runs table.

A run is identified by (task, backend, model, run_key); the run key encodes
the task configuration and generation settings exactly like a result file
name, so one parameter set always maps to one key. The runs table is
partitioned by task and backend, so locating a run by its parameters prunes
partitions before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.text import first_nonempty, sanitize_component
from evalframe.sources.files import read_if_exists
from evalframe.sources.ledger import newest, next_pass

# --- fixed values ---------------------------------------------------------
DEFAULT_MAX_TOKENS = 4096
DEFAULT_TEMPERATURE = 0.0
ALL_SAMPLES = "all"
UNKNOWN_BACKEND = "unknown-backend"
UNKNOWN_MODEL = "unknown-model"
SKIPPED_KEY_SUFFIX = "_dir"
SUMMARY_SCHEMA_VERSION = 2
RESULT_SUFFIX = ".json"
RECORDS_SUFFIX = ".jsonl"
# Keys removed from a run's metadata because they are stored as run fields.
RUN_FIELDS_IN_METADATA = ("task_config", "generation_config", "model", "result_path")
# Folder that evaluated results are re-rooted under, and the marker folder of saved results.
EVALUATED_ROOT = "results/evaluated"
RESULTS_DIR = "results"
# --------------------------------------------------------------------------

RUN_PARTITIONS = ("task_name", "backend")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_key(task_config=None, max_tokens=None, temperature=None, limit=None, *, temperature_text: str | None = None) -> Column:
    """``{k-v__...}max_tokens-N__temperature-T__limit-L``.

    Config entries are sorted by key; null/empty values and keys ending in
    ``_dir`` are skipped; every key and value is sanitised. Defaults: 4096,
    0.0 and ``all``. ``temperature_text`` gives the temperature already rendered
    (Python's float repr, e.g. ``1e-05``) when keys are built on the driver.
    """
    entries = None
    if task_config is not None:
        kept = F.map_filter(
            _c(task_config),
            lambda k, v: v.isNotNull() & (v != "") & ~k.endswith(SKIPPED_KEY_SUFFIX),
        )
        entries = F.array_sort(F.map_entries(kept))
        entries = F.transform(entries, lambda e: F.concat(sanitize_component(e["key"]), F.lit("-"), sanitize_component(e["value"])))
    mt = F.coalesce(_c(max_tokens).cast("string"), F.lit(str(DEFAULT_MAX_TOKENS))) if max_tokens is not None else F.lit(str(DEFAULT_MAX_TOKENS))
    if temperature_text is not None:
        tp = F.lit(temperature_text)
    elif temperature is not None:
        tp = F.coalesce(_c(temperature).cast("double").cast("string"), F.lit(str(DEFAULT_TEMPERATURE)))
    else:
        tp = F.lit(str(DEFAULT_TEMPERATURE))
    lm = F.coalesce(_c(limit).cast("string"), F.lit(ALL_SAMPLES)) if limit is not None else F.lit(ALL_SAMPLES)
    pieces = F.array(
        F.concat(F.lit("max_tokens-"), sanitize_component(mt)),
        F.concat(F.lit("temperature-"), sanitize_component(tp)),
        F.concat(F.lit("limit-"), sanitize_component(lm)),
    )
    return F.array_join(pieces if entries is None else F.concat(F.coalesce(entries, F.array().cast("array<string>")), pieces), "__")


def result_path(task, backend, model, key) -> Column:
    """``{task}/{backend}/{model}/{run_key}.json`` with sanitised components."""
    return F.concat_ws(
        "/",
        sanitize_component(task),
        sanitize_component(first_nonempty(_c(backend), F.lit(UNKNOWN_BACKEND))),
        sanitize_component(first_nonempty(_c(model), F.lit(UNKNOWN_MODEL))),
        F.concat(_c(key), F.lit(RESULT_SUFFIX)),
    )


def evaluated_key(key, grader_backend=None, grader_model=None) -> Column:
    """``{run_key}__graded`` or ``{run_key}__graded-by-{backend}-{model}`` (present parts only)."""
    parts = []
    for g in (grader_backend, grader_model):
        if g is not None:
            parts.append(F.when(F.coalesce(_c(g), F.lit("")) != "", sanitize_component(g)))
    by = F.concat_ws("-", *parts) if parts else F.lit("")
    marker = F.when(by != "", F.concat(F.lit("graded-by-"), by)).otherwise(F.lit("graded"))
    return F.concat(_c(key), F.lit("__"), marker)


def evaluated_path(path, grader_backend=None, grader_model=None, output_dir: str = EVALUATED_ROOT) -> Column:
    """Location of an evaluated result: ``{output_dir}/{path below the first
    "results" folder}/{name}__{marker}.json``; a path without a "results"
    folder keeps all of its folders."""
    # normalised like a file path: empty and "." segments dropped
    parts = F.filter(F.split(_c(path), "/"), lambda x: (x != "") & (x != "."))
    n = F.size(parts)
    at = F.array_position(parts, F.lit(RESULTS_DIR)).cast("int")
    start = F.when(at > 0, at + 1).otherwise(F.lit(1))
    folders = F.slice(parts, start, F.greatest(n - start, F.lit(0)))
    base = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    name = F.concat(evaluated_key(base, grader_backend, grader_model), F.lit(RESULT_SUFFIX))
    return F.array_join(F.concat(F.array(F.lit(output_dir)), folders, F.array(name)), "/")


def evaluation_name(task, grader_backend=None, grader_model=None) -> Column:
    """``grader__{task}__{backend}__{model}`` when both grader fields are set, else ``task__{task}``."""
    t = _c(task)
    if grader_backend is None or grader_model is None:
        return F.concat(F.lit("task__"), t)
    gb, gm = _c(grader_backend), _c(grader_model)
    both = (F.coalesce(gb, F.lit("")) != "") & (F.coalesce(gm, F.lit("")) != "")
    return F.when(both, F.concat_ws("__", F.lit("grader"), t, gb, gm)).otherwise(F.concat(F.lit("task__"), t))


def summary_row(
    task_name,
    backend,
    model,
    task_config,
    max_tokens,
    temperature,
    limit,
    metrics,
    num_samples,
    evaluations=None,
    metadata=None,
) -> list[Column]:
    """Columns of one runs-table row (summary payload, schema version 2); null maps become empty."""
    key = run_key(task_config, max_tokens, temperature, limit)
    path = result_path(task_name, backend, model, key)
    empty_metrics = F.create_map().cast("map<string,double>")
    empty_meta = F.create_map().cast("map<string,string>")
    ev_type = "map<string,struct<metrics:map<string,double>,grader:map<string,string>>>"
    meta = F.coalesce(_c(metadata), empty_meta) if metadata is not None else empty_meta
    # run parameters live in their own columns, not in the free-form metadata
    meta = F.map_filter(meta, lambda k, _: ~k.isin(*RUN_FIELDS_IN_METADATA))
    records_path = F.regexp_replace(path, r"\.json$", RECORDS_SUFFIX)
    meta = F.map_concat(F.map_filter(meta, lambda k, _: k != "sample_results_path"), F.create_map(F.lit("sample_results_path"), F.coalesce(meta["sample_results_path"], records_path)))
    return [
        F.lit(SUMMARY_SCHEMA_VERSION).alias("schema_version"),
        _c(task_name).alias("task_name"),
        F.coalesce(_c(backend), F.lit(UNKNOWN_BACKEND)).alias("backend"),
        F.coalesce(_c(model), F.lit(UNKNOWN_MODEL)).alias("model"),
        key.alias("run_key"),
        path.alias("result_path"),
        F.coalesce(_c(task_config), empty_meta).alias("task_config") if task_config is not None else empty_meta.alias("task_config"),
        F.struct(
            F.coalesce(_c(max_tokens).cast("int"), F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens") if max_tokens is not None else F.lit(DEFAULT_MAX_TOKENS).alias("max_tokens"),
            F.coalesce(_c(temperature).cast("double"), F.lit(DEFAULT_TEMPERATURE)).alias("temperature") if temperature is not None else F.lit(DEFAULT_TEMPERATURE).alias("temperature"),
            (_c(limit).cast("int") if limit is not None else F.lit(None).cast("int")).alias("limit"),
        ).alias("generation_config"),
        F.coalesce(_c(metrics), empty_metrics).alias("metrics") if metrics is not None else empty_metrics.alias("metrics"),
        _c(num_samples).cast("bigint").alias("num_samples"),
        (F.coalesce(_c(evaluations), F.create_map().cast(ev_type)) if evaluations is not None else F.create_map().cast(ev_type)).alias("evaluations"),
        meta.alias("metadata"),
    ]


def write_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Persist summary rows, partitioned by task and backend.

    The runs table holds one small row per run, so rows are first grouped by
    the partition columns: one file per partition instead of one per task
    and partition. Each write has the next sequence number (``seq``), so the
    later of two rows of a run is known whatever the clock says.
    """
    stored = None if mode == "overwrite" else read_if_exists(runs.sparkSession.read.parquet, path)
    runs = runs.withColumn("seq", F.lit(next_pass(stored, "seq")).cast("bigint"))
    runs.repartition(*RUN_PARTITIONS).write.mode(mode).partitionBy(*RUN_PARTITIONS).parquet(path)


def find_runs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Runs matching requested parameter sets.

    ``wanted`` carries (task_name, backend, model, run_key) per request. The
    join on the partition columns lets dynamic partition pruning skip
    partitions no request names.
    """
    runs = spark.read.parquet(path)
    keys = ["task_name", "backend", "model", "run_key"]
    return runs.join(wanted.select(*keys), keys, "left_semi")


def find_run(spark: SparkSession, path: str, task_name: str, backend: str, model: str, key: str) -> DataFrame:
    """One run by its parameters; a missing run raises naming the expected result path."""
    runs = spark.read.parquet(path).where(
        (F.col("task_name") == task_name) & (F.col("backend") == backend) & (F.col("model") == model) & (F.col("run_key") == key)
    )
    if runs.isEmpty():
        raise FileNotFoundError(f"Could not find run {task_name}/{backend}/{model}/{key}{RESULT_SUFFIX} in {path}")
    return runs


def metrics_entries(metrics: DataFrame) -> DataFrame:
    """Long form of a metrics map: (…, metric, value)."""
    return metrics.select("*", F.explode_outer("metrics").alias("metric", "value"))


EVALUATION_LOG_SCHEMA = (
    "result_path string, evaluation_name string, metrics map<string,double>, grader map<string,string>, "
    "num_samples bigint, ts timestamp, seq bigint, snapshot boolean"
)
_EVALUATION = ["result_path", "evaluation_name"]


def append_evaluation(
    spark: SparkSession,
    log_path: str,
    key: str,
    name: str,
    metrics: DataFrame,
    grader: dict | None = None,
    num_samples: int | None = None,
) -> None:
    """Append one evaluation of a run to the evaluation log; ``key`` is the run's
    ``result_path``, which names task, backend, model and run key.

    ``metrics`` is the long form (metric, value[, n]); it becomes one map. The
    log is append-only: re-evaluating under the same name adds a row with a
    higher sequence number, and ``run_summaries`` keeps that one. ``ts`` is
    information only.
    """
    log = read_if_exists(spark.read.parquet, log_path)
    grader_map = F.create_map(*[F.lit(x) for kv in sorted((grader or {}).items()) for x in kv]).cast("map<string,string>")
    row = metrics.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("double")))).alias("metrics")).select(
        F.lit(key).alias("result_path"),
        F.lit(name).alias("evaluation_name"),
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"),
        grader_map.alias("grader"),
        F.lit(num_samples).cast("bigint").alias("num_samples"),
        F.current_timestamp().alias("ts"),
        F.lit(number := next_pass(log, "part")).cast("bigint").alias("seq"),
        F.lit(False).alias("snapshot"),
        F.lit(number).cast("bigint").alias("part"),
    )
    row.write.mode("append").partitionBy("part").parquet(log_path)


def read_evaluations(spark: SparkSession, log_path: str) -> DataFrame:
    """Rows of the evaluation log from its newest snapshot on; older folders are not opened."""
    log = spark.read.parquet(log_path)
    cut = log.where("snapshot").agg(F.max("part").alias("part")).first()["part"]
    return (log if cut is None else log.where(F.col("part") >= cut)).drop("part")


def compact_evaluations(spark: SparkSession, log_path: str) -> None:
    """Fold the log into a snapshot: the newest row per (run, evaluation name), with its sequence number.

    The snapshot is one more folder of the log. Readers start at the newest
    complete one, so an interrupted compaction changes nothing, and folders
    before it may be removed when no reader is left that began earlier.
    """
    number = next_pass(spark.read.parquet(log_path), "part")
    rows = newest(read_evaluations(spark, log_path), _EVALUATION, F.col("seq"))
    rows = rows.withColumns({"snapshot": F.lit(True), "part": F.lit(number).cast("bigint")})
    rows.coalesce(1).write.mode("append").partitionBy("part").parquet(log_path)


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row per run (task, backend, model, run key): the one written last."""
    return newest(runs, ["result_path"], F.col("seq")).select(*runs.columns)


def run_summaries(spark: SparkSession, runs_path: str, log_path: str | None) -> DataFrame:
    """Runs with their evaluations folded in: per (run, evaluation name) the newest
    entry wins, ``evaluations`` maps name → {metrics, grader}, and the run's
    top-level ``metrics`` are those of its newest evaluation."""
    runs = latest_runs(spark.read.parquet(runs_path))
    if log_path is None:
        return runs
    latest = newest(read_evaluations(spark, log_path), _EVALUATION, F.col("seq")).select(*_EVALUATION, F.struct("metrics", "grader", "seq").alias("e"))
    per_run = latest.groupBy("result_path").agg(
        F.map_from_entries(F.collect_list(F.struct("evaluation_name", F.struct(F.col("e.metrics").alias("metrics"), F.col("e.grader").alias("grader"))))).alias("_evals"),
        F.max_by(F.col("e.metrics"), F.col("e.seq")).alias("_metrics"),
    )
    joined = runs.join(per_run, "result_path", "left")
    return joined.withColumn("evaluations", F.coalesce("_evals", "evaluations")).withColumn(
        "metrics", F.coalesce("_metrics", "metrics")
    ).drop("_evals", "_metrics")
