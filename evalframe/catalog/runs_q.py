"""Run bookkeeping queries: run keys, evaluation upserts, the runs table, metric listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.catalog import sqltext as S
from evalframe.catalog.fixtures import qa_samples, qa_samples_sql
from evalframe.catalog.prompts_q import sql_fill
from evalframe.catalog.registry import query
from evalframe.functions.prompts import QA_OPEN_TEMPLATE
from evalframe.functions.text import py_strip
from evalframe.operators.infer import GenerationConfig
from evalframe.operators.joins import upsert_evaluations
from evalframe.operators.metrics import category_label, grade_qa, metrics_long, record_accuracy
from evalframe.operators.stand_in_models import choice_model
from evalframe.plans.run import TaskRun, run_tasks, summary, validate_samples
from evalframe.plans.tasks import get_task
from evalframe.session import scratch_path, table
from evalframe.sources.runs import evaluated_key, evaluation_name, find_runs, result_path, run_key, summary_row, write_runs

# Run parameters derived from `part`: task, backend and model names, a task
# config with empty, null and *_dir entries, and generation settings.
_TASK = "CASE WHEN p_size % 2 = 0 THEN 'rubric_chat' ELSE 'choice_qa' END"
_MAX_TOKENS = "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 64 END"
_TEMPERATURE = "CAST(p_size % 11 AS DOUBLE) / 10.0"
_LIMIT = "CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 7 * 10 AS INT) END"
_SUBSET = "lower(element_at(split(p_type, ' '), 1))"
_NOTE = "CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN NULL ELSE p_container END"


def _run_params(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.expr(_TASK).alias("task"),
        F.col("p_brand").alias("backend"),
        F.col("p_name").alias("model"),
        F.create_map(
            F.lit("subset"), F.expr(_SUBSET),
            F.lit("data_dir"), F.lit("/data/x"),
            F.lit("seed"), F.col("p_size").cast("string"),
            F.lit("note"), F.expr(_NOTE.replace("p_container", "p_type")),
        ).alias("task_config"),
        F.expr(_MAX_TOKENS).alias("max_tokens"),
        F.expr(_TEMPERATURE).alias("temperature"),
        F.expr(_LIMIT).alias("limit"),
        F.when(F.col("p_size") % 3 != 1, F.col("p_brand")).alias("grader_backend"),
        F.when(F.col("p_size") % 3 != 2, F.col("p_type")).alias("grader_model"),
    )


def _key_sql() -> str:
    note = _NOTE.replace("p_container", "p_type")
    subset = "lower(string_split(p_type, ' ')[1])"
    entries = [
        f"CASE WHEN coalesce({note}, '') <> '' THEN 'note-' || {S.sanitize(note)} END",
        f"'seed-' || {S.sanitize('CAST(p_size AS VARCHAR)')}",
        f"CASE WHEN coalesce({subset}, '') <> '' THEN 'subset-' || {S.sanitize(subset)} END",
        f"'max_tokens-' || {S.sanitize(f'coalesce(CAST({_MAX_TOKENS} AS VARCHAR), {chr(39)}4096{chr(39)})')}",
        f"'temperature-' || {S.sanitize(f'CAST({_TEMPERATURE} AS VARCHAR)')}",
        f"'limit-' || {S.sanitize(f'coalesce(CAST({_LIMIT} AS VARCHAR), {chr(39)}all{chr(39)})')}",
    ]
    return "concat_ws('__', " + ", ".join(entries) + ")"


_RUN_KEY_SQL = f"""WITH k AS (SELECT p_partkey, p_brand, p_name, p_type, p_size, {_TASK} AS task, {_key_sql()} AS run_key FROM part),
g AS (SELECT *, CASE WHEN p_size % 3 <> 1 THEN p_brand END AS gb, CASE WHEN p_size % 3 <> 2 THEN p_type END AS gm FROM k)
SELECT p_partkey, run_key,
       {S.sanitize('task')} || '/' || {S.sanitize("coalesce(nullif(p_brand, ''), 'unknown-backend')")} || '/' || {S.sanitize("coalesce(nullif(p_name, ''), 'unknown-model')")} || '/' || run_key || '.json' AS result_path,
       run_key || '__' || CASE WHEN coalesce(gb, '') = '' AND coalesce(gm, '') = '' THEN 'graded'
            ELSE 'graded-by-' || concat_ws('-', CASE WHEN coalesce(gb, '') <> '' THEN {S.sanitize('gb')} END, CASE WHEN coalesce(gm, '') <> '' THEN {S.sanitize('gm')} END) END AS evaluated_key,
       CASE WHEN coalesce(gb, '') <> '' AND coalesce(gm, '') <> '' THEN 'grader__' || task || '__' || gb || '__' || gm ELSE 'task__' || task END AS evaluation_name
FROM g"""


@query("run_key", oracle=_RUN_KEY_SQL)
def q_run_key(spark, sf_dir):
    """Run key, result path, evaluated-run key and evaluation name per parameter set."""
    p = _run_params(spark, sf_dir)
    key = run_key("task_config", "max_tokens", "temperature", "limit")
    k = p.select("*", key.alias("run_key"))
    return k.select(
        "p_partkey",
        "run_key",
        result_path("task", "backend", "model", "run_key").alias("result_path"),
        evaluated_key("run_key", "grader_backend", "grader_model").alias("evaluated_key"),
        evaluation_name("task", "grader_backend", "grader_model").alias("evaluation_name"),
    )


@query(
    "run_table",
    oracle=f"""WITH k AS ({_RUN_KEY_SQL})
SELECT k.evaluation_name LIKE 'grader%' AS graded, k.run_key, k.result_path,
       regexp_replace(k.result_path, '\\.json$', '.jsonl') AS sample_results_path, CAST(p.p_size * 10 AS BIGINT) AS num_samples
FROM k JOIN part p ON k.p_partkey = p.p_partkey""",
)
def q_run_table(spark, sf_dir):
    """Summary rows (schema version 2) written to the runs table partitioned by task and
    backend, then located again from their parameters."""
    # a small file of many rows is one or two tasks; keys and paths cost far more than the rows weigh
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = _run_params(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").repartition(tasks)
    rows = p.select(
        *summary_row("task", "backend", "model", "task_config", "max_tokens", "temperature", "limit", None, F.col("p_size") * 10),
        evaluation_name("task", "grader_backend", "grader_model").alias("evaluation_name"),
    )
    path = scratch_path(spark, "runs")
    write_runs(rows, path)
    wanted = _run_params(spark, sf_dir).repartition(tasks).select(
        F.col("task").alias("task_name"),
        "backend",
        "model",
        run_key("task_config", "max_tokens", "temperature", "limit").alias("run_key"),
    )
    found = find_runs(spark, path, wanted)
    return found.select(
        F.col("evaluation_name").startswith("grader").alias("graded"),
        "run_key",
        "result_path",
        F.col("metadata")["sample_results_path"].alias("sample_results_path"),
        "num_samples",
    )


@query(
    "evaluation_upsert",
    oracle="""WITH h AS (
  SELECT 'run-' || p_partkey AS run_key, 'task__choice_qa' AS evaluation_name, round(p_size / 50.0, 6) AS value, 1 AS ts FROM part
  UNION ALL SELECT 'run-' || p_partkey, 'grader__rubric_chat__b__m', round(p_retailprice / 10000.0, 6), 1 FROM part),
u AS (
  SELECT 'run-' || p_partkey AS run_key, 'task__choice_qa' AS evaluation_name, round(p_size / 100.0, 6) AS value, 2 AS ts FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT 'run-' || p_partkey, 'grader__choice_qa__x__y', round(p_retailprice / 20000.0, 6), 2 FROM part WHERE p_size % 3 = 0),
a AS (SELECT * FROM h UNION ALL SELECT * FROM u)
SELECT run_key, evaluation_name, arg_max(value, ts) AS value, max(ts) AS ts FROM a GROUP BY run_key, evaluation_name""",
)
def q_evaluation_upsert(spark, sf_dir):
    """Evaluations upserted into runs by name: an evaluation with an existing name replaces
    it, a new name is added, the others are kept (newest write wins)."""
    part = table(spark, sf_dir, "part")
    rk = F.concat(F.lit("run-"), F.col("p_partkey").cast("string")).alias("run_key")

    def rows(name, value, ts, cond=None):
        src = part if cond is None else part.where(cond)
        return src.select(rk, F.lit(name).alias("evaluation_name"), F.round(value, 6).alias("value"), F.lit(ts).alias("ts"))

    history = rows("task__choice_qa", F.col("p_size") / 50.0, 1).unionByName(
        rows("grader__rubric_chat__b__m", F.col("p_retailprice") / 10000.0, 1)
    )
    updates = rows("task__choice_qa", F.col("p_size") / 100.0, 2, F.col("p_size") % 2 == 0).unionByName(
        rows("grader__choice_qa__x__y", F.col("p_retailprice") / 20000.0, 2, F.col("p_size") % 3 == 0)
    )
    return upsert_evaluations(history, updates).select("run_key", "evaluation_name", "value", "ts")


_QA = f"WITH qa AS ({qa_samples_sql()})"


@query(
    "metrics_long",
    oracle=f"""{_QA}, g AS (
  SELECT nullif(category, '') AS cat,
         CAST({S.choice_correct('prediction', f"upper({S.strip('answer')})")} AS DOUBLE) AS ok FROM qa),
m AS (
  SELECT CASE WHEN grouping(cat) = 1 THEN 'accuracy' ELSE 'accuracy_' || cat END AS metric, avg(ok) AS value
  FROM g GROUP BY GROUPING SETS ((), (cat)) HAVING grouping(cat) = 1 OR cat IS NOT NULL)
SELECT 'choice_qa' AS task, metric, printf('%.4f', value) AS value, (SELECT CAST(count(*) AS VARCHAR) FROM orders) AS num_samples FROM m
UNION ALL SELECT 'rubric_chat', 'status', 'predictions_saved', (SELECT CAST(count(*) AS VARCHAR) FROM orders)""",
)
def q_metrics_long(spark, sf_dir):
    """Per-task metrics listing (task, metric, "%.4f" value, # samples); a run without metrics
    lists status=predictions_saved. Duplicate task entries: the last run wins."""
    s = qa_samples(spark, sf_dir)
    graded = s.select(
        grade_qa("prediction", F.upper(py_strip("answer")), F.lit(True)).alias("correct"),
        category_label("category").alias("category"),
    )
    acc = record_accuracy(graded)
    n = table(spark, sf_dir, "orders").count()
    metrics = acc.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    runs = metrics.select(F.lit("choice_qa").alias("task"), "metrics", F.lit(n).alias("num_samples"), F.lit(2).alias("run_order"))
    empty = F.create_map().cast("map<string,double>")
    older = spark.range(1).select(F.lit("choice_qa").alias("task"), F.create_map(F.lit("accuracy"), F.lit(0.5)).alias("metrics"), F.lit(n).alias("num_samples"), F.lit(1).alias("run_order"))
    saved = spark.range(1).select(F.lit("rubric_chat").alias("task"), empty.alias("metrics"), F.lit(n).alias("num_samples"), F.lit(1).alias("run_order"))
    summary = runs.unionByName(older).unionByName(saved)
    last = summary.groupBy("task").agg(F.max_by(F.struct("metrics", "num_samples"), "run_order").alias("r"))
    return metrics_long(last.select("task", "r.metrics", "r.num_samples"))


_DOC_WORDS = S.token_count(sql_fill(QA_OPEN_TEMPLATE, question="coalesce(text, '')"))
_VALID = "coalesce(role, 'user') IN ('user', 'assistant', 'system') AND text IS NOT NULL AND text <> ''"


@query(
    "validate_dataset",
    oracle=f"""WITH per AS (SELECT conv_id, count(*) FILTER (WHERE {_VALID}) AS n_valid, count(*) FILTER (WHERE text IS NULL) AS no_text, count(*) FILTER (WHERE role IS NULL) AS no_role,
                            count(*) FILTER (WHERE {_VALID} AND coalesce(role, 'user') <> 'system') AS n_said FROM conversations GROUP BY conv_id)
SELECT count(*) AS num_samples, 1 + greatest(arg_min(n_valid, conv_id), 1) AS first_prompt_turns, CAST(0 AS BIGINT) AS null_conversation,
       count(*) FILTER (WHERE no_text > 0) AS null_content, count(*) FILTER (WHERE no_role > 0) AS null_role, count(*) FILTER (WHERE n_said = 0) AS no_input, CAST(0 AS BIGINT) AS no_reference
FROM per""",
)
def q_validate_dataset(spark, sf_dir):
    """Dataset check in one aggregate job: sample count, message count of the first
    sample's prompt (system text + valid turns, at least one), nulls by column, samples
    without an input text or a reference."""
    turn = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))
    samples = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    samples = samples.select("sample_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversation"))
    # nulls inside the conversations, as a column that is null where a turn lacks the field
    samples = samples.withColumns({
        "content": F.when(~F.exists("conversation", lambda x: x["content"].isNull()), F.lit(True)),
        "role": F.when(~F.exists("conversation", lambda x: x["role"].isNull()), F.lit(True)),
    })
    found = validate_samples(get_task("rubric_chat"), samples)
    checks = F.col("checks")
    return found.select(
        "num_samples",
        F.col("first_prompt_messages").cast("bigint").alias("first_prompt_turns"),
        *[checks[f"null_{c}"].alias(f"null_{c}") for c in ("conversation", "content", "role")],
        *[checks[c].alias(c) for c in ("no_input", "no_reference")],
    )


@query(
    "tasks_summary",
    oracle=f"""WITH q AS (SELECT CAST(({_DOC_WORDS}) % 5 = doc_id % 5 AS DOUBLE) AS ok FROM documents),
p AS (SELECT 'size' || CAST(p_size % 5 AS VARCHAR) AS cat,
             {S.exact_match("coalesce(list_last(list_filter(regexp_split_to_array('Material of: ' || p_type, '" + S.WS + "+'), lambda t: t <> '')), '')",
                            "CASE WHEN p_size % 2 = 0 THEN list_last(string_split(p_type, ' ')) ELSE p_brand END")} AS ok FROM part)
SELECT 'choice_qa' AS task, 'accuracy' AS metric, printf('%.4f', avg(ok)) AS value, CAST(count(*) AS VARCHAR) AS num_samples FROM q
UNION ALL SELECT 'part_material', CASE WHEN grouping(cat) = 1 THEN 'accuracy' ELSE 'accuracy_' || cat END, printf('%.4f', avg(ok)), (SELECT CAST(count(*) AS VARCHAR) FROM part)
FROM p GROUP BY GROUPING SETS ((), (cat))
UNION ALL SELECT 'rubric_chat', 'status', 'predictions_saved', (SELECT CAST(count(DISTINCT conv_id) AS VARCHAR) FROM conversations)""",
)
def q_tasks_summary(spark, sf_dir):
    """Four runs of three tasks: questions over documents twice (a model that knows nothing,
    then one that answers; the later run counts), a task of one's own over parts, and chats
    whose predictions are saved without evaluation. The listing has each task's last run."""
    from evalframe.catalog.evaluate_q import reply_model
    from evalframe.catalog.infer_q import PART_MATERIAL, last_word_model

    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("question"), F.expr("'answer is ' || chr(65 + CAST(doc_id % 5 AS INT))").alias("answer")
    )
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "sample_id")
    chats = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg(F.max("text").alias("prompt"))
    qa = get_task("choice_qa")
    again = GenerationConfig(max_tokens=64)
    root = scratch_path(spark, "several-tasks")
    run_tasks(
        spark,
        [
            TaskRun(qa, docs, reply_model),
            # a small file of many rows is one or two tasks
            TaskRun(PART_MATERIAL, parts, last_word_model, {"partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}),
            TaskRun(get_task("rubric_chat"), chats, reply_model, judge_options=None),
            TaskRun(qa, docs, choice_model, {"config": again}),
        ],
        root, backend="stand-in", model="several", chunks=1,
    )
    return summary(spark, root)
