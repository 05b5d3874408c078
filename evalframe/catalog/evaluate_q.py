"""Chat samples stored as JSON Lines: mixed payload shapes, and a full run + grading.

Samples are written from `conversations` (one sample per conversation) and
`benchmark` (rubric criteria), then read back through the library's scans.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from evalframe.catalog import sqltext as S
from evalframe.catalog.fixtures import SAMPLE_CRITERIA_SQL, qa_samples_sql, sample_criteria
from evalframe.catalog.io_q import qa_records
from evalframe.catalog.prompts_q import sql_fill, sql_str
from evalframe.catalog.registry import query
from evalframe.functions.prompts import CHAT_SYSTEM_PROMPT, GRADER_TEMPLATE
from evalframe.operators.infer import user_text
from evalframe.operators.stand_in_models import failing_judge, parity_judge
from evalframe.plans.run import details_location, evaluate_run, run_generation
from evalframe.plans.tasks import get_task
from evalframe.session import materialize, scratch_path, table
from evalframe.sources.files import read_jsonl
from evalframe.sources.runs import append_evaluation, run_summaries, summary_row, write_runs

_SAMPLE_ID = "conv_id"


def _turn_blocks(spark, sf_dir):
    """Conversations as samples: (sample_id, conv_id, ordered turns)."""
    turns = table(spark, sf_dir, "conversations").select(F.expr(_SAMPLE_ID).alias("sample_id"), "conv_id", "turn", "role", "text")
    return turns.groupBy("sample_id", "conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")
    )


def _json_string(c):
    """JSON string literal of a text column (the element of a one-item JSON array)."""
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def _mixed_prompt(t):
    """Prompt JSON in one of four shapes, picked by conversation id mod 4: a string (all
    turns joined), one message object (the same, in the first turn's role), a list of
    message objects, or a list mixing strings and single-message lists."""
    obj = lambda x: F.to_json(F.struct(x["role"].alias("role"), x["text"].alias("content")))
    first = F.element_at(t, 1)
    whole = F.array_join(F.transform(t, lambda x: x["text"]), "\n")
    as_list = F.concat(F.lit("["), F.array_join(F.transform(t, obj), ","), F.lit("]"))
    mixed_items = F.transform(t, lambda x, i: F.when(i % 2 == 0, _json_string(x["text"])).otherwise(F.concat(F.lit("["), obj(x), F.lit("]"))))
    mixed = F.concat(F.lit("["), F.array_join(mixed_items, ","), F.lit("]"))
    return mixed, as_list, F.to_json(F.struct(first["role"].alias("role"), whole.alias("content"))), _json_string(whole)


@query(
    "chat_payload_shapes",
    oracle=f"""WITH b AS (
  SELECT {_SAMPLE_ID} AS sample_id, conv_id % 4 AS shape, role, text,
         row_number() OVER (PARTITION BY {_SAMPLE_ID} ORDER BY turn) - 1 AS pos FROM conversations),
w AS (SELECT sample_id, coalesce(string_agg(text, chr(10) ORDER BY pos), '') AS whole FROM b GROUP BY sample_id),
c AS (SELECT b.sample_id, shape, role, pos, CASE WHEN shape IN (0, 1) THEN whole ELSE text END AS text FROM b JOIN w ON w.sample_id = b.sample_id),
m AS (
  SELECT sample_id, pos, CASE WHEN shape = 0 OR (shape = 3 AND pos % 2 = 0) THEN 'user' ELSE coalesce(role, 'user') END AS role, text AS content
  FROM c
  WHERE (shape IN (0, 1) AND pos = 0 OR shape IN (2, 3))
    AND text IS NOT NULL AND text <> ''
    AND (shape = 0 OR (shape = 3 AND pos % 2 = 0) OR coalesce(role, 'user') IN ('user', 'assistant', 'system'))),
k AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS msg_idx, role, content FROM m),
s AS (SELECT DISTINCT sample_id FROM b)
SELECT sample_id, CAST(0 AS INTEGER) AS msg_idx, 'system' AS role, {sql_str(CHAT_SYSTEM_PROMPT)} AS content FROM s
UNION ALL SELECT sample_id, CAST(msg_idx AS INTEGER), role, content FROM k
UNION ALL SELECT sample_id, CAST(1 AS INTEGER), 'user', '' FROM s WHERE sample_id NOT IN (SELECT sample_id FROM k)""",
)
def q_chat_payload_shapes(spark, sf_dir):
    """Chat samples whose prompt is a string, a message object, a list, or a nested mixed
    list (JSON Lines read as VARIANT) turned into model input messages."""
    blocks = _turn_blocks(spark, sf_dir)
    mixed, as_list, one_obj, one_str = _mixed_prompt(F.col("t"))
    shape = F.col("conv_id") % 4
    prompt = F.when(shape == 0, one_str).when(shape == 1, one_obj).when(shape == 2, as_list).otherwise(mixed)
    line = F.concat(F.lit('{"sample_id": '), F.col("sample_id").cast("string"), F.lit(', "prompt": '), prompt, F.lit("}"))
    path = scratch_path(spark, "payload-shapes")
    blocks.select(line.alias("value")).write.mode("overwrite").text(path)
    samples = read_jsonl(spark, path, "sample_id bigint, prompt variant")
    task = get_task("rubric_chat")
    msgs = samples.select("sample_id", F.posexplode(task.messages(samples)).alias("msg_idx", "m"))
    return msgs.select("sample_id", "msg_idx", "m.role", F.col("m.content")[0]["text"].alias("content"))


def reply_model():
    """Stand-in chat model: replies "Reply: " + the last user message."""

    def predict(messages, **_):
        return "Reply: " + user_text(messages)

    return predict


_E2E_SQL = f"""WITH b AS (
  SELECT {_SAMPLE_ID} AS sample_id, conv_id, turn, role, text FROM conversations),
h AS (SELECT sample_id, any_value(conv_id) AS conv_id,
             string_agg({S.capitalize('role')} || ': ' || coalesce(text, 'None'), chr(10) || chr(10) ORDER BY turn) AS history,
             'Reply: ' || coalesce(arg_max(text, turn) FILTER (WHERE role = 'user' AND text <> ''), '') AS response
      FROM b GROUP BY sample_id),
c AS (SELECT h.sample_id, {sql_fill(GRADER_TEMPLATE, history="coalesce(nullif(h.history, ''), 'User: ')", response="h.response", criterion="bm.criterion")} AS prompt,
             CAST(bm.item_id % 3 + 1 AS DOUBLE) AS weight
      FROM h JOIN {SAMPLE_CRITERIA_SQL} bm ON h.conv_id = bm.conv_id),
v AS (SELECT sample_id, weight, length(prompt) % 2 = 0 AS met FROM c),
s AS (SELECT sample_id, coalesce(sum(weight) FILTER (WHERE met), 0.0) / sum(weight) AS rubric_score, count(*) AS n_criteria, count(*) FILTER (WHERE met) AS n_met
      FROM v GROUP BY sample_id)
SELECT h.sample_id, h.response AS prediction, CAST(coalesce(s.n_criteria, 0) AS VARCHAR) || ' rubrics' AS reference,
       round(coalesce(s.rubric_score, 0.0), 6) AS rubric_score, coalesce(s.n_criteria, 0) AS n_criteria, coalesce(s.n_met, 0) AS n_met
FROM h LEFT JOIN s ON h.sample_id = s.sample_id"""


def _rubric_run(spark, sf_dir):
    """(task, records, folder) of a run over chat samples with weighted rubrics, stored as JSON Lines."""
    blocks = _turn_blocks(spark, sf_dir)
    rubric = F.struct("criterion", ((F.col("item_id") % 3) + 1).cast("double").alias("weight"), "item_id")
    rubrics = sample_criteria(spark, sf_dir, blocks.select("conv_id")).groupBy("conv_id").agg(F.array_sort(F.collect_list(rubric)).alias("rubrics"))
    docs = blocks.join(rubrics, "conv_id", "left").select(
        "sample_id",
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("conversation"),
        F.transform(F.coalesce("rubrics", F.array()), lambda r: F.struct(r["criterion"].alias("criterion"), r["weight"].alias("weight"))).alias("rubrics"),
    )
    root = scratch_path(spark, "rubric-run")
    docs.write.mode("overwrite").json(os.path.join(root, "samples"))
    schema = "sample_id bigint, conversation array<struct<role:string,content:string>>, rubrics array<struct<criterion:string,text:string,weight:double,points:double>>"
    samples = read_jsonl(spark, os.path.join(root, "samples"), schema)
    task = get_task("rubric_chat")
    records = run_generation(spark, task, samples, reply_model, os.path.join(root, "records"))
    return task, records, root


@query("rubric_evaluate", oracle=_E2E_SQL)
def q_rubric_evaluate(spark, sf_dir):
    """End to end on JSON Lines chat samples with weighted rubrics: run (prompts, model,
    records; resumable), then evaluate (criteria exploded, grader prompts, judge,
    verdicts, weighted scores) — first for the conversations that open with a system
    turn, then resumed for all."""
    task, records, root = _rubric_run(spark, sf_dir)
    graded_path = os.path.join(root, "graded")
    # first evaluation covers the conversations that open with a system turn; the second resumes
    opens_with_system = F.element_at("evaluation_sample.conversation", 1)["role"] == "system"
    evaluate_run(spark, task, records.where(opens_with_system), graded_path, judge=parity_judge)
    graded, _ = evaluate_run(spark, task, records, graded_path, judge=parity_judge)
    return graded.select(
        "sample_id",
        "prediction",
        "reference",
        F.round("evaluation.rubric_score", 6).alias("rubric_score"),
        F.col("evaluation.n_criteria").alias("n_criteria"),
        F.col("evaluation.n_met").alias("n_met"),
    )


@query(
    "judge_retry",
    oracle=_E2E_SQL.split("\nSELECT h.sample_id, h.response")[0].replace("v AS (SELECT sample_id, weight,", "v AS (SELECT sample_id, weight, length(prompt) % 3 = 0 AS failed,").replace(
        "count(*) FILTER (WHERE met) AS n_met", "count(*) FILTER (WHERE met) AS n_met, count(*) FILTER (WHERE failed) AS n_failed, coalesce(sum(weight) FILTER (WHERE met AND NOT failed), 0.0) / nullif(sum(weight) FILTER (WHERE NOT failed), 0) AS first_score"
    )
    + """
SELECT h.sample_id, round(coalesce(s.first_score, 0.0), 6) AS first_score, round(coalesce(s.rubric_score, 0.0), 6) AS rubric_score,
       coalesce(s.n_failed, 0) AS n_failed, coalesce(s.n_criteria, 0) + coalesce(s.n_failed, 0) AS n_calls
FROM h LEFT JOIN s ON h.sample_id = s.sample_id""",
)
def q_judge_retry(spark, sf_dir):
    """Rubric grading while the judge fails for some criteria, then again with a healthy
    judge: the second pass calls it only for those, and scores come from the newest good
    call of each criterion. The criterion ledger gives the calls of each sample."""
    task, records, root = _rubric_run(spark, sf_dir)
    graded_path = os.path.join(root, "graded")
    first, _ = evaluate_run(spark, task, records, graded_path, judge=failing_judge, on_error="null")
    first = materialize(first.select("sample_id", "evaluation.rubric_score", "evaluation.n_failed"), "first-grades")
    second, _ = evaluate_run(spark, task, records, graded_path, judge=parity_judge)
    calls = spark.read.parquet(details_location(graded_path)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_calls"))
    out = second.select("sample_id", F.round("evaluation.rubric_score", 6).alias("rubric_score"))
    out = out.join(first.select("sample_id", F.round("rubric_score", 6).alias("first_score"), "n_failed"), "sample_id").join(calls, "sample_id", "left")
    return out.select("sample_id", "first_score", "rubric_score", "n_failed", F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


_QA_GRADED_SQL = f"""WITH qa AS ({qa_samples_sql()}),
g AS (SELECT nullif(category, '') AS cat,
             CASE WHEN has_options THEN CAST({S.choice_correct('prediction', f"upper({S.strip('answer')})")} AS DOUBLE)
                  ELSE {S.exact_match('prediction', f"upper({S.strip('answer')})")} END AS ok FROM qa),
m AS (SELECT CASE WHEN grouping(cat) = 1 THEN 'accuracy' ELSE 'accuracy_' || cat END AS metric, round(avg(ok), 6) AS value
      FROM g GROUP BY GROUPING SETS ((), (cat)) HAVING grouping(cat) = 1 OR cat IS NOT NULL)"""


@query(
    "run_summary",
    oracle=_QA_GRADED_SQL
    + """
SELECT e.name AS evaluation_name, m.metric, m.value, e.is_latest FROM m,
  (VALUES ('task__choice_qa', false), ('grader__choice_qa__stand-in__parity', true)) AS e(name, is_latest)""",
)
def q_run_summary(spark, sf_dir):
    """A QA run's records graded and aggregated, the evaluation recorded twice (task and
    grader names) in the append-only evaluation log, and the run summary folded: every
    evaluation by name, top-level metrics from the newest one."""
    root = scratch_path(spark, "run-summary")
    recs = qa_records(spark, sf_dir).drop("status")
    payload = F.struct(
        *[F.col("evaluation_sample." + f) for f in ("answer", "category", "type", "task_type", "options")],
        F.col("evaluation_sample.options").isNotNull().alias("has_options"),
    )
    records = recs.withColumn("evaluation_sample", payload)
    task = get_task("choice_qa")
    _, metrics = evaluate_run(spark, task, records, os.path.join(root, "graded"))
    metrics = materialize(metrics, "run-summary-metrics")  # feeds two evaluation entries: aggregate once
    n = records.count()
    run = spark.range(1).select(*summary_row(F.lit("choice_qa"), F.lit("stand-in"), F.lit("choice"), None, None, None, None, None, F.lit(n)))
    write_runs(run, os.path.join(root, "runs"))
    key = run.first().result_path
    log = os.path.join(root, "evaluations")
    append_evaluation(spark, log, key, "task__choice_qa", metrics, num_samples=n)
    append_evaluation(spark, log, key, "grader__choice_qa__stand-in__parity", metrics, {"backend": "stand-in", "model": "parity"}, n)
    s = run_summaries(spark, os.path.join(root, "runs"), log)
    ev = s.select("metrics", F.explode("evaluations").alias("evaluation_name", "e"))
    rows = ev.select("evaluation_name", "metrics", F.explode("e.metrics").alias("metric", "value"))
    latest = F.col("evaluation_name") == "grader__choice_qa__stand-in__parity"
    return rows.select(
        "evaluation_name",
        "metric",
        F.round("value", 6).alias("value"),
        (latest & (F.col("metrics")[F.col("metric")] == F.col("value"))).alias("is_latest"),
    )
