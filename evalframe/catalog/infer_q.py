"""Queries that run the inference stage (with deterministic stand-in models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.catalog import sqltext as S
from evalframe.catalog.prompts_q import _GRADER_SQL, grader_inputs, sql_fill
from evalframe.catalog.registry import query
from evalframe.functions.prompts import QA_OPEN_TEMPLATE, grader_prompt
from evalframe.functions.text import exact_match
from evalframe.functions.verdict import with_verdict
from evalframe.operators.infer import GenerationConfig, RetryPolicy, generate, user_text
from evalframe.operators.rubric import score_samples
from evalframe.operators.stand_in_models import choice_model, flaky_choice_model, parity_judge
from evalframe.plans.run import GenerationFailed, evaluate_run, record_frame, run_generation
from evalframe.plans.tasks import MESSAGE_TYPE, TaskSpec, _text_message, get_task, register
from evalframe.operators.metrics import record_accuracy
from evalframe.session import materialize, scratch_path, table
from evalframe.sources.files import read_jsonl, with_sample_idx
from evalframe.sources.ledger import GRADE_PASS, RUN_PASS

_N = S.token_count(sql_fill(QA_OPEN_TEMPLATE, question="coalesce(text, '')"))


def _doc_samples(spark, sf_dir):
    """Documents as open-ended QA samples (question = text), positioned in ingest order."""
    docs = with_sample_idx(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("sample_id"), "sample_idx", F.col("text").alias("question"), F.lit("").alias("answer"))


@query(
    "generate_stub",
    oracle=f"SELECT doc_id AS sample_id, 'The answer is ' || chr(65 + CAST(({_N}) % 5 AS INT)) AS prediction, 1 AS attempts FROM documents",
)
def q_generate_stub(spark, sf_dir):
    """Batch inference over every document question: prompts built per row, one model
    call per row inside Arrow batches (stand-in model: letter from the token count)."""
    frame = record_frame(get_task("choice_qa"), _doc_samples(spark, sf_dir))
    out = generate(frame, "messages", choice_model, carry=["sample_id"])
    return out.select("sample_id", "prediction", "attempts")


GENERATE_LIMIT = 100


@query(
    "generate_resume",
    oracle=f"SELECT least({GENERATE_LIMIT}, count(*)) AS n_first_pass, count(*) AS n_records, count(DISTINCT doc_id) AS n_distinct FROM documents",
)
def q_generate_resume(spark, sf_dir):
    """Run pipeline twice into one record table: a limited first run, then a full run that
    only generates the samples without a persisted record."""
    path = scratch_path(spark, "run-records")
    task = get_task("choice_qa")
    samples = _doc_samples(spark, sf_dir)
    first = run_generation(spark, task, samples, choice_model, path, limit=GENERATE_LIMIT).count()
    records = run_generation(spark, task, samples, choice_model, path)
    return records.agg(
        F.lit(first).cast("bigint").alias("n_first_pass"),
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct("sample_id").alias("n_distinct"),
    )


@query(
    "grade_stub",
    oracle=f"""WITH p AS ({_GRADER_SQL}), v AS (SELECT conv_id, length(prompt) % 2 = 0 AS met FROM p)
SELECT conv_id, round(avg(CAST(met AS DOUBLE)), 6) AS rubric_score, count(*) AS n_criteria, count(*) FILTER (WHERE met) AS n_met
FROM v GROUP BY conv_id""",
)
def q_grade_stub(spark, sf_dir):
    """Rubric grading with a grader model: one grader prompt per (conversation, criterion),
    judged in Arrow batches (stand-in judge), replies parsed to verdicts, scored per sample."""
    g = grader_inputs(spark, sf_dir)
    prompts = g.select(
        "conv_id",
        "item_id",
        F.lit(1.0).alias("weight"),
        F.array(_text_message("user", grader_prompt("history", "response", "criterion"))).cast(MESSAGE_TYPE).alias("messages"),
    )
    cfg = GenerationConfig(max_tokens=256, temperature=0.0, options={"response_format": {"type": "json_object"}})
    replies = generate(prompts, "messages", parity_judge, out="reply", carry=["conv_id", "item_id", "weight"], config=cfg)
    judged = with_verdict(replies, "reply", "criteria_met")
    s = score_samples(judged, "conv_id")
    return s.select("conv_id", F.round("rubric_score", 6).alias("rubric_score"), "n_criteria", "n_met")


@query(
    "generate_retry",
    oracle=f"""WITH n AS (SELECT doc_id, {_N} AS n FROM documents)
SELECT doc_id AS sample_id,
       CASE WHEN n % 7 = 0 THEN NULL ELSE 'The answer is ' || chr(65 + CAST(n % 5 AS INT)) END AS prediction,
       CASE WHEN n % 7 = 0 THEN 1 WHEN n % 5 = 0 THEN 2 ELSE 1 END AS attempts,
       CASE WHEN n % 7 = 0 THEN 'StatusError: bad request' END AS error
FROM n""",
)
def q_generate_retry(spark, sf_dir):
    """Inference with retries: rate-limited calls are retried with backoff (zero delay
    here), rejected calls are kept as null output with their error and attempt count."""
    frame = record_frame(get_task("choice_qa"), _doc_samples(spark, sf_dir))
    cfg = GenerationConfig(max_tokens=64, temperature=0.0, options={"top_p": 1.0})
    out = generate(
        frame, "messages", flaky_choice_model, carry=["sample_id"], config=cfg,
        retry=RetryPolicy(max_retries=3, base_delay=0.0, max_delay=0.0, jitter=0.0), on_error="null",
    )
    return out.select("sample_id", "prediction", "attempts", "error")


_NO_DELAY = RetryPolicy(max_retries=3, base_delay=0.0, max_delay=0.0, jitter=0.0)


def _failing_then_well(spark, samples, path, between=None):
    """Records of a run whose model rejects some samples, run again with a model that answers them;
    ``between`` is called with the records of the first run."""
    task = get_task("choice_qa")
    try:
        run_generation(spark, task, samples, flaky_choice_model, path, retry=_NO_DELAY)
    except GenerationFailed:
        pass  # everything that was answered is stored
    first = run_generation(spark, task, samples, flaky_choice_model, path, retry=_NO_DELAY, on_error="null") if between else None
    seen = between(first) if between else None
    return run_generation(spark, task, samples, choice_model, path), seen


@query(
    "generate_interrupted",
    oracle=f"""WITH n AS (SELECT doc_id, {_N} AS n FROM documents)
SELECT doc_id AS sample_id, 'The answer is ' || chr(65 + CAST(n % 5 AS INT)) AS prediction,
       CAST(CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS run_pass, CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END AS n_records,
       CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 2 ELSE 1 END AS n_calls
FROM n""",
)
def q_generate_interrupted(spark, sf_dir):
    """A run that ends in errors keeps every finished sample; the next run calls the model
    only for the failed ones, and their newest good attempt is the record. The attempt
    ledger gives the calls of each sample."""
    path = scratch_path(spark, "interrupted")
    records, _ = _failing_then_well(spark, _doc_samples(spark, sf_dir), path)
    ledger = read_jsonl(spark, path, f"sample_id bigint, attempts bigint, {RUN_PASS} bigint")
    calls = ledger.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n_records"), F.sum("attempts").cast("int").alias("n_calls"))
    return records.join(calls, "sample_id").select("sample_id", "prediction", RUN_PASS, "n_records", "n_calls")


@query(
    "regrade_after_retry",
    oracle=f"""WITH n AS (SELECT doc_id, {_N} AS n FROM documents),
g AS (SELECT CAST(n % 5 = doc_id % 5 AS DOUBLE) AS ok, n % 7 = 0 AS failed FROM n)
SELECT 'first' AS evaluation, round(avg(CASE WHEN failed THEN 0 ELSE ok END), 6) AS accuracy, count(*) AS n, count(*) AS n_graded FROM g
UNION ALL SELECT 'second', round(avg(ok), 6), count(*), count(*) FILTER (WHERE failed) FROM g""",
)
def q_regrade_after_retry(spark, sf_dir):
    """Records graded while some calls had failed, then graded again after a run answered
    them: only the records that changed are graded anew, and the metrics are those of the
    records as they are."""
    samples = _doc_samples(spark, sf_dir).withColumn("answer", F.expr("'answer is ' || chr(65 + CAST(sample_id % 5 AS INT))"))
    task, path, graded_path = get_task("choice_qa"), scratch_path(spark, "regraded"), scratch_path(spark, "regraded-grades")
    # computed before the second pass adds rows to the table it reads
    grade_now = lambda failed: materialize(evaluate_run(spark, task, failed, graded_path)[1], "first-metrics")
    records, first = _failing_then_well(spark, samples, path, grade_now)
    graded_first = read_jsonl(spark, graded_path, f"{GRADE_PASS} bigint").where(F.col(GRADE_PASS) == 1)
    _, second = evaluate_run(spark, task, records, graded_path)
    graded_second = read_jsonl(spark, graded_path, f"{GRADE_PASS} bigint").where(F.col(GRADE_PASS) == 2)
    rows = []
    for name, metrics, graded in (("first", first, graded_first), ("second", second, graded_second)):
        n = graded.select(F.count(F.lit(1)).alias("n")).scalar()
        rows.append(metrics.where("metric = 'accuracy'").select(F.lit(name).alias("evaluation"), F.round("value", 6).alias("accuracy"), "n", n.alias("n_graded")))
    return rows[0].unionByName(rows[1])


# ---- a task defined by a user: part type → guess the material -------------
def last_word_model():
    """Stand-in model for the custom task: answers with the last word of the user text."""

    def predict(messages, **_):
        words = user_text(messages).split()
        return words[-1] if words else ""

    return predict


def _part_grade(records, judge=None, details_path=None):
    s = F.col("evaluation_sample")
    ev = F.struct(exact_match(F.coalesce("prediction", F.lit("")), "reference").alias("correct"), s["size_group"].alias("category"))
    return records.select("sample_id", ev.alias("evaluation"))


PART_MATERIAL = TaskSpec(
    name="part_material",
    description="Guess the material word of a part type.",
    messages=lambda df: F.array(_text_message("user", F.concat(F.lit("Material of: "), F.col("p_type")))).cast(MESSAGE_TYPE),
    reference=lambda df: F.when(F.col("p_size") % 2 == 0, F.element_at(F.split("p_type", " "), -1)).otherwise(F.col("p_brand")),
    payload=lambda df: F.struct(F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string")).alias("size_group")),
    grade=_part_grade,
    aggregate=lambda recs, judged=True: record_accuracy(recs.select(F.col("evaluation.correct").alias("correct"), F.col("evaluation.category").alias("category"))),
)


@query(
    "custom_task",
    oracle=f"""WITH r AS (
  SELECT 'size' || CAST(p_size % 5 AS VARCHAR) AS cat,
         {S.exact_match("coalesce(list_last(list_filter(regexp_split_to_array('Material of: ' || p_type, '" + S.WS + "+'), lambda t: t <> '')), '')",
                        "CASE WHEN p_size % 2 = 0 THEN list_last(string_split(p_type, ' ')) ELSE p_brand END")} AS ok
  FROM part)
SELECT CASE WHEN grouping(cat) = 1 THEN 'accuracy' ELSE 'accuracy_' || cat END AS metric, round(avg(ok), 6) AS value, count(*) AS n
FROM r GROUP BY GROUPING SETS ((), (cat))""",
)
def q_custom_task(spark, sf_dir):
    """A user-registered task run end to end: its prompts, a plugged-in model, its grade
    and its metric aggregation."""
    task = register(PART_MATERIAL)
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "sample_id")
    frame = record_frame(get_task(task.name), parts)
    gen = generate(frame, "messages", last_word_model, carry=["sample_id", "reference", "evaluation_sample"])
    graded = task.grade(gen, None)
    m = task.aggregate(graded, True)
    return m.select("metric", F.round("value", 6).alias("value"), "n")
