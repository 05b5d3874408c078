"""Rubric scoring queries: criteria → verdicts → per-sample and dataset scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.catalog.fixtures import SAMPLE_CRITERIA_SQL, rubric_criteria, rubric_criteria_sql, rubric_samples, sample_criteria
from evalframe.catalog.registry import query
from evalframe.catalog.text_q import _verdict_sql
from evalframe.operators.rubric import judge_criteria, score_all_samples, score_samples
from evalframe.functions.verdict import parse_verdict
from evalframe.operators.metrics import dataset_rubric_metrics
from evalframe.operators.metrics import rubric_score_nested as rubric_score_nested_expr
from evalframe.session import materialize, table

_JUDGED = f"""WITH j AS (SELECT sample_id, criterion, weight, {_verdict_sql('reply')} AS v FROM ({rubric_criteria_sql()}) c)"""
_SCORED = (
    _JUDGED
    + """, s AS (
  SELECT sample_id,
         coalesce(coalesce(sum(CASE WHEN v THEN weight END), 0.0)
                  / nullif(sum(CASE WHEN v IS NOT NULL THEN weight END), 0.0), 0.0) AS rubric_score,
         count(*) AS n_criteria, count(v) AS n_judged, count(*) FILTER (WHERE v) AS n_met
  FROM j GROUP BY sample_id)"""
)


@query(
    "rubric_score_per_sample",
    oracle=_SCORED + "\nSELECT sample_id, round(rubric_score, 6) AS rubric_score, n_criteria, n_judged, n_met FROM s",
)
def rubric_score_per_sample(spark, sf_dir):
    """Parse each criterion's grader reply, then Σ weight(met) / Σ weight(judged) per sample."""
    judged = judge_criteria(rubric_criteria(spark, sf_dir), "reply")
    s = score_samples(judged, "sample_id")
    return s.select("sample_id", F.round("rubric_score", 6).alias("rubric_score"), "n_criteria", "n_judged", "n_met")


@query(
    "rubric_score_dataset",
    oracle=_SCORED
    + """
SELECT round(coalesce(avg(coalesce(s.rubric_score, 0.0)), 0.0), 6) AS rubric_score,
       count(*) FILTER (WHERE coalesce(s.n_criteria, 0) > 0) AS num_graded, count(*) AS num_samples
FROM orders o LEFT JOIN s ON o.o_orderkey = s.sample_id""",
)
def rubric_score_dataset(spark, sf_dir):
    """Dataset rubric metrics: mean over all samples (rubric-less samples score 0.0) and num_graded."""
    judged = judge_criteria(rubric_criteria(spark, sf_dir), "reply")
    per_sample = score_all_samples(rubric_samples(spark, sf_dir), score_samples(judged, "sample_id"), "sample_id")
    m = dataset_rubric_metrics(per_sample)
    return m.select(F.round("rubric_score", 6).alias("rubric_score"), "num_graded", "num_samples")


@query(
    "criterion_results",
    oracle=_SCORED
    + """
SELECT j.sample_id, j.criterion, j.weight, CAST(j.v AS VARCHAR) AS criteria_met, round(s.rubric_score, 6) AS rubric_score
FROM j JOIN s ON j.sample_id = s.sample_id""",
)
def criterion_results(spark, sf_dir):
    """Per-sample grading result in long form: every criterion with its weight and
    verdict, next to the sample's rubric score (scores aggregated first, then joined)."""
    # verdicts feed both the per-sample aggregate and the rows joined back: parse once
    judged = materialize(judge_criteria(rubric_criteria(spark, sf_dir), "reply").drop("reply"), "judged-criteria")
    scores = score_samples(judged, "sample_id").select("sample_id", "rubric_score")
    out = judged.join(scores, "sample_id")
    return out.select(
        "sample_id",
        "criterion",
        "weight",
        F.col("criteria_met").cast("string").alias("criteria_met"),
        F.round("rubric_score", 6).alias("rubric_score"),
    )


# Nested form: each conversation's rubric is the list of its five benchmark
# items, each with a grader reply shaped by the item id.
_ITEM_REPLY = """CASE CAST(item_id % 4 AS INT)
    WHEN 0 THEN '{"explanation": "fine", "criteria_met": true}'
    WHEN 1 THEN 'No, it misses this.'
    WHEN 2 THEN 'Cannot tell.'
    ELSE '```json' || chr(10) || '{"criteria_met": false}' || chr(10) || '```' END"""


@query(
    "rubric_score_nested",
    oracle=f"""WITH c AS (SELECT b.conv_id, CAST(b.item_id % 3 + 1 AS DOUBLE) AS weight, {_verdict_sql(_ITEM_REPLY.replace('item_id', 'b.item_id'))} AS v
      FROM {SAMPLE_CRITERIA_SQL} b)
SELECT conv_id,
       round(coalesce(coalesce(sum(CASE WHEN v THEN weight END), 0.0) / nullif(sum(CASE WHEN v IS NOT NULL THEN weight END), 0.0), 0.0), 6) AS rubric_score,
       count(*) AS n_criteria
FROM c GROUP BY conv_id""",
)
def rubric_score_nested(spark, sf_dir):
    """Rubric score of criteria held as an array per sample: verdicts parsed and
    weights summed inside the array, no shuffle of criteria."""
    samples = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    rubric = F.struct("item_id", "criterion", ((F.col("item_id") % 3) + 1).cast("double").alias("weight"), F.expr(_ITEM_REPLY).alias("reply"))
    s = sample_criteria(spark, sf_dir, samples).groupBy("conv_id").agg(F.collect_list(rubric).alias("rubrics"))
    results = F.transform(
        "rubrics",
        lambda r: F.struct(r["criterion"].alias("criterion"), r["weight"].alias("weight"), parse_verdict(r["reply"]).alias("criteria_met")),
    )
    return s.select(
        "conv_id",
        F.round(rubric_score_nested_expr(results), 6).alias("rubric_score"),
        F.size("rubrics").cast("bigint").alias("n_criteria"),
    )
