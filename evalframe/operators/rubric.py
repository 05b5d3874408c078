"""Rubric grading: criteria → verdicts → per-sample and dataset scores.

Criteria live in long form, one row per (sample, criterion). Scores are
aggregated per sample with partial (map-side) sums before any join to the
sample table, so the join sees one row per sample, and a sample holding a
third of all criteria still only sends one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.text import first_nonempty
from evalframe.functions.verdict import with_verdict
from evalframe.operators.metrics import dataset_rubric_metrics, rubric_score_expr

def rubric_list(rubrics, criteria=None) -> Column:
    """``rubrics or criteria or []``."""
    r = F.col(rubrics) if isinstance(rubrics, str) else rubrics
    chosen = F.when(F.size(r) > 0, r)
    if criteria is not None:
        c = F.col(criteria) if isinstance(criteria, str) else criteria
        chosen = F.coalesce(chosen, F.when(F.size(c) > 0, c))
    return chosen


def explode_criteria(
    samples: DataFrame,
    key: str,
    rubrics: str,
    criteria: str | None = None,
    weight_field: str = "weight",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per criterion: (key, criterion_idx, criterion, weight, *carry).

    Criterion text is ``criterion or text``; the weight field defaults to 1.0
    (``points`` is ignored unless ``weight_field="points"``). Samples without
    rubrics produce no rows; per-sample scoring adds them back with 0.0.
    ``carry`` columns of the sample are repeated on its criteria rows (no join).
    """
    carry = list(carry or [])
    lst = rubric_list(rubrics, criteria)
    exploded = samples.select(F.col(key), *carry, F.posexplode(lst).alias("criterion_idx", "_r"))
    fields = exploded.schema["_r"].dataType
    names = set(fields.fieldNames()) if hasattr(fields, "fieldNames") else set()
    if names:
        parts = [F.col("_r." + n) for n in ("criterion", "text") if n in names]
        text = first_nonempty(*parts, F.to_json(F.col("_r"))) if parts else F.to_json(F.col("_r"))
        w = F.col("_r." + weight_field).cast("double") if weight_field in names else F.lit(None).cast("double")
    else:
        text, w = F.col("_r").cast("string"), F.lit(None).cast("double")
    return exploded.select(key, "criterion_idx", text.alias("criterion"), F.coalesce(w, F.lit(1.0)).alias("weight"), *carry)


def judge_criteria(criteria: DataFrame, reply: str = "reply", out: str = "criteria_met") -> DataFrame:
    """Attach the three-valued verdict parsed from each grader reply."""
    return with_verdict(criteria, reply, out)


def score_samples(judged: DataFrame, key: str, met: str = "criteria_met", weight: str = "weight", failed: str | None = None) -> DataFrame:
    """Per-sample rubric score from judged criteria (key, rubric_score, n_criteria, n_judged, n_met;
    with ``failed``, the column of a call's error, also n_failed)."""
    v = F.col(met)
    more = [F.count(failed).alias("n_failed")] if failed else []
    return judged.groupBy(key).agg(
        rubric_score_expr(v, F.col(weight)).alias("rubric_score"),
        F.count(F.lit(1)).alias("n_criteria"),
        F.count(v).alias("n_judged"),
        F.count_if(v).alias("n_met"),
        *more,
    )


def score_all_samples(samples: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Every sample with its score; samples without criteria score 0.0 with n_criteria 0."""
    s = samples.select(key).join(scored, key, "left")
    return s.select(
        key,
        F.coalesce("rubric_score", F.lit(0.0)).alias("rubric_score"),
        F.coalesce("n_criteria", F.lit(0).cast("bigint")).alias("n_criteria"),
        F.coalesce("n_judged", F.lit(0).cast("bigint")).alias("n_judged"),
        F.coalesce("n_met", F.lit(0).cast("bigint")).alias("n_met"),
    )


def rubric_dataset_metrics(samples: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Dataset metrics: mean score over all samples and ``num_graded``."""
    return dataset_rubric_metrics(score_all_samples(samples, score_samples(judged, key), key))


def criterion_results(judged: DataFrame, key: str) -> DataFrame:
    """Criterion results in long form: (key, criterion_idx, criterion, weight, criteria_met).

    This is the table form of the per-sample ``criterion_results`` list; it is
    never gathered into one array per sample, so no sample's criteria have to
    fit in one row.
    """
    return judged.select(key, "criterion_idx", "criterion", "weight", "criteria_met")
