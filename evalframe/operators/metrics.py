"""Metric aggregations over graded records.

All metrics are algebraic (sums, counts, boolean and): Spark aggregates them
partially on the map side, so a category or sample holding a third of all
rows still ships one partial row per task through the shuffle. Overall and
per-category values come from one ``GROUPING SETS`` pass, not two scans.

Results are in long form ``(metric STRING, value DOUBLE, n BIGINT)`` so batch,
streaming and the run tables share one layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.text import choice_correct, exact_match, first_nonempty, token_count

METRIC_SCHEMA = "metric string, value double, n bigint"
# --- fixed values ---------------------------------------------------------
# Metrics that are counts: listed as integers, not with four decimals.
INTEGER_METRICS = ("num_graded",)
# --------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: powers of two that split a double into two integers for exact sums
_HIGH, _LOW = 2.0**26, 2.0**78


def exact_sum(value) -> Column:
    """Aggregate: sum of doubles that does not depend on the order or the partitioning of rows.

    Each value is split into a multiple of 2^-26 and a rest counted in 2^-78; both are summed as
    decimals, which is exact and associative, and only the two totals are rounded to a double.
    Null for no values, as ``sum``. Values are finite.
    """
    v = _c(value).cast("double")
    high = F.rint(v * _HIGH)
    low = F.rint((v - high / _HIGH) * _LOW)
    part = lambda x, unit: F.sum(x.cast("decimal(38,0)")).cast("double") / unit
    return part(high, _HIGH) + part(low, _LOW)


def exact_mean(value) -> Column:
    """Aggregate: mean of the non-null doubles, equal for any order and partitioning; null for none."""
    return F.try_divide(exact_sum(value), F.count(value))


def category_label(category, type_=None, task_type=None) -> Column:
    """``category or type or task_type``; empty → null (no category)."""
    cols = [c for c in (category, type_, task_type) if c is not None]
    label = first_nonempty(*[_c(c) for c in cols]) if len(cols) > 1 else _c(cols[0])
    return F.nullif(label, F.lit(""))


def grade_qa(prediction, reference, has_options) -> Column:
    """Per-record QA grade (1.0/0.0): multiple choice when the record has options, else exact match."""
    return F.when(_c(has_options), choice_correct(prediction, reference).cast("double")).otherwise(
        exact_match(prediction, reference)
    )


def _with_sentinel(rows: DataFrame) -> DataFrame:
    """Add one marker row (all values null, ``_sentinel`` true) so the overall
    grouping set exists even for an empty input; aggregates skip its nulls and
    counts skip it explicitly. One pass, no second scan."""
    marker = rows.sparkSession.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields], F.lit(True).alias("_sentinel")
    )
    return rows.withColumn("_sentinel", F.lit(False)).unionByName(marker)


def record_accuracy(graded: DataFrame, correct: str = "correct", category: str = "category") -> DataFrame:
    """Accuracy from graded records: overall mean of ``correct`` (missing → 0.0)
    over all records plus the mean per non-empty category (``accuracy_{cat}``).
    No records → accuracy 0.0."""
    ok = F.coalesce(F.col(correct).cast("double"), F.lit(0.0))
    cat = F.nullif(F.col(category).cast("string"), F.lit(""))
    rows = _with_sentinel(graded.select(ok.alias("_ok"), cat.alias("_cat")))
    agg = rows.groupingSets([[], ["_cat"]], "_cat").agg(
        F.coalesce(F.avg("_ok"), F.lit(0.0)).alias("value"),
        F.count_if(~F.col("_sentinel")).alias("n"),
        F.grouping("_cat").alias("_g"),
    )
    return agg.where((F.col("_g") == 1) | (F.col("_cat").isNotNull() & (F.col("n") > 0))).select(
        F.when(F.col("_g") == 1, F.lit("accuracy")).otherwise(F.concat(F.lit("accuracy_"), F.col("_cat"))).alias("metric"),
        F.col("value"),
        F.col("n"),
    )


def multiple_choice_accuracy(pairs: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Share of multiple-choice-correct predictions; empty → 0.0. One row."""
    ok = choice_correct(prediction, reference).cast("double")
    return pairs.agg(
        F.coalesce(F.avg(ok), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def batch_accuracy(
    samples: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    has_options: str = "has_options",
    category: str = "category",
) -> DataFrame:
    """Accuracy of the in-memory (batch) path.

    Overall: multiple choice when *every* sample has options, otherwise
    exact match for all. Per category: always multiple choice.
    Denominators are the number of predictions.
    """
    mc = choice_correct(prediction, reference).cast("double")
    em = exact_match(prediction, reference)
    rows = _with_sentinel(
        samples.select(
            mc.alias("_mc"), em.alias("_em"), F.col(has_options).alias("_opt"),
            F.nullif(F.col(category).cast("string"), F.lit("")).alias("_cat"),  # "" is no category
        )
    )
    agg = rows.groupingSets([[], ["_cat"]], "_cat").agg(
        F.coalesce(F.avg("_mc"), F.lit(0.0)).alias("_mc"),
        F.coalesce(F.avg("_em"), F.lit(0.0)).alias("_em"),
        F.bool_and("_opt").alias("_all_opt"),
        F.count_if(~F.col("_sentinel")).alias("n"),
        F.grouping("_cat").alias("_g"),
    )
    overall = F.when(F.coalesce(F.col("_all_opt"), F.lit(True)), F.col("_mc")).otherwise(F.col("_em"))
    return agg.where((F.col("_g") == 1) | (F.col("_cat").isNotNull() & (F.col("n") > 0))).select(
        F.when(F.col("_g") == 1, F.lit("accuracy")).otherwise(F.concat(F.lit("accuracy_"), F.col("_cat"))).alias("metric"),
        F.when(F.col("_g") == 1, overall).otherwise(F.col("_mc")).alias("value"),
        F.col("n"),
    )


def rubric_score_expr(met, weight, judged=None) -> Column:
    """Aggregate expression: Σ weight(met) / Σ weight(judged).

    Unjudged (null) verdicts are skipped; nothing judged or a zero total → 0.0.
    """
    v = _c(met)
    w = F.coalesce(_c(weight).cast("double"), F.lit(1.0))
    met_w = F.coalesce(exact_sum(F.when(v, w)), F.lit(0.0))
    total_w = exact_sum(F.when(v.isNotNull(), w))
    return F.coalesce(F.try_divide(met_w, total_w), F.lit(0.0))


def points_score_expr(met, points) -> Column:
    """Opt-in points scoring (aggregate): Σ points of met criteria / Σ positive
    points, clipped to [0, 1]. Negative points penalise when met; an unjudged
    criterion counts as not met; no positive points → 0.0."""
    v = F.coalesce(_c(met), F.lit(False))
    p = F.coalesce(_c(points).cast("double"), F.lit(0.0))
    achieved = F.coalesce(F.sum(F.when(v, p)), F.lit(0.0))
    possible = F.sum(F.when(p > 0, p))
    raw = F.coalesce(F.try_divide(achieved, possible), F.lit(0.0))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def rubric_score_nested(results) -> Column:
    """Row-level score of an ``array<struct<criterion, weight, criteria_met>>``; no shuffle."""
    judged = F.filter(_c(results), lambda x: x["criteria_met"].isNotNull())
    total = F.aggregate(judged, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["weight"].cast("double"), F.lit(1.0)))
    met = F.aggregate(
        F.filter(judged, lambda x: x["criteria_met"]),
        F.lit(0.0),
        lambda acc, x: acc + F.coalesce(x["weight"].cast("double"), F.lit(1.0)),
    )
    return F.coalesce(F.try_divide(met, F.when(total != 0, total)), F.lit(0.0))


def dataset_rubric_metrics(per_sample: DataFrame, score: str = "rubric_score", n_criteria: str = "n_criteria") -> DataFrame:
    """Mean score over all samples (rubric-less count as 0.0) and the number of
    samples with a non-empty rubric list. One row."""
    return per_sample.agg(
        F.coalesce(exact_mean(F.coalesce(F.col(score), F.lit(0.0))), F.lit(0.0)).alias("rubric_score"),
        F.count_if(F.coalesce(F.col(n_criteria), F.lit(0)) > 0).alias("num_graded"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def avg_response_length(predictions: DataFrame, prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Mean whitespace-token count of the predictions (empty → 0.0)."""
    n = token_count(prediction)
    aggs = [F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_response_length"), F.count(F.lit(1)).alias("n")]
    return predictions.groupBy(*by).agg(*aggs) if by else predictions.agg(*aggs)


def metrics_long(metrics: DataFrame, task: str = "task", num_samples: str = "num_samples") -> DataFrame:
    """Display rows (task, metric, value text, # samples); value text has four
    decimals, rounded half-even from the exact value like Python's ``%.4f``
    (counts such as ``num_graded`` are listed as integers). A task without
    metrics yields one ``status=predictions_saved`` row."""
    entry = F.explode_outer(F.map_entries(F.col("metrics")))
    rows = metrics.select(F.col(task).alias("task"), F.col(num_samples).alias("num_samples"), entry.alias("_e"))
    return rows.select(
        "task",
        F.coalesce(F.col("_e.key"), F.lit("status")).alias("metric"),
        F.when(F.col("_e.key").isNull(), F.lit("predictions_saved"))
        .when(F.col("_e.key").isin(*INTEGER_METRICS), F.col("_e.value").cast("bigint").cast("string"))
        .otherwise(F.regexp_replace(F.format_number(F.col("_e.value"), 4), ",", ""))
        .alias("value"),
        F.col("num_samples").cast("string").alias("num_samples"),
    )
