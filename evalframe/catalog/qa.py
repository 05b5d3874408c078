"""QA grading queries: choice extraction, correctness and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.catalog import sqltext as S
from evalframe.catalog.fixtures import qa_samples, qa_samples_sql
from evalframe.catalog.registry import query
from evalframe.functions.text import py_strip
from evalframe.operators.joins import zip_by_key
from evalframe.operators.metrics import batch_accuracy, category_label, grade_qa, multiple_choice_accuracy, record_accuracy

_QA = f"WITH qa AS ({qa_samples_sql()})"
_REF = f"upper({S.strip('answer')})"


def _records(spark, sf_dir):
    """Records as persisted by a QA run: prediction, reference, options flag, category."""
    s = qa_samples(spark, sf_dir)
    return s.select(
        "sample_id",
        "prediction",
        F.upper(py_strip("answer")).alias("reference"),
        F.lit(True).alias("has_options"),
        category_label("category").alias("category"),
    )


@query(
    "qa_accuracy_by_category",
    oracle=f"""{_QA}, g AS (
  SELECT nullif(category, '') AS cat,
         CAST({S.choice_correct('prediction', _REF)} AS DOUBLE) AS ok FROM qa)
SELECT CASE WHEN grouping(cat) = 1 THEN 'accuracy' ELSE 'accuracy_' || cat END AS metric,
       round(avg(ok), 6) AS value, count(*) AS n
FROM g GROUP BY GROUPING SETS ((), (cat))
HAVING grouping(cat) = 1 OR cat IS NOT NULL""",
)
def qa_accuracy_by_category(spark, sf_dir):
    """Record-path accuracy: extract choice → choice correctness → overall and per-category means."""
    graded = _records(spark, sf_dir).withColumn("correct", grade_qa("prediction", "reference", "has_options"))
    return record_accuracy(graded).select("metric", F.round("value", 6).alias("value"), "n")


@query(
    "qa_accuracy_overall",
    oracle=f"""{_QA}
SELECT round(coalesce(avg(CAST({S.choice_correct('prediction', _REF)} AS DOUBLE)), 0.0), 6) AS accuracy,
       count(*) AS n FROM qa""",
)
def qa_accuracy_overall(spark, sf_dir):
    """Multiple-choice accuracy over all prediction/reference pairs."""
    pairs = _records(spark, sf_dir)
    return multiple_choice_accuracy(pairs).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query(
    "qa_batch_accuracy_mixed",
    oracle=f"""{_QA}, g AS (
  SELECT nullif(category, '') AS cat, has_options,
         CAST({S.choice_correct('prediction', _REF)} AS DOUBLE) AS mc,
         {S.exact_match('prediction', _REF)} AS em FROM qa)
SELECT CASE WHEN grouping(cat) = 1 THEN 'accuracy' ELSE 'accuracy_' || cat END AS metric,
       round(CASE WHEN grouping(cat) = 1 AND NOT coalesce(bool_and(has_options), true) THEN avg(em) ELSE avg(mc) END, 6) AS value,
       count(*) AS n
FROM g GROUP BY GROUPING SETS ((), (cat))
HAVING grouping(cat) = 1 OR cat IS NOT NULL""",
)
def qa_batch_accuracy_mixed(spark, sf_dir):
    """Batch path on a mixed set: exact match overall (not every sample has options),
    multiple choice per category."""
    s = qa_samples(spark, sf_dir).select(
        "prediction",
        F.upper(py_strip("answer")).alias("reference"),
        "has_options",
        category_label("category").alias("category"),
    )
    return batch_accuracy(s).select("metric", F.round("value", 6).alias("value"), "n")


@query(
    "qa_record_grade",
    oracle=f"""{_QA}, p AS (SELECT sample_id, prediction, has_options FROM qa),
r AS (SELECT sample_id, {_REF} AS reference, nullif(category, '') AS category FROM qa WHERE status <> 'P')
SELECT p.sample_id,
       CASE WHEN has_options THEN CAST({S.choice_correct('prediction', "coalesce(nullif(reference, ''), '')")} AS DOUBLE)
            ELSE {S.exact_match('prediction', "coalesce(nullif(reference, ''), '')")} END AS correct,
       category
FROM p LEFT JOIN r ON p.sample_id = r.sample_id""",
)
def qa_record_grade(spark, sf_dir):
    """Per-record grade: predictions and references are separate tables zipped on the
    key (predictions of pending orders have no reference and keep their row, graded against ""), MC when the
    record has options else exact match; category label carried along."""
    s = qa_samples(spark, sf_dir)
    preds = s.select("sample_id", "prediction", "has_options")
    refs = s.where(F.col("status") != "P").select(
        "sample_id", F.upper(py_strip("answer")).alias("reference"), category_label("category").alias("category")
    )
    z = zip_by_key(preds, refs, "sample_id")
    ref = F.coalesce(F.nullif("reference", F.lit("")), F.lit(""))
    return z.select("sample_id", grade_qa("prediction", ref, "has_options").alias("correct"), "category")
