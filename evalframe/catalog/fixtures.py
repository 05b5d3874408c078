"""Stand-in inputs derived from the driver's test tables.

Each fixture only shapes rows into the schema a job expects (samples,
predictions, references, grader replies...); none of them does any of the
job's work. The column expressions are plain SQL understood by both Spark
and DuckDB, so the oracle reads exactly the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.session import table

# QA samples from `orders`: reference letter from the key, category from the
# priority, and six prediction shapes (phrase, leading letter, lower-case
# letter in parentheses, no letter, letter with colon, "answer:" prefix).
_PRED_LETTER = "chr(65 + CAST(o_custkey % 5 AS INT))"
QA_COLUMNS = [
    "o_orderkey AS sample_id",
    "chr(65 + CAST(o_orderkey % 5 AS INT)) AS answer",
    "o_orderpriority AS category",
    "o_orderstatus AS status",
    "(o_orderkey % 4 <> 0) AS has_options",
    f"""CASE CAST(o_orderkey % 6 AS INT)
        WHEN 0 THEN 'The answer is ' || {_PRED_LETTER}
        WHEN 1 THEN {_PRED_LETTER} || '. because it fits'
        WHEN 2 THEN '(' || lower({_PRED_LETTER}) || ')'
        WHEN 3 THEN 'no idea'
        WHEN 4 THEN {_PRED_LETTER} || ': yes'
        ELSE 'answer: ' || {_PRED_LETTER} END AS prediction""",
]


def qa_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*QA_COLUMNS)


def qa_samples_sql() -> str:
    return "SELECT " + ", ".join(QA_COLUMNS) + " FROM orders"


# Rubric criteria from `lineitem`: sample = order, weight = quantity, and a
# grader reply whose shape depends on the return flag and line number.
REPLY_EXPR = """CASE
    WHEN l_returnflag = 'R' THEN '{"explanation": "meets it", "criteria_met": true}'
    WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN '```json' || chr(10) || '{"criteria_met": false}' || chr(10) || '```'
    WHEN l_returnflag = 'A' THEN 'Verdict: {"criteria_met": false, "explanation": "no"}'
    WHEN l_linenumber % 4 = 0 THEN 'Yes, the response covers it.'
    WHEN l_linenumber % 4 = 1 THEN 'No. It misses the point.'
    WHEN l_linenumber % 4 = 2 THEN 'I am unsure about this one.'
    ELSE '{"criteria_met": "true"}' END"""
CRITERIA_COLUMNS = [
    "l_orderkey AS sample_id",
    "'criterion for part ' || CAST(l_partkey AS STRING) AS criterion",
    "l_quantity AS weight",
    f"{REPLY_EXPR} AS reply",
]


def rubric_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*CRITERIA_COLUMNS)


def rubric_criteria_sql() -> str:
    return "SELECT " + ", ".join(CRITERIA_COLUMNS) + " FROM lineitem"


#: criteria per conversation: benchmark items (conv_id * 5 + j) mod their number, j = 0..4
CRITERIA_PER_SAMPLE = 5


def sample_criteria(spark: SparkSession, sf_dir: str, samples: DataFrame) -> DataFrame:
    """``samples`` (with conv_id) × their criteria: item_id and the item's text as criterion."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("criterion"))
    n_items = bench.select((F.max("item_id") + 1).alias("n")).scalar()
    j = F.explode(F.sequence(F.lit(0), F.lit(CRITERIA_PER_SAMPLE - 1)))
    keyed = samples.select("*", j.alias("_j")).withColumn("item_id", (F.col("conv_id") * CRITERIA_PER_SAMPLE + F.col("_j")) % n_items)
    return keyed.drop("_j").join(bench, "item_id")


SAMPLE_CRITERIA_SQL = f"""(SELECT s.conv_id, b.item_id, b.text AS criterion
FROM (SELECT DISTINCT conv_id FROM conversations) s, (SELECT unnest(range(0, {CRITERIA_PER_SAMPLE})) AS j) k, benchmark b
WHERE b.item_id = (s.conv_id * {CRITERIA_PER_SAMPLE} + k.j) % (SELECT max(item_id) + 1 FROM benchmark))"""


def rubric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sample_id")
