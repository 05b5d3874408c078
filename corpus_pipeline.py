"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import decontam, jaccard, mixing, quality, sharding
from evalframe.llm.common import hidden, read
from evalframe.session import materialize

N_SHARDS = 8


def _others(docs: DataFrame) -> list[str]:
    """The columns that no stage reads; they may have any name, and keep their values."""
    return [c for c in docs.columns if c not in ("doc_id", "text", "source")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line-frequency rule keep; their texts stay as they are."""
    plain, names = hidden(docs, _others(docs))
    return quality.judge(plain).where("kept").select(*plain.columns).withColumnsRenamed(names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every component of linked 5-word shingle sets (Jaccard 0.8 or more).

    Rows that repeat an id and its text count as one document, other texts of an
    id as documents of their own; rows without an id all stay.
    """
    plain, names = hidden(docs, _others(docs))
    keyed = plain.where("doc_id is not null").withColumn("_text", jaccard.text_key(F.col("doc_id"), F.col("text")))
    first = jaccard.first_texts(plain, k=5, percent=80).withColumnRenamed("_doc", "doc_id")
    chosen = keyed.join(first, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"]).drop("_text")
    return chosen.unionByName(plain.where("doc_id is null")).select(*plain.columns).withColumnsRenamed(names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    key = F.xxhash64("text")
    plain, names = hidden(docs, _others(docs))
    leaks = decontam.find_leaks(plain.select(key.alias("_key"), "text"), read(spark, sf_dir, "benchmark"), doc_id="_key")
    gone = leaks.select("_key").distinct()
    return plain.withColumn("_key", key).join(gone, "_key", "left_anti").select(*plain.columns).withColumnsRenamed(names)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0, 1 or 2 times) as the weighted mix takes it."""
    plain, names = hidden(docs, _others(docs))
    mixed = mixing.mix(plain)
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    return mixed.withColumn("_times", times).where("_times > 0").select(
        *plain.columns, F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_pass")
    ).drop("_pass").withColumnsRenamed(names)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document row with its shard and slot."""
    return sharding.shard(docs, N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: hashing, retrieval and seeded choices have no DuckDB counterpart; tests/llm checks the rows by brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
