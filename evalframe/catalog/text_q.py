"""Scalar text functions over the whole text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.catalog import sqltext as S
from evalframe.catalog.registry import query
from evalframe.functions.text import exact_match, extract_choice, normalize_answer
from evalframe.functions.verdict import with_verdict
from evalframe.catalog.fixtures import rubric_criteria, rubric_criteria_sql
from evalframe.operators.metrics import avg_response_length
from evalframe.session import table


@query(
    "normalize_answer",
    oracle=f"SELECT doc_id, {S.normalize('text')} AS normalized FROM documents",
)
def q_normalize_answer(spark, sf_dir):
    """Answer normalisation of every document text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", normalize_answer("text").alias("normalized"))


_EM_VARIANT = """CASE CAST(p_partkey % 3 AS INT)
    WHEN 0 THEN 'The ' || upper(p_name) || '!'
    WHEN 1 THEN '  ' || p_name || ', an'
    ELSE p_type END"""


@query(
    "exact_match",
    oracle=f"SELECT p_partkey, {S.exact_match(_EM_VARIANT, 'p_name')} AS em FROM part",
)
def q_exact_match(spark, sf_dir):
    """Exact match of part names against decorated, re-cased or unrelated variants."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", exact_match(F.expr(_EM_VARIANT), F.col("p_name")).alias("em"))


@query(
    "extract_choice",
    oracle=f"""SELECT 'turn' AS src, conv_id AS id, turn AS pos, {S.choice('text')} AS choice FROM conversations
UNION ALL
SELECT 'doc' AS src, doc_id AS id, 0 AS pos, {S.choice('text')} AS choice FROM documents""",
)
def q_extract_choice(spark, sf_dir):
    """Letter choice extracted from every conversation turn and document."""
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("src"), F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "text"
    )
    docs = table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("pos"), "text"
    )
    return turns.unionByName(docs).select("src", "id", "pos", extract_choice("text").alias("choice"))


@query(
    "avg_response_length",
    oracle=f"""SELECT 'assistant' AS scope, round(coalesce(avg({S.token_count('text')}), 0.0), 6) AS avg_response_length,
       count(*) AS n FROM conversations WHERE role = 'assistant'
UNION ALL
SELECT 'lang_' || lang AS scope, round(coalesce(avg({S.token_count('text')}), 0.0), 6), count(*) FROM documents GROUP BY lang""",
)
def q_avg_response_length(spark, sf_dir):
    """Mean whitespace-token length of assistant turns, and of documents per language."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(F.col("text").alias("prediction"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("lang_"), "lang").alias("scope"), F.col("text").alias("prediction"))
    a = avg_response_length(turns).select(F.lit("assistant").alias("scope"), "avg_response_length", "n")
    b = avg_response_length(docs, by=["scope"])
    out = a.unionByName(b)
    return out.select("scope", F.round("avg_response_length", 6).alias("avg_response_length"), "n")


def _verdict_sql(x: str) -> str:
    s = S.strip(x)
    fenced = f"regexp_extract({s}, '(?s)```(?:json)?{S.WS}*(\\{{.*?\\}}){S.WS}*```', 1)"
    greedy = f"regexp_extract({s}, '(?s)(\\{{.*\\}})', 1)"

    def from_json(c):
        return (
            f"CASE WHEN json_valid({c}) AND json_type({c}) = 'OBJECT' "
            f"AND json_type({c}, '$.criteria_met') = 'BOOLEAN' "
            f"THEN json_extract({c}, '$.criteria_met')::BOOLEAN END"
        )

    low = f"lower({s})"
    word = "[^\\p{L}\\p{N}_]"
    text_rules = (
        f"CASE WHEN regexp_matches({low}, '\"criteria_met\"{S.WS}*:{S.WS}*true') THEN true "
        f"WHEN regexp_matches({low}, '\"criteria_met\"{S.WS}*:{S.WS}*false') THEN false "
        f"WHEN regexp_matches({low}, '(^|{word})yes({word}|$)') THEN true "
        f"WHEN regexp_matches({low}, '(^|{word})no({word}|$)') THEN false END"
    )
    return (
        f"CASE WHEN {s} IS NULL OR {s} = '' THEN NULL ELSE coalesce({from_json(s)}, "
        f"CASE WHEN {fenced} <> '' THEN {from_json(fenced)} END, "
        f"CASE WHEN {greedy} <> '' THEN {from_json(greedy)} END, {text_rules}) END"
    )


@query(
    "parse_verdict",
    oracle=f"""WITH c AS ({rubric_criteria_sql()})
SELECT sample_id, criterion, reply, CAST({_verdict_sql('reply')} AS VARCHAR) AS criteria_met FROM c""",
)
def q_parse_verdict(spark, sf_dir):
    """Three-valued verdict of every grader reply (rendered as text: true/false/null)."""
    c = rubric_criteria(spark, sf_dir)
    v = with_verdict(c, "reply", "criteria_met")
    return v.select("sample_id", "criterion", "reply", F.col("criteria_met").cast("string").alias("criteria_met"))
