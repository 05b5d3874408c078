"""Prompt-building queries over conversations, benchmark questions and parts."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from evalframe.catalog import sqltext as S
from evalframe.catalog.fixtures import SAMPLE_CRITERIA_SQL, sample_criteria
from evalframe.catalog.registry import query
from evalframe.functions.prompts import (
    CHAT_SYSTEM_PROMPT,
    GRADER_TEMPLATE,
    QA_CHOICE_TEMPLATE,
    QA_OPEN_TEMPLATE,
    format_options,
    grader_prompt,
    has_options,
    image_data_url,
    qa_user_text,
)
from evalframe.functions.text import first_nonempty, py_strip
from evalframe.operators.conversation import chat_messages, grading_history, last_turn
from evalframe.plans.tasks import get_task
from evalframe.session import table


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fill(template: str, **exprs) -> str:
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(sql_str(literal))
        if field is not None:
            parts.append(f"({exprs[field]})")
    return " || ".join(parts)


_VALID = "coalesce(role, 'user') IN ('user', 'assistant', 'system') AND text IS NOT NULL AND text <> ''"


@query(
    "chat_messages",
    oracle=f"""WITH per AS (SELECT conv_id, max(CASE WHEN {_VALID} THEN 1 ELSE 0 END) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(-1 AS BIGINT) AS msg_idx, 'system' AS role, {sql_str(CHAT_SYSTEM_PROMPT)} AS content FROM per
UNION ALL SELECT conv_id, turn, coalesce(role, 'user'), text FROM conversations WHERE {_VALID}
UNION ALL SELECT conv_id, CAST(0 AS BIGINT), 'user', '' FROM per WHERE n = 0""",
)
def q_chat_messages(spark, sf_dir):
    """Chat model input per conversation, one row per message: system text, then the
    valid turns in order (fallback: one empty user message)."""
    turns = table(spark, sf_dir, "conversations")
    return chat_messages(turns, "conv_id").select("conv_id", "msg_idx", "role", "content")


_HISTORY_SQL = (
    f"SELECT conv_id, string_agg({S.capitalize('role')} || ': ' || coalesce(text, 'None'), chr(10) || chr(10) ORDER BY turn) AS history "
    "FROM conversations GROUP BY conv_id"
)


@query("grading_history", oracle=_HISTORY_SQL)
def q_grading_history(spark, sf_dir):
    """Grader-facing history of every conversation: "Role: content" lines, blank-line separated."""
    return grading_history(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "history")


_GRADER_SQL = f"""WITH h AS ({_HISTORY_SQL}),
r AS (SELECT conv_id, arg_max(text, turn) AS response FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT h.conv_id, b.item_id, b.criterion, h.history FROM h JOIN {SAMPLE_CRITERIA_SQL} b ON h.conv_id = b.conv_id)
SELECT c.conv_id, c.item_id,
       {sql_fill(GRADER_TEMPLATE, history="coalesce(nullif(c.history, ''), 'User: ')", response="coalesce(r.response, '')", criterion="c.criterion")} AS prompt
FROM c LEFT JOIN r ON c.conv_id = r.conv_id"""


def grader_inputs(spark, sf_dir):
    """(conv_id, item_id, history, response, criterion) for every criterion of every conversation."""
    turns = table(spark, sf_dir, "conversations")
    hist = grading_history(turns, "conv_id")
    resp = last_turn(turns, "conv_id")
    crit = sample_criteria(spark, sf_dir, hist)
    return crit.join(resp, "conv_id", "left").select(
        "conv_id", "item_id", "history", F.coalesce("last_assistant", F.lit("")).alias("response"), "criterion"
    )


@query("grader_prompt", oracle=_GRADER_SQL)
def q_grader_prompt(spark, sf_dir):
    """Grader prompt per (conversation, criterion): history, last assistant reply as the
    response under test, and a benchmark text as the criterion."""
    g = grader_inputs(spark, sf_dir)
    return g.select("conv_id", "item_id", grader_prompt("history", "response", "criterion").alias("prompt"))


# QA fixture: each benchmark item gets the names of the four parts with
# p_partkey div 4 = item_id as options; item_id % 4 picks the layout:
# 0 = options list, 1 = option_A plus list, 2 = option_A/B/D fields, 3 = none.
def qa_items(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    opts = part.groupBy(F.floor(F.col("p_partkey") / 4).alias("item_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("names")
    )
    items = table(spark, sf_dir, "benchmark").join(opts, "item_id", "left")
    v = F.col("item_id") % 4
    nm = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    return items.select(
        "item_id",
        F.col("text").alias("question"),
        F.when(v <= 1, nm).alias("options"),
        F.when(v.isin(1, 2), F.upper(F.try_element_at(nm, F.lit(1)))).alias("option_A"),
        F.when(v == 2, F.try_element_at(nm, F.lit(2))).alias("option_B"),
        F.when(v == 2, F.try_element_at(nm, F.lit(4))).alias("option_D"),
    )


_QA_ITEMS_SQL = """WITH o AS (SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS item_id, list(p_name ORDER BY p_partkey) AS names FROM part GROUP BY 1),
i AS (SELECT b.item_id, b.text AS question, coalesce(o.names, []) AS names FROM benchmark b LEFT JOIN o ON b.item_id = o.item_id),
f AS (SELECT item_id, question, names, item_id % 4 AS v,
        array_to_string(list_transform(names[1:5], lambda x, i: chr(64 + CAST(i AS INT)) || '. ' || x), chr(10)) AS listed FROM i)"""

_OPTS_TEXT = (
    "CASE v WHEN 0 THEN listed "
    "WHEN 1 THEN CASE WHEN len(names) > 0 THEN 'A. ' || upper(names[1]) || chr(10) || listed ELSE 'A. ' || upper(names[1]) END "
    "WHEN 2 THEN array_to_string(list_filter(['A. ' || upper(names[1]), 'B. ' || names[2], 'D. ' || names[4]], lambda x: x IS NOT NULL), chr(10)) END"
)
_HAS_OPTS = "(v <= 1 AND len(names) > 0) OR (v IN (1, 2) AND names[1] IS NOT NULL) OR (v = 2 AND (names[2] IS NOT NULL OR names[4] IS NOT NULL))"


@query(
    "qa_prompt",
    oracle=f"""{_QA_ITEMS_SQL}
SELECT item_id, ({_HAS_OPTS}) AS has_options,
       CASE WHEN {_HAS_OPTS} THEN {sql_fill(QA_CHOICE_TEMPLATE, question="coalesce(question, '')", options=_OPTS_TEXT)}
            ELSE {sql_fill(QA_OPEN_TEMPLATE, question="coalesce(question, '')")} END AS user_text
FROM f""",
)
def q_qa_prompt(spark, sf_dir):
    """QA prompt text per benchmark question: options detection, lettered option
    formatting (list, keyed fields, or both) and the choice/open-ended template."""
    s = qa_items(spark, sf_dir)
    keyed = {"option_A": "option_A", "option_B": "option_B", "option_D": "option_D"}
    opt = has_options(options="options", keyed=keyed)
    text = format_options(options="options", keyed=keyed)
    return s.select("item_id", opt.alias("has_options"), qa_user_text("question", text, opt).alias("user_text"))


@query(
    "image_data_url",
    oracle="""SELECT doc_id, length(u) AS url_chars, sha256(u) AS url_sha256
FROM (SELECT doc_id, 'data:image/jpeg;base64,' || base64(encode(text)) AS u FROM documents)""",
)
def q_image_data_url(spark, sf_dir):
    """Image bytes (document text as bytes) → base64 data URL; reported by length and SHA-256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("image"))
    url = image_data_url("image")
    return docs.select("doc_id", F.length(url).cast("bigint").alias("url_chars"), F.sha2(url, 256).alias("url_sha256"))


@query(
    "reference_column",
    oracle=f"""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS sample_id,
       upper({S.strip("coalesce(nullif(o_orderpriority, ''), nullif(o_orderstatus, ''), '')")}) AS qa_reference,
       CAST(coalesce(n.n, 0) AS VARCHAR) || ' rubrics' AS chat_reference
FROM orders LEFT JOIN n ON o_orderkey = n.l_orderkey""",
)
def q_reference_column(spark, sf_dir):
    """Reference per sample: QA answer (first non-empty answer field, stripped, upper-cased)
    and the chat reference "{number of rubric criteria} rubrics"."""
    orders = table(spark, sf_dir, "orders")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rubric = F.struct(F.lit("a criterion").alias("criterion"), F.lit(1.0).alias("weight"))
    s = orders.join(counts, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderpriority").alias("answer"),
        F.col("o_orderstatus").alias("gt_answer"),
        F.array_repeat(rubric, F.coalesce("n", F.lit(0)).cast("int")).alias("rubrics"),
    )
    qa, chat = get_task("choice_qa"), get_task("rubric_chat")
    return s.select("sample_id", qa.reference(s).alias("qa_reference"), chat.reference(s).alias("chat_reference"))


@query(
    "qa_image_messages",
    oracle=f"""WITH d AS (SELECT doc_id, doc_id % 3 AS k, coalesce(text, '') AS q, 'data:image/jpeg;base64,' || base64(encode(text)) AS u FROM documents),
o AS (SELECT *, CASE WHEN k = 1 THEN 'one; two; three' WHEN k = 2 THEN '' END AS opts FROM d)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND u IS NOT NULL THEN 2 ELSE 1 END AS n_parts,
       CASE WHEN doc_id % 2 = 0 AND u IS NOT NULL THEN sha256(u) END AS image_sha256,
       sha256(CASE WHEN opts <> '' THEN {sql_fill(QA_CHOICE_TEMPLATE, question="q", options="opts")} ELSE {sql_fill(QA_OPEN_TEMPLATE, question="q")} END) AS text_sha256
FROM o""",
)
def q_qa_image_messages(spark, sf_dir):
    """Model input of image questions through the task: every second document carries its
    bytes as an image; options are one text, an empty text or absent."""
    k = F.col("doc_id") % 3
    s = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("question"),
        F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).alias("image"),
        F.when(k == 1, F.lit("one; two; three")).when(k == 2, F.lit("")).alias("options"),
    )
    parts = s.select("doc_id", F.element_at(get_task("choice_qa").messages(s), -1)["content"].alias("c"))
    last = F.element_at("c", -1)
    return parts.select(
        "doc_id",
        F.size("c").alias("n_parts"),
        F.sha2(F.get(F.filter("c", lambda p: p["type"] == "image_url"), F.lit(0))["url"], 256).alias("image_sha256"),
        F.sha2(last["text"], 256).alias("text_sha256"),
    )
