"""Chat payloads in long form: normalised messages and grading histories.

A conversation is stored one turn per row. Messages are produced as rows
(no per-sample array), and the grading history — which has to become one
string per sample — is concatenated in two phases: first within bounded
buckets of consecutive turns, then the bucket pieces per sample. A sample
with a huge number of turns is therefore sorted and joined by many tasks;
only its final, already-joined pieces meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.prompts import CHAT_ROLES, CHAT_SYSTEM_PROMPT, turn_line

MESSAGE_COLUMNS = ("msg_idx", "role", "content")


def valid_message(role, content, default_role: str = "user") -> Column:
    """A message is kept when its role (absent → default) is user/assistant/system and its content is non-empty."""
    r = F.coalesce(F.col(role) if isinstance(role, str) else role, F.lit(default_role))
    c = F.col(content) if isinstance(content, str) else content
    return r.isin(*CHAT_ROLES) & c.isNotNull() & (c != "")


def chat_messages(
    turns: DataFrame,
    key: str,
    order: str = "turn",
    role: str = "role",
    content: str = "text",
    samples: DataFrame | None = None,
    prompt: str | None = None,
    system_prompt: str = CHAT_SYSTEM_PROMPT,
) -> DataFrame:
    """Model input messages, one row per message: (key, msg_idx, role, content).

    The system text comes first (``msg_idx = -1``), then every valid turn in
    turn order. A sample with no valid turn falls back to its non-empty
    ``prompt`` as one user message, else to one empty user message
    (``msg_idx = 0``). ``samples`` (key[, prompt]) adds samples that have no
    turn rows at all.
    """
    ok = valid_message(role, content)
    per_sample = turns.groupBy(key).agg(F.max(ok.cast("int")).alias("_n"))
    if samples is not None:
        cols = [key] + ([prompt] if prompt else [])
        per_sample = samples.select(*cols).join(per_sample, key, "left")
    kept = turns.where(ok).select(
        key, F.col(order).cast("bigint").alias("msg_idx"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.col(content).alias("content")
    )
    fb_text = F.coalesce(F.nullif(F.col(prompt), F.lit("")), F.lit("")) if prompt else F.lit("")
    msg = "struct<msg_idx:bigint,role:string,content:string>"
    system_msg = F.struct(F.lit(-1).cast("bigint").alias("msg_idx"), F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))
    fallback_msg = F.struct(F.lit(0).cast("bigint").alias("msg_idx"), F.lit("user").alias("role"), fb_text.alias("content"))
    # one pass over the per-sample flags: the system row always, the fallback row when no turn was kept
    extra = F.when(F.coalesce(F.col("_n"), F.lit(0)) == 0, F.array(system_msg, fallback_msg)).otherwise(F.array(system_msg))
    added = per_sample.select(key, F.explode(extra.cast(f"array<{msg}>")).alias("_m")).select(key, "_m.msg_idx", "_m.role", "_m.content")
    return added.unionByName(kept)


def ordered_concat(rows: DataFrame, key: str, order: str, value: str, sep: str, bucket_rows: int = 1024) -> DataFrame:
    """``sep.join(value ordered by order)`` per key → (key, text).

    Phase 1 joins runs of ``bucket_rows`` consecutive order values; phase 2 joins
    the pieces. Order values are expected to be unique per key.
    """
    piece_of = F.floor(F.col(order) / F.lit(bucket_rows))
    pieces = rows.groupBy(key, piece_of.alias("_b")).agg(
        F.min(order).alias("_start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]), sep).alias("_piece"),
    )
    return pieces.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_start").alias("o"), F.col("_piece").alias("v")))), lambda x: x["v"]), sep).alias("text")
    )


def grading_history(turns: DataFrame, key: str, order: str = "turn", role: str = "role", content: str = "text", bucket_rows: int = 1024) -> DataFrame:
    """Conversation history as the grader sees it, one row per sample: (key, history).

    Every turn is kept as stored (no role filter), each rendered as
    ``"{Role}: {content}"`` and separated by a blank line.
    """
    lines = turns.select(key, order, turn_line(F.col(role), F.coalesce(F.col(content), F.lit("None"))).alias("_line"))
    return ordered_concat(lines, key, order, "_line", "\n\n", bucket_rows).withColumnRenamed("text", "history")


def last_turn(turns: DataFrame, key: str, role_value: str = "assistant", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """Text of the last turn with the given role per sample (partial aggregate, no group
    collected; equal turn numbers are broken by the text, so the result is deterministic)."""
    latest = F.max(F.struct(F.col(order).alias("o"), F.col(content).alias("t")))
    return turns.where(F.col(role) == role_value).groupBy(key).agg(latest["t"].alias("last_" + role_value))
