"""Quality rules: per-document counts, and cross-document line frequency per host.

Base rules count words, symbols, repeated lines and repeated 8-word windows of
the whole text. The line rule hashes normalised lines, counts the distinct
documents of a host that hold each line, removes lines above the host's limit
and rejects documents that lose almost all of their words.

Copies of one text count as one document, so a popular page does not turn its
own lines into boilerplate. Everything is DataFrame code; the only shuffles are
of line hashes (pre-aggregated per host and line) and of one small row per
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import NOT_SPACE, SPACE, checkpoint, shielded, text_or_empty, words, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: a line is boilerplate on a host if at least this many of its distinct texts hold it ...
MIN_LINE_DOCS = 20
#: ... and more than this share of them
LINE_SHARE_PERCENT = 10
#: a document is depleted if fewer than this share of its words is left
MIN_LEFT_PERCENT = 20


def _paired(hashes: str, width: int) -> Column:
    """Each hash combined with the one ``width`` places on."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(F.col(hashes), i + width)))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus the base counts and ``base_failed``.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and
    base_failed. A null text counts as empty: all counts 0, base_failed true.
    """
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in own]
    t = text_or_empty(F.col(f"`{text}`"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    a = df.select(*keep, words(F.col(f"`{text}`")).alias("_w"), lines.alias("_lines"))
    b = a.select(
        *keep,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # hashes of 2, 4 and 8 words from pairs of the shorter ones; the last WINDOW - 1 starts have no whole window
    for width in (1, 2, 4):
        b = b.select(*keep, *counts, _paired("_h", width).alias("_h"))
    c = b.select(*keep, *counts, F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))).alias("_h"))
    d = c.select(*keep, *counts, "_h", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_any"))
    # only where some window repeats: positions in hash order, then the repeated ones in text order
    e = d.select(
        *keep, *counts,
        F.when(F.col("_any"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_p"),
    )
    same = lambda i, j: F.get(F.col("_p"), i)["h"] == F.get(F.col("_p"), j)["h"]
    f = e.select(
        *keep, *counts,
        F.sort_array(
            F.transform(
                F.filter("_p", lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
                lambda x: x["i"],
            )
        ).alias("_r"),
    )
    covered = F.aggregate(
        F.col("_r"),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    g = f.select(*keep, *counts, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return g.withColumn("base_failed", failed)


def normal_line(line: Column) -> Column:
    """Lower case, digit runs as 0, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "0"), SPACE, " "))


def _host_and_text(host: str, text: str) -> list[Column]:
    """Join keys of a document: its host (null: a host of its own) and the hash of its whole text."""
    h = F.col(f"`{host}`").cast("string")
    return [
        F.when(h.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), h)).alias("_host"),
        F.xxhash64(text_or_empty(F.col(f"`{text}`"))).alias("_text"),
    ]


def document_lines(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Lines with a word, one row per host, distinct text and normalised line: _host, _text, _line (hash), _words."""
    lines = F.filter(F.split(text_or_empty(F.col(f"`{text}`")), "\n"), lambda x: x.rlike(NOT_SPACE))
    each = df.select(*_host_and_text(host, text), lines.alias("_lines")).select(
        "_host", "_text", F.explode("_lines").alias("_raw")
    )
    hashed = each.select(
        "_host", "_text", F.xxhash64(normal_line(F.col("_raw"))).alias("_line"), F.size(words("_raw")).alias("_n")
    )
    # copies of a text repeat its rows: _words is the sum over all copies
    return hashed.groupBy("_host", "_text", "_line").agg(F.sum("_n").alias("_words"))


def distinct_texts(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """One row per host and distinct text with its number of copies: _host, _text, _copies."""
    return df.select(*_host_and_text(host, text)).groupBy("_host", "_text").agg(F.count(F.lit(1)).alias("_copies"))


def frequent_lines(lines: DataFrame, copies: DataFrame) -> DataFrame:
    """(_host, _line) of every line above its host's limit, counted over distinct texts."""
    per_line = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"))
    texts = copies.groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    above = (F.col("_docs") >= MIN_LINE_DOCS) & (100 * F.col("_docs") > LINE_SHARE_PERCENT * F.col("_texts"))
    return per_line.join(texts, "_host").where(above).select("_host", "_line")


@shielded
def judge(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """All columns of ``df`` plus the base counts, n_boiler_words and ``kept``.

    n_boiler_words counts the words on lines above the host's limit; a document
    is kept if base_failed is false and at least MIN_LEFT_PERCENT of its words
    remain without those lines. Null text: kept false. Null host: one host of
    its own. Repeated rows get equal verdicts. Empty table: no rows.
    """
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_boiler_words", "kept"}
    cols = [F.col(f"`{c}`") for c in df.columns if c not in own]
    base = base_counts(df.select(*_host_and_text(host, text), F.col(f"`{text}`").alias("_t")), "_t").drop("_t")
    base = base.dropDuplicates(["_host", "_text"])
    # both are small against the texts and feed several joins: written once to the shared folder
    lines, copies = checkpoint(document_lines(df, host, text)), checkpoint(distinct_texts(df, host, text))
    boiler = (
        lines.join(frequent_lines(lines, copies), ["_host", "_line"], "left_semi")
        .groupBy("_host", "_text")
        .agg(F.sum("_words").alias("_sum"))
        .join(copies, ["_host", "_text"])
        .select("_host", "_text", F.expr("_sum div _copies").alias("_boiler"))
    )
    lost = F.coalesce("_boiler", F.lit(0).cast("bigint"))
    left = (F.col("n_words") - F.col("n_boiler_words")) * 100 >= MIN_LEFT_PERCENT * F.col("n_words")
    # one row per text and host; written, so that a filter on the verdict reads it instead of counting again
    verdict = base.join(boiler, ["_host", "_text"], "left").withColumn("n_boiler_words", lost).drop("_boiler")
    verdict = written(verdict.withColumn("kept", ~F.col("base_failed") & left), "verdicts")
    joined = df.select(*cols, *_host_and_text(host, text)).join(verdict, ["_host", "_text"])
    return joined.drop("_host", "_text")


@shielded
def without_frequent_lines(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``df`` with the lines above their host's limit cut from ``text``; other lines stay byte for byte.

    A null text stays null. The list of lines to cut is gathered per distinct
    text, from that text's own lines only.
    """
    lines, copies = checkpoint(document_lines(df, host, text)), checkpoint(distinct_texts(df, host, text))
    cut = (
        lines.join(frequent_lines(lines, copies), ["_host", "_line"], "left_semi")
        .groupBy("_host", "_text")
        .agg(F.collect_set("_line").alias("_cut"))
    )
    keys = df.select(*[F.col(f"`{c}`") for c in df.columns], *_host_and_text(host, text))
    joined = keys.join(cut, ["_host", "_text"], "left")
    left = F.filter(
        F.split(F.col(f"`{text}`"), "\n"),
        lambda x: ~x.rlike(NOT_SPACE) | ~F.array_contains(F.col("_cut"), F.xxhash64(normal_line(x))),
    )
    new = F.when(F.col("_cut").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
