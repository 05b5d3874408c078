"""Queries of the training-data operators over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import decontam, html_bp, jaccard, langid, lines, mixing, packing, periodic, prefix_trie, quality, repeats, sharding, vector_graph
from evalframe.llm.common import read, text_or_empty, words

N_SHARDS = 8


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line repeats, up to one word."""
    return lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), characters=True)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards whose row counts differ by at most one."""
    text = text_or_empty("text")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shard(docs, N_SHARDS).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_bp.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, with cross-document line frequency per source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).drop("text", "source")


def op6_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 200-byte strings that occur anywhere else."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeats.cut_repeats(docs, width=200)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, markup, address and host."""
    model = langid.fit_text(read(spark, sf_dir, "documents").select("text", "lang"))
    return langid.identify(read(spark, sf_dir, "pages"), model).drop("html")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the weighted mix takes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).drop("text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how much of it they hold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"))


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2048 token ids."""
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), the text of one id in ten rewritten to repeat part of itself.

    With h = crc32(decimal doc_id), g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, each word
    i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A row
    without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words("text")).alias("w"))
    n = F.size("w").cast("bigint")
    rows = rows.withColumn("n", F.when(n > 0, n)).withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rows = rows.withColumn("rest", (F.col("n") - F.col("a")).cast("int")).withColumn("a", F.col("a").cast("int"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, the largest by exponent, and its text without the repeats."""
    docs = planted_periods(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.collapse_runs(docs).withColumn("top", periodic.largest_run(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with the head of every conversation c taken from conversation c - c % 20:
    its first h turns (all of fewer), h = crc32(decimal c) % 4, then c's own turns after its first h."""
    conv = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    plan = sizes.select("conv_id", (conv - conv % 20).alias("base"), (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int").alias("h"))
    # a base is asked for by at most 20 conversations and gives each at most 3 turns
    head = turns.where("pos < 3").withColumnRenamed("conv_id", "base").join(plan, "base").where("pos < h")
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    own = turns.join(plan.select("conv_id", "h", taken.alias("taken")), "conv_id").where("pos >= h")
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ("conv_id", "pos", "role", "text")
    return head.select(*columns).unionByName(own.select(*columns)), plan.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations with the measures of its subtree."""
    turns = prefix_trie.ordered_turns(read(spark, sf_dir, "conversations"))
    return prefix_trie.conversation_trie(*rebuilt_turns(turns)).drop("node", "parent")


# DuckDB has no crc32: the remainder of the decimal id, eight steps a byte
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
  lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, byte)),
  4294967295::BIGINT))"""

_TRIE_SQL = f"""WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
i AS (SELECT s.conv_id, s.conv_id - s.conv_id % 20 AS base, {_CRC32.replace("conv_id", "s.conv_id")} % 4 AS h, coalesce(b.n, 0) AS n_base
      FROM s LEFT JOIN s b ON b.conv_id = s.conv_id - s.conv_id % 20),
t AS (SELECT i.conv_id, o.pos, o.role, o.text FROM i JOIN o ON o.conv_id = i.base AND o.pos < i.h
      UNION ALL SELECT i.conv_id, o.pos - i.h + least(i.h, i.n_base), o.role, o.text FROM i JOIN o ON o.conv_id = i.conv_id AND o.pos >= i.h),
p AS (SELECT conv_id, pos + 1 AS depth, text, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t
      UNION ALL SELECT conv_id, 0, NULL, [] FROM i),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (SELECT prefix, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs,
             len(list_filter(regexp_split_to_array(coalesce(any_value(text), ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_words,
             string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE e.depth = p.depth) AS ends
      FROM p JOIN e ON e.conv_id = p.conv_id GROUP BY prefix),
k AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.prefix = n.prefix),
u AS (SELECT p.prefix, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.n_words) AS saved_tokens
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.prefix)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, f.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u ON u.prefix = m.prefix LEFT JOIN m f ON m.depth > 0 AND f.prefix = list_slice(m.prefix, 1, m.depth - 1)"""


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links (cosine 0.9 or more) and its component."""
    return vector_graph.near_vectors(read(spark, sf_dir, "embeddings"), least=0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_sharding": op2_sharding,
    "op3_html_text": op3_html_text,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality_rules": op5_quality_rules,
    "op6_repeated_windows": op6_repeated_windows,
    "op8_source_mixing": op8_source_mixing,
}
QUERIES |= {"op1_line_dedup": op1_line_dedup, "op7_language": op7_language}
QUERIES |= {"op9_decontamination": op9_decontamination, "op10_token_packing": op10_token_packing}
QUERIES |= {"op11_periodic_runs": op11_periodic_runs}
QUERIES |= {"op12_prefix_trie": op12_prefix_trie}
_VECTORS_SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT r AS a, r AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT c.a AS r, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.b GROUP BY c.a),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, v.vec_id IS NOT DISTINCT FROM m.component_id AS kept
FROM v JOIN m ON m.r = v.r LEFT JOIN n ON n.r = v.r"""


QUERIES |= {"op13_near_vectors": op13_near_vectors}
ORACLES: dict[str, str] = {"op12_prefix_trie": _TRIE_SQL, "op13_near_vectors": _VECTORS_SQL}
