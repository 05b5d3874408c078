"""Scan, sink, ingest-order and merge queries.

Queries that exercise a sink write their input under the session's shared
scratch root (``spark.checkpoint.dir``) and read it back; every run uses a
fresh folder.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from evalframe.catalog.fixtures import QA_COLUMNS, qa_samples, qa_samples_sql
from evalframe.catalog import sqltext as S
from evalframe.catalog.registry import query
from evalframe.functions.text import py_strip
from evalframe.operators.joins import completed, merge_keyed, merge_prefix, pending
from evalframe.plans.run import evaluate_file
from evalframe.plans.tasks import get_task
from evalframe.session import scratch_path, table
from evalframe.sources.positions import first_samples, position_manifest
from evalframe.sources.files import (
    evaluated_records,
    legacy_records,
    read_jsonl,
    read_splits,
    subset_scan,
    with_sample_idx,
    write_jsonl,
)

RECORD_SCHEMA = (
    "sample_id bigint, prediction string, reference string, "
    "evaluation_sample struct<answer:string, category:string, type:string, task_type:string, options:array<string>>"
)


def qa_records(spark, sf_dir):
    """QA run records: prediction, reference and the evaluation payload kept for grading."""
    s = qa_samples(spark, sf_dir)
    payload = F.struct(
        F.col("answer").alias("answer"),
        F.col("category").alias("category"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("task_type"),
        F.when(F.col("has_options"), F.array(*[F.lit(x) for x in "ABCDE"])).alias("options"),
    )
    return s.select("sample_id", "prediction", F.upper(py_strip("answer")).alias("reference"), payload.alias("evaluation_sample"), "status")


@query(
    "jsonl_roundtrip",
    oracle=f"""WITH qa AS ({qa_samples_sql()})
SELECT sample_id, prediction, upper(answer) AS reference, answer, category,
       CAST(NULL AS VARCHAR) AS type, CASE WHEN has_options THEN 5 ELSE -1 END AS n_options FROM qa""",
)
def q_jsonl_roundtrip(spark, sf_dir):
    """Run records written as JSON Lines (finished orders overwrite, the rest appended),
    read back with the record schema."""
    path = scratch_path(spark, "records")
    recs = qa_records(spark, sf_dir)
    finished = F.coalesce(F.col("status") == "F", F.lit(False))
    write_jsonl(recs.where(finished).drop("status"), path, "overwrite")
    write_jsonl(recs.where(~finished).drop("status"), path, "append")
    back = read_jsonl(spark, path, RECORD_SCHEMA)
    return back.select(
        "sample_id",
        "prediction",
        "reference",
        F.col("evaluation_sample.answer").alias("answer"),
        F.col("evaluation_sample.category").alias("category"),
        F.col("evaluation_sample.type").alias("type"),
        F.coalesce(F.size("evaluation_sample.options"), F.lit(-1)).alias("n_options"),
    )


@query(
    "ordered_ingest",
    oracle="SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS sample_idx FROM benchmark",
)
def q_ordered_ingest(spark, sf_dir):
    """Benchmark items written as four range-ordered JSONL files, read back; every row
    gets its global position from (file order, in-file order)."""
    path = scratch_path(spark, "ordered")
    bench = table(spark, sf_dir, "benchmark")
    write_jsonl(bench.repartitionByRange(4, "item_id").sortWithinPartitions("item_id"), path)
    back = read_jsonl(spark, path, "item_id bigint, text string")
    return with_sample_idx(back).select("item_id", "sample_idx")


# Fixture layout for the subset scan: one JSONL location per language.
_SUBSET_FILES = {"en": "hard_en.jsonl", "fr": "fr_oss_eval.jsonl", "de": "de_meta_oss_eval.jsonl", "es": "es_oss_eval.jsonl"}
_CONSENSUS_FILE = "consensus_a set.jsonl"


@query(
    "subset_scan",
    oracle="""SELECT 'standard' AS subset, doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS sample_idx, md5(text) AS text_md5 FROM documents WHERE lang IN ('es', 'fr')
UNION ALL
SELECT 'hard', doc_id, row_number() OVER (ORDER BY doc_id) - 1, md5(text) FROM documents WHERE lang = 'en'
UNION ALL
SELECT 'consensus', item_id, row_number() OVER (ORDER BY item_id) - 1, md5(text) FROM benchmark""",
)
def q_subset_scan(spark, sf_dir):
    """Documents laid out as subset files by language, then scanned per subset by file-name
    pattern ("standard" skips the meta file), with positions in sorted-path order; the
    benchmark as the consensus subset, in a folder and a file with a space in the name."""
    root = scratch_path(spark, "sub sets")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    for lang, name in _SUBSET_FILES.items():
        part = docs.where(F.col("lang") == lang).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        write_jsonl(part, os.path.join(root, name))
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(None).cast("string").alias("lang"), "text")
    write_jsonl(bench.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), os.path.join(root, _CONSENSUS_FILE))
    schema = "doc_id bigint, lang string, text string"
    out = None
    for subset in ("standard", "hard", "consensus"):
        rows = subset_scan(spark, root, subset, schema).select(F.lit(subset).alias("subset"), "doc_id", "sample_idx", F.md5("text").alias("text_md5"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _write_arrays(df, path, bucket_col):
    """One JSON array per bucket, one file per bucket (bounded arrays)."""
    _write_sorted_arrays(df, path, bucket_col, [])


def _write_sorted_arrays(df, path, bucket_col, order):
    """``_write_arrays`` with the elements of an array by the columns ``order`` (not written), then by their own."""
    kept = [c for c in df.columns if c != bucket_col and c not in order]
    items = F.array_sort(F.collect_list(F.struct(*order, *kept)))
    if order:
        items = F.transform(items, lambda x: F.struct(*[x[c].alias(c) for c in kept]))
    arrays = df.groupBy(bucket_col).agg(F.to_json(items).alias("value"))
    arrays.write.mode("overwrite").partitionBy(bucket_col).text(path)


@query(
    "json_array_scan",
    oracle="""SELECT item_id, text AS question, chr(65 + CAST(item_id % 5 AS INT)) AS answer,
       CASE WHEN item_id % 2 = 0 THEN '[[' || item_id || ',' || (item_id + 5) || ']]'
            ELSE '[{"video_id":"v' || item_id || '","intervals":[[0,' || item_id || ']]}]' END AS clue_interval,
       CASE WHEN floor(item_id / 8) % 2 = 0 THEN 'test_day' ELSE 'test_week' END AS source_split
FROM benchmark""",
)
def q_json_array_scan(spark, sf_dir):
    """Benchmark items stored as JSON-array files in two split folders (clue intervals in
    two shapes), read as the "test" split: tagged union plus clue-interval back-fill."""
    root = scratch_path(spark, "arrays")
    b = table(spark, sf_dir, "benchmark")
    even = (F.col("item_id") % 2) == 0
    items = b.select(
        F.col("item_id"),
        F.col("text").alias("question"),
        F.expr("chr(65 + CAST(item_id % 5 AS INT))").alias("answer"),
        F.when(even, F.array(F.array(F.col("item_id"), F.col("item_id") + 5))).alias("clue_intervals"),
        F.when(~even, F.array(F.struct(F.concat(F.lit("v"), F.col("item_id").cast("string")).alias("video_id"),
                                       F.array(F.array(F.lit(0).cast("bigint"), F.col("item_id"))).alias("intervals")))).alias("clue_interval"),
        F.floor(F.col("item_id") / 8).alias("bucket"),
    )
    day = (F.col("bucket") % 2) == 0
    _write_arrays(items.where(day), os.path.join(root, "day"), "bucket")
    _write_arrays(items.where(~day), os.path.join(root, "week"), "bucket")
    schema = "item_id bigint, question string, answer string, clue_interval string, clue_intervals string"
    split_files = {"test": [("day", "test_day"), ("week", "test_week")]}
    rows = read_splits(spark, root, "test", schema, split_files)
    return rows.select("item_id", "question", "answer", "clue_interval", "source_split")


#: bytes of text in one JSON array of a split, about
ARRAY_BYTES = 8 << 20


@query(
    "split_union",
    oracle="SELECT doc_id, lang, text, CASE WHEN lang = 'en' THEN 'test_day' ELSE 'test_week' END AS source_split FROM documents",
)
def q_split_union(spark, sf_dir):
    """English documents as the day split and all others as the week split (JSON arrays of
    about ARRAY_BYTES of text, one per file); the "test" split reads both and tags every row."""
    root = scratch_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // ARRAY_BYTES + 1)))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    _write_arrays(docs.where(english), os.path.join(root, "day"), "bucket")
    _write_arrays(docs.where(~english), os.path.join(root, "week"), "bucket")
    rows = read_splits(spark, root, "test", "doc_id bigint, lang string, text string", {"test": [("day", "test_day"), ("week", "test_week")]})
    return rows.select("doc_id", "lang", "text", "source_split")


_LEGACY_RUN = "CAST(o_custkey AS STRING) || '-' || CAST(CAST(floor(o_orderkey / 1000) AS BIGINT) AS STRING)"


@query(
    "legacy_records",
    oracle=f"""WITH qa AS (SELECT {_LEGACY_RUN} AS run_key, o_custkey % 3 AS shape, {', '.join(QA_COLUMNS)} FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY sample_id) - 1 AS idx, count(*) OVER (PARTITION BY run_key) AS cnt FROM qa)
SELECT run_key, idx AS sample_idx, prediction,
       CASE WHEN shape = 0 AND idx = cnt - 1 THEN '' ELSE upper(answer) END AS reference,
       CASE WHEN shape = 1 AND idx >= cnt - 2 THEN NULL ELSE answer END AS sample_answer
FROM r""",
)
def q_legacy_records(spark, sf_dir):
    """Legacy run summaries (parallel arrays per customer run, some with short reference or
    sample arrays) turned back into one record per prediction with padding."""
    orders = table(spark, sf_dir, "orders")
    s = orders.selectExpr(f"{_LEGACY_RUN} AS run_key", "o_custkey % 3 AS shape", *QA_COLUMNS)
    rec = F.struct("sample_id", "prediction", F.upper("answer").alias("reference"), F.struct("answer").alias("sample"))
    runs = s.groupBy("run_key", "shape").agg(F.array_sort(F.collect_list(rec)).alias("r"))
    n = F.size("r")
    summaries = runs.select(
        "run_key",
        F.transform("r", lambda x: x["prediction"]).alias("predictions"),
        F.when(F.col("shape") == 0, F.slice(F.transform("r", lambda x: x["reference"]), F.lit(1), n - 1))
        .otherwise(F.transform("r", lambda x: x["reference"])).alias("references"),
        F.when(F.col("shape") == 1, F.slice(F.transform("r", lambda x: x["sample"]), F.lit(1), F.greatest(n - 2, F.lit(0))))
        .otherwise(F.transform("r", lambda x: x["sample"])).alias("evaluation_samples"),
    )
    recs = legacy_records(summaries)
    return recs.select("run_key", "sample_idx", "prediction", "reference", F.col("evaluation_sample.answer").alias("sample_answer"))


@query(
    "evaluate_legacy",
    oracle=f"""WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS sample_id, count(*) OVER () AS n FROM benchmark),
p AS (SELECT sample_id, text, 'The answer is ' || chr(65 + CAST(item_id % 3 AS INT)) AS prediction,
             CASE WHEN sample_id = n - 1 THEN '' ELSE chr(65 + CAST(item_id % 5 AS INT)) END AS reference, chr(65 + CAST(item_id % 5 AS INT)) AS answer FROM b),
g AS (SELECT *, CAST({S.choice_correct("prediction", "upper(coalesce(nullif(reference, ''), answer))")} AS DOUBLE) AS correct FROM p)
SELECT sample_id, prediction, reference, correct, round((SELECT avg(correct) FROM g), 6) AS accuracy FROM g""",
)
def q_evaluate_legacy(spark, sf_dir):
    """A legacy summary (parallel arrays, the references one short) graded end to end: turned
    into a record file, graded, and written in place, every record with its evaluation."""
    root = scratch_path(spark, "legacy-run")
    letter = lambda n: F.expr(f"chr(65 + CAST(item_id % {n} AS INT))")
    bench = table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat(F.lit("The answer is "), letter(3)).alias("p"), letter(5).alias("r"),
        F.struct(letter(5).alias("answer"), F.array(*[F.lit(x) for x in "ABCDE"]).alias("options"), *[F.lit(None).cast("string").alias(c) for c in ("category", "type", "task_type")]).alias("s"),
    )
    run = bench.agg(F.array_sort(F.collect_list(F.struct("item_id", "p", "r", "s"))).alias("x"))  # one document, as the format has it
    get = lambda c: F.transform("x", lambda e: e[c])
    run = run.select(get("p").alias("predictions"), F.slice(get("r"), F.lit(1), F.size("x") - 1).alias("references"), get("s").alias("evaluation_samples"))
    summary_path = os.path.join(root, "results", "legacy.json")
    run.write.json(summary_path)
    summary_schema = "predictions array<string>, references array<string>, evaluation_samples array<struct<answer:string, options:array<string>, category:string, type:string, task_type:string>>"
    where, metrics = evaluate_file(
        spark, get_task("choice_qa"), os.path.join(root, "results", "legacy.jsonl"), None,
        summary_path=summary_path, summary_schema=summary_schema, in_place=True, output_dir=os.path.join(root, "evaluated"),
    )
    back = read_jsonl(spark, where, "sample_id bigint, prediction string, reference string, evaluation struct<correct:double>")
    accuracy = metrics.where("metric = 'accuracy'").select(F.round("value", 6)).scalar()
    return back.select("sample_id", "prediction", "reference", "evaluation.correct", accuracy.alias("accuracy"))


@query(
    "evaluated_sink",
    oracle="""SELECT 'in_place' AS layout, d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT 'separate', doc_id, CAST(NULL AS VARCHAR), quality, toxic FROM labels""",
)
def q_evaluated_sink(spark, sf_dir):
    """Graded records persisted in both layouts (in place: every source record with its
    evaluation; separate: evaluation rows only), read back."""
    src = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    ev = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.struct("quality", "toxic").alias("evaluation"))
    p_in, p_sep = scratch_path(spark, "eval-in-place"), scratch_path(spark, "eval-separate")
    write_jsonl(evaluated_records(src, ev, in_place=True), p_in)
    write_jsonl(evaluated_records(src, ev, in_place=False), p_sep)
    schema_in = "sample_id bigint, lang string, evaluation struct<quality:int, toxic:int>"
    a = read_jsonl(spark, p_in, schema_in).select(F.lit("in_place").alias("layout"), F.col("sample_id").alias("doc_id"), "lang", "evaluation.quality", "evaluation.toxic")
    b = read_jsonl(spark, p_sep, "sample_id bigint, evaluation struct<quality:int, toxic:int>").select(
        F.lit("separate").alias("layout"), F.col("sample_id").alias("doc_id"), F.lit(None).cast("string").alias("lang"), "evaluation.quality", "evaluation.toxic"
    )
    return a.unionByName(b)


def _merge_inputs(spark, sf_dir, positions=True):
    src = table(spark, sf_dir, "documents").select("doc_id", "lang")
    src = (with_sample_idx(src) if positions else src).withColumnRenamed("doc_id", "sample_id")
    persisted = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sample_id"), F.struct("quality", "toxic").alias("evaluation"), F.lit("grader-a").alias("grader")
    )
    return src, persisted


@query(
    "merge_prefix",
    oracle="""SELECT d.doc_id AS sample_id, l.quality, l.toxic, 'grader-a' AS grader FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE d.doc_id < coalesce((SELECT min(d2.doc_id) FROM documents d2 WHERE NOT EXISTS (SELECT 1 FROM labels l2 WHERE l2.doc_id = d2.doc_id)), 9223372036854775807)""",
)
def q_merge_prefix(spark, sf_dir):
    """Prior grades resumed by position: evaluations kept up to the first record (in ingest
    order) without one; extra persisted fields (grader) carried over."""
    src, persisted = _merge_inputs(spark, sf_dir)
    m = merge_prefix(src, persisted, order="sample_idx")
    return m.select("sample_id", "evaluation.quality", "evaluation.toxic", "grader")


@query(
    "merge_keyed",
    oracle="SELECT d.doc_id AS sample_id, l.quality, l.toxic, 'grader-a' AS grader FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def q_merge_keyed(spark, sf_dir):
    """Prior grades resumed by key: every record with a persisted evaluation, anywhere."""
    src, persisted = _merge_inputs(spark, sf_dir, positions=False)
    m = merge_keyed(src, persisted)
    return m.select("sample_id", "evaluation.quality", "evaluation.toxic", "grader")


@query(
    "resume_pending",
    oracle="""SELECT o_orderkey AS sample_id, 'pending' AS state FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_orderstatus = 'F' AND r.o_orderkey = o.o_orderkey)
UNION ALL
SELECT o_orderkey, 'kept' FROM orders o WHERE EXISTS (SELECT 1 FROM orders r WHERE r.o_orderstatus = 'F' AND r.o_orderkey = o.o_orderkey)""",
)
def q_resume_pending(spark, sf_dir):
    """Resume split of a run: samples without a persisted record are pending, the rest kept
    (persisted records = finished orders)."""
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))
    records = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("sample_id"))
    todo = pending(samples, records).select("sample_id", F.lit("pending").alias("state"))
    kept = completed(samples, records).select("sample_id", F.lit("kept").alias("state"))
    return todo.unionByName(kept)


@query(
    "split_limit",
    oracle="""WITH o AS (SELECT doc_id, lang = 'en' AND lang IS NOT NULL AS english, CAST(floor(doc_id / 50) AS BIGINT) AS bucket FROM documents),
n AS (SELECT doc_id, CASE WHEN english THEN 'test_day' ELSE 'test_week' END AS source_split,
             row_number() OVER (ORDER BY NOT english, CAST(bucket AS VARCHAR), doc_id) - 1 AS sample_idx FROM o)
SELECT doc_id, source_split, sample_idx FROM n WHERE sample_idx < (SELECT count(*) FROM documents) // 2""",
)
def q_split_limit(spark, sf_dir):
    """The first half of the rows of a split that spans two folders of JSON-array files:
    positions run over (list place, path, place in the file). A file holds the buckets of 50
    ids whose numbers begin alike, in the order of their text, so that there are few files."""
    root = scratch_path(spark, "split-limit")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 50).cast("string").alias("place"))
    digits = docs.agg(F.max(F.length("place")).alias("n")).first()["n"] or 1
    docs = docs.withColumn("bucket", F.substring("place", 1, max(1, digits - 2)))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    _write_sorted_arrays(docs.where(english), os.path.join(root, "day"), "bucket", ["place"])
    _write_sorted_arrays(docs.where(~english), os.path.join(root, "week"), "bucket", ["place"])
    files = {"test": [("day", "test_day"), ("week", "test_week")]}
    rows = read_splits(spark, root, "test", "doc_id bigint, lang string", files, ordered=True)
    half = docs.select((F.floor(F.count(F.lit(1)) / 2)).alias("n")).scalar()
    return rows.where(F.col("sample_idx") < half).select("doc_id", "source_split", "sample_idx")


@query(
    "limit_files",
    oracle="""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_idx FROM orders)
SELECT o_orderkey, sample_idx, manifest FROM n, (VALUES ('first'), ('reused')) AS m(manifest) WHERE sample_idx < 1000""",
)
def q_limit_files(spark, sf_dir):
    """The first 1000 orders of sixteen files by a position manifest: it is built by one
    counting scan, published, and used again; only the files that start below the limit
    are opened."""
    root = scratch_path(spark, "limit-files")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    write_jsonl(orders.repartitionByRange(16, "o_orderkey").sortWithinPartitions("o_orderkey"), os.path.join(root, "orders"))
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
    read = lambda paths: read_jsonl(spark, paths, schema)
    out = None
    for name in ("first", "reused"):
        manifest = position_manifest(spark, read, [os.path.join(root, "orders")], os.path.join(root, "manifest"))
        rows = first_samples(read, manifest, 1000).select("o_orderkey", "sample_idx", F.lit(name).alias("manifest"))
        out = rows if out is None else out.unionByName(rows)
    return out


PREFIX_LIMIT = 100


@query(
    "limit_prefix",
    oracle=f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS sample_idx FROM documents QUALIFY sample_idx < {PREFIX_LIMIT}",
)
def q_limit_prefix(spark, sf_dir):
    """Run limit: the first N samples in ingest order (positions assigned at the scan)."""
    docs = with_sample_idx(table(spark, sf_dir, "documents").select("doc_id"))
    return docs.where(F.col("sample_idx") < PREFIX_LIMIT).select("doc_id", "sample_idx")
