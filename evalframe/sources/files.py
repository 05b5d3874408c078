"""Sample and record files: JSONL / JSON-array scans and sinks, ordered ingest.

Scans are plain Spark file sources (splittable JSONL; whole-file JSON
arrays), so the cluster reads them in parallel with column pruning. Every
row gets a stable key at ingest; nothing downstream relies on row order.
"""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.session import materialize

# --- fixed values ---------------------------------------------------------
# Sample subsets of the rubric chat dataset → file-name patterns.
SUBSET_FILE_PATTERNS = {
    "hard": "hard_*.jsonl",
    "consensus": "consensus_*.jsonl",
    "standard": "*_oss_eval.jsonl",
}
# The "standard" subset skips files whose name contains this marker.
STANDARD_EXCLUDE = "meta"
# Splits of the visual QA dataset → (file, tag) in read order.
SPLIT_FILES = {
    "train": [("month/train.json", "train")],
    "val": [("month/val.json", "val")],
    "test": [("day/test.json", "test_day"), ("week/test.json", "test_week")],
    "test_day": [("day/test.json", "test_day")],
    "test_week": [("week/test.json", "test_week")],
}
# --------------------------------------------------------------------------


_MISSING = ("PATH_NOT_FOUND", "Path does not exist", "UNABLE_TO_INFER_SCHEMA")


def read_if_exists(read, path: str) -> DataFrame | None:
    """``read(path)`` when something was written there, else None (no data is read)."""
    try:
        df = read(path)
        df.inputFiles()
        return df
    except AnalysisException as exc:
        if any(marker in str(exc) for marker in _MISSING):
            return None
        raise


def read_jsonl(spark: SparkSession, path, schema=None) -> DataFrame:
    """JSON Lines scan: one object per line, blank lines skipped, a malformed line fails the job."""
    r = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_json_array(spark: SparkSession, path, schema=None) -> DataFrame:
    """Scan of files that each hold one JSON array of objects (one row per element)."""
    r = spark.read.option("multiLine", "true").option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def plain_paths(files: list[str]) -> list[str]:
    """File names as Spark reports them (URL-escaped) as paths that a reader takes literally."""
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(f)) for f in files]


def _glob_regex(pattern: str) -> str:
    return "".join("[^/]*" if ch == "*" else re.escape(ch) for ch in pattern)


def subset_scan(spark: SparkSession, data_dir: str, subset: str = "standard", schema=None, ordered: bool = True) -> DataFrame:
    """Rows of every file of a dataset subset, optionally with ``sample_idx`` in
    sorted-path order. Matching entries may be files or directories of part files;
    only file names are listed on the driver, the rows are read by the cluster."""
    if subset not in SUBSET_FILE_PATTERNS:
        raise ValueError(f"No subset named '{subset}'; there are {', '.join(sorted(SUBSET_FILE_PATTERNS))}")
    pattern = SUBSET_FILE_PATTERNS[subset]
    rx = re.compile("/(" + _glob_regex(pattern) + ")(/|$)")
    try:
        listed = spark.read.format("text").load(os.path.join(data_dir, pattern)).inputFiles()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"{data_dir} has no file named like {pattern}") from exc
        raise
    files = []
    for f in listed:
        m = rx.search(unquote(f))
        if m is None or (subset == "standard" and STANDARD_EXCLUDE in m.group(1)):
            continue
        files.append(f)
    if not files:
        raise FileNotFoundError(f"{data_dir} has no file named like {pattern}")
    df = read_jsonl(spark, plain_paths(sorted(files)), schema)
    return with_sample_idx(df) if ordered else df


def read_splits(spark: SparkSession, root: str, split: str, schema=None, split_files: dict | None = None, ordered: bool = False) -> DataFrame:
    """Rows of a named split: its files concatenated in list order, each row
    tagged with ``source_split``; ``clue_interval`` back-filled from
    ``clue_intervals`` when absent (both read as raw JSON text). ``ordered``
    adds ``sample_idx``, the position in (list place, path, place in the file)."""
    files = (split_files or SPLIT_FILES).get(split)
    if files is None:
        raise ValueError(f"No split named '{split}'; there are {', '.join(sorted(split_files or SPLIT_FILES))}")
    scans = [read_json_array(spark, os.path.join(root, name), schema) for name, _ in files]
    tags = [F.lit(tag) for _, tag in files]
    if ordered:
        out = union_with_sample_idx([scan.withColumn("source_split", tag) for scan, tag in zip(scans, tags, strict=True)])
    else:
        out = scans[0].withColumn("source_split", tags[0])
        for scan, tag in zip(scans[1:], tags[1:], strict=True):
            out = out.unionByName(scan.withColumn("source_split", tag), allowMissingColumns=True)
    cols = out.columns
    if "clue_intervals" in cols:
        fill = F.col("clue_intervals") if "clue_interval" not in cols else F.coalesce("clue_interval", "clue_intervals")
        out = out.withColumn("clue_interval", fill)
    return out


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines sink; nulls are written (not dropped), non-ASCII kept as is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _offsets_distributed(splits: DataFrame) -> DataFrame:
    """Running sum over (scan, file, split) order without a single-task window.

    The split table is range-partitioned in that order and written once
    with each row's partition number, so every branch below sees the same
    assignment. Offsets are then the running sum of the partition totals
    (one row per partition) plus the running sum inside the partition.
    """
    ranged = materialize(
        splits.repartitionByRange("_s", "_f", "_b").select("*", F.spark_partition_id().alias("_p")), "split-offsets"
    )
    totals = ranged.groupBy("_p").agg(F.sum("_n").alias("_pn"))
    part_before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part_off = totals.select("_p", F.coalesce(F.sum("_pn").over(part_before), F.lit(0)).alias("_poff"))
    local_before = Window.partitionBy("_p").orderBy("_s", "_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("_p", "_s", "_f", "_b", "_m0", F.coalesce(F.sum("_n").over(local_before), F.lit(0)).alias("_loff"))
    return local.join(part_off, "_p").select("_s", "_f", "_b", "_m0", (F.col("_poff") + F.col("_loff")).alias("_off"))


def _tagged(scan: DataFrame, place: int) -> DataFrame:
    """A file scan whose rows carry the scan's place, their file, split start (0 where a file is one split) and order in it."""
    return scan.select(
        "*",
        F.lit(place).alias("_s"),
        F.col("_metadata.file_path").alias("_f"),
        F.coalesce(F.col("_metadata.file_block_start"), F.lit(0)).alias("_b"),
        F.monotonically_increasing_id().alias("_m"),
    )


def _numbered(tagged: DataFrame, name: str) -> DataFrame:
    keys = ["_s", "_f", "_b"]
    splits = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    out = tagged.join(_offsets_distributed(splits), keys)
    return out.withColumn(name, F.col("_off") + F.col("_m") - F.col("_m0")).drop(*keys, "_m", "_m0", "_off")


def with_sample_idx(scan: DataFrame, name: str = "sample_idx") -> DataFrame:
    """Global 0-based position of every row in (sorted file path, in-file order).

    Must be applied directly on a file scan. Rows are tagged with their file,
    split start and a monotonically increasing id (contiguous within a split);
    per-split row counts (one row per file split) give each split its offset
    through a running sum, and a row's position is offset + its rank inside
    the split. No data row is sorted or moved to one task; the running sum over
    splits is a distributed prefix sum.
    """
    return _numbered(_tagged(scan, 0), name)


def union_with_sample_idx(scans: list[DataFrame], name: str = "sample_idx") -> DataFrame:
    """Union by name of file scans with each row's global 0-based position in (list place, sorted file path, in-file order)."""
    out = _tagged(scans[0], 0)
    for i, scan in enumerate(scans[1:], 1):
        out = out.unionByName(_tagged(scan, i), allowMissingColumns=True)
    return _numbered(out, name)


def legacy_records(summaries: DataFrame, run_key: str = "run_key") -> DataFrame:
    """Records of legacy summaries that keep parallel arrays.

    ``predictions``, ``references`` and ``evaluation_samples`` are zipped by
    index; a short ``references`` pads with "" and short samples with null;
    no predictions → no rows. Output: (run_key, sample_idx, prediction,
    reference, evaluation_sample).
    """
    def present(name):
        # a missing references/samples list counts as empty (arrays_zip would return null)
        c = F.col(name)
        return F.coalesce(c, F.array().cast(summaries.schema[name].dataType))

    zipped = F.arrays_zip(
        F.col("predictions").alias("prediction"),
        present("references").alias("reference"),
        present("evaluation_samples").alias("evaluation_sample"),
    )
    ex = summaries.select(
        run_key,
        F.size("predictions").alias("_np"),
        F.coalesce(F.size("references"), F.lit(0)).alias("_nr"),
        F.posexplode_outer(zipped).alias("sample_idx", "_z"),
    )
    ex = ex.where(F.col("sample_idx") < F.col("_np"))
    # only positions beyond a short references list are padded; an explicit null stays null
    reference = F.when(F.col("sample_idx") < F.col("_nr"), F.col("_z.reference")).otherwise(F.lit(""))
    return ex.select(
        run_key,
        F.col("sample_idx").cast("bigint").alias("sample_idx"),
        F.col("_z.prediction").alias("prediction"),
        reference.alias("reference"),
        F.col("_z.evaluation_sample").alias("evaluation_sample"),
    )


def load_records(spark: SparkSession, records_path: str, summary_path: str | None, schema, summary_schema=None) -> DataFrame | None:
    """Per-sample records of a run.

    The JSONL sidecar wins when it exists. Otherwise a legacy summary (one
    JSON document per run holding parallel arrays) is turned into records
    (``sample_id`` = position) and written through as the sidecar. Returns
    None when neither exists.
    """
    records = read_if_exists(lambda p: read_jsonl(spark, p, schema), records_path)
    if records is not None or summary_path is None:
        return records
    summary = read_if_exists(lambda p: read_json_array(spark, p, summary_schema), summary_path)
    if summary is None:
        return None
    if "run_key" not in summary.columns:
        summary = summary.withColumn("run_key", F.lit(None).cast("string"))
    # a legacy summary identifies records by position only: the position is the key
    legacy = legacy_records(summary).drop("run_key").withColumn("sample_id", F.col("sample_idx"))
    write_jsonl(legacy, records_path)
    return read_jsonl(spark, records_path, legacy.schema)


def evaluated_records(source: DataFrame, evaluations: DataFrame, key: str = "sample_id", in_place: bool = True) -> DataFrame:
    """Records to persist after grading.

    In place: every source record, with ``evaluation`` where one exists.
    Separate: only (key, evaluation) rows of graded records.
    """
    if in_place:
        return source.join(evaluations.select(key, "evaluation"), key, "left")
    return evaluations.select(key, "evaluation")
