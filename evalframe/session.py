"""Session, table and scratch-location helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, partitions: int = 8, app: str = "evalframe") -> SparkSession:
    """Session tuned for this engine; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # sessions without a SparkContext (Spark Connect)
        pass
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver test table (parquet)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_LOCAL_ROOTS: dict[int, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or the context's checkpoint
    directory). Only when neither is set on a local master (tests) a private
    temporary folder is created once per session and registered as the
    checkpoint directory; on a cluster that is an error, never a machine-local
    folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    try:
        root = spark.sparkContext.getCheckpointDir()
    except Exception:  # Spark Connect has no SparkContext
        root = None
    if root:
        return root
    try:
        master = spark.conf.get("spark.master", "") or ""
    except Exception:
        master = ""
    if master and not master.startswith("local"):
        raise RuntimeError(
            "No shared checkpoint location: set spark.checkpoint.dir (or SparkContext.setCheckpointDir) "
            "to a folder every executor can reach"
        )
    key = id(spark)
    if key not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[key] = tempfile.mkdtemp(prefix="evalframe-")
        try:
            spark.sparkContext.setCheckpointDir(_LOCAL_ROOTS[key])
        except Exception:
            pass
    return _LOCAL_ROOTS[key]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused location under the shared root."""
    return os.path.join(shared_root(spark), "evalframe", f"{label}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared root (in a folder per value of ``by``) and read it back.

    Used where one expensive intermediate feeds several branches of a plan:
    the work runs once, the lineage is cut (a lost executor re-reads files
    instead of recomputing), and later scans get column pruning.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path) if by is None else df.sparkSession.read.schema(df.schema).parquet(path)
