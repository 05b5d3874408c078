"""Position manifest: which file holds which samples, kept between scans.

The position of a sample is its place in (sorted file path, in-file order). A manifest has one
row per file with its rows and first position. It is built by one counting scan, published as a
numbered version, and reused: an unchanged file is never counted again, and a limit of n samples
opens only the files that start below n.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.session import materialize
from evalframe.sources.files import plain_paths, read_if_exists, with_sample_idx

#: reads a list of paths as a scan, for instance ``lambda paths: read_jsonl(spark, paths, schema)``
Reader = Callable[[list[str]], DataFrame]


def _listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, modified, bytes) of every file below ``paths``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def published(spark: SparkSession, location: str) -> DataFrame | None:
    """Newest version of a manifest, or None."""
    versions = read_if_exists(spark.read.parquet, location)
    if versions is None:
        return None
    newest = versions.agg(F.max("version").alias("v")).first()["v"]
    return None if newest is None else versions.where(F.col("version") == newest).drop("version")


def position_manifest(spark: SparkSession, read: Reader, paths: list[str], location: str) -> DataFrame:
    """Manifest (file, modified, bytes, rows, first_position) of the files below ``paths``.

    Counts of files that are in the published version with the same size and time are kept; only other
    files are scanned. When nothing has changed, nothing is written either. Files
    without a byte hold no sample and are not listed.
    """
    known = published(spark, location)
    listed = materialize(_listing(spark, paths), "manifest-listing")
    same = ["file", "modified", "bytes"]
    if known is None:
        counted, fresh = listed.limit(0).withColumn("rows", F.lit(0).cast("bigint")), listed
    else:
        counted = listed.join(known.select(*same, "rows"), same)
        fresh = listed.join(known, same, "left_anti")
    names = [r["file"] for r in fresh.select("file").collect()]  # a reader takes its paths from the driver
    if not names and known is not None and known.count() == listed.count():
        return known
    if names:
        rows = read(plain_paths(names)).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        counted = counted.unionByName(fresh.join(rows, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0))))
    ranged = materialize(counted.repartitionByRange("file").withColumn("_p", F.spark_partition_id()), "manifest-ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").agg(F.sum("rows").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_p").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_at", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(starts, "_p")
    version = 1 if known is None else spark.read.parquet(location).agg(F.max("version").alias("v")).first()["v"] + 1
    manifest = placed.select(*same, "rows", (F.col("_start") + F.col("_at")).alias("first_position"))
    manifest.write.parquet(os.path.join(location, f"version={version}"))
    return spark.read.parquet(os.path.join(location, f"version={version}"))


def first_samples(read: Reader, manifest: DataFrame, n: int, name: str = "sample_idx") -> DataFrame:
    """The samples at positions below ``n``, with their position: only files that start below ``n`` are opened.

    As each has a row at least, there are at most ``n`` of them; being the first in path order, they number
    themselves from 0. An empty manifest names no file to read and raises ``ValueError``.
    """
    files = manifest.where((F.col("first_position") < n) & (F.col("rows") > 0)).select("file").collect()
    if not files:
        some = [r["file"] for r in manifest.select("file").limit(1).collect()]
        if not some:
            raise ValueError("the manifest lists no file")
        return with_sample_idx(read(plain_paths(some)), name).limit(0)
    return with_sample_idx(read(plain_paths([r["file"] for r in files])), name).where(F.col(name) < n)
