"""Helpers shared by the training-data operators.

Column rule: operators give their own columns names that start with ``_``.
Caller columns of such names go by others while a ``shielded`` operator runs, so
the two never clash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalframe.session import scratch_path, shared_root

#: white space of the word rule: space and the controls 0x09-0x0D
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: Spark's setting that removes a query's shuffle files when it ends; else they wait for the driver to collect garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: rows that one window group of ``with_rank`` holds on average, at most
ROWS_PER_RANGE = 20_000


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(col: Column | str) -> Column:
    """Maximal runs of non-space characters, in order; none for a null text."""
    return F.array_remove(F.split(text_or_empty(col), SPACE), "")


def range_bits(rows: int) -> int:
    """Bits of a 64-bit hash that split ``rows`` into ranges of ROWS_PER_RANGE on average."""
    return max(1, min(40, math.ceil(math.log2(max(2, rows / ROWS_PER_RANGE)))))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in ``spark.checkpoint.dir``, which every executor reaches."""
    spark = df.sparkSession
    root = shared_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as zstd Parquet under the shared folder and read back; the write leaves no shuffle files."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def row_hash(df: DataFrame, seed: int) -> Column:
    """Seeded 64-bit hash of a whole row (map columns, which have no hash, left out)."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *cols)


def with_rank(df: DataFrame, group: list[str], key: str, bits: int, out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of each row in its group by the 64-bit hash ``key``.

    No task ever holds a whole group: rows meet in (group, hash range) buckets,
    ranges are numbered by key order, and each bucket adds the count of the
    ranges below it. Equal keys are ordered arbitrarily, so ``key`` must cover
    every column whose order matters. Group columns must not be null.
    """
    ranged = df.withColumn("_range", F.shiftright(F.col(key), 64 - bits))
    cells = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_cell"))
    below = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_cell").over(below), F.lit(0))).drop("_cell")
    inside = Window.partitionBy(*group, "_range").orderBy(key)
    return (
        ranged.withColumn("_at", F.row_number().over(inside))
        .join(starts, [*group, "_range"])
        .withColumn(out, F.col("_start") + F.col("_at") - 1)
        .drop("_start", "_at", "_range")
    )


def hash_sample(df: DataFrame, columns: list[str], rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows, chosen by a seeded hash of their content; all of a smaller table."""
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def hidden(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with new names for the columns in ``names``, and {new name: old name} to undo it."""
    out, names = {}, list(names)
    for i, c in enumerate(names):
        new = f"caller{i}"
        while new in {x.lower() for x in df.columns}:
            new += "_"
        out[new] = c
    return df.withColumnsRenamed({c: new for new, c in out.items()}), out


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` over a table whose columns may have any name.

    Columns whose names start with ``_`` are renamed before the call and named
    back after it; arguments that name such a column follow. Other tables are
    passed on as they are.
    """

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        plain, names = hidden(df, [c for c in df.columns if c.startswith("_")])
        if not names:
            return operator(df, *args, **options)
        new = {old: name for name, old in names.items()}

        def of(x):
            return new.get(x, x) if isinstance(x, str) else x

        return operator(plain, *map(of, args), **{k: of(v) for k, v in options.items()}).withColumnsRenamed(names)

    return run
