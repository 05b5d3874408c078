"""Proportional stratified interleaving of sources into shards.

Every source's rows are put in a seeded random order; the row of rank r among
n gets the fractional rank (r + 1/2) / n. Sorted by that fraction the sources
interleave in proportion, so any contiguous cut has the corpus mixture. The
order is cut into ``n_shards`` runs whose row counts differ by at most one.

Scale: ranks and positions are prefix sums over hash ranges (see
``common.with_rank``), so neither a source with a third of all rows nor the
global order is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalframe.llm.common import checkpoint, range_bits, row_hash, shielded, with_rank

#: ranges of the global order; positions inside a range come from one sort task
MIN_POSITION_RANGES = 64


@shielded
def shard(df: DataFrame, n_shards: int, source: str = "source", seed: int = 17) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (0..n_shards-1) and ``slot`` (0.. in each shard).

    Null sources are one source of their own. Repeated rows each get a slot of
    their own; identical rows are interchangeable. An empty table gives no
    rows. Caller columns named ``shard`` or ``slot`` are replaced; other
    columns may have any name.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(
        *[F.col(f"`{c}`") for c in keep],
        row_hash(df.select(*[F.col(f"`{c}`") for c in keep]), seed).alias("_key"),
        F.struct(F.col(f"`{source}`").isNull().alias("a"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("b")).alias("_src"),
    )
    per_source = checkpoint(rows.groupBy("_src").agg(F.count(F.lit(1)).alias("_n")))
    total = per_source.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    bits = range_bits(total)
    ranges = max(MIN_POSITION_RANGES, 2**bits)

    ranked = with_rank(rows, ["_src"], "_key", bits, "_rank").join(per_source, "_src")
    ranked = ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_n")).withColumn(
        "_cut", F.floor(F.col("_f") * ranges)
    )
    cells = ranked.groupBy("_cut").agg(F.count(F.lit(1)).alias("_cell"))
    # one row per range of the order: a summary of fixed size
    below = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_cut", F.coalesce(F.sum("_cell").over(below), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_cut").orderBy("_f", "_key")
    placed = ranked.withColumn("_at", F.row_number().over(inside)).join(starts, "_cut")
    placed = placed.withColumn("_pos", F.col("_start") + F.col("_at") - 1).withColumn(
        "_shard", F.expr(f"(_pos * {n_shards}) div {max(total, 1)}")
    )
    slot = F.col("_pos") - F.expr(f"(_shard * {max(total, 1)} + {n_shards - 1}) div {n_shards}")
    return placed.select(
        *[F.col(f"`{c}`") for c in keep], F.col("_shard").cast("int").alias("shard"), slot.cast("bigint").alias("slot")
    )
