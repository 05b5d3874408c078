"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) get weights 5, 2, 1 repeating
and share ``share`` times all words; no target exceeds twice its source, the
excess is shared again by weight until none is above.

Filling: a source first takes as many whole passes as its target holds (0, 1
or 2). The rest is fitted exactly: documents are counted by exact token
length, a proportional part of every length is taken, and a bounded-knapsack
over the lengths still left closes the remaining gap. Documents are then
chosen by seeded rank within their length.

Scale: documents are reduced to (source, length) counts before anything is
planned; the plan of one source sees one row per distinct length. Ranks come
from ``common.with_rank``, so a length shared by a third of all rows is never
in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import checkpoint, range_bits, row_hash, shielded, with_rank, words

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_PASSES = 2
#: a gap above this is closed by whole lengths first, the rest by the knapsack table
KNAPSACK_WORDS = 1 << 18


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the words come as near ``budget`` as possible, never above.

    Exact (the sum equals ``budget``) whenever the knapsack can reach it; at
    equal sums, the earlier length is preferred. Returns zeros for budget <= 0.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    # the proportional part of each length, by exact integer arithmetic
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    gap = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if gap <= KNAPSACK_WORDS:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), (gap - KNAPSACK_WORDS + int(lengths[i]) - 1) // int(lengths[i]), gap // int(lengths[i]))
            take[i] += more
            gap -= more * int(lengths[i])
    # bounded knapsack: each length in binary lots; first[s] is the lot that first reached sum s
    first = np.full(gap + 1, -1, dtype=np.int32)
    first[0] = 0
    lots: list[tuple[int, int, int]] = [(-1, 0, 0)]
    for i, (size, left) in enumerate(zip(lengths.tolist(), (counts - take).tolist(), strict=True)):
        lot = 1
        while left > 0 and 0 < size <= gap and first[gap] < 0:
            n = min(lot, left)
            left, lot, step = left - n, lot * 2, n * size
            if step <= gap:
                fresh = (first[:-step] >= 0) & (first[step:] < 0)
                if fresh.any():
                    lots.append((i, n, step))
                    first[step:][fresh] = len(lots) - 1
    s = int(np.flatnonzero(first >= 0)[-1])
    while s > 0:
        i, n, step = lots[first[s]]
        take[i] += n
        s -= step
    return take


def targets(per_source: DataFrame, share_percent: int = SHARE_PERCENT) -> list[tuple[str | None, int, float]]:
    """(source, its words, its target) in code-point order, null last; one row per source reaches the driver."""
    rows = sorted(
        ((r["_source"], int(r["_words"])) for r in per_source.collect()),
        key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")),
    )
    weight = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(rows))]
    cap = [float(MAX_PASSES * w) for _, w in rows]
    target, open_, left = [0.0] * len(rows), set(range(len(rows))), sum(w for _, w in rows) * share_percent / 100.0
    while open_:
        all_weight = sum(weight[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weight[i] / all_weight > cap[i]]
        if not full:
            for i in open_:
                target[i] = left * weight[i] / all_weight
            break
        for i in full:
            target[i] = cap[i]
            left -= cap[i]
            open_.discard(i)
    return [(s, w, t) for (s, w), t in zip(rows, target, strict=True)]


def _plan(histogram: pd.DataFrame) -> pd.DataFrame:
    """One source: rows (_key, _size, _n, _target) in, plus _passes and _extra out."""
    h = histogram.sort_values("_size").reset_index(drop=True)
    total = int((h["_size"] * h["_n"]).sum())
    budget = int(np.floor(h["_target"].iloc[0] + 0.5))
    passes = min(MAX_PASSES, budget // total) if total else 0
    h["_passes"] = passes
    left = budget - passes * total if passes < MAX_PASSES else 0
    h["_extra"] = fit_lengths(h["_size"].to_numpy(), h["_n"].to_numpy(), left)
    return h[["_key", "_size", "_passes", "_extra"]]


@shielded
def mix(df: DataFrame, text: str = "text", source: str = "source", seed: int = 29) -> DataFrame:
    """All columns of ``df`` plus size, source_size, target and taken.

    size counts the words of the text (null text: 0); taken is 0, 1 or 2 times
    size. Documents of no words are never taken. Null sources are one source,
    last. Repeated rows are documents of their own. Empty table: no rows.
    Caller columns of these four names are replaced.
    """
    own = ("size", "source_size", "target", "taken")
    keep = [c for c in df.columns if c not in own]
    cols = [F.col(f"`{c}`") for c in keep]
    src = F.col(f"`{source}`").cast("string")
    key = F.when(src.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), src))
    sized = df.select(
        *cols, key.alias("_key"), src.alias("_source"), F.size(words(F.col(f"`{text}`"))).cast("bigint").alias("_size"),
    )
    hashed = sized.select("*", row_hash(df.select(*cols), seed).alias("_hash"))
    histogram = checkpoint(hashed.groupBy("_key", "_source", "_size").agg(F.count(F.lit(1)).alias("_n")))
    per_source = histogram.groupBy("_key", "_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_words"), F.sum("_n").alias("_rows"))
    goal = targets(per_source)
    spark = df.sparkSession
    goals = spark.createDataFrame(
        [("-" if s is None else "+" + s, w, float(t)) for s, w, t in goal], "_key string, _total bigint, _target double"
    )
    plan = checkpoint(
        histogram.select("_key", "_size", "_n").join(goals, "_key").groupBy("_key")
        .applyInPandas(_plan, "_key string, _size bigint, _passes bigint, _extra bigint")
    ).join(goals, "_key")
    total = histogram.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    ranked = with_rank(hashed, ["_key", "_size"], "_hash", range_bits(total), "_rank")
    taken = F.col("_size") * (F.col("_passes") + F.when(F.col("_rank") < F.col("_extra"), 1).otherwise(0))
    return ranked.join(plan, ["_key", "_size"]).select(
        *cols, F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken")
    )
