"""Exact Jaccard join of word-shingle sets as a metric-space join.

d(x, y) = 1 - J(x, y) is a metric; two documents link if d <= eps. Regions are
joined through pivots, never by listing all pairs:

1. A document's shingle hashes in sorted order form a ring. Linked sets differ
   in few elements, so their rings share neighbouring pairs: at least
   3 |x n y| - |x| - |y|. By the prefix principle the first of x's pairs in hash
   order, ``prefix_length`` many, meet those of every partner. The documents
   that share a pair form a region; unlike single shingles, ring pairs are not
   shared by texts that merely quote the same line. Regions of equal members are
   one region; overlapping regions are never merged.
2. The least document of a region is its first pivot. What links to it joins its
   component, and a region whose other members share one component is done.
3. In a region that is left and larger than ``LEAF`` each document is measured
   against ``PIVOTS`` more pivots and goes to the Voronoi region of the nearest
   one, which is cut into blocks by distance band. Two blocks meet only if, for
   every pivot p, their ranges of d(., p) come within eps of each other (by the
   triangle inequality no link can bridge a wider gap).
4. In a cell (a region, or two blocks) pairs of different components are held
   against two exact bounds: their sizes, and the parities of their sets in
   ``BITS`` buckets, of which a symmetric difference of m changes m at most.
   The few pairs within both bounds are counted over the whole texts, once each.

Only components are reported, so two members of one component need no test.
Set sizes, distances and links are exact; 64-bit hashes stand for shingles.
Equal sets are one node. Regions are found by pre-aggregated minima, so a
region with a third of all documents costs each task a row. Only parities
travel to cells; texts go to the pairs that are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalframe.llm.common import text_or_empty, written
from evalframe.llm.components import components

#: documents whose pairs decide which come last in the order, and the share of them that makes a pair frequent;
#: a set has 1 / ORDER_SHARE such pairs on average at most, so their list has a fixed bound
ORDER_SAMPLE = 20_000
ORDER_SHARE = 1 / 2_000
#: documents of a region that is one cell, and of two blocks that meet; a document takes about 300 bytes there
LEAF = 4096
#: pivots of a larger region
PIVOTS = 8
#: distance bands within eps
BANDS = 3
#: buckets whose parities bound the difference of two sets
BITS = 2048
#: pairs of a cell that are compared at once
PAIRS = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _A
    h = h ^ (h >> np.uint64(29))
    h = h * _B
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of a text (bytes)."""

    def __init__(self, k: int):
        self.k = k
        self.powers = np.ones(1, dtype=np.uint64)

    def _up_to(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            p = np.full(2 * n, np.uint64(_BASE), dtype=np.uint64)
            p[0] = 1
            self.powers = np.cumprod(p, dtype=np.uint64)
        return self.powers

    def word_hashes(self, text: bytes) -> np.ndarray:
        data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
        inside = np.concatenate(([False], _IS_WORD[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        # the place of a byte in its own word decides its weight
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
        if place is None:
            place = np.arange(len(data))
            place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        weights = self._up_to(int((stops - starts).max()) + 1)
        value = (data.astype(np.uint64) + np.uint64(1)) * weights[np.minimum(place, len(weights) - 1)]
        value[~inside[1:-1]] = 0
        return _mix(np.add.reduceat(value, starts) + (stops - starts).astype(np.uint64) * _B)

    def shingles(self, text: bytes | None) -> np.ndarray:
        w = self.word_hashes(text or b"")
        if not len(w):
            return w
        k = min(self.k, len(w))
        n = len(w) - k + 1
        h = np.full(n, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            h = (h + w[i : i + n]) * _A
            h ^= h >> np.uint64(31)
        return np.unique(_mix(h))


def prefix_length(n: int, percent: int) -> int:
    """How many ring pairs a set of n needs so that it meets every partner's: n + 1 less the fewest that partners share."""
    least = -(-percent * n // 100)
    shared = -(-(n + least) * (2 * percent - 100) // (100 + percent))
    return n - max(1, shared) + 1


def ring_pairs(s: np.ndarray) -> np.ndarray:
    return _mix(s * _A + np.roll(s, -1) * _B)


def _set_rows(k: int, percent: int, last: np.ndarray):
    """(_doc, _text, _id, _n, _set, _keys): size and digest of each set, and its first ring pairs."""
    schema = pa.schema([("_doc", pa.int64()), ("_text", pa.int64()), ("_id", pa.int64()), ("_n", pa.int64()), ("_set", pa.binary()), ("_keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for x in batch.column("_bytes"):
                s = of.shingles(x.as_buffer() if x.is_valid else b"")
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(first_pairs(s, percent, last) if len(s) else s)
            ends = np.cumsum([0, *[len(x) for x in keys]]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_text"), batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], schema=schema)

    return run


def first_pairs(s: np.ndarray, percent: int, last: np.ndarray) -> np.ndarray:
    """The first ring pairs of a set, in the order (in ``last``, hash)."""
    pairs, p = ring_pairs(s), prefix_length(len(s), percent)
    if p >= len(pairs):
        return pairs
    late = last[np.minimum(np.searchsorted(last, pairs), len(last) - 1)] == pairs if len(last) else np.zeros(len(pairs), dtype=bool)
    early = pairs[~late]
    if p < len(early):
        return np.partition(early, p - 1)[:p]
    return np.concatenate((early, np.sort(pairs[late])[: p - len(early)]))


def _pair_rows(k: int):
    """(_key) of all ring pairs of each set."""
    schema = pa.schema([("_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for batch in batches:
            for x in batch.column("_bytes"):
                s = of.shingles(x.as_buffer())
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(ring_pairs(s).view(np.int64))], schema=schema)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([squeeze.compress(x.as_buffer()) for x in batch.column("_bytes")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), packed], names=["_id", "_packed"])


def parities(s: np.ndarray) -> bytes:
    """One bit a bucket: whether the set has an odd number of elements there."""
    return np.packbits(np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _text_rows(k: int):
    """(_id, _n, _parity, _packed): size and parities of the set of each packed text."""
    schema = pa.schema([("_id", pa.int64()), ("_n", pa.int64()), ("_parity", pa.binary()), ("_packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, unpack = Shingler(k), zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, bits = [], []
            for x in batch.column("_packed"):
                s = of.shingles(unpack.decompress(x.as_py()))
                sizes.append(len(s))
                bits.append(parities(s))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), batch.column("_packed")], schema=schema)

    return run


def _common_rows(k: int):
    """(a, b, _both, _n, _m): sizes of the intersection and of both sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("_both", pa.int64()), ("_n", pa.int64()), ("_m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, unpack = Shingler(k), zstandard.ZstdDecompressor()
        seen: dict[int, np.ndarray] = {}

        def set_of(i: int, packed: pa.Scalar) -> np.ndarray:
            if i not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[i] = of.shingles(unpack.decompress(packed.as_py()))
            return seen[i]

        for batch in batches:
            rows = []
            for i, j, own, other in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("_packed"), batch.column("_other"), strict=True):
                s, t = set_of(i, own), set_of(j, other)
                rows.append((i, j, len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def _as_matrix(parity: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(parity.to_pylist()), dtype=np.uint64).reshape(len(parity), BITS // 64)


def _in_bound(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the parities of two sets differ in no more places than linked sets of ``sizes`` elements together may."""
    return (100 + percent) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (100 - percent) * sizes


def _bounded_rows(percent: int):
    """The pairs (a, b) whose parities are within the bound."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _in_bound(_as_matrix(batch.column("_parity")), _as_matrix(batch.column("_other")), batch.column("_sizes").to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], schema=schema)

    return run


def cell_pairs(cell: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a, b) of the pairs of a ``_left`` and a ``_right`` row that may link and have different labels."""
    ids, sizes, labels = (cell.column(c).to_numpy() for c in ("_id", "_n", "_label"))
    bits = _as_matrix(cell.column("_parity").combine_chunks())
    left, right = (np.flatnonzero(cell.column(c).to_numpy()) for c in ("_left", "_right"))
    found = []
    step = max(1, PAIRS // max(1, len(right)))
    for start in range(0, len(left), step):
        x = left[start : start + step]
        n, m = sizes[x][:, None], sizes[right][None, :]
        fit = (labels[x][:, None] != labels[right][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        i, j = np.nonzero(fit)
        i, j = x[i], right[j]
        near = _in_bound(bits[i], bits[j], sizes[i] + sizes[j], percent)
        found.append((ids[i[near]], ids[j[near]]))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (ids[:0], ids[:0])
    return np.maximum(a, b), np.minimum(a, b)


def _cell_rows(percent: int):
    """``cell_pairs`` of every cell; rows come sorted by cell, and a cell holds about LEAF rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cells: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                a, b = cell_pairs(cells.slice(lo, hi - lo), percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        rest = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            here = here if rest is None else pa.concat_tables([rest, here])
            x, y = here.column("_x").to_numpy(), here.column("_y").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1))
            yield from pairs(here, cuts)
            rest = here.slice(int(cuts[-1])) if len(x) else None
        if rest is not None:
            yield from pairs(rest, np.array([0, rest.num_rows]))

    return run


def _measured(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, _both, _n, _m) of pairs (a, b), over their whole texts."""
    other = texts.select(F.col("_id").alias("b"), F.col("_packed").alias("_other"))
    rows = pairs.join(other, "b").join(texts.select(F.col("_id").alias("a"), "_packed"), "a").select("a", "b", "_packed", "_other")
    return rows.mapInArrow(_common_rows(k), "a bigint, b bigint, _both bigint, _n bigint, _m bigint")


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(100 * F.col("_both") >= percent * (F.col("_n") + F.col("_m") - F.col("_both"))).select("a", "b")


def _pivot_links(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of the members of each region (_key, _id, _head) to its pivot ``_head``."""
    sizes = texts.select("_id", "_n", "_parity")
    a = sizes.select(F.col("_id").alias("a"), F.col("_n").alias("_na"), "_parity")
    b = sizes.select(F.col("_id").alias("b"), F.col("_n").alias("_nb"), F.col("_parity").alias("_other"))
    pairs = members.where("_id <> _head").select(F.col("_id").alias("a"), F.col("_head").alias("b")).distinct().join(b, "b").join(a, "a")
    fit = pairs.where(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")).select("a", "b", (F.col("_na") + F.col("_nb")).alias("_sizes"), "_parity", "_other")
    near = written(fit.mapInArrow(_bounded_rows(percent), "a bigint, b bigint"), "near")
    return written(_linked(_measured(near, texts, k), percent), "links")


def _blocks(big: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Cells (_x, _y, _id, _label, _left, _right) of the regions (_key, _id, _label) above a leaf, and the links (a, b) to their pivots."""
    at = F.row_number().over(Window.partitionBy("_key").orderBy("_hash", "_id")) - 1
    # the least hashes of a region, found without sorting it: the least of each of PIVOTS parts, then ranked
    parts = big.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(PIVOTS))).groupBy("_key", "_part").agg(F.min(F.struct(F.xxhash64("_id", F.lit(1)).alias("_hash"), "_id")).alias("_p"))
    pivots = written(parts.select("_key", F.col("_p._hash").alias("_hash"), F.col("_p._id").alias("_id")).withColumn("_at", at).select("_key", F.col("_id").alias("b"), "_at"), "pivots")
    pairs = big.select("_key", F.col("_id").alias("a"), "_label").join(pivots, "_key")
    measured = written(_measured(pairs.select("a", "b").distinct(), texts, k), "measured")

    eps = 1 - percent / 100
    d = 1 - F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))
    by_doc = pairs.join(measured.select("a", "b", d.alias("_d")), ["a", "b"]).groupBy("_key", F.col("a").alias("_id"), "_label").agg(
        F.min(F.struct("_d", "_at")).alias("_near"), *[F.max(F.when(F.col("_at") == i, F.col("_d"))).alias(f"_d{i}") for i in range(PIVOTS)]
    )
    cell = ["_key", F.col("_near._at").alias("_home"), F.ceil(F.col("_near._d") / (eps / BANDS) - 1e-9).alias("_band")]
    docs = written(by_doc.select(*cell, "_id", "_label", *[f"_d{i}" for i in range(PIVOTS)]), "distances")
    counts = docs.groupBy("_key", "_home", "_band").agg(F.ceil(F.count(F.lit(1)) / (LEAF // 2)).alias("_blocks"))
    docs = docs.join(counts, ["_key", "_home", "_band"]).withColumn("_block", F.xxhash64("_key", "_home", "_band", F.pmod(F.xxhash64("_id", F.lit(2)), F.col("_blocks"))))
    docs = written(docs.drop("_home", "_band", "_blocks"), "blocks")
    ranges = docs.groupBy("_key", "_block").agg(
        F.min("_label").alias("_from"), F.max("_label").alias("_to"),
        *[f(f"_d{i}").alias(f"_{n}{i}") for i in range(PIVOTS) for f, n in ((F.min, "lo"), (F.max, "hi"))],
    )
    x, y = ranges.alias("x"), ranges.alias("y")
    near = [F.greatest(F.col(f"x._lo{i}") - F.col(f"y._hi{i}"), F.col(f"y._lo{i}") - F.col(f"x._hi{i}")) <= eps + 1e-9 for i in range(PIVOTS)]
    one = (F.col("x._from") == F.col("x._to")) & (F.col("y._from") == F.col("y._to")) & (F.col("x._from") == F.col("y._from"))
    meet = x.join(y, F.col("x._key") == F.col("y._key")).where(F.col("x._block") <= F.col("y._block")).where(~one)
    for close in near:
        meet = meet.where(F.coalesce(close, F.lit(True)))
    meet = written(meet.select(F.col("x._block").alias("_x"), F.col("y._block").alias("_y")), "meet")
    sides = meet.select("_x", "_y", F.col("_x").alias("_block"), F.lit(True).alias("_left"), (F.col("_x") == F.col("_y")).alias("_right")).unionByName(
        meet.where("_x <> _y").select("_x", "_y", F.col("_y").alias("_block"), F.lit(False).alias("_left"), F.lit(True).alias("_right"))
    )
    cells = docs.select("_id", "_label", "_block").join(sides, "_block").select("_x", "_y", "_id", "_label", "_left", "_right")
    return cells, _linked(measured, percent)


def _region_links(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that give the components of the regions (_key, _id, _head)."""
    to_pivot = _pivot_links(members, texts, k, percent)
    labels = written(components(to_pivot).select(F.col("node").alias("_id"), F.col("component").alias("_label")), "labels")
    # the pivot has met every other member
    others = members.where("_id <> _head").join(labels, "_id", "left").select("_key", "_id", F.coalesce("_label", "_id").alias("_label"))
    others = written(others, "others")
    left = others.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"), F.min("_label").alias("_from"), F.max("_label").alias("_to"))
    left = written(left.where("_from <> _to").select("_key", "_size"), "left")
    both = [F.lit(True).alias("_left"), F.lit(True).alias("_right")]
    cells = others.join(left.where(F.col("_size") <= LEAF), "_key", "left_semi").select(F.col("_key").alias("_x"), F.col("_key").alias("_y"), "_id", "_label", *both)
    links = to_pivot
    big = others.join(left.where(F.col("_size") > LEAF), "_key", "left_semi")
    if not left.where(F.col("_size") > LEAF).isEmpty():
        blocks, to_pivots = _blocks(big, texts, k, percent)
        cells, links = cells.unionByName(blocks), links.unionByName(to_pivots)
    rows = cells.join(texts.select("_id", "_n", "_parity"), "_id").repartition("_x", "_y").sortWithinPartitions("_x", "_y")
    pairs = written(rows.mapInArrow(_cell_rows(percent), "a bigint, b bigint").distinct(), "pairs")
    return links.unionByName(_linked(_measured(pairs, texts, k), percent))


def text_key(doc_id: Column, text: Column) -> Column:
    """What a text goes by if its id has other texts too."""
    return F.xxhash64(doc_id.cast("bigint"), text_or_empty(text).cast("binary"))


def _nodes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_doc, _text, _id, _bytes): _id is the document id, or the ``text_key`` (_text) where that id has several texts."""
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    src = df.select(i.cast("bigint").alias("_doc"), text_key(i, t).alias("_text"), text_or_empty(t).cast("binary").alias("_bytes"))
    several = src.where("_doc is not null").groupBy("_doc").agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi"))
    several = written(several.where("_lo <> _hi").select("_doc", F.lit(True).alias("_several")), "several")
    if several.isEmpty():
        return src.select("_doc", "_text", F.col("_doc").alias("_id"), "_bytes")
    return src.join(several, "_doc", "left").select("_doc", "_text", F.when(F.col("_several"), F.col("_text")).otherwise(F.col("_doc")).alias("_id"), "_bytes")


def _solve(df: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """(_doc, _text, _id, _set, n_shingles, _component, component_id) of every row; _component is the least _id reached."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    src = _nodes(df, doc_id, text)
    rows = max(1, src.count())
    sample = src.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, ORDER_SAMPLE / rows) * (1 << 30)))
    often = sample.where("_id is not null").mapInArrow(_pair_rows(k), "_key bigint").groupBy("_key").count()
    often = often.where(F.col("count") >= max(4, int(min(rows, ORDER_SAMPLE) * ORDER_SHARE))).select("_key").toPandas()["_key"]
    last = np.sort(often.to_numpy(dtype=np.int64).view(np.uint64))

    sets = written(src.mapInArrow(_set_rows(k, percent, last), "_doc bigint, _text bigint, _id bigint, _n bigint, _set binary, _keys array<bigint>"), "sets")
    reps = written(sets.where("_n > 0 and _id is not null").groupBy("_set").agg(F.min("_id").alias("_rep"), F.min("_doc").alias("_least")), "reps")
    # one document stands for its copies, so a key that only copies share is no region
    alone = sets.select(F.col("_id").alias("_rep"), "_set", "_keys").join(reps, ["_rep", "_set"], "left_semi")
    keyed = alone.select(F.explode("_keys").alias("_key"), F.col("_rep").alias("_id"))
    tied = written(keyed.groupBy("_key").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo <> _hi").select("_key"), "keys")
    members = keyed.join(tied, "_key", "left_semi")
    members = written(members, "members")
    # regions of equal members (by count and a 128-bit digest) are one
    same = ["_size", "_even", "_odd"]
    regions = members.groupBy("_key").agg(
        F.min("_id").alias("_head"), F.count(F.lit(1)).alias("_size"),
        *[F.bit_xor(F.xxhash64("_id", F.lit(seed))).alias(name) for seed, name in ((5, "_even"), (6, "_odd"))],
    ).groupBy(*same).agg(F.min(F.struct("_key", "_head")).alias("_first")).select("_first.*")
    members = written(members.join(regions, "_key").select("_key", "_id", "_head"), "regions")

    packed = src.where("_id is not null").mapInArrow(_pack, "_id bigint, _packed binary")
    texts = packed.join(members.select("_id").distinct(), "_id").dropDuplicates(["_id"])
    texts = written(texts.mapInArrow(_text_rows(k), "_id bigint, _n bigint, _parity binary, _packed binary"), "texts")
    links = _region_links(members, texts, k, percent)

    label = components(links).select(F.col("node").alias("_rep"), F.col("component").alias("_label"))
    least = label.join(reps, "_rep").groupBy("_label").agg(F.min("_least").alias("component_id"))
    label = label.join(least, "_label")
    found = sets.drop("_keys").join(reps, "_set", "left").join(label, "_rep", "left")
    of = [F.when(F.col("_id").isNotNull(), F.coalesce(*names)).alias(name) for name, names in (("_component", ("_label", "_rep", "_id")), ("component_id", ("component_id", "_least", "_doc")))]
    return found.select("_doc", "_text", "_id", "_set", F.col("_n").alias("n_shingles"), *of)


def first_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(_doc, _text) of one text of every component, that of the least document id; _text is its ``text_key``."""
    found = _solve(df, doc_id, text, k, percent).where("_doc is not null")
    return found.groupBy("_component").agg(F.min(F.struct("_doc", "_text")).alias("_first")).select("_first.*")


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``df``: the id column, n_shingles and component_id.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased;
    a text of fewer than ``k`` words is one shingle, a text without words (or
    null) has none and links with nothing. Two documents link if 100 times the
    intersection is at least ``percent`` times the union; component_id is the
    least id reached over links. Rows of equal shingle sets share a component. Links
    are between texts: where one id has several texts, each is compared, and its
    row has the component of that text. A row whose id is null links with nothing and has a null component_id. Other
    columns of ``df`` play no part; an empty table gives no rows.
    """
    found = _solve(df, doc_id, text, k, percent)
    return found.select(F.col("_doc").alias(doc_id), "n_shingles", "component_id")
