"""Repeated byte windows by a depth-limited radix sort.

A window is ``width`` bytes of one text. The suffix that starts at a window is
ordered only as deep as the window, one digit per pass, most significant digit
first, and a suffix leaves as soon as its group holds nothing else:

1. digit 1 is the window's anchor, the ``GRAM``-byte string of least hash in it
   (leftmost if several). Equal windows have equal anchors at equal offsets, and
   neighbouring suffixes share an anchor, so one row stands for a run of them.
   A run whose anchor string occurs nowhere else holds no repeated window.
2. digit 2 is the whole text under a run. Runs equal in it are repeated from
   end to end.
3. where one anchor has several digits 2, runs go in bands of neighbouring
   suffixes. Digit 3 is the core that all windows of a band have in common (a
   core that occurs once holds no repeated window), digit 4 the whole text under
   the band (bands equal in it are repeated from end to end).
4. digit 5 orders the single suffixes of bands that share a core but not the
   whole, by the whole window. Groups of two or more equal windows are exactly
   the repeated ones.

Scale: pass 1 shuffles about 2 / (width - GRAM) rows a byte (about 1.5 %), the
later passes only what is still tied. Groups are counted by pre-aggregated
minimum and maximum, never gathered, so a passage in a third of all documents
costs each task a row. Only a document's own windows are ever listed together.
Anchors only group, by a 64-bit hash; equality is decided by 128-bit digests of
the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import row_hash, shielded, text_or_empty, written

GRAM = 64
#: bands of the longest run
BANDS = 8
#: bytes that one numpy pass holds; longer texts go in blocks that overlap by a window
BLOCK = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: a run in one long: first window, last window - first, anchor - first
_LAST_BITS, _BACK_BITS = 12, 12
_SHIFT = _LAST_BITS + _BACK_BITS


def _unpack_run(run: int) -> tuple[int, int, int]:
    return run >> _SHIFT, (run >> _BACK_BITS) & ((1 << _LAST_BITS) - 1), run & ((1 << _BACK_BITS) - 1)


class _Anchors:
    """Anchor runs of a block of bytes, by a rolling polynomial hash mod 2^64."""

    def __init__(self, width: int, gram: int, block: int):
        self.width, self.gram = width, gram
        self.up, self.down = _powers(int(_BASE), block), _powers(_inverse(int(_BASE)), block)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[self.gram:] - sums[: n + 1 - self.gram]) * self.down[: n + 1 - self.gram]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h

    def runs(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, last window, anchor, anchor's hash) of every run of the texts [start, stop) in ``data``."""
        none = np.empty(0, dtype=np.int64)
        lengths = stops - starts - self.width + 1
        starts, lengths = starts[lengths > 0], lengths[lengths > 0]
        if not len(starts):
            return none, none, none, none
        h = self.hashes(data)
        # the offset breaks ties to the left; 24 bits hold any offset of a block
        least = ((h >> np.uint64(24)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        span, wide = 1, self.width - self.gram + 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span:])
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        anchor = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1
        first = np.concatenate(([0], new))
        last = np.concatenate((new, [len(at)])) - 1
        return at[first], at[last], anchor[first], h[anchor[first]].view(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), offsets
    return np.frombuffer(column.buffers()[2], dtype=np.uint8), offsets


def _blocks(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, list[int]]]:
    """(from, to, rows) byte ranges of at most BLOCK bytes: whole small texts, or overlapping parts of one long text."""
    rows: list[int] = []
    begin = None
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a > BLOCK:
            if rows:
                yield begin, a, rows
            rows, begin = [], None
            while b - a >= width:
                yield a, min(b, a + BLOCK), [i]
                a = a + BLOCK - width + 1
            continue
        if rows and b - begin > BLOCK:
            yield begin, a, rows
            rows = []
        if not rows:
            begin = a
        rows.append(i)
    if rows:
        yield begin, int(offsets[-1]), rows


def _anchor_rows(width: int):
    schema = pa.schema([("_gram", pa.int64()), ("_hash", pa.binary()), ("_run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Anchors(width, GRAM, BLOCK)
        for batch in batches:
            data, offsets = _bytes_of(batch.column("_bytes"))
            keys = batch.column("_hash")
            for begin, end, rows in _blocks(offsets, width):
                r = np.array(rows)
                starts = np.maximum(offsets[r], begin) - begin
                stops = np.minimum(offsets[r + 1], end) - begin
                first, last, anchor, gram = finder.runs(data[begin:end], starts, stops)
                if not len(first):
                    continue
                owner = r[np.searchsorted(starts, first, side="right") - 1]
                packed = (first + begin - offsets[owner]) << _SHIFT | (last - first) << _BACK_BITS | (anchor - first)
                yield pa.RecordBatch.from_arrays([pa.array(gram), keys.take(pa.array(owner)).cast(pa.binary()), pa.array(packed)], schema=schema)

    return run


def _digest(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle, the other columns as they are."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([squeeze.compress(x.as_buffer()) for x in batch.column("_bytes")], pa.binary())
        yield batch.drop_columns("_bytes").append_column("_packed", packed)


def _unpacked(packed: bytes) -> memoryview:
    return memoryview(zstandard.ZstdDecompressor().decompress(packed))


def _span_rows(width: int):
    schema = pa.schema([("_gram", pa.int64()), ("_hash", pa.binary()), ("_run", pa.int64()), ("_digest", pa.binary()), ("_span", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, owner, spans = batch.column("_runs"), [], []
            for i in range(batch.num_rows):
                text = _unpacked(batch.column("_packed")[i].as_py())
                own = runs[i].values.field("_run").to_pylist()
                owner += [i] * len(own)
                for x in own:
                    first, more, _ = _unpack_run(x)
                    spans.append(bytes(text[first : first + more + width]))
            flat = runs.flatten()
            yield pa.RecordBatch.from_arrays(
                [flat.field("_gram"), batch.column("_hash").take(pa.array(owner, pa.int64())).cast(pa.binary()), flat.field("_run"), pa.array([_digest(x) for x in spans], pa.binary()), pa.array(spans, pa.binary())],
                schema=schema,
            )

    return run


def _band_size(width: int) -> int:
    return -(-(width - GRAM + 1) // BANDS)


def _band_rows(width: int):
    """The bands of a run: the core that all windows of a band have in common, at a place fixed by the anchor, and the whole."""
    schema = pa.schema([("_core", pa.binary()), ("_hash", pa.binary()), ("_run", pa.int64()), ("_band", pa.int32()), ("_whole", pa.binary())])
    size = _band_size(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores, row, bands, wholes = [], [], [], []
            for i, (x, span) in enumerate(zip(batch.column("_run").to_pylist(), batch.column("_span").to_pylist(), strict=True)):
                _, more, back = _unpack_run(x)
                for band in range((back - more) // size, back // size + 1):
                    at = back - band * size
                    cores.append(_digest(span[max(0, at) : at - size + 1 + width]))
                    low, high = max(0, at - size + 1), min(at, more)
                    wholes.append(_digest(span[low : high + width]))
                    row.append(i)
                    bands.append(band)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cores, pa.binary()), batch.column("_hash").take(row).cast(pa.binary()), batch.column("_run").take(row), pa.array(bands, pa.int32()), pa.array(wholes, pa.binary())], schema=schema)

    return run


def _window_rows(width: int):
    """Every window of the bands in _bands (a bit for each); _alone where _open has the bit too."""
    schema = pa.schema([("_lo", pa.int64()), ("_hi", pa.int64()), ("_hash", pa.binary()), ("_at", pa.int32()), ("_alone", pa.bool_())])
    size = _band_size(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, row, at, alone = [], [], [], []
            for i, (x, span, bands, single) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_run", "_span", "_bands", "_open")), strict=True)):
                first, more, back = _unpack_run(x)
                own = [k for k in range(more + 1) if bands >> ((back - k) // size) & 1]
                windows += [_digest(span[k : k + width]) for k in own]
                row += [i] * len(own)
                at += [first + k for k in own]
                alone += [bool(single >> ((back - k) // size) & 1) for k in own]
            both = np.frombuffer(b"".join(windows), dtype=np.int64).reshape(-1, 2)
            keys = batch.column("_hash").take(pa.array(row, pa.int64())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), keys, pa.array(at, pa.int32()), pa.array(alone, pa.bool_())], schema=schema)

    return run


def _windows_of(pairs: list[dict] | None, blocks: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows of the repeated runs, from (first, last) pairs and bit-map blocks."""
    a, b = np.array([(x["_a"], x["_b"]) for x in pairs or []], dtype=np.int64).reshape(-1, 2).T
    if blocks:
        bits = np.array([x["_bits"] for x in blocks], dtype="<i8").view(np.uint8).reshape(-1, 8)
        row, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
        at = np.array([x["_block"] for x in blocks], dtype=np.int64)[row] * 64 + bit
        a, b = np.concatenate((a, at)), np.concatenate((b, at))
    return a, b


def _cut(text: memoryview, first: np.ndarray, last: np.ndarray, width: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed spans, and the bytes that stay."""
    order = np.argsort(first, kind="stable")
    first, stop = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + width)
    new = np.concatenate(([True], first[1:] > stop[:-1]))
    begins = first[new]
    ends = stop[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(stop) - 1]))]
    spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
    kept, done = [], 0
    for a, b in spans:
        kept.append(text[done:a])
        done = b
    kept.append(text[done:])
    return spans, b"".join(kept)


def _cut_rows(width: int, with_text: bool):
    fields = [("_hash", pa.binary()), ("_removed", pa.int64()), ("_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("_sha", pa.string())]
    schema = pa.schema(fields + [("_kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = _unpacked(batch.column("_packed")[i].as_py())
                first, last = _windows_of(batch.column("_pairs")[i].as_py(), batch.column("_blocks")[i].as_py())
                spans, kept = _cut(text, first, last, width)
                out = {"_hash": batch.column("_hash")[i].as_py(), "_removed": sum(b - a for a, b in spans), "_spans": [{"start": a, "stop": b} for a, b in spans], "_sha": hashlib.sha256(kept).hexdigest()}
                rows.append(out | ({"_kept": kept} if with_text else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _several(df: DataFrame, key: list[str], item: list[str]) -> DataFrame:
    """Keys that hold at least two different items, by the least and greatest item hash."""
    a = F.xxhash64(*item)
    return df.groupBy(*key).agg(F.min(a).alias("_min"), F.max(a).alias("_max")).where("_min <> _max").select(*key)


def _split(df: DataFrame, group: str, digest: str, item: list[str]) -> tuple[DataFrame, DataFrame]:
    """One radix pass: rows whose (group, digest) holds several items; and, of every group with
    several digests that isn't settled by this, one row for each digest, with ``_alone``."""
    place = F.xxhash64(*item)
    classes = df.groupBy(group, digest).agg(F.min(place).alias("_least"), F.max(place).alias("_most"))
    classes = written(classes.select(group, digest, "_least", (F.col("_least") == F.col("_most")).alias("_alone")), "classes")
    same = df.join(classes.where("not _alone").select(group, digest), [group, digest], "left_semi")
    d = F.xxhash64(digest)
    mixed = classes.groupBy(group).agg(F.min(d).alias("_min"), F.max(d).alias("_max"), F.bool_or("_alone").alias("_any"))
    mixed = mixed.where("_min <> _max and _any").select(group)
    first = df.withColumn("_least", place).join(classes.join(mixed, group, "left_semi"), [group, digest, "_least"])
    return same, first.drop("_least")


@shielded
def cut_repeats(df: DataFrame, text: str = "text", width: int = 200, with_text: bool = False) -> DataFrame:
    """All columns of ``df`` plus n_bytes, n_removed, spans, kept_sha256 (and kept_bytes).

    A byte is removed if some ``width``-byte string over it also starts anywhere
    else, in this or another row; rows are judged on the input. spans lists the
    maximal removed byte ranges (start, stop). A null text counts as empty;
    texts shorter than ``width`` bytes stay whole; repeated rows are documents
    that repeat each other. Caller columns of the new names are replaced. An
    empty table gives no rows.
    """
    if width <= GRAM:
        raise ValueError(f"width must exceed {GRAM} bytes")
    if width - GRAM >= 1 << _BACK_BITS:
        raise ValueError(f"width must be under {GRAM + (1 << _BACK_BITS)} bytes")
    own = ("n_bytes", "n_removed", "spans", "kept_sha256", "kept_bytes")
    raw = text_or_empty(F.col(f"`{text}`")).cast("binary")
    key = F.unhex(F.md5(raw))
    size = F.octet_length(raw).cast("bigint")
    row = row_hash(df.drop(text), 0)
    texts = df.select(key.alias("_hash"), raw.alias("_bytes"), row.alias("_row")).where(F.octet_length("_bytes") >= width)

    # one row of every distinct text stands for its copies
    copies = written(
        df.select(key.alias("_hash"), row.alias("_row")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_copies"), F.min("_row").alias("_row")),
        "copies",
    )
    packed = texts.mapInArrow(_pack, "_hash binary, _row bigint, _packed binary")

    anchors = texts.select("_hash", "_bytes").mapInArrow(_anchor_rows(width), "_gram bigint, _hash binary, _run bigint")
    shared = written(_several(anchors, ["_gram"], ["_hash", "_run"]), "grams")
    # a set, as copies of a text bring the same runs
    tied = anchors.join(shared, "_gram", "left_semi")
    per_text = tied.groupBy("_hash").agg(F.collect_set(F.struct("_gram", "_run")).alias("_runs"))
    spans = written(
        packed.join(per_text.join(copies.select("_hash", "_row"), "_hash"), ["_hash", "_row"]).select("_hash", "_packed", "_runs")
        .mapInArrow(_span_rows(width), "_gram bigint, _hash binary, _run bigint, _digest binary, _span binary"),
        "spans",
    )

    # digit 2: runs with the same anchor
    whole, members = _split(spans, "_gram", "_digest", ["_hash", "_run"])
    first, more = F.shiftright("_run", _SHIFT), F.shiftright("_run", _BACK_BITS).bitwiseAND(F.lit((1 << _LAST_BITS) - 1))
    back = F.col("_run").bitwiseAND(F.lit((1 << _BACK_BITS) - 1))
    members = written(members.select("_hash", "_run", "_span"), "members")

    # digits 3 and 4: their bands
    made = "_core binary, _hash binary, _run bigint, _band int, _whole binary"
    bands = written(members.mapInArrow(_band_rows(width), made), "bands")
    whole_bands, left = _split(bands, "_core", "_whole", ["_hash", "_run", "_band"])
    mask = F.expr("shiftleft(1, _band)")
    left = left.groupBy("_hash", "_run").agg(F.bit_or(mask).alias("_bands"), F.bit_or(F.when(F.col("_alone"), mask).otherwise(0)).alias("_open"))

    # runs and bands that are repeated from end to end, written once for each text: no later step holds the files that they were sought with
    band = _band_size(width)
    at = back - F.col("_band") * band
    pairs = whole.select("_hash", first.alias("_a"), (first + more).alias("_b")).unionByName(
        whole_bands.select("_hash", (first + F.greatest(F.lit(0), at - (band - 1))).alias("_a"), (first + F.least(at, more)).alias("_b"))
    )
    pairs = written(pairs.groupBy("_hash").agg(F.collect_list(F.struct("_a", "_b")).alias("_pairs")), "pairs")

    # digit 5: single windows
    windows = members.join(left, ["_hash", "_run"]).select("_hash", "_run", "_span", "_bands", "_open").mapInArrow(
        _window_rows(width), "_lo bigint, _hi bigint, _hash binary, _at int, _alone boolean"
    )
    windows = written(windows, "windows")
    single = windows.where("_alone").join(_several(windows, ["_lo", "_hi"], ["_hash", "_at"]), ["_lo", "_hi"], "left_semi")

    # repeated windows as 64-bit blocks of a bit map: a run or band is at most a few blocks
    bits = single.groupBy("_hash", F.shiftright("_at", 6).alias("_block")).agg(F.bit_or(F.expr("shiftleft(1L, _at & 63)")).alias("_bits"))
    bits = written(bits.groupBy("_hash").agg(F.collect_list(F.struct("_block", "_bits")).alias("_blocks")), "bits")
    listed = pairs.join(bits, "_hash", "full")
    once = copies.where("_copies = 1").select("_hash", "_row")
    made = "_hash binary, _removed bigint, _spans array<struct<start:bigint,stop:bigint>>, _sha string" + ", _kept binary" * with_text
    cut = packed.join(listed.join(once, "_hash"), ["_hash", "_row"]).select("_hash", "_packed", "_pairs", "_blocks").mapInArrow(_cut_rows(width, with_text), made)

    cols = [F.col(f"`{c}`") for c in df.columns if c not in own]
    rows = df.select(*cols, key.alias("_hash"), size.alias("_n"), F.sha2(raw, 256).alias("_full"))
    rows = rows.join(copies.select("_hash", "_copies"), "_hash").join(cut, "_hash", "left")
    gone = (F.col("_copies") > 1) & (F.col("_n") >= width)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    all_ = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("_n").alias("stop")))
    out = [
        *cols, F.col("_n").alias("n_bytes"),
        F.when(gone, F.col("_n")).otherwise(F.coalesce("_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(gone, all_).otherwise(F.coalesce("_spans", none)).alias("spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("_sha", "_full")).alias("kept_sha256"),
    ]
    if with_text:
        out.append(F.when(gone, F.lit("").cast("binary")).otherwise(F.coalesce(F.col("_kept"), raw)).alias("kept_bytes"))
    return rows.select(*out)
