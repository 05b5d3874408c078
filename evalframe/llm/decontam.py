"""Benchmark decontamination by latent semantic retrieval and alignment checks.

1. TF-IDF vectors of passages over ``FEATURES`` hashed words; document
   frequencies are counted over every document.
2. A randomised SVD of the passage matrix A: Spark tasks add up the products of
   the words of every passage of every document, which gives A'A, a table of
   ``FEATURES`` by ``FEATURES`` whatever the input. A few power rounds on it,
   from a seeded test matrix and with the benchmark's own passages, give the
   leading right singular vectors.
3. Every window of every document is projected and compared by cosine with
   every benchmark item. Windows come in the lengths of the items, in steps of
   ``STEP`` words, so an item inside a document always has a window that
   differs by fewer than ``STEP`` words at each end.
4. A candidate is a leak if the longest common subsequence of its words and the
   item's covers ``MIN_LCS_PERCENT`` of the item, and the item's answer, its
   last ``ANSWER_WORDS`` words, survives to ``MIN_ANSWER_PERCENT`` as well.

Scale: the benchmark is a small reference set (its vectors travel with the
task, and ``MAX_ITEMS`` bounds them). The features of the words are written
once, two bytes a word; documents are only scanned, and all that leaves a task
are counts, sums of fixed size and confirmed leaks. The products of a passage
grow with the square of its length, the middle length of the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import text_or_empty, written

FEATURES = 1 << 12
RANK, EXTRA, POWER_ROUNDS = 80, 16, 2
#: tasks that add up passages: this many, and more where one would have more than PART_DOCUMENTS documents
FIT_PARTS, PART_DOCUMENTS = 16, 1 << 18
#: benchmark items that a task may hold as vectors; a larger benchmark has to be run in parts
MAX_ITEMS = 100_000
STEP = 8
MIN_COSINE = 0.62
MIN_LCS_PERCENT = 70
ANSWER_WORDS = 8
MIN_ANSWER_PERCENT = 50
#: documents that a task takes at a time for windows, items for the products of the fit, and passages for their words' products
DOCUMENTS, FIT_BATCH, PASSAGES = 2048, 32, 4096
#: words whose vectors one task holds at a time, with the padding between texts (a longer text is held alone)
WORDS = 1 << 16
#: trimmed from both ends of a word
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¿¡•"


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _flat_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of every word, offsets of the texts, words by code), lower-cased, split at white space, trimmed of punctuation."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, pc.utf8_trim(coded.dictionary, EDGE)


def _slots(words: pa.Array) -> np.ndarray:
    """Feature of every word, by a polynomial hash of its bytes."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    sizes = np.diff(offsets)
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    base = np.full(int(sizes.max(initial=0)) + 1, np.uint64(0x9E3779B97F4A7C15))
    base[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * np.cumprod(base)[at], dtype=np.uint64)))
    h = sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64)


def words_of(text: str | None) -> list[str]:
    codes, _, names = _flat_words(pa.array([text], pa.string()))
    names = names.to_pylist()
    return [names[c] for c in codes if names[c]]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def is_leak(item: list[str], passage: list[str]) -> tuple[bool, float]:
    """Whether ``passage`` holds the item up to small changes, and the share of the item that it holds."""
    if not item:
        return False, 0.0
    bag = set(passage)
    if 100 * sum(w in bag for w in item) < MIN_LCS_PERCENT * len(item):
        return False, 0.0  # a common subsequence can't be longer than the words in common
    share = lcs(item, passage) / len(item)
    answer = item[-ANSWER_WORDS:]
    ok = 100 * share >= MIN_LCS_PERCENT and 100 * lcs(answer, passage) >= MIN_ANSWER_PERCENT * len(answer)
    return ok, share


def word_slots(texts: DataFrame) -> DataFrame:
    """The features of the words of every row of ``texts`` (_text), in order, as 16-bit numbers: _words."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, DOCUMENTS):
            codes, offsets, names = _flat_words(batch.column("_text"))
            data = (_slots(names)[codes] if len(codes) else codes).astype(np.uint16)
            words = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(2 * offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary())], names=["_words"])

    return written(texts.select("_text").mapInArrow(code, "_words binary"), "word-slots")


def _stored_slots(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature of every word, offsets of the texts) of a batch of ``word_slots``."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data.view(np.uint16), (ends - ends[0]) // 2


def document_frequency(words: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over every row of ``word_slots``, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            slot, offsets = _stored_slots(batch.column("_words"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            for a in range(0, batch.num_rows, 1024):  # a table of texts by features at a time
                lo, hi = offsets[a], offsets[min(a + 1024, batch.num_rows)]
                holds = np.zeros((1024, FEATURES), dtype=bool)
                holds[owner[lo:hi] - a, slot[lo:hi]] = True
                df += holds.sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1)), pa.array(np.append(df, n))], names=["_slot", "_n"])

    rows = words.mapInArrow(count, "_slot bigint, _n bigint").groupBy("_slot").agg(F.sum("_n").alias("_n")).toPandas()
    by = dict(zip(rows["_slot"], rows["_n"], strict=True))
    return np.array([by.get(i, 0) for i in range(FEATURES)], dtype=np.float64), int(by.get(-1, 0))


def _passages(texts: pa.Array, length: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows (row, slot, value), unit length, of consecutive passages of ``length`` words."""
    codes, offsets, names = _flat_words(texts)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    slot = _slots(names)[codes]
    at = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    first = np.flatnonzero(at % length == 0)
    row = np.searchsorted(first, np.arange(len(codes)), side="right") - 1
    key, n = np.unique(row * FEATURES + slot, return_counts=True)
    value = n * idf[key % FEATURES]
    norm = np.sqrt(np.bincount(key // FEATURES, weights=value**2, minlength=len(first)))
    return key // FEATURES, key % FEATURES, value / np.maximum(norm[key // FEATURES], 1e-12)


def _times(row: np.ndarray, slot: np.ndarray, value: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A'(A v) of sparse rows."""
    out = np.zeros_like(v)
    if not len(row):
        return out
    starts = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
    y = np.add.reduceat(value[:, None] * v[slot], starts, axis=0)
    order = np.argsort(slot, kind="stable")
    back = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))
    parts = value[order, None] * y[back[order]]
    first = np.flatnonzero(np.concatenate(([True], np.diff(slot[order]) > 0)))
    out[slot[order][first]] = np.add.reduceat(parts, first, axis=0)
    return out


def _sorted_passages(slot: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """A row for each passage of ``length`` words with its features in order; a shorter passage ends in FEATURES."""
    sizes = np.diff(offsets)
    first = np.concatenate(([0], np.cumsum(-(-sizes // length))))
    at = np.arange(len(slot)) - np.repeat(offsets[:-1], sizes)
    table = np.full((first[-1], length), FEATURES, dtype=np.uint16)
    table[np.repeat(first[:-1], sizes) + at // length, at % length] = slot
    table.sort(axis=1)
    return table


def _add_products(table: np.ndarray, squares: np.ndarray, total: np.ndarray) -> None:
    """Add A'A without the factors idf to ``total`` (flat, FEATURES + 1 a row) over the upper triangle, its diagonal halved;
    ``squares`` are the squared idf, with 0 for the end of a short passage."""
    norm = squares[table].sum(axis=1)
    rows = np.arange(len(table))
    for d in range(1, table.shape[1]):  # a feature found n times counts n * n
        part = table[rows]
        same = (part[:, d:] == part[:, :-d]) & (part[:, d:] < FEATURES)
        some = same.any(axis=1)
        if not some.any():
            break
        norm[rows] += 2 * np.where(same, squares[part[:, d:]], 0).sum(axis=1)
        rows = rows[some]
    share = 1 / np.maximum(norm, 1e-24)
    words = np.ascontiguousarray(table.T).astype(np.int64)
    starts = words * (FEATURES + 1)
    np.add.at(total, (starts + words).ravel(), np.tile(share / 2, len(words)))
    for d in range(1, len(words)):
        np.add.at(total, (starts[:-d] + words[d:]).ravel(), np.tile(share, len(words) - d))


def passage_products(words: DataFrame, idf: np.ndarray, length: int, documents: int) -> np.ndarray:
    """A'A of the TF-IDF rows (unit length) of all passages of ``length`` words of ``word_slots``."""
    # frequent features side by side: their sums are near in memory
    order = np.argsort(idf, kind="stable")
    place = np.empty(FEATURES + 1, dtype=np.uint16)
    place[order], place[FEATURES] = np.arange(FEATURES), FEATURES
    squares = np.append(idf[order] ** 2, 0.0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1) ** 2)
        for batch in batches:
            slot, offsets = _stored_slots(batch.column("_words"))
            table = _sorted_passages(place[slot], offsets, length)
            for a in range(0, len(table), PASSAGES):
                _add_products(table[a : a + PASSAGES], squares, total)
        total = total.reshape(FEATURES + 1, -1)[:FEATURES, :FEATURES]
        rows = [i for i in range(FEATURES) if total[i, i:].any()]
        for a in range(0, len(rows), 512):
            part = rows[a : a + 512]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([total[i, i:].astype(np.float32).tobytes() for i in part], pa.binary())], names=["_slot", "_sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("_slot").to_pylist(), batch.column("_sums"), strict=True):
                row = np.frombuffer(row.as_buffer(), dtype=np.float32)
                if i in sums:
                    sums[i] += row
                else:
                    sums[i] = row.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["_slot", "_sums"])

    made = "_slot int, _sums binary"
    parts = max(FIT_PARTS, -(-documents // PART_DOCUMENTS))
    out = np.zeros((FEATURES, FEATURES), dtype=np.float32)
    for r in words.coalesce(parts).mapInArrow(add, made).repartition(FIT_PARTS, "_slot").mapInArrow(merge, made).collect():  # half a table, whatever the input
        out[r["_slot"], r["_slot"] :] = np.frombuffer(r["_sums"], dtype=np.float32)
    out += out.T
    ranked = idf[order].astype(np.float32)
    out *= ranked
    out *= ranked[:, None]
    return out[np.ix_(place[:FEATURES], place[:FEATURES])]


def fit_basis(texts: DataFrame, items: list[str], idf: np.ndarray, length: int, seed: int = 5, documents: int = 0) -> np.ndarray:
    """Leading right singular vectors (FEATURES x RANK) of all passages of ``texts`` (_text, or ``word_slots`` of it) and of
    the items, each divided by its singular value: latent axes of unit spread."""
    width = RANK + EXTRA
    words = texts if "_words" in texts.columns else word_slots(texts)
    products = passage_products(words, idf, length, documents)
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, width)))[0]
    scale = np.ones(width)
    for _ in range(POWER_ROUNDS + 1):
        y = sum(_times(*_passages(pa.array(items[a : a + FIT_BATCH], pa.string()), length, idf), v) for a in range(0, len(items), FIT_BATCH))
        y = y + products @ v.astype(np.float32)
        v, upper = np.linalg.qr(y)
        u, scale, _ = np.linalg.svd(upper)
        v = v @ u
    return (v / np.sqrt(np.maximum(scale, 1e-9 * scale.max() + 1e-12)))[:, :RANK].astype(np.float32)


def find_leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Confirmed leaks, one row for each document row and item: doc id, item id, cosine, lcs_share.

    A document without words (or null) and an item without words match nothing.
    Repeated documents each get their rows. Null ids are carried through. Empty
    tables give no rows. Other columns of either table play no part.
    """
    items = [(r["i"], words_of(r["t"])) for r in benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).limit(MAX_ITEMS + 1).collect()]
    if len(items) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} benchmark items: run them in parts")
    items = [(i, w) for i, w in items if w]
    made = "_id bigint, _item bigint, _cosine double, _share double"
    src = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), text_or_empty(F.col(f"`{text}`")).alias("_text"))
    out = [F.col("_id").alias(doc_id), F.col("_item").alias(item_id if item_id != doc_id else "item"), F.col("_cosine").alias("cosine"), F.col("_share").alias("lcs_share")]
    if not items:
        return df.sparkSession.createDataFrame([], made).select(*out)
    words = word_slots(src)
    df_counts, n = document_frequency(words)
    idf = np.log((n + 1.0) / (df_counts + 1.0)) + 1.0
    lengths = [len(w) for _, w in items]
    typical = max(1, int(np.median(lengths)))
    basis = fit_basis(words, [" ".join(w) for _, w in items], idf, typical, documents=n)
    weights = (idf[:, None] * basis).astype(np.float32)

    vectors = np.array([weights[_slots(pa.array(w))].sum(axis=0) for _, w in items])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    table = np.vstack((weights, np.zeros((1, RANK), dtype=np.float32)))  # the last row pads
    # windows of whole steps, nearest to the lengths of the items that look for them
    steps = np.maximum(1, (np.array(lengths) + STEP // 2) // STEP)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, DOCUMENTS):
            codes, offsets, names = _flat_words(batch.column("_text"))
            slot, found = _slots(names) if len(names) else None, []
            begin, padded = 0, (-(-np.diff(offsets) // STEP) + int(steps.max()) + 1) * STEP
            held = np.concatenate(([0], np.cumsum(padded)))
            while begin < len(offsets) - 1:
                end = max(begin + 1, int(np.searchsorted(held, held[begin] + WORDS, side="right")) - 1)
                found += _scan_part(codes, offsets, slot, begin, end)
                begin = end
            vocabulary, best = names.to_pylist(), {}
            for row, item, a, b, cosine in found:
                lo, hi = offsets[row], offsets[row + 1]
                passage = [vocabulary[c] for c in codes[max(lo, lo + a - 2 * STEP) : min(hi, lo + b + 2 * STEP)]]
                ok, held = is_leak(items[item][1], passage)
                if ok and (held, cosine) > best.get((row, item), (0.0, 0.0)):
                    best[row, item] = (held, cosine)
            ids = batch.column("_id")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r for r, _ in best], pa.int64())), pa.array([items[i][0] for _, i in best], pa.int64()), pa.array([float(c) for _, c in best.values()], pa.float64()), pa.array([float(h) for h, _ in best.values()], pa.float64())],
                names=["_id", "_item", "_cosine", "_share"],
            )

    def _scan_part(codes: np.ndarray, offsets: np.ndarray, slot: np.ndarray, begin: int, end: int) -> list[tuple]:
        """(row, item, first word, last word, cosine) of the windows of texts begin..end-1 that come near an item."""
        base = offsets[begin]
        part = codes[base : offsets[end]]
        if not len(part):
            return []
        # sums of STEP words; a text starts a step of its own, and empty steps keep windows off the next text
        longest = int(steps.max()) + 1
        sizes = np.diff(offsets[begin : end + 1])
        blocks = -(-sizes // STEP) + longest
        first_block = np.concatenate(([0], np.cumsum(blocks)))
        at = np.arange(len(part)) + np.repeat(first_block[:-1] * STEP - (offsets[begin:end] - base), sizes)
        padded = np.full(first_block[-1] * STEP, FEATURES, dtype=np.int64)
        padded[at] = slot[part]
        grid = padded.reshape(-1, STEP)
        sums = table[grid[:, 0]]
        for j in range(1, STEP):
            sums += table[grid[:, j]]
        window, out = sums.copy(), []
        for n_steps in range(1, longest + 1):
            if n_steps > 1:
                window[: 1 - n_steps] += sums[n_steps - 1 :]
            # an item of few steps is easily off the grid: it also looks at windows that hold all of it
            who = np.flatnonzero((steps == n_steps) | (steps <= 3) & (steps == n_steps - 1))
            if not len(who):
                continue
            norm = np.sqrt(np.einsum("ij,ij->i", window, window)) + 1e-9
            near = (window @ vectors[who].T.astype(np.float32)) / norm[:, None]
            for w, i in zip(*np.divmod(np.flatnonzero(near >= MIN_COSINE), len(who)), strict=True):
                row = int(np.searchsorted(first_block, w, side="right")) - 1
                a = int(w - first_block[row]) * STEP
                out.append((begin + row, int(who[i]), a, a + n_steps * STEP, float(near[w, i])))
        return out

    return src.mapInArrow(scan, made).select(*out)
