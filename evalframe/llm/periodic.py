"""Periodic runs: stretches of words that repeat with a period, found by recursive frequency splitting.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are identical), at least max(MIN_WORDS, MIN_TIMES * q) words long, that no
neighbouring word extends. Every word of a run occurs MIN_TIMES times in it, so:

1. Splitting. A word that occurs fewer than MIN_TIMES times in its segment is in
   no run; it splits the segment. Pieces shorter than MIN_WORDS go, the others
   are counted anew and split until nothing is rare. Only the smaller pieces are
   counted from scratch (the largest keeps what is left of its parent's counts),
   so a text of n words costs n log n however long the recursion.
2. Lag scan of what survives. Words are named by their 2**j-word contexts, j
   rising; where the distance to the last equal context stays the same lag q, with
   q within (2**j / 2, 2**j], over consecutive positions, they span one maximal run
   of smallest period q: inside a run, equal contexts of q words or more lie exactly
   a multiple of q apart. Each level is one sort, so all lags cost n log^2 n.

Scale: a map over the input's own partitions; a task holds SLICE_BYTES of text or
one longer text. Nothing is shuffled, so hot sources and copies cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import fresh_name

MIN_WORDS, MIN_TIMES = 24, 3
#: text that a task tokenises at a time
SLICE_BYTES = 8 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN_TYPE = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def segments(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches in which every word occurs MIN_TIMES times, MIN_WORDS long or more."""
    stack = [(0, words)]
    while stack:
        at, part = stack.pop()
        if len(part) < MIN_WORDS:
            continue
        _, x, count = np.unique(part, return_inverse=True, return_counts=True)
        lo, hi = 0, len(x)
        cuts = np.flatnonzero(count[x] < MIN_TIMES)
        places = first = None
        while len(cuts):
            edges = np.concatenate(([lo - 1], cuts, [hi]))
            sizes = np.diff(edges) - 1
            largest = int(sizes.argmax())
            stack += [(at + edges[k] + 1, part[edges[k] + 1 : edges[k + 1]]) for k in np.flatnonzero(sizes >= MIN_WORDS) if k != largest]
            was_lo, was_hi, lo, hi = lo, hi, int(edges[largest]) + 1, int(edges[largest + 1])
            if hi - lo < MIN_WORDS:
                break
            gone, times = np.unique(np.concatenate((x[was_lo:lo], x[hi:was_hi])), return_counts=True)
            if places is None:
                places = np.argsort(x, kind="stable")
                first = np.concatenate(([0], np.cumsum(count)))
                count = count.copy()
            count[gone] -= times
            rare = gone[(count[gone] > 0) & (count[gone] < MIN_TIMES)]
            cuts = []
            for w in rare:
                own = places[first[w] : first[w + 1]]
                begin = np.searchsorted(own, lo)
                cuts.extend(own[begin : begin + count[w]])
            cuts = np.sort(np.array(cuts, dtype=np.int64))
        if hi - lo >= MIN_WORDS:
            yield at + lo, at + hi


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of a segment."""
    n, out = len(words), []
    name, span = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while True:
        order = np.argsort(name, kind="stable")
        same = np.flatnonzero(name[order][1:] == name[order][:-1])
        if not len(same):
            break  # no context comes twice, nor does a longer one
        lag = np.zeros(len(name), dtype=np.int64)
        lag[order[same + 1]] = order[same + 1] - order[same]
        lag[(lag <= span // 2) | (lag > span)] = 0
        edge = np.flatnonzero(np.diff(lag, prepend=0, append=0))
        begin = edge[:-1]
        q = lag[begin]
        length = np.diff(edge) + span - 1 + q
        good = (q > 0) & (length >= np.maximum(MIN_WORDS, MIN_TIMES * q))
        out += zip((begin - q)[good].tolist(), length[good].tolist(), q[good].tolist(), strict=True)
        if span >= n // MIN_TIMES or len(name) <= span:
            break  # longer lags leave no room for MIN_TIMES periods
        key = name[:-span] * (int(name.max()) + 1) + name[span:]
        name, span = np.unique(key, return_inverse=True)[1].astype(np.int64), 2 * span
    return out


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of a text's word codes, by start, then period."""
    found = [(s + a, length, q) for s, e in segments(words) for a, length, q in lag_scan(words[s:e])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about SLICE_BYTES of text, a longer text alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def _collapse(texts: pa.Array) -> pa.Array:
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = np.flatnonzero(pc.equal(names, "").to_numpy(zero_copy_only=False))  # the one piece of a text without words
    kept = ~np.isin(codes, empty)
    codes, owner = codes[kept], owner[kept]
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    keep, runs, sizes = np.ones(len(codes), dtype=bool), [], []
    for a, b in zip(offsets, offsets[1:], strict=False):
        found = runs_of(codes[a:b]) if b - a >= MIN_WORDS else []
        for start, length, period in found:
            keep[a + start + period : a + start + length] = False
        runs += found
        sizes.append(len(found))
    left = np.concatenate(([0], np.cumsum(keep)))[offsets]
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), names.take(pa.array(codes[keep]))), " ")
    starts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    table = np.array(runs, dtype=np.int64).reshape(-1, 3)
    flat = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], fields=list(_RUN_TYPE))
    return pa.StructArray.from_arrays([pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(starts, flat), text], names=["n_words", "runs", "collapsed"])


def collapse_runs(df: DataFrame, text: Column | str = "text") -> DataFrame:
    """All rows and columns of ``df`` plus ``n_words``, ``runs`` (start, length, period, in words from 0;
    by start, then period) and ``collapsed``: the text without the words that lie in a run after its
    first period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. A null, empty or blank text has no words, no
    runs and an empty collapsed text. Runs may overlap; a word goes if any of them drops it. Repeated
    rows each get the same result; an empty table gives none. Caller columns named like the three are
    replaced; all others may have any name.
    """

    @F.arrow_udf(f"struct<n_words:bigint,runs:array<{RUN}>,collapsed:string>")
    def collapsed(texts: pa.Array) -> pa.Array:
        done = [_collapse(part) for part in _parts(texts)]
        return pa.concat_arrays(done) if done else _collapse(texts)

    made = fresh_name(df, "made")
    out = ("n_words", "runs", "collapsed")
    keep = [c for c in df.columns if c.lower() not in out]
    src = F.col(f"`{text}`") if isinstance(text, str) else text
    whole = df.select(*[F.col(f"`{c}`") for c in keep], collapsed(src.cast("string")).alias(made))
    return whole.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{made}`.{c}").alias(c) for c in out])


def largest_run(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones, null without runs."""
    return F.aggregate(
        runs,
        F.lit(None).cast(RUN),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
