"""Periodic runs against every lag of every text, splitting against its definition, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from evalframe.llm import periodic
from evalframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_runs(w):
    """Every maximal stretch of every lag; of equal stretches the least lag."""
    best = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    w = words_of(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def some_words(r):
    """Words with runs of all periods: nested, overlapping, broken by a word, next to each other."""
    w = []
    for _ in range(r.randint(1, 5)):
        unit = [r.randint(0, r.choice((1, 3, 50))) for _ in range(r.randint(1, 14))]
        w += (unit * r.randint(1, 14))[: r.randint(1, 120)]
        if r.random() < 0.5:
            w += [r.randint(0, 60) for _ in range(r.randint(0, 9))]
    return w * r.choice((1, 1, 1, 3))


def test_runs_against_every_lag():
    r = random.Random(5)
    seen = 0
    for _ in range(1500):
        w = some_words(r)
        want = slow_runs(w)
        seen += len(want)
        assert periodic.runs_of(np.array(w)) == want
    assert seen > 2000


def test_segments_are_stable_and_lose_no_run():
    r = random.Random(6)
    for _ in range(300):
        w = some_words(r)
        parts = list(periodic.segments(np.array(w)))
        for a, b in parts:
            assert b - a >= periodic.MIN_WORDS and min(Counter(w[a:b]).values()) >= periodic.MIN_TIMES
        for s, n, _ in slow_runs(w):
            assert any(a <= s and s + n <= b for a, b in parts)


def test_splitting_goes_on_while_pieces_peel_off():
    """Each split makes one more word rare: the recursion is as deep as the text, its cost isn't."""
    w = np.concatenate([[k + 1, k, k] for k in range(20_000)])  # cutting out word k leaves word k + 1 only twice on the right
    assert list(periodic.segments(w)) == []


def test_long_texts():
    r = random.Random(8)
    unit = [r.randint(0, 400) for _ in range(100_000)]
    w = np.array(unit * 3 + unit[:7])
    assert periodic.runs_of(w) == [(0, 300_007, 100_000)]
    assert periodic.runs_of(np.zeros(1_000_000, dtype=np.int64)) == [(0, 1_000_000, 1)]


def test_query(spark):
    rows = QUERIES["op11_periodic_runs"](spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r)[:8] for r in rows) == sorted(slow_row(*d) for d in docs)
    assert sum(r["n_runs"] for r in rows) > 10


def test_edge_cases(spark):
    ab = "a b " * 20
    texts = [None, "", " \t\n\x0b\x0c\r ", "x", "x " * 23, "x " * 24, "  " * 30, ab, ab, "a\x1cb " * 24, ab + "c " + ab, "x\n" * 5_000_000]
    df = spark.createDataFrame([(i, t, i, "kept") for i, t in enumerate(texts)], "made int, text string, _made int, runs string")
    got = {r["made"]: r for r in periodic.collapse_runs(df).collect()}
    assert list(got[0].asDict()) == ["made", "text", "_made", "n_words", "runs", "collapsed"] and len(got) == len(texts)
    for i, t in enumerate(texts[:-1]):
        w = words_of(t)
        assert got[i]["text"] == t and got[i]["_made"] == i and got[i]["n_words"] == len(w)
        assert [tuple(x) for x in got[i]["runs"]] == slow_runs(w)
    assert [len(got[i]["runs"]) for i in range(11)] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 2]
    assert got[0]["collapsed"] == "" and got[5]["collapsed"] == "x" and got[7]["collapsed"] == "a b" and got[10]["collapsed"] == "a b c a b"
    assert got[11]["collapsed"] == "x" and got[11]["n_words"] == 5_000_000
    assert periodic.collapse_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("row", [(0, 0), (1, 10)])
def test_planted_edges(spark, tmp_path, row):
    """Documents without id, text or words, and each id rule, through the query."""
    rows = [(None, "a b c"), (5, None), (6, ""), *[(row[0] + i, " ".join(f"w{(i * 7 + k) % (3 + i)}" for k in range(i))) for i in range(row[1], row[1] + 120)]]
    spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:8] for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((slow_row(*r) for r in rows + rows[:5]), key=str)
