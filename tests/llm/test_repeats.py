"""Repeated windows against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from evalframe.llm import repeats
from evalframe.llm.queries import QUERIES

W = 200


def brute(texts, width=W):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i:i + width]) for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[hash(b[i:i + width])] > 1:
                gone[i:i + width] = b"\x01" * width
        spans = [p for p in bytes(gone).split(b"\x00") if p]
        out.append((len(b), sum(gone), len(spans), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def compare(rows, texts, width=W):
    want = brute(texts, width)
    got = {r["i"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows}
    assert len(got) == len(rows) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, i


def fixture(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, page, base = prose(50), prose(200), prose(150)
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, "ab" * 150, passage, prose(5)]
    texts += [prose(r.randint(5, 80)) + passage + prose(r.randint(0, 80)) for _ in range(12)] + [page] * 3
    for _ in range(8):  # near copies with single bytes changed
        b = list(base)
        for _ in range(r.randint(1, 4)):
            b[r.randrange(len(b))] = "#"
        texts.append("".join(b))
    texts += [base[: r.randint(100, len(base))] for _ in range(6)] + [base[r.randint(0, 300):] + "tail" for _ in range(6)]
    texts += [prose(300) + "\n" + (passage + "\n") * 3, passage[:199], passage[:200], passage[-205:]]
    texts += [("é" * 100) + str(i) for i in range(3)]
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    texts = fixture(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(5)
    compare(repeats.cut_repeats(df).collect(), texts)


def test_other_width_and_kept_bytes(spark):
    texts = fixture(9)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "i int, text string, n_bytes int, _x string").drop("_x")
    rows = repeats.cut_repeats(df, width=90, with_text=True).collect()
    compare(rows, texts, 90)
    for r in rows:
        assert hashlib.sha256(bytes(r["kept_bytes"])).hexdigest() == r["kept_sha256"]


def test_long_texts_in_blocks():
    r = random.Random(5)
    text = bytes(r.choice(b"abcdef") for _ in range(7000))
    import numpy as np

    big = repeats._Anchors(W, repeats.GRAM, 8000)
    whole = big.runs(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
    assert whole[0][0] == 0 and whole[1][-1] == len(text) - W and (whole[0][1:] == whole[1][:-1] + 1).all()
    old, repeats.BLOCK = repeats.BLOCK, 1500
    try:
        covered = []
        for a, b, rows in repeats._blocks(np.array([0, 300, 7000, 7100]), W):
            assert b - a <= 1500 or rows != [1]
            if rows == [1]:
                first, last, _, _ = big.runs(np.frombuffer(text, np.uint8)[a:b], np.array([0]), np.array([b - a]))
                covered += range(a + first[0], a + last[-1] + 1)
        assert covered == list(range(300, 7000 - W + 1))
    finally:
        repeats.BLOCK = old


def test_empty_table(spark):
    assert repeats.cut_repeats(spark.createDataFrame([], "i int, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, brute([r["text"] for r in docs]))}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op6_repeated_windows"](spark, sf).collect()}
    assert got == want


def test_last_step_reads_only_what_is_repeated(spark):
    """Runs, bands and windows are settled and written before texts are cut, so their files aren't held together."""
    texts = fixture(3)
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    cut = repeats.cut_repeats(df)
    compare(cut.collect(), texts)
    read = {f.rsplit("/", 2)[1].rsplit("-", 1)[0] for f in cut.inputFiles()}
    assert {"pairs", "bits"} <= read and not read & {"spans", "members", "bands", "classes", "windows"}
