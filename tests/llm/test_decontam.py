"""Benchmark decontamination: retrieval and alignment against brute force."""

import random
from functools import lru_cache

import numpy as np
import pytest

from evalframe.llm import decontam
from evalframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_lcs(a, b):
    @lru_cache(None)
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return f(i + 1, j + 1) + 1 if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        assert decontam.lcs(a, b) == slow_lcs(tuple(a), tuple(b))


def brute(docs, items):
    """Every window of an item's length and twice STEP around it, without retrieval."""
    out = set()
    for d, t in docs:
        w = decontam.words_of(t)
        for i, item in items:
            x = decontam.words_of(item)
            if x and len(set(x) & set(w)) * 2 >= len(set(x)):
                n = len(x) + 4 * decontam.STEP
                if any(decontam.is_leak(x, w[a:a + n])[0] for a in range(0, max(1, len(w) - n + decontam.STEP), decontam.STEP)):
                    out.add((d, i))
    return out


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    want = brute(docs, items)
    assert want and got <= want and len(got) >= 0.95 * len(want)
    whole = {(d, i) for d, t in docs for i, x in items if x in (t or "")}
    assert whole <= got


def test_paraphrases_and_short_quotes(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))
    common = [word() for _ in range(30)]
    prose = lambda n: [r.choice(common) if r.random() < 0.4 else word() for _ in range(n)]
    items = [(i, prose(r.randint(12, 60))) for i in range(30)] + [(98, []), (99, None)]
    docs, leaks = [], set()
    for i, x in items[:30]:
        near = [w if r.random() > 0.1 else word() for w in x]
        for k, inner in enumerate((x, near, [w.upper() + "," for w in x], x[:6])):
            docs.append((10 * i + k, " ".join(prose(r.randint(0, 200)) + inner + prose(r.randint(0, 200)))))
            if k < 3:
                leaks.add((10 * i + k, i))
    docs += [(None, " ".join(items[0][1])), (1000, None), (1001, ""), (1002, " ".join(prose(5000)))] + docs[:1]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(x) if x is not None else None) for i, x in items], "item_id bigint, text string")
    rows = decontam.find_leaks(d, b).collect()
    got = {(x["doc_id"], x["item_id"]) for x in rows}
    assert {g for g in got if g[0] is not None and g[0] % 10 == 3} == set()
    assert {g for g in leaks if g[0] % 10 != 1} <= got and len(leaks & got) >= 0.9 * len(leaks)
    assert (None, 0) in got and len([x for x in rows if x["doc_id"] == 0]) == 2
    assert got <= leaks | {(None, 0)}


@pytest.mark.parametrize("leak_first", [False, True])
def test_slices_with_and_without_leaks(spark, leak_first):
    """A slice of one task without any leak before or after a slice that holds one."""
    leak = (1, "one two three four five six seven eight nine ten eleven twelve")
    clean = [(10 + i, f"clean words number {i}") for i in range(decontam.DOCUMENTS + 5)]
    docs = [leak, *clean] if leak_first else [*clean, leak]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    b = spark.createDataFrame([(7, leak[1])], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(d, b).collect()] == [(1, 7)]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find_leaks(d, b).count() == 0
    assert decontam.find_leaks(d.limit(0), spark.createDataFrame([(1, "some words")], "item_id bigint, text string")).count() == 0


def test_basis_finds_leading_subspace(spark, monkeypatch):
    monkeypatch.setattr(decontam, "RANK", 4)
    monkeypatch.setattr(decontam, "EXTRA", 8)
    r = random.Random(8)
    topics = [[f"t{k}w{j}" for j in range(6)] for k in range(4)]
    texts = [" ".join(r.choice(topics[i % 4]) for _ in range(20)) for i in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "_text string")
    idf = np.ones(decontam.FEATURES)
    basis = decontam.fit_basis(df, texts[:1], idf, 20)
    import pyarrow as pa

    row, slot, value = decontam._passages(pa.array(texts), 20, idf)
    a = np.zeros((80, decontam.FEATURES))
    a[row, slot] = value
    a = np.vstack([a, a[:1]])
    want = np.linalg.svd(a, full_matrices=False)[2][:4]
    got = basis / np.linalg.norm(basis, axis=0)
    assert np.linalg.svd(want @ got)[1].min() > 0.99


@pytest.mark.parametrize("text", [None, "", "...", "One, TWO; three"])
def test_words(text):
    assert decontam.words_of(text) == ([] if not text or text == "..." else ["one", "two", "three"])


def test_basis_is_fitted_on_every_document(spark, monkeypatch):
    """The whole table goes into the basis, not a sample of it."""
    n, seen, fit = 9_000, [], decontam.fit_basis

    def spy(texts, *args, **options):
        seen.append(texts.count())
        return fit(texts, *args, **options)

    monkeypatch.setattr(decontam, "fit_basis", spy)
    d = spark.range(n, numPartitions=2).selectExpr("id AS doc_id", "concat('some words of document number ', id) AS text")
    b = spark.createDataFrame([(7, "some words of document number 77")], "item_id bigint, text string")
    assert 77 in {r["doc_id"] for r in decontam.find_leaks(d, b).collect()}
    assert seen == [n]


def test_passage_products(spark):
    """A'A of all passages: repeated words, short and empty texts, several partitions."""
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghijkl") * r.randint(1, 3) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["same " * 17, None, "", "x"]
    idf = 1 + np.random.default_rng(2).random(decontam.FEATURES)
    df = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3)
    got = decontam.passage_products(decontam.word_slots(df), idf, 7, len(texts))
    import pyarrow as pa

    row, slot, value = decontam._passages(pa.array(texts), 7, idf)
    a = np.zeros((row.max() + 1, decontam.FEATURES))
    a[row, slot] = value
    assert np.abs(got - a.T @ a).max() < 1e-4
