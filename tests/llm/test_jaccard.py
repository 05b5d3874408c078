"""Jaccard join against brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalframe.llm import jaccard
from evalframe.llm.components import components
from evalframe.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not w:
        return set()
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    index = {}
    for j, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(j)
    seen = {p for js in index.values() for p in combinations(js, 2)}
    for a, b in seen:
        (i, s), (j, t) = sets[a], sets[b]
        both = len(s & t)
        if i is not None and j is not None and 100 * both >= percent * (len(s) + len(t) - both):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clusters(seed, n=8):
    """Clusters of near copies around the threshold, chains, shared lines, short texts."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("aeiou") + r.choice("klmnopqrst")
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " \n", "One", "one", "one two", "ONE two", "a b c", "a b c d", "a b c d", "É é", "é é"]
    for _ in range(n):
        base = [word() for _ in range(r.choice([6, 15, 40, 120, 300]))]
        cur = list(base)
        for _ in range(r.randint(2, 9)):
            cur = list(base) if r.random() < 0.6 else list(cur)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                at = r.randrange(len(cur))
                cur[at:at + r.randint(0, 2)] = [word()] * r.randint(0, 2)
            texts.append(("\n" + line + "\n" if r.random() < 0.4 else "") + " ".join(cur))
    texts += [f"{line} {word()} {word()}" for _ in range(12)]
    r.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, line), (4, texts[1])]


@pytest.mark.parametrize("seed,k,percent", [(0, 4, 85), (1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_against_brute_force(spark, seed, k, percent):
    rows = clusters(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(jaccard.jaccard_components(df, k=k, percent=percent)) == brute(rows, k, percent)


@pytest.mark.parametrize("links", [False, True])
def test_large_clusters(spark, monkeypatch, links):
    """Clusters above the leaf size: measured against pivots, cut into blocks, still exact."""
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    r = random.Random(4)
    rows = []
    for c in range(2):
        base = [f"w{c}{i}" for i in range(60)]
        for i in range(40):
            t = list(base)
            for at in r.sample(range(60), r.choice([0, 1] if links else [1, 2, 3])):
                t[at] = f"x{r.randint(0, 5)}"
            rows.append((100 * c + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(jaccard.jaccard_components(df)) == brute(rows, 4, 85)


def test_empty_and_wordless(spark):
    ddl = "doc_id bigint, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], ddl)).count() == 0
    rows = [(1, None), (2, ""), (3, " ")]
    assert rows_of(jaccard.jaccard_components(spark.createDataFrame(rows, ddl))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op4_ngram_jaccard"](spark, sf)) == brute(docs, 4, 85)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=50), st.sets(st.integers(0, 60), max_size=4), st.sets(st.integers(0, 60), max_size=4), st.sampled_from([60, 80, 85, 100]))
def test_prefix_principle(a, out, new, percent):
    b = (a - out) | new
    if not b or 100 * len(a & b) < percent * len(a | b):
        return
    keys = []
    for s in (a, b):
        h = np.sort(jaccard._mix(np.array(sorted(s), dtype=np.uint64)))
        keys.append(set(np.sort(jaccard.ring_pairs(h))[: jaccard.prefix_length(len(s), percent)].tolist()))
    assert keys[0] & keys[1]


def cell_rows(sets, cells):
    """Rows of ``_cell_rows`` over the cells (x, y, left, right) of the ``sets``."""
    rows = [(x, y, i, 100 + i, i in left, i in right) for x, y, left, right in cells for i in sorted(left | right)]
    x, y, ids, labels, left, right = (list(c) for c in zip(*rows, strict=True))
    bits = [jaccard.parities(np.array(sorted(sets[i]), dtype=np.uint64)) for i in ids]
    return pa.RecordBatch.from_pydict({"_x": x, "_y": y, "_id": ids, "_label": labels, "_left": left, "_right": right, "_n": [len(sets[i]) for i in ids], "_parity": bits})


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_cells_lose_no_link(rows):
    """Cells cut over any batches give each linked pair of a left and a right row, and pairs within the bounds only."""
    r = random.Random(rows)
    sets = []
    for _ in range(8):
        base = r.sample(range(1 << 60), 80)
        sets += [set(base[r.randint(0, 8):]) | set(r.sample(range(1 << 60), r.randint(0, 8))) for _ in range(5)]
    every = set(range(len(sets)))
    cells = [(1, 1, every, every), (1, 2, set(range(20)), set(range(20, 40))), (2, 2, {3}, {3})]
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    for some in (cells, cells[:1], cells[1:]):
        batch = cell_rows(sets, some)
        found = set()
        for out in jaccard._cell_rows(85)(iter([batch.slice(at, rows) for at in range(0, batch.num_rows, rows)])):
            found |= set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
        wanted = {(max(i, j), min(i, j)) for _, _, left, right in some for i in left for j in right if i != j and linked(i, j)}
        assert wanted <= found and all(a > b for a, b in found)
        assert len(found) <= len(wanted) + 60
    assert len({(i, j) for i in every for j in range(i) if linked(i, j)}) > 10


@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.text(alphabet="aAbé \t\n\x0b\x85ß", max_size=40), st.integers(1, 5))
def test_shingle_counts(text, k):
    assert len(jaccard.Shingler(k).shingles(text.encode())) == len(shingles(text, k))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(500, 500)]
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_leaf_of_two_stars(spark):
    """After one round of the path 1-10-5-20-2 no centre is a leaf, but 5 still has two centres."""
    got = sorted(tuple(x) for x in components(spark.createDataFrame([(10, 5), (10, 1), (20, 5), (20, 2)], "a bigint, b bigint")).collect())
    assert got == [(1, 1), (2, 1), (5, 1), (10, 1), (20, 1)]
    r, edges, expected = random.Random(7), [], {}
    for tree in range(60):
        nodes = [100 * tree + x for x in r.sample(range(100), 8)]
        edges += [(nodes[i], nodes[r.randrange(i)]) for i in range(1, 8)]
        expected |= dict.fromkeys(nodes, min(nodes))
    for first in range(0, 6000, 2000):  # few trees at a time, so that others do not keep the rounds going
        some = [e for e in edges if first <= e[0] < first + 2000]
        rows = components(spark.createDataFrame(some, "a bigint, b bigint")).collect()
        assert sorted(tuple(x) for x in rows) == sorted(x for x in expected.items() if first <= x[0] < first + 2000)


@pytest.mark.parametrize("leaf", [2, 512])
def test_path_whose_middle_has_two_stars(spark, monkeypatch, leaf):
    """Texts that link only along 1-10-5-20-2."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    words = [f"w{i}" for i in range(84)]
    rows = [(i, " ".join(words[4 * at : 4 * at + 64])) for at, i in enumerate((1, 10, 5, 20, 2))]
    got = rows_of(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute(rows, 4, 85) and {c for _, _, c in got} == {1}


@pytest.mark.parametrize("leaf", [2, 512])
def test_one_id_with_two_texts(spark, monkeypatch, leaf):
    """Each text of an id is compared; a row has the component of its own text."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    a, b, c = ([f"{x}{i}" for i in range(64)] for x in "abc")
    rows = [(4, a), (4, b), (4, b), (2, [*a[:-1], "x"]), (9, [*b[:-1], "x"]), (12, [*b[:-1], "y"]), (4, c), (4, []), (1, [*c[:-1], "x"]), (7, b[::-1])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string").repartition(3)
    assert rows_of(jaccard.jaccard_components(df)) == sorted([(4, 61, 2), (4, 61, 4), (4, 61, 4), (2, 61, 2), (9, 61, 4), (12, 61, 4), (4, 61, 1), (4, 0, 4), (1, 61, 1), (7, 61, 7)], key=repr)
