"""Quality rules, sharding and mixing against brute force, with their edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalframe.llm import mixing, quality, sharding
from evalframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one two three", None), (5, "one two three", None),
    (5, "one two three", None), (6, "w " * 5000, "b"), (7, " ".join(f"x{i}" for i in range(3000)), "b"),
    (8, "a b c d e f g h\n" * 4, "a"), (None, "null id " * 12, "a"), (9, "é*$ ü|<b>\r\nline two\r\n", ""),
]


def base(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def check_base(rows):
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == base(r["text"]), r["doc_id"]
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r["base_failed"] and r["kept"])


def test_base_counts(spark, docs):
    check_base(quality.judge(docs(EDGE)).collect())
    check_base(quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect())


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub(r"\d+", "0", line.lower())).strip(" ")


def test_line_rule(docs):
    body = "plain words of text number {} and some more of them to have twenty words or so in this very document number {} here"
    rows = [(i, body.format(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}", i) + "\nShared  footer LINE 12", "h1") for i in range(60)]
    rows += [(100 + i, f"Shared footer line {i}\n" * 3 + "tail", "h1") for i in range(3)]
    rows += [(200 + i, "the same text in many copies is one document and stays because copies count once for each of its lines ok", "h1") for i in range(80)]
    rows += [(300, "shared footer line 1 but on another host where it is rare so that all of it stays in this one place fine yes", "h2")]
    by = {r["doc_id"]: r for r in quality.judge(docs(rows)).collect()}
    texts = {(s, t) for _, t, s in rows}
    per = defaultdict(set)
    for s, t in texts:
        for x in t.split("\n"):
            if x.strip():
                per[s, norm(x)].add(t)
    n_texts = Counter(s for s, _ in texts)
    for i, t, s in rows:
        lost = sum(len(x.split()) for x in t.split("\n") if x.strip() and len(per[s, norm(x)]) >= 20 and 100 * len(per[s, norm(x)]) > 10 * n_texts[s])
        assert by[i]["n_boiler_words"] == lost, i
        n = len(t.split())
        assert by[i]["kept"] == (not by[i]["base_failed"] and 100 * (n - lost) >= 20 * n)
    assert by[0]["n_boiler_words"] == 4 and by[0]["kept"] and by[200]["kept"] and by[300]["n_boiler_words"] == 0
    cut = {r["doc_id"]: r["text"] for r in quality.without_frequent_lines(docs(rows)).collect()}
    assert cut[0] == rows[0][1].split("\n")[0] and cut[200] == rows[63][1] and cut[300] == rows[-1][1]


def test_depleted_document_goes(docs):
    long = "sold by the yard in every shop of this town and in no other place of the land until the end of days or later"
    rows = [(i, f"{long}\nunique {chr(97 + i % 26)}{chr(97 + i // 26)} tail", "h") for i in range(40)]
    assert all(not r["kept"] and not r["base_failed"] for r in quality.judge(docs(rows)).collect())


def test_sharding(spark, docs):
    big = spark.read.parquet(f"{SF}/documents.parquet")
    for df, n in ((big, 8), (docs(EDGE), 3), (docs(EDGE[:1]), 4)):
        rows = sharding.shard(df.withColumn("slot", F.lit("x")), n).collect()
        assert len(rows) == df.count() and rows[0].__fields__[:5] == df.columns
        sizes = Counter(r["shard"] for r in rows)
        assert max(sizes.values()) - min([sizes.get(i, 0) for i in range(n)]) <= 1
        for s, m in sizes.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(m))
        assert sorted(map(repr, rows)) == sorted(map(repr, sharding.shard(df.repartition(3).withColumn("slot", F.lit("x")), n).collect()))
    rows = sharding.shard(spark.range(4000).select("id", F.when(F.col("id") < 3000, "a").when(F.col("id") < 3900, "b").alias("source")), 8).collect()
    for k in range(8):
        mix = Counter(r["source"] for r in rows if r["shard"] == k)
        assert abs(mix["a"] - 375) <= 3 and abs(mix["b"] - 112.5) <= 3 and abs(mix[None] - 12.5) <= 3
    assert sharding.shard(docs([]), 8).count() == 0


def test_op2_digest(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op2_sharding"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        b = (r["text"] or "").encode()
        assert rows[r["doc_id"]]["size"] == len(b) + 1 and rows[r["doc_id"]]["text_crc32"] == zlib.crc32(b)


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        per = left / sum(w[s] for s in free)
        over = [s for s in free if per * w[s] > 2 * sizes[s]]
        if not over:
            out |= {s: per * w[s] for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(spark, docs):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), docs(EDGE)):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes, taken = Counter(), Counter()
        for r in rows:
            assert r["size"] == len(WORD.findall(r["text"] or ""))
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
        want = expected_targets(sizes)
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(r["size"] for r in rows if r["source"] == s)
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(docs([])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs([(1, None, None), (2, " ", "z")])).collect()] == [0, 0]


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 400))
def test_knapsack(hist, budget):
    lengths, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    take = mixing.fit_lengths(lengths, counts, budget)
    assert (0 <= take).all() and (take <= counts).all()
    got, total = int((take * lengths).sum()), int((lengths * counts).sum())
    assert got <= max(budget, 0) or budget >= total
    if budget < total:
        # never a larger gap than one that greedy filling in any order could leave
        assert budget - got < max(lengths) or got == total


def test_knapsack_closes_a_large_gap():
    lengths, counts = np.array([1, 7, 100_003, 400_009]), np.array([3, 10**6, 11, 9])
    take = mixing.fit_lengths(lengths, counts, 5_000_000)
    assert 0 <= 5_000_000 - int((take * lengths).sum()) < 7


@pytest.mark.parametrize("name", ["op2_sharding", "op5_quality_rules"])
def test_native_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)
