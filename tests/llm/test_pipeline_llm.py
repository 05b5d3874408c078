"""The corpus pipeline, each stage against brute force on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_jaccard import brute
from test_native_ops import WORD, base, expected_targets

SF = "/root/testdata/sf0.001"
STAGE = dict(cp.STAGES)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_order_and_names():
    assert [f for _, f in cp.STAGES] == [cp.quality_rules, cp.near_duplicates, cp.decontamination, cp.source_mixing, cp.shards]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages(spark, docs):
    kept = cp.materialize(cp.quality_rules(spark, docs, SF), "t")
    ids = {r["doc_id"] for r in kept.collect()}
    for r in docs.collect():
        n, *_, repeat = base(r["text"])
        assert (r["doc_id"] in ids) == (n >= 20 and 100 * repeat <= 30 * n)  # no line is frequent enough on a host here
    assert kept.columns == docs.columns

    unique = cp.materialize(cp.near_duplicates(spark, kept, SF), "t")
    want = {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80) if i == c}
    assert {r["doc_id"] for r in unique.collect()} == want and unique.count() == len(want) and unique.columns == docs.columns

    clean = cp.materialize(cp.decontamination(spark, unique, SF), "t")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in unique.collect() if any(x in r["text"] for x in items)}
    assert {r["doc_id"] for r in clean.collect()} == want - leaked and clean.columns == docs.columns

    mixed = cp.materialize(cp.source_mixing(spark, clean, SF), "t")
    times = Counter(r["doc_id"] for r in mixed.collect())
    size, taken, largest = Counter(), Counter(), Counter()
    for r in clean.collect():
        n = len(WORD.findall(r["text"]))
        size[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], n)
        assert times[r["doc_id"]] <= 2
    for s, t in expected_targets(size).items():
        assert abs(taken[s] - t) <= largest[s]
    assert mixed.columns == docs.columns

    out = cp.shards(spark, mixed, SF).collect()
    assert sorted((r["doc_id"] for r in out)) == sorted(times.elements())
    n = Counter(r["shard"] for r in out)
    assert len(n) == 8 and max(n.values()) - min(n.values()) <= 1


def test_run(spark):
    df = cp.run(spark, SF)
    assert df.columns[-2:] == ["shard", "slot"] and df.count() > 0


def test_nulls_repeats_and_empty(spark, docs):
    odd = docs.limit(3).union(docs.limit(3)).unionByName(
        spark.createDataFrame([(None, None, None, None, None), (None, "word " * 30, "en", None, 1), (7, "", "en", "s", 0)], docs.schema)
    ).withColumn("shard", F.lit("x"))
    for df in (odd, odd.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= 2 * df.count(), name
            assert name == "sharding" or out.columns == df.columns
    kept = rows(cp.near_duplicates(spark, odd, SF).select("doc_id"))
    assert kept.count((None,)) == 2 and len(kept) == len(set(kept)) + 1


def test_near_duplicates_keep_each_text_of_an_id(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    texts = [(4, a), (4, b), (4, b), (2, [*a[:-1], "x"]), (9, [*b[:-1], "x"]), (4, c)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted((r["doc_id"], r["text"].split()[0]) for r in cp.near_duplicates(spark, docs, SF).collect())
    assert kept == [(2, "a0"), (4, "b0"), (4, "c0")]
