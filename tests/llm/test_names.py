"""Caller columns with the operators' internal names: same rows, values untouched."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalframe.llm import langid, mixing, quality, repeats, sharding

TAKEN = ("_key", "_src", "_source", "_host", "_text", "_page", "_url", "_hash", "_row", "_copies", "_n", "_rank", "_range", "_times", "_pass", "_a", "_b", "_size", "_KEY2")


def with_taken(df):
    return df.select(F.lit("mine").alias(TAKEN[0]), "*", *[F.lit("mine").alias(c) for c in TAKEN[1:]])


@pytest.fixture
def rows(docs):
    long = "the same long passage of this text that stands in two documents of the table " * 5
    return docs([(i, f"{long if i < 2 else ''} document {i} has words\nof its own {i * 7}", f"s{i % 3}") for i in range(12)] + [(20, None, None)])


@pytest.mark.parametrize("operator", [lambda d: sharding.shard(d, 3), mixing.mix, quality.judge, quality.without_frequent_lines, repeats.cut_repeats])
def test_operators(rows, operator):
    got = operator(with_taken(rows))
    plain = operator(rows)
    assert got.columns == [TAKEN[0], *rows.columns, *TAKEN[1:], *[c for c in plain.columns if c not in rows.columns]]
    assert got.where(" and ".join(f"{c} = 'mine'" for c in TAKEN)).count() == rows.count()
    seeded = {"shard", "slot", "taken"}  # by a hash of the whole row
    same = [c for c in plain.columns if c not in seeded]
    assert sorted(map(repr, got.select(same).collect())) == sorted(map(repr, plain.select(same).collect()))


def test_argument_that_names_such_a_column(rows):
    named = rows.withColumnsRenamed({"source": "_host", "text": "_text"})
    got = quality.judge(named, host="_host", text="_text").withColumnsRenamed({"_host": "source", "_text": "text"})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, quality.judge(rows).collect()))


def test_language(spark):
    model = langid.fit_text(spark.createDataFrame([("the house of this man", "en"), ("das haus von diesem mann", "de")] * 20, "text string, lang string"))
    pages = spark.createDataFrame([(i, f"http://a{i}.de", f"<p>das haus {i}</p>") for i in range(3)], "page_id int, url string, html string")
    plain, got = langid.identify(pages, model), langid.identify(with_taken(pages), model)
    assert got.count() == 3 and sorted(got.select(plain.columns).collect()) == sorted(plain.collect())


def test_stages_keep_other_columns(spark, rows):
    extra = rows.select("*", *[F.lit("mine").alias(c) for c in ("_key", "_text", "_times", "_pass", "size", "target", "kept", "n_words", "caller0")])
    for name, stage in corpus_pipeline.STAGES:
        got, plain = stage(spark, extra, "/root/testdata/sf0.001"), stage(spark, rows, "/root/testdata/sf0.001")
        assert got.columns[: len(extra.columns)] == extra.columns, name
        assert got.where("_key = 'mine' and _times = 'mine' and size = 'mine' and kept = 'mine' and caller0 = 'mine'").count() == got.count(), name
        if name != "source_mixing":
            assert got.count() == plain.count(), name
