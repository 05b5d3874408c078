"""Language identification: held-out accuracy, the value of each kind of evidence, edge cases."""

import re

from pyspark.sql import functions as F

from evalframe.llm import langid
from evalframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_text_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_text(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 and length(text) > 60").select("text", "lang").collect()
    right = [model.languages[int(model.scores(r["text"]).argmax())] == r["lang"] for r in rest]
    assert sum(right) >= 0.97 * len(right)


def test_pages(spark):
    rows = QUERIES["op7_language"](spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    declared = {i: re.search(r'<html lang="(\w+)"', h).group(1) for i, h in pages.items()}
    assert sum(r["language"] == declared[r["page_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(0.25 <= r["confidence"] <= 1.0 for r in rows)


def test_evidence_decides_where_text_is_silent(spark):
    docs = spark.createDataFrame([("the house and the garden of this man", "en"), ("das haus und der garten von diesem mann", "de")] * 20, "text string, lang string")
    model = langid.fit_text(docs)
    en, de = "the garden and the man of this house " * 5, "der garten und das haus von diesem mann " * 5
    rows = [(i, f"http://www.a{i % 3}.example.de/x", f'<html lang="de"><p>{de}</p>') for i in range(30)]
    rows += [(100 + i, f"http://b{i % 3}.example.com/x", f'<html lang="en"><p>{en}</p>') for i in range(40)]
    rows += [(200, "http://www.a1.example.de/y", "<html><p>123</p>"), (201, "http://b1.example.com/y", None), (202, None, '<html lang="de">'), (203, "no url", ""), (203, "no url", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("language", F.lit("?"))
    got = {r["page_id"]: r["language"] for r in langid.identify(df, model).collect()}
    assert got[200] == "de" and got[201] == "en" and got[202] == "de" and got[203] == "en"
    assert all(got[i] == "de" for i in range(30)) and langid.identify(df, model).count() == len(rows)
    assert langid.identify(df.limit(0), model).count() == 0
    nothing = langid.fit_text(docs.limit(0))
    assert langid.identify(df, nothing).where("language is null").count() == len(rows)
