"""Line dedup against brute force over all pairs of lines."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalframe.llm import lines
from evalframe.llm.common import SHUFFLE_CLEANUP, written
from evalframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def within_one(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < lines.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def brute(rows):
    """(id, lines with a word, removed, text) of rows of distinct (id, text)."""
    seen, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out.append((i, 0, 0, None))
            continue
        keep, n, gone = [], 0, 0
        for x in t.split("\n"):
            w = WORD.findall(x.lower())
            if w:
                n += 1
                if any(within_one(w, v) for v in seen):
                    gone += 1
                else:
                    keep.append(x)
                seen.append(w)
            else:
                keep.append(x)
        out.append((i, n, gone, "\n".join(keep)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = [[r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.choice([1, 3, 7, 8, 9, 15, 40]))] for _ in range(8)]
    rows = [(1, None), (2, ""), (3, " \n\n"), (None, "a line of no document id that has nine words\nA B")]
    for i in range(40):
        made = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(w) + 1)
                w[at:at + r.randint(0, 1)] = [r.choice("xyz")] * r.randint(0, 1)
            made.append(r.choice([" ", "  "]).join(w).replace("a", r.choice("aA")) + r.choice(["", " ", "\r"]))
        rows.append((100 - i, "\n".join(made)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(lines.dedup_lines(df)) == brute(rows)


def test_template_line_in_many_documents(spark):
    rows = [(i, f"this page was last edited by the user number {i} of this site\nbody {i}") for i in range(300)]
    got = result(lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute(rows) and sum(r[2] for r in got) == 299


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x y", 5, "q"), (1, "x y", 5, "q"), (2, "X  y", 6, "q")], "doc_id bigint, text string, n_lines int, lines string")
    for c in ("_a", "_b", "_c", "_d", "_all", "_cut", "_line", "_first", "_raw", "_w", "_stays"):
        df = df.withColumn(c, F.lit(7))
    rows = sorted(lines.dedup_lines(df).collect(), key=repr)
    assert [(r["doc_id"], r["n_removed"], r["text"], r["lines"]) for r in rows] == [(1, 0, "x y", "q"), (1, 0, "x y", "q"), (2, 1, "", "q")]
    assert [r["n_lines"] for r in rows] == [1, 1, 1] and {r["_a"] for r in rows} | {r["_cut"] for r in rows} == {7}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_hot_line_and_long_line(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(i, f"all of these pages carry one and the same line\nbody text {i} of its own " + "x" * (i % 7)) for i in range(900)]
    rows += [(1000, long), (1001, long.replace("w30000 ", "")), (1002, long.replace("w30000 ", "").replace("w7 ", ""))]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(v for k, v in got.items() if k < 1000) == 899 and [got[k] for k in (1000, 1001, 1002)] == [0, 1, 1]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = QUERIES["op1_line_dedup"](spark, sf)
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", df._jdf.queryExecution().executedPlan().toString())
    assert result(df) == brute(rows)


def one_character(a, b):
    """One edit over the words joined by single spaces."""
    s, t = sorted((a, b), key=len)
    if len(s) == len(t):
        return sum(x != y for x, y in zip(s, t)) <= 1
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def brute_characters(rows):
    """{id: text} by all pairs: one word from 8 words on; one character from 8 characters, or one space."""
    seen, out = [], {}
    for i, t in sorted(rows):
        keep = []
        for x in t.split("\n"):
            w = WORD.findall(x.lower())
            a = " ".join(w)

            def near(v):
                b = " ".join(v)
                few = max(len(w), len(v)) <= 8 and min(len(a), len(b)) >= 8
                space = min(len(w), len(v)) >= 8 and a.replace(" ", "") == b.replace(" ", "")
                return within_one(w, v) or (few or space) and one_character(a, b)

            if not any(near(v) for v in seen):
                keep.append(x)
            seen.append(w)
        out[i] = "\n".join(keep)
    return out


def test_lines_one_character_apart(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [
        (1, f"Contact our office\nla.\nall rights are reserved by us now\n{long}"),
        (2, "Contact  our offices\nde.\nall rights are reserved by usnow"),  # a character more; short words stay; a space less
        (3, f"Contact ourx office\nall rights are reserved by u s now\n{long.replace('two three', 'twothree')}"),
        (4, f"contactxour office\n{long.replace('eight', 'ei ght')}\ncontakt our ofice"),
    ]
    r = random.Random(5)
    base = [" ".join(r.choice(["ab", "cde", "é𝄞f", "ghijk"]) for _ in range(n)) for n in (2, 3, 5, 7, 8, 9, 9, 12)]
    for i in range(5, 40):
        made = []
        for _ in range(3):
            x = r.choice(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(1, len(x) - 1)
                x = x[:at] + r.choice(["", " ", "q", x[at]]) + x[at + r.randint(0, 1):]
            made.append(x)
        rows.append((i, "\n".join(made)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(df, characters=True).collect()}
    assert got == brute_characters(rows)
    assert got[2] == "de." and got[3] == "" and got[4] == "contakt our ofice"


def test_variants_meet_lines_once(spark, monkeypatch):
    """Lines one word longer and one word shorter come from one written join, which the last step only reads."""
    plans, keep = {}, lines.written

    def spy(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(lines, "written", spy)
    base = "one two three four five six seven eight nine ten"
    rows = [(1, base), (2, base + " eleven"), (3, "a b c d e f g h i j k"), (4, "a b c d e f g h i j"), (5, base.replace("four five", "fourfive"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(df, characters=True).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}
    assert len(plans["hits"]) == 2 and "isnotnull(_joined" in plans["hits"][0]
    assert "isnotnull(_joined" not in plans["near"][0]


def test_written_leaves_no_shuffle_files(spark):
    """The shuffle files of a write go when it ends; the session's own setting stays as it was."""
    roots = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for root in roots for f in Path(root).rglob("shuffle_*")}
    old, set_before = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    df = spark.range(5_000, numPartitions=3).groupBy((F.col("id") % 1000).alias("k")).count()
    again = written(df, "counts")
    for _ in range(100):
        if not (left := files() - old):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == set_before
    assert again.count() == df.count() == 1000
