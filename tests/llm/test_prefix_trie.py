"""The prefix trie against every prefix of every conversation, its search and cuts, edge cases."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalframe.llm import prefix_trie
from evalframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def slow_trie(convs):
    """{prefix: measures} of conversations {id: [(role, text), ...]}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        turns = convs[c]
        for d in range(len(turns) + 1):
            p = tuple(turns[:d])
            members[p].append(c)
            if d:
                kids[p[:-1]].add(p)
        ends[tuple(turns)].append(c)

    out = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(out[k]["n_leaves"] for k in kids[p]) if kids[p] else 1
        own = (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0
        out[p] = {
            "conv_id": members[p][0], "depth": len(p), "parent_conv_id": members[p[:-1]][0] if p else None, "n_convs": len(members[p]),
            "n_children": len(kids[p]), "n_leaves": leaves, "saved_tokens": own + sum(out[k]["saved_tokens"] for k in kids[p]),
            "ends_sha256": hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest(),
        }
    return out


def frames(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, pos int, role string, text string"), spark.createDataFrame([(c,) for c in convs], "conv_id bigint")


def same(spark, convs):
    got = [r.asDict() for r in prefix_trie.conversation_trie(*frames(spark, convs)).drop("node", "parent").collect()]
    key = lambda r: tuple(str(r[c]) for c in sorted(r))
    assert sorted(got, key=key) == sorted(slow_trie(convs).values(), key=key)


def test_against_every_prefix(spark):
    r = random.Random(4)
    convs = {}
    for c in range(150):
        start = convs[r.choice(list(convs))] if convs and r.random() < 0.7 else []
        keep = start[: r.randint(0, len(start))]
        convs[c * 3 + 1] = keep + [(r.choice("ua"), r.choice(["a", "a b", "b", "", "c d e"])) for _ in range(r.randint(0, 5))]
    long = [("u", f"w{i % 7} x") for i in range(230)]
    convs |= {9000: long, 9001: long, 9002: long[:100], 9003: long[:129] + [("a", "z")], 9004: long[:128], 9005: long + [("u", "more")]}
    same(spark, convs)


def test_long_path_left_at_every_depth(spark):
    """A path that a conversation leaves at every turn: deep trie, few batches."""
    path = [("u", f"t{i}") for i in range(40)]
    same(spark, {i: path[:i] + [("a", f"leaves at {i}")] for i in range(40)} | {100: path, 101: path[:20]})


def test_many_copies(spark):
    same(spark, {i: [("u", "same"), ("a", "answer here")] for i in range(9000)} | {20_000: [("u", "same")], 20_001: []})


def test_two_fattest(spark):
    rows = [(a, b) for a in range(40) for b in range(a + 1, 70)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(x["f"] == max(range(x["a"] + 1, x["b"] + 1), key=lambda f: f & -f) for x in got)


def test_ordered_turns(spark):
    rows = [(1, 5, "a", "later"), (1, None, None, "first"), (1, 5, "A", "tie"), (1, 7, "u", None), (1, 7, "u", None), (None, 1, "u", "no conversation"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit("x")).withColumn("_turn", F.lit(1))
    got = [tuple(r) for r in prefix_trie.ordered_turns(df).orderBy("conv_id", "pos").collect()]
    assert got == [(1, 0, "", "first"), (1, 1, "A", "tie"), (1, 2, "a", "later"), (1, 3, "u", ""), (1, 4, "u", ""), (2, 0, "", "")]


def test_no_conversations_and_no_turns(spark):
    turns, convs = frames(spark, {1: [("u", "x")]})
    assert prefix_trie.conversation_trie(turns.limit(0), convs.limit(0)).count() == 0
    rows = prefix_trie.conversation_trie(turns.limit(0), spark.createDataFrame([(3,), (2,), (2,), (None,)], "conv_id bigint")).collect()
    assert [(r["depth"], r["conv_id"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in rows] == [(0, 2, 2, 1, 0)]
    assert rows[0]["ends_sha256"] == hashlib.sha256(b"2,3").hexdigest()


@pytest.mark.parametrize("size", ["given", "made"])
def test_query_matches_sql(spark, tmp_path, size):
    import duckdb

    path = SF
    if size == "made":
        r = random.Random(2)
        rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a b", "a  b", "", None, "c\td", "Zäh"])) for c in range(0, 90) if c % 20 != 0 or c % 40 for t in range(r.randint(1, 6))]
        path = str(tmp_path)
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    glob = f"{path}/conversations.parquet" + ("/*.parquet" if size == "made" else "")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{glob}'")
    got = QUERIES["op12_prefix_trie"](spark, path)
    want = con.execute(ORACLES["op12_prefix_trie"])
    names = [d[0] for d in want.description]
    assert set(names) == set(got.columns)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
