"""Token packing: exact round trip, capacity search against a scan, edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest

from evalframe.llm import packing
from evalframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def unpack(rows, size):
    pieces = defaultdict(list)
    for r in rows:
        ids, cu = np.frombuffer(bytes(r["ids"]), dtype="<i4"), r["cu_seqlens"]
        assert len(ids) == size and cu[0] == 0 and cu[-1] == r["n_tokens"] <= size
        assert len(cu) - 1 == len(r["starts"]) == len(r["doc_ids"]) and (ids[cu[-1]:] == packing.PAD).all()
        for a, b, s, d in zip(cu, cu[1:], r["starts"], r["doc_ids"]):
            assert b > a
            pieces[d].append((s, ids[a:b].tolist()))
    return pieces


def check(rows, docs, size):
    encode = packing.encoder(packing.TOKENIZER)
    pieces = unpack(rows, size)
    assert set(pieces) == {d for d, _ in docs}
    for d, t in docs:
        ids = [x for _, part in sorted(pieces[d]) for x in part]
        assert sum(len(p) for s, p in pieces[d]) == len(ids) and ids[-1] == packing.EOS
        assert encode.decode_bytes(ids[:-1]) == (t or "").encode()
        at = 0
        for s, p in sorted(pieces[d]):
            assert s == at
            at += len(p)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op10_token_packing"](spark, SF).collect()
    check(rows, docs, packing.ROW)
    assert sum(r["n_tokens"] for r in rows) >= 0.95 * packing.ROW * (len(rows) - 1)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_round_trip(spark, size, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 500)
    r = random.Random(size)
    docs = [(1, None), (2, ""), (3, "<|endoftext|> é€\n\t "), (None, "no id"), (4, "long " * 300)]
    docs += [(10 + i, "".join(r.choice("abc dé\n") for _ in range(r.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, ids string").repartition(3)
    check(packing.pack(df, row=size).collect(), docs, size)


def test_repeated_rows_and_empty_table(spark):
    ddl = "doc_id bigint, text string"
    rows = packing.pack(spark.createDataFrame([(1, "same text")] * 3, ddl).coalesce(1), row=64).collect()
    assert len(rows) == 1 and rows[0]["doc_ids"] == [1, 1, 1] and rows[0]["starts"] == [0, 0, 0]
    assert packing.pack(spark.createDataFrame([], ddl)).count() == 0


def test_best_fit_decreasing_against_a_scan():
    r = random.Random(7)
    for size in (1, 2, 10, 33, 64):
        lengths = np.array([r.randint(1, size) for _ in range(120)])
        rows, left = [], []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [c for c in left if c >= lengths[i]]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - lengths[i])
            else:
                left.append(size - lengths[i])
        rows = packing.best_fit_decreasing(lengths, size)
        assert sorted(i for x in rows for i in x) == list(range(120))
        assert sorted(size - lengths[x].sum() for x in rows) == sorted(left)
