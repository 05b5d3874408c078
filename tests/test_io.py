"""Scans and sinks: JSONL nulls, subsets, JSON arrays, legacy summaries, ordered ingest, merges."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalframe.operators.joins import merge_keyed, merge_prefix, pending
from evalframe.sources.files import (
    legacy_records,
    read_json_array,
    read_jsonl,
    read_splits,
    subset_scan,
    with_sample_idx,
    write_jsonl,
)


def _write_lines(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(("" if r is None else json.dumps(r, ensure_ascii=False)) + "\n")


def test_jsonl_keeps_nulls_and_non_ascii(spark, tmp_dir):
    df = spark.createDataFrame([(1, None, "héllo")], "sample_id int, reference string, prediction string")
    path = os.path.join(tmp_dir, "out")
    write_jsonl(df, path)
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if f.endswith(".json"))
    assert '"reference":null' in text and "héllo" in text
    write_jsonl(df.withColumn("sample_id", F.lit(2)), path, "append")
    assert read_jsonl(spark, path, "sample_id int, reference string, prediction string").count() == 2


def test_jsonl_blank_lines_and_failfast(spark, tmp_dir):
    good = os.path.join(tmp_dir, "good.jsonl")
    _write_lines(good, [{"a": 1}, None, {"a": 2}])
    assert read_jsonl(spark, good, "a int").count() == 2
    bad = os.path.join(tmp_dir, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        read_jsonl(spark, bad, "a int").collect()


def test_subset_scan(spark, tmp_dir):
    _write_lines(os.path.join(tmp_dir, "b_oss_eval.jsonl"), [{"id": 3}, {"id": 4}])
    _write_lines(os.path.join(tmp_dir, "a_oss_eval.jsonl"), [{"id": 1}, {"id": 2}])
    _write_lines(os.path.join(tmp_dir, "a_meta_oss_eval.jsonl"), [{"id": 99}])
    _write_lines(os.path.join(tmp_dir, "hard_x.jsonl"), [{"id": 7}])
    std = subset_scan(spark, tmp_dir, "standard", "id int").orderBy("sample_idx").collect()
    assert [(r.id, r.sample_idx) for r in std] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert [r.id for r in subset_scan(spark, tmp_dir, "hard", "id int").collect()] == [7]
    with pytest.raises(FileNotFoundError):
        subset_scan(spark, tmp_dir, "consensus", "id int")
    with pytest.raises(ValueError, match="consensus, hard, standard"):
        subset_scan(spark, tmp_dir, "easy", "id int")


def test_splits_union_and_backfill(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "day"))
    os.makedirs(os.path.join(tmp_dir, "week"))
    with open(os.path.join(tmp_dir, "day", "test.json"), "w") as f:
        json.dump([{"question": "q1", "answer": "A", "clue_intervals": [[1, 2]]}], f, indent=2)
    with open(os.path.join(tmp_dir, "week", "test.json"), "w") as f:
        json.dump([{"question": "q2", "answer": "B", "clue_interval": [{"video_id": "v", "intervals": [[0, 1]]}]}], f, indent=2)
    schema = "question string, answer string, clue_interval string, clue_intervals string"
    rows = read_splits(spark, tmp_dir, "test", schema).orderBy("question").collect()
    assert [(r.question, r.source_split) for r in rows] == [("q1", "test_day"), ("q2", "test_week")]
    assert json.loads(rows[0].clue_interval) == [[1, 2]]  # raw JSON text, passed through
    assert json.loads(rows[1].clue_interval) == [{"video_id": "v", "intervals": [[0, 1]]}]
    with pytest.raises(ValueError):
        read_splits(spark, tmp_dir, "dev", schema)
    assert read_json_array(spark, os.path.join(tmp_dir, "day"), schema).count() == 1


def test_legacy_records_padding(spark):
    ddl = "run_key string, predictions array<string>, references array<string>, evaluation_samples array<struct<answer:string>>"
    df = spark.createDataFrame(
        [("r1", ["p0", "p1", "p2"], ["a"], [("x",), ("y",)]), ("r2", [], ["a"], []), ("r3", None, None, None),
         ("r4", ["q0", "q1"], [None, "b"], None)], ddl
    )
    out = legacy_records(df).orderBy("run_key", "sample_idx").collect()
    assert [(r.run_key, r.sample_idx, r.prediction, r.reference, None if r.evaluation_sample is None else r.evaluation_sample.answer) for r in out] == [
        ("r1", 0, "p0", "a", "x"),
        ("r1", 1, "p1", "", "y"),
        ("r1", 2, "p2", "", None),
        ("r4", 0, "q0", None, None),  # an explicit null reference is kept, not padded
        ("r4", 1, "q1", "b", None),
    ]


def test_ordered_ingest_many_files(spark, tmp_dir):
    for name, ids in [("f2.jsonl", range(100, 150)), ("f1.jsonl", range(0, 100)), ("f3.jsonl", range(150, 151))]:
        _write_lines(os.path.join(tmp_dir, name), [{"id": i} for i in ids])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")  # several splits per file
    try:
        rows = with_sample_idx(read_jsonl(spark, tmp_dir, "id int")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.id, r.sample_idx) for r in rows) == [(i, i) for i in range(151)]


def test_resume_and_merges(spark):
    src = spark.createDataFrame([(i, i, f"p{i}") for i in range(6)], "sample_id int, sample_idx int, prediction string")
    persisted = spark.createDataFrame([(0, 1.0, "g"), (1, 0.0, "g"), (3, 1.0, "g")], "sample_id int, evaluation double, grader string")
    assert sorted(r.sample_id for r in pending(src, persisted).collect()) == [2, 4, 5]
    assert sorted(r.sample_id for r in merge_prefix(src, persisted).collect()) == [0, 1]
    keyed = merge_keyed(src, persisted).orderBy("sample_id").collect()
    assert [(r.sample_id, r.evaluation, r.grader, r.prediction) for r in keyed] == [(0, 1.0, "g", "p0"), (1, 0.0, "g", "p1"), (3, 1.0, "g", "p3")]
    full = spark.createDataFrame([(i, 1.0, "g") for i in range(6)], "sample_id int, evaluation double, grader string")
    assert merge_prefix(src, full).count() == 6


def test_sidecar_wins_and_legacy_is_written_through(spark, tmp_dir):
    from evalframe.sources.files import load_records

    summary = os.path.join(tmp_dir, "run.json")
    with open(summary, "w") as f:
        json.dump({"task_name": "t", "predictions": ["A", "B"], "references": ["A"], "evaluation_samples": [{"answer": "A"}]}, f, indent=2)
    sidecar = os.path.join(tmp_dir, "run.jsonl")
    schema = "predictions array<string>, references array<string>, evaluation_samples array<struct<answer:string>>"
    recs = load_records(spark, sidecar, summary, None, schema).orderBy("sample_idx").collect()
    assert [(r.sample_id, r.prediction, r.reference) for r in recs] == [(0, "A", "A"), (1, "B", "")]
    assert os.path.isdir(sidecar)  # written through
    os.remove(summary)
    again = load_records(spark, sidecar, summary, "sample_idx long, prediction string, reference string")
    assert again.count() == 2
    assert load_records(spark, os.path.join(tmp_dir, "none.jsonl"), os.path.join(tmp_dir, "none.json"), "a int") is None


def test_ordered_ingest_parquet_row_groups(spark, tmp_dir):
    """Parquet splits follow row groups: positions still follow file row order."""
    path = os.path.join(tmp_dir, "docs")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.coalesce(1).sortWithinPartitions("doc_id").write.option("parquet.block.size", str(16 * 1024)).parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 * 1024))
    try:
        df = with_sample_idx(spark.read.parquet(path).select("doc_id"))
        assert df.where("doc_id <> sample_idx").count() == 0 and df.count() == docs.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _documents(spark, tmp_path, n):
    rows = spark.range(n).selectExpr("id AS doc_id", "element_at(array('en', 'fr', 'de', 'es', null), int(id % 5) + 1) AS lang", "concat('text ', id) AS text")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(7).selectExpr("id AS item_id", "concat('item ', id) AS text").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_splits_have_few_files(spark, tmp_path):
    """Files of a split grow with its bytes, not by one for every 50 ids; positions keep the order of the buckets."""
    from evalframe.catalog import QUERIES

    sf = _documents(spark, tmp_path, 6000)
    rows = QUERIES["split_union"](spark, sf)
    assert len(rows.inputFiles()) <= 2 and rows.distinct().count() == 6000
    first = QUERIES["split_limit"](spark, sf)
    got = [r.doc_id for r in first.orderBy("sample_idx").collect()]
    key = lambda i: (i % 5 != 0, str(i // 50), i)
    assert got == sorted(range(6000), key=key)[:3000]
    assert len(first.inputFiles()) < 60


def test_subset_files_are_written_by_as_many_tasks_as_the_session_has(spark, tmp_path, monkeypatch):
    from evalframe.catalog import QUERIES, io_q

    sf, parts, write = _documents(spark, tmp_path, 4000), [], io_q.write_jsonl

    def spy(df, *args):
        parts.append(df.rdd.getNumPartitions())
        write(df, *args)

    monkeypatch.setattr(io_q, "write_jsonl", spy)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert QUERIES["subset_scan"](spark, sf).count() == 2 * 800 + 800 + 7
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert min(parts[:4]) == 6
