"""Positions over unions, the position manifest, and paths of any name."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalframe.session import scratch_path
from evalframe.sources.files import read_jsonl, read_splits, subset_scan, union_with_sample_idx, with_sample_idx
from evalframe.sources.positions import first_samples, position_manifest, published


def _write(path, ids):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(json.dumps({"id": i}) + "\n" for i in ids))


def _arrays(path, ids):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump([{"question": f"q{i}"} for i in ids], f, indent=1)


def test_positions_over_a_split(spark, tmp_dir):
    """List place first, then path, then the place in the file."""
    _arrays(os.path.join(tmp_dir, "day/b.json"), range(5, 9))
    _arrays(os.path.join(tmp_dir, "day/a.json"), range(5))
    _arrays(os.path.join(tmp_dir, "alpha/test.json"), range(9, 20))
    files = {"test": [("day", "test_day"), ("alpha/test.json", "test_week")]}
    rows = read_splits(spark, tmp_dir, "test", "question string", files, ordered=True)
    assert rows.columns == ["question", "source_split", "sample_idx"]
    got = sorted((r.sample_idx, r.question, r.source_split) for r in rows.collect())
    assert got == [(i, f"q{i}", "test_day" if i < 9 else "test_week") for i in range(20)]
    assert read_splits(spark, tmp_dir, "test", "question string", files).columns == ["question", "source_split"]


def test_positions_over_scans_of_many_splits(spark, tmp_dir):
    for folder, base in (("z", 0), ("a", 1000)):
        for k in range(3):
            _write(os.path.join(tmp_dir, folder, f"f{k}.jsonl"), range(base + 100 * k, base + 100 * k + 100))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = union_with_sample_idx([read_jsonl(spark, os.path.join(tmp_dir, x), "id int") for x in ("z", "a")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.sample_idx, r.id) for r in rows) == list(enumerate([*range(300), *range(1000, 1300)]))


@pytest.mark.parametrize("name", ["with space", "100% [all] {x}", "per%20cent"])
def test_subset_in_folders_of_any_name(spark, tmp_dir, name):
    root = os.path.join(tmp_dir, "data dir")
    _write(os.path.join(root, f"hard_{name}.jsonl"), range(3))
    _write(os.path.join(root, "consensus_a.jsonl"), [7])
    got = subset_scan(spark, root, "hard", "id int").orderBy("sample_idx").collect()
    assert [(r.id, r.sample_idx) for r in got] == [(0, 0), (1, 1), (2, 2)]
    assert [r.id for r in subset_scan(spark, root, "consensus", "id int").collect()] == [7]


def test_manifest_is_built_once_and_limits_the_files_read(spark, tmp_dir):
    root, location = os.path.join(tmp_dir, "in put"), scratch_path(spark, "manifest")
    for k in range(8):
        _write(os.path.join(root, f"f{k}.jsonl"), range(10 * k, 10 * k + 10) if k != 3 else [])
    asked = []

    def read(paths):
        asked.append(sorted(os.path.basename(p) for p in paths))
        return read_jsonl(spark, paths, "id int")

    manifest = position_manifest(spark, read, [root], location)
    assert [(r.rows, r.first_position) for r in manifest.orderBy("file").collect()] == [(10, 0), (10, 10), (10, 20), (10, 30), (10, 40), (10, 50), (10, 60)]
    rows = first_samples(read, manifest, 31)
    ids = [i for i in range(80) if not 30 <= i < 40]
    assert sorted((r.sample_idx, r.id) for r in rows.collect()) == list(enumerate(ids[:31]))
    assert asked == [[f"f{k}.jsonl" for k in range(8) if k != 3], ["f0.jsonl", "f1.jsonl", "f2.jsonl", "f4.jsonl"]]
    assert len(rows.inputFiles()) >= 4 and not any("f5" in f for f in rows.inputFiles())
    asked.clear()
    position_manifest(spark, read, [root], location)  # nothing has changed: nothing is read or written
    assert asked == [] and spark.read.parquet(location).select("version").distinct().count() == 1
    _write(os.path.join(root, "f3.jsonl"), range(30, 40))
    _write(os.path.join(root, "g.jsonl"), [99])
    again = position_manifest(spark, read, [root], location)
    assert asked == [["f3.jsonl", "g.jsonl"]]
    assert again.agg(F.sum("rows"), F.max("first_position")).first()[:] == (81, 80)
    assert published(spark, location).count() == 9  # the version of the first build stays readable
    whole = with_sample_idx(read_jsonl(spark, root, "id int"))
    assert sorted((r.sample_idx, r.id) for r in first_samples(read, again, 1000).collect()) == sorted((r.sample_idx, r.id) for r in whole.collect())


def test_manifest_of_empty_files(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "d", "a.jsonl"), [])
    read = lambda paths: read_jsonl(spark, paths, "id int")
    manifest = position_manifest(spark, read, [os.path.join(tmp_dir, "d")], scratch_path(spark, "empty-manifest"))
    assert manifest.count() == 0
    with pytest.raises(ValueError, match="no file"):
        first_samples(read, manifest, 5)
    _write(os.path.join(tmp_dir, "d", "b.jsonl"), [4, 5])
    manifest = position_manifest(spark, read, [os.path.join(tmp_dir, "d")], scratch_path(spark, "empty-manifest"))
    assert first_samples(read, manifest, 0).columns == ["id", "sample_idx"] and first_samples(read, manifest, 0).count() == 0
