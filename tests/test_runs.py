"""Run keys, evaluation names, summary rows and the runs table."""

import pytest
from pyspark.sql import functions as F

from evalframe.operators.joins import upsert_evaluation_map, upsert_evaluations
from evalframe.operators.metrics import metrics_long, record_accuracy
from evalframe.session import scratch_path
from evalframe.sources.runs import evaluated_key, evaluated_path, evaluation_name, find_run, result_path, run_key, summary_row, write_runs


def _one(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols[n][0] for n in names)], ", ".join(f"{n} {cols[n][1]}" for n in names))


def test_run_key_and_path(spark):
    df = _one(
        spark,
        cfg=({"subset": "standard", "data_dir": "/x", "empty": "", "none": None, "Zeta": "a/b c"}, "map<string,string>"),
        mt=(None, "int"),
        temp=(None, "double"),
        lim=(None, "int"),
        task=("healthy", "string"),
        backend=("", "string"),
        model=("gpt-4.1", "string"),
    )
    r = df.select(run_key("cfg", "mt", "temp", "lim").alias("k")).first().k
    assert r == "Zeta-a-b-c__subset-standard__max_tokens-4096__temperature-0.0__limit-all"
    p = df.select(result_path("task", "backend", "model", F.lit(r)).alias("p")).first().p
    assert p == f"healthy/unknown-backend/gpt-4.1/{r}.json"
    df2 = _one(spark, mt=(256, "int"), temp=(0.7, "double"), lim=(8, "int"))
    assert df2.select(run_key(None, "mt", "temp", "lim").alias("k")).first().k == "max_tokens-256__temperature-0.7__limit-8"


def test_evaluated_key_and_name(spark):
    df = spark.createDataFrame(
        [("k", "t", "azure", "gpt-4o"), ("k", "t", None, None), ("k", "t", "", "m/x"), ("k", "t", "b", None)],
        "key string, task string, gb string, gm string",
    )
    out = df.select(evaluated_key("key", "gb", "gm").alias("e"), evaluation_name("task", "gb", "gm").alias("n")).collect()
    assert [(r.e, r.n) for r in out] == [
        ("k__graded-by-azure-gpt-4o", "grader__t__azure__gpt-4o"),
        ("k__graded", "task__t"),
        ("k__graded-by-m-x", "task__t"),
        ("k__graded-by-b", "task__t"),
    ]


def test_summary_rows_and_lookup(spark):
    df = spark.createDataFrame(
        [("qa", "openai", "m1", 8, 10), ("qa", "openai", "m2", None, 20), ("chat", "azure", "m1", 8, 30)],
        "task string, backend string, model string, lim int, n int",
    )
    rows = df.select(*summary_row("task", "backend", "model", None, None, None, "lim", None, "n"))
    first = rows.where("model = 'm1' AND task_name = 'qa'").first()
    assert first.schema_version == 2 and first.metrics == {} and first.evaluations == {}
    assert first.metadata["sample_results_path"] == "qa/openai/m1/max_tokens-4096__temperature-0.0__limit-8.jsonl"
    path = scratch_path(spark, "runs-test")
    write_runs(rows, path)
    found = find_run(spark, path, "qa", "openai", "m2", "max_tokens-4096__temperature-0.0__limit-all")
    assert found.first().num_samples == 20
    with pytest.raises(FileNotFoundError, match="qa/openai/m3"):
        find_run(spark, path, "qa", "openai", "m3", "max_tokens-4096__temperature-0.0__limit-all")


def test_upserts(spark):
    ev_t = "map<string,struct<acc:double>>"
    df = spark.createDataFrame([({"task__qa": (0.1,), "other": (0.2,)},)], f"ev {ev_t}")
    out = df.select(upsert_evaluation_map("ev", "task__qa", F.struct(F.lit(0.9).alias("acc"))).alias("m")).first().m
    assert {k: v.acc for k, v in out.items()} == {"task__qa": 0.9, "other": 0.2}
    hist = spark.createDataFrame([("r", "a", 1.0, 1), ("r", "b", 2.0, 1)], "run_key string, evaluation_name string, v double, ts int")
    upd = spark.createDataFrame([("r", "a", 5.0, 2), ("r", "c", 7.0, 2)], "run_key string, evaluation_name string, v double, ts int")
    got = {(r.evaluation_name, r.v) for r in upsert_evaluations(hist, upd).collect()}
    assert got == {("a", 5.0), ("b", 2.0), ("c", 7.0)}


def test_record_accuracy_and_listing(spark):
    g = spark.createDataFrame([(1.0, "x"), (0.0, "x"), (None, ""), (1.0, None)], "correct double, category string")
    m = {r.metric: (r.value, r.n) for r in record_accuracy(g).collect()}
    assert m == {"accuracy": (0.5, 4), "accuracy_x": (0.5, 2)}
    empty = record_accuracy(g.limit(0)).collect()
    assert [(r.metric, r.value) for r in empty] == [("accuracy", 0.0)]
    runs = spark.createDataFrame(
        [("qa", {"accuracy": 0.123456}, 4), ("chat", {}, 3), ("rubric", {"rubric_score": 0.5, "num_graded": 7.0}, 9)],
        "task string, metrics map<string,double>, num_samples int",
    )
    rows = {(r.task, r.metric, r.value, r.num_samples) for r in metrics_long(runs).collect()}
    assert rows == {
        ("qa", "accuracy", "0.1235", "4"),
        ("chat", "status", "predictions_saved", "3"),
        ("rubric", "rubric_score", "0.5000", "9"),
        ("rubric", "num_graded", "7", "9"),
    }


def test_evaluated_path_rerooting(spark):
    df = spark.createDataFrame(
        [("results/rubric_chat/azure/gpt-4o/run__limit-8.json", "azure", "gpt-4o"),
         ("/data/x/results/a/b/run.json", None, None),
         ("out/a/run.json", "", "m"),
         ("./out//./b/run.json", None, None)],
        "p string, gb string, gm string",
    )
    got = [r.e for r in df.select(evaluated_path("p", "gb", "gm").alias("e")).collect()]
    assert got == [
        "results/evaluated/rubric_chat/azure/gpt-4o/run__limit-8__graded-by-azure-gpt-4o.json",
        "results/evaluated/a/b/run__graded.json",
        "results/evaluated/out/a/run__graded-by-m.json",
        "results/evaluated/out/b/run__graded.json",
    ]


def test_evaluation_log_and_summaries(spark):
    from evalframe.sources.runs import append_evaluation, run_summaries

    df = spark.createDataFrame([("qa", "openai", "m1", 10)], "task string, backend string, model string, n int")
    rows = df.select(*summary_row("task", "backend", "model", None, None, None, None, None, "n"))
    runs_path, log_path = scratch_path(spark, "runs-ev"), scratch_path(spark, "evals")
    write_runs(rows, runs_path)
    key = rows.first().result_path
    m1 = spark.createDataFrame([("accuracy", 0.5, 10)], "metric string, value double, n bigint")
    append_evaluation(spark, log_path, key, "task__qa", m1)
    append_evaluation(spark, log_path, key, "grader__qa__b__m", m1.selectExpr("metric", "0.7 AS value", "n"), {"backend": "b", "model": "m"})
    append_evaluation(spark, log_path, key, "task__qa", m1.selectExpr("metric", "0.9 AS value", "n"))
    s = run_summaries(spark, runs_path, log_path).first()
    assert {k: v.metrics["accuracy"] for k, v in s.evaluations.items()} == {"task__qa": 0.9, "grader__qa__b__m": 0.7}
    assert s.evaluations["grader__qa__b__m"].grader == {"backend": "b", "model": "m"}
    assert s.metrics == {"accuracy": 0.9}


def test_batch_accuracy_empty_category_is_none(spark):
    from evalframe.operators.metrics import batch_accuracy

    df = spark.createDataFrame([("A", "A", True, ""), ("B", "A", True, "x"), ("C", "C", True, None)],
                               "prediction string, reference string, has_options boolean, category string")
    got = {r.metric: r.value for r in batch_accuracy(df).collect()}
    assert got == {"accuracy": 2 / 3, "accuracy_x": 0.0}


def test_metric_text_rounds_like_python(spark):
    ties = [1 / 32, 3 / 160, 0.10625, 0.5, 2 / 3, 1234.56785]
    runs = spark.createDataFrame([("t", {f"m{i}": v for i, v in enumerate(ties)}, 1)], "task string, metrics map<string,double>, num_samples int")
    got = {r.metric: r.value for r in metrics_long(runs).collect()}
    assert got == {f"m{i}": f"{v:.4f}" for i, v in enumerate(ties)}
