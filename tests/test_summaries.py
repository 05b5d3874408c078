"""Sequenced logs, several tasks in one run, order-free means, validation in passing."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from evalframe.operators.metrics import dataset_rubric_metrics, exact_mean, exact_sum
from evalframe.operators.stand_in_models import choice_model
from evalframe.plans.run import TaskRun, failing_rows, run_generation, run_task, run_tasks, summary, validate_samples
from evalframe.plans.tasks import get_task
from evalframe.session import scratch_path
from evalframe.sources.runs import append_evaluation, compact_evaluations, latest_runs, read_evaluations, run_summaries, summary_row, write_runs


def _metrics(spark, value):
    return spark.createDataFrame([("accuracy", value, 3)], "metric string, value double, n bigint")


def test_later_write_wins_whatever_the_clock(spark):
    root = scratch_path(spark, "sequence")
    runs_path, log = os.path.join(root, "runs"), os.path.join(root, "log")
    for n in (10, 4):  # the rerun has fewer samples
        df = spark.createDataFrame([("qa", "b", "m", n)], "task string, backend string, model string, n int")
        row = df.select(*summary_row("task", "backend", "model", None, None, None, None, None, "n"))
        write_runs(row, runs_path)
    key = row.first().result_path
    assert [r.num_samples for r in latest_runs(spark.read.parquet(runs_path)).collect()] == [4]
    for name, value in (("task__qa", 0.1), ("grader__x", 0.5), ("task__qa", 0.2)):
        append_evaluation(spark, log, key, name, _metrics(spark, value))
    # equal times: the order of writing still decides
    frozen = spark.read.parquet(log).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    other = os.path.join(root, "frozen")
    frozen.write.partitionBy("part").parquet(other)
    for path in (log, other):
        s = run_summaries(spark, runs_path, path).first()
        assert {k: v.metrics["accuracy"] for k, v in s.evaluations.items()} == {"task__qa": 0.2, "grader__x": 0.5} and s.metrics == {"accuracy": 0.2}


def test_compaction_keeps_the_fold_and_later_writes(spark):
    root = scratch_path(spark, "compaction")
    runs_path, log = os.path.join(root, "runs"), os.path.join(root, "log")
    row = spark.createDataFrame([("qa", "b", "m", 3)], "task string, backend string, model string, n int").select(*summary_row("task", "backend", "model", None, None, None, None, None, "n"))
    write_runs(row, runs_path)
    key = row.first().result_path
    for i in range(6):
        append_evaluation(spark, log, key, f"e{i % 2}", _metrics(spark, i / 10))
    fold = lambda: run_summaries(spark, runs_path, log).select("metrics", F.map_entries("evaluations").alias("e")).first()
    before = fold()
    compact_evaluations(spark, log)
    after = fold()
    assert after.metrics == before.metrics and sorted(after.e) == sorted(before.e)
    rows = read_evaluations(spark, log)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 2 and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]  # older folders are not opened
    append_evaluation(spark, log, key, "e0", _metrics(spark, 0.9))
    s = run_summaries(spark, runs_path, log).first()
    assert s.metrics == {"accuracy": 0.9} and {k: v.metrics["accuracy"] for k, v in s.evaluations.items()} == {"e0": 0.9, "e1": 0.5}
    compact_evaluations(spark, log)
    assert read_evaluations(spark, log).count() == 2


def test_several_tasks_and_their_last_runs(spark):
    rows = [(i, f"question {'w ' * i}", "answer is " + "ABCDE"[i % 5]) for i in range(12)]
    samples = spark.createDataFrame(rows, "sample_id long, question string, answer string")
    chats = spark.createDataFrame([(i, f"hi {i}") for i in range(3)], "sample_id long, prompt string")
    silent = lambda: lambda messages, **_: "no idea"
    root = scratch_path(spark, "several")
    qa, chat = get_task("choice_qa"), get_task("rubric_chat")
    metrics = run_tasks(
        spark,
        [TaskRun(qa, samples, choice_model), TaskRun(chat, chats, silent, judge_options=None), TaskRun(qa, samples.where("sample_id < 7"), silent, {"task_config": {"subset": "small"}})],
        root, backend="b", model="m",
    )
    by_run = {(r.run_no, r.task_name): (r.value, r.n) for r in metrics.where("metric = 'accuracy'").collect()}
    assert set(by_run) == {(1, "choice_qa"), (3, "choice_qa")} and by_run[3, "choice_qa"] == (0.0, 7)
    got = {(r.task, r.metric, r.value, r.num_samples) for r in summary(spark, root).collect()}
    assert got == {("choice_qa", "accuracy", "0.0000", "7"), ("rubric_chat", "status", "predictions_saved", "3")}
    # the first parameter set again: it is the last run now, with its own stored grades
    run_task(spark, qa, samples, choice_model, root, backend="b", model="m")
    got = {(r.task, r.num_samples) for r in summary(spark, root).where("metric = 'accuracy'").collect()}
    assert got == {("choice_qa", "12")}
    assert run_tasks(spark, [], root, backend="b", model="m").count() == 0


@pytest.mark.parametrize("values", [[0.1] * 1000 + [1e9, 3.3e-7, -1e9 + 0.7], [1 / k for k in range(1, 4000)], [2.0**-40 * k for k in range(500)] + [1e5 / 7]])
def test_sums_do_not_depend_on_the_order(spark, values):
    import math

    df = spark.createDataFrame([(v,) for v in values], "v double")
    seen = {tuple(df.repartition(n).sortWithinPartitions(F.rand(n)).agg(exact_sum("v"), exact_mean("v")).first()) for n in (1, 7, 200)}
    assert len(seen) == 1
    total, mean = seen.pop()
    assert total == pytest.approx(math.fsum(values), rel=4e-16, abs=0) and mean == total / len(values)
    assert df.limit(0).agg(exact_sum("v"), exact_mean("v")).first()[:] == (None, None)


def test_published_mean_for_any_partitioning(spark):
    scores = [16 / 19, 6 / 10, 2 / 2, 15 / 20, 6 / 13, 9 / 12, 9 / 14, 7 / 11]
    df = spark.createDataFrame([(s, 1) for s in scores], "rubric_score double, n_criteria int")
    for n in (1, 7, 200):
        assert dataset_rubric_metrics(df.repartition(n)).first().rubric_score == 0.710358062989642


def test_validation_counts_and_failing_rows(spark):
    task = get_task("choice_qa")
    rows = [(1, "q", "A", "x"), (2, "q", None, None), (None, "q", "B", None), (4, None, "", "y")]
    samples = spark.createDataFrame(rows, "sample_id long, question string, answer string, category string")
    checks = validate_samples(task, samples).first().checks
    assert checks["null_category"] == 2 and checks["null_question"] == 1 and checks["no_key"] == 1 and checks["no_reference"] == 2 and checks["no_payload"] == 0
    bad = {r.sample_id: r.problems for r in failing_rows(task, samples).collect()}
    assert bad[2] == ["no_reference"] and bad[None] == ["no_key"] and "no_reference" in bad[4] and 1 not in bad
    chats = spark.createDataFrame([(1, "hi", None), (2, None, None), (3, None, [("user", "yo")])], "sample_id long, prompt string, conversation array<struct<role:string,content:string>>")
    assert [r.sample_id for r in failing_rows(get_task("rubric_chat"), chats).collect()] == [2]


def test_run_observes_its_samples(spark):
    samples = spark.createDataFrame([(1, "q", "A"), (2, "q", None), (3, "r", None)], "sample_id long, question string, answer string")
    seen = Observation("checks")
    records = run_generation(spark, get_task("choice_qa"), samples, choice_model, scratch_path(spark, "observed"), observation=seen, chunks=2)
    assert records.count() == 3
    assert seen.get["num_samples"] == 3 and seen.get["null_answer"] == 2 and seen.get["no_reference"] == 2 and seen.get["no_input"] == 0


def test_options_as_one_text(spark):
    task = get_task("choice_qa")
    s = spark.createDataFrame([(1, "q", "A) x  B) y", None), (2, "q", "", None), (3, "q", None, None), (4, "q", "listed", "first")], "id int, question string, options string, option_A string")
    text = {r.id: r.t for r in s.select("id", F.element_at(task.messages(s), -1)["content"][0]["text"].alias("t")).collect()}
    opts = {r.id: r.h for r in s.select("id", task.payload(s)["has_options"].alias("h")).collect()}
    assert opts == {1: True, 2: False, 3: False, 4: True}
    assert "A) x  B) y" in text[1] and text[2] == text[3] and "A. first" in text[4] and "listed" not in text[4]
