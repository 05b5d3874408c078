"""End-to-end plans: generation with resume, grading with a judge, custom tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalframe.operators.stand_in_models import choice_model
from evalframe.plans.run import evaluate_run, run_generation
from evalframe.plans.tasks import get_task, list_tasks
from evalframe.session import scratch_path
from evalframe.sources.files import read_jsonl


def test_registry():
    assert {"choice_qa", "rubric_chat"} <= set(list_tasks())
    with pytest.raises(ValueError, match="registered: "):
        get_task("nope")


def _qa_samples(spark, n=40):
    rows = [(i, i, f"question {'w ' * i}", ["x", "y", "z"] if i % 2 else None, "ABCDE"[i % 5], "cat" + str(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, sample_idx long, question string, options array<string>, answer string, category string")


def test_generation_resume_fills_holes(spark):
    task = get_task("choice_qa")
    samples = _qa_samples(spark)
    path = scratch_path(spark, "resume-test")
    run_generation(spark, task, samples.where("sample_id % 4 = 1"), choice_model, path)
    first = read_jsonl(spark, path, "sample_id long").count()
    recs = run_generation(spark, task, samples, choice_model, path, limit=30)
    assert first == 10
    ids = [r.sample_id for r in recs.select("sample_id").collect()]
    assert sorted(ids) == sorted(set(ids))  # nothing generated twice
    assert set(ids) == set(range(30))  # the limit holds for what an earlier run left, too
    assert read_jsonl(spark, path, "sample_id long").count() == 30 + len([i for i in range(30, 40) if i % 4 == 1])
    again = run_generation(spark, task, samples, choice_model, path)
    assert again.count() == 40


def _judge_met_first_k():
    """Judge: a criterion text "c<k>/<m>" is met when k < m."""

    def predict(messages, **_):
        import re

        text = messages[-1]["content"][0]["text"]
        k, m = map(int, re.search(r"## Evaluation Criterion\nc(\d+)/(\d+)", text).groups())
        return json.dumps({"explanation": "", "criteria_met": k < m})

    return predict


def test_rubric_evaluation_reproduces_published_mean(spark):
    met_total = [(16, 19), (6, 10), (2, 2), (15, 20), (6, 13), (9, 12), (9, 14), (7, 11)]
    samples = []
    for sid, (met, total) in enumerate(met_total):
        rubrics = [{"criterion": f"c{k}/{met}", "points": 1} for k in range(total)]
        samples.append({"sample_id": sid, "conversation": [{"role": "user", "content": f"q{sid}"}], "rubrics": rubrics})
    root = scratch_path(spark, "rubric-e2e")
    os.makedirs(root, exist_ok=True)
    src = os.path.join(root, "samples.jsonl")
    with open(src, "w") as f:
        f.write("\n".join(json.dumps(s) for s in samples) + "\n")
    schema = "sample_id long, conversation array<struct<role:string,content:string>>, rubrics array<struct<criterion:string,text:string,weight:double,points:double>>"
    df = read_jsonl(spark, src, schema)
    task = get_task("rubric_chat")

    def echo():
        def predict(messages, **_):
            return "answer to " + messages[-1]["content"][0]["text"]

        return predict

    recs = run_generation(spark, task, df, echo, os.path.join(root, "records"))
    assert {r.reference for r in recs.collect()} == {f"{t} rubrics" for _, t in met_total}
    graded, metrics = evaluate_run(spark, task, recs, os.path.join(root, "graded"), judge=_judge_met_first_k)
    m = {r.metric: r.value for r in metrics.collect()}
    assert m["rubric_score"] == pytest.approx(0.710358062989642, abs=1e-12)
    assert m["num_graded"] == 8
    # a second evaluation resumes: nothing left to grade, same metrics
    _, again = evaluate_run(spark, task, recs, os.path.join(root, "graded"), judge=_judge_met_first_k)
    assert {r.metric: r.value for r in again.collect()} == m
    assert read_jsonl(spark, os.path.join(root, "graded"), "sample_id long").count() == 8
    _, unjudged = evaluate_run(spark, task, recs, os.path.join(root, "graded-none"), judge=None)
    assert [r.metric for r in unjudged.collect()] == ["avg_response_length"]


def test_qa_evaluation_metrics(spark):
    task = get_task("choice_qa")
    samples = _qa_samples(spark, 20)
    root = scratch_path(spark, "qa-e2e")
    recs = run_generation(spark, task, samples, choice_model, os.path.join(root, "records"))
    graded, metrics = evaluate_run(spark, task, recs, os.path.join(root, "graded"))
    m = {r.metric: r.value for r in metrics.collect()}
    assert set(m) == {"accuracy", "accuracy_cat0", "accuracy_cat1", "accuracy_cat2"}
    rows = graded.select("sample_id", "prediction", "reference", "evaluation.correct", "evaluation_sample.has_options").collect()
    for r in rows:
        if r.has_options:
            expected = 1.0 if r.prediction.endswith(r.reference) else 0.0
        else:
            expected = 1.0 if r.prediction.lower().replace("the ", "") == r.reference.lower() else 0.0
        assert r.correct == expected


def test_variant_prompt_history_and_empty_run(spark):
    from evalframe.plans.tasks import grading_history_of

    root = scratch_path(spark, "variant-history")
    os.makedirs(root, exist_ok=True)
    lines = [
        {"sample_id": 1, "prompt": [{"role": "user", "content": "hi"}, {"role": "ASSISTANT", "content": "no"}, {"role": "assistant", "content": "yo"}]},
        {"sample_id": 2, "prompt": "plain"},
        {"sample_id": 3, "prompt": [], "question": "q"},
        {"sample_id": 4, "conversation": [{"role": "tool", "content": None}], "prompt": "ignored"},
    ]
    with open(os.path.join(root, "s.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines) + "\n")
    df = read_jsonl(spark, root, "sample_id long, prompt variant, question string, conversation array<struct<role:string,content:string>>")
    task = get_task("rubric_chat")
    payload = df.select("sample_id", task.payload(df).alias("evaluation_sample"))
    got = {r.sample_id: r.h for r in payload.select("sample_id", grading_history_of(F.col("evaluation_sample"), True).alias("h")).collect()}
    assert got == {1: "User: hi\n\nAssistant: yo", 2: "User: plain", 3: "User: q", 4: "Tool: None"}
    with pytest.raises(ValueError, match="No per-sample records"):
        evaluate_run(spark, task, payload.limit(0), os.path.join(root, "graded"))


def test_criterion_results_persisted_once(spark):
    from evalframe.plans.run import criterion_results_of

    root = scratch_path(spark, "criteria-details")
    os.makedirs(root, exist_ok=True)
    samples = [{"sample_id": i, "conversation": [{"role": "user", "content": f"q{i}"}],
                "rubrics": [{"criterion": f"c{k}/{i}", "weight": float(k + 1)} for k in range(i + 1)]} for i in range(4)]
    with open(os.path.join(root, "s.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(s) for s in samples) + "\n")
    schema = "sample_id long, conversation array<struct<role:string,content:string>>, rubrics array<struct<criterion:string,text:string,weight:double,points:double>>"
    df = read_jsonl(spark, os.path.join(root, "s.jsonl"), schema)
    task = get_task("rubric_chat")

    def echo():
        def predict(messages, **_):
            return "ok"

        return predict

    recs = run_generation(spark, task, df, echo, os.path.join(root, "records"))
    graded_path = os.path.join(root, "graded")
    graded, _ = evaluate_run(spark, task, recs.where("sample_id < 2"), graded_path, judge=_judge_met_first_k)
    graded, _ = evaluate_run(spark, task, recs, graded_path, judge=_judge_met_first_k)
    crit = criterion_results_of(spark, graded_path)
    assert crit.count() == 1 + 2 + 3 + 4
    met = {(r.sample_id, r.criterion_idx): r.criteria_met for r in crit.collect()}
    assert all(met[(i, k)] == (k < i) for i in range(4) for k in range(i + 1))
    scores = {r.sample_id: r.evaluation.rubric_score for r in graded.collect()}
    assert scores[3] == pytest.approx((1 + 2 + 3) / 10)


def test_validate_samples(spark):
    from evalframe.plans.run import validate_samples

    df = spark.createDataFrame(
        [(2, None, "q2"), (1, [("user", "hi"), ("assistant", "yo")], None)],
        "sample_id long, conversation array<struct<role:string,content:string>>, question string",
    )
    row = validate_samples(get_task("rubric_chat"), df).first()
    assert (row.num_samples, row.first_prompt_messages, row.first_sample_keys) == (2, 3, ["sample_id", "conversation"])


def test_strict_payload_variant(spark):
    df = spark.createDataFrame([(1, "q", "a", "b", None)], "sample_id long, question string, option_A string, option_B string, options array<string>")
    loose = df.select(get_task("choice_qa").payload(df).alias("p")).first().p
    strict = df.select(get_task("choice_qa_strict").payload(df).alias("p")).first().p
    assert loose.has_options is True and strict.has_options is False


def test_run_and_evaluate_task_bookkeeping(spark):
    from evalframe.operators.infer import GenerationConfig
    from evalframe.plans.run import evaluate_task, run_task
    from evalframe.sources.runs import run_summaries

    root = scratch_path(spark, "task-bookkeeping")
    task = get_task("choice_qa")
    samples = _qa_samples(spark, 12)
    cfg = GenerationConfig(max_tokens=64, temperature=0.0)
    run = run_task(spark, task, samples, choice_model, root, backend="stand-in", model="choice", task_config={"subset": "all", "data_dir": "/x"}, config=cfg).first()
    assert run.run_key == "subset-all__max_tokens-64__temperature-0.0__limit-all"
    assert run.num_samples == 12 and run.metrics == {}
    metrics = {r.metric: r.value for r in evaluate_task(spark, task, root, backend="stand-in", model="choice", task_config={"subset": "all", "data_dir": "/x"}, config=cfg).collect()}
    summary = run_summaries(spark, os.path.join(root, "runs"), os.path.join(root, "evaluations")).first()
    assert summary.metrics == metrics and list(summary.evaluations) == ["task__choice_qa"]
    with pytest.raises(FileNotFoundError):
        evaluate_task(spark, task, root, backend="stand-in", model="other", config=cfg)


def test_readme_usage_flow(spark, tmp_dir):
    """The README's usage example, with local folders and stand-in models."""
    from evalframe.operators.infer import GenerationConfig
    from evalframe.operators.stand_in_models import parity_judge
    from evalframe.plans.run import evaluate_task, run_task
    from evalframe.sources.files import subset_scan
    from evalframe.sources.runs import run_summaries

    with open(os.path.join(tmp_dir, "x_oss_eval.jsonl"), "w") as f:
        for i in range(5):
            f.write(json.dumps({"conversation": [{"role": "user", "content": "q" * (i + 1)}],
                                "rubrics": [{"criterion": "c" * (k + 1), "points": 1} for k in range(i + 1)]}) + "\n")
    schema = ("conversation array<struct<role:string,content:string>>, "
              "rubrics array<struct<criterion:string,text:string,weight:double,points:double>>")
    samples = subset_scan(spark, tmp_dir, "standard", schema).withColumnRenamed("sample_idx", "sample_id")

    def my_model():
        return lambda messages, **opts: "reply"

    root = scratch_path(spark, "usage")
    task = get_task("rubric_chat")
    cfg = GenerationConfig(max_tokens=4096, temperature=0.0)
    run_task(spark, task, samples, my_model, root, backend="openai", model="m",
             task_config={"subset": "standard"}, config=cfg, partitions=4, concurrency=2)
    metrics = evaluate_task(spark, task, root, backend="openai", model="m", task_config={"subset": "standard"},
                            config=cfg, judge=parity_judge, grader_backend="openai", grader_model="judge")
    m = {r.metric: r.value for r in metrics.collect()}
    assert m["num_graded"] == 5 and 0.0 <= m["rubric_score"] <= 1.0
    s = run_summaries(spark, os.path.join(root, "runs"), os.path.join(root, "evaluations")).first()
    assert s.num_samples == 5 and list(s.evaluations) == ["grader__rubric_chat__openai__judge"]


def test_base_reference(spark):
    from evalframe.plans.tasks import base_reference

    df = spark.createDataFrame([("x", None), (None, 3), (None, None)], "answer string, label int")
    assert [r.r for r in df.select(base_reference(df).alias("r")).collect()] == ["x", "3", ""]
    only_label = spark.createDataFrame([(7,)], "label int")
    assert only_label.select(base_reference(only_label).alias("r")).first().r == "7"


def test_models_do_not_share_grades_and_reruns_stay_one_run(spark):
    from evalframe.plans.run import evaluate_task, run_task
    from evalframe.sources.runs import run_summaries

    root = scratch_path(spark, "two-models")
    task, samples = get_task("choice_qa"), _qa_samples(spark)

    def silent():
        return lambda messages, **_: "no idea"

    def always_a():
        return lambda messages, **_: "The answer is A"

    for model, factory in (("m1", always_a), ("m2", silent), ("m1", always_a)):
        assert run_task(spark, task, samples, factory, root, backend="b", model=model).count() == 1
    values = {m: {r["metric"]: r["value"] for r in evaluate_task(spark, task, root, backend="b", model=m).collect()} for m in ("m1", "m2")}
    assert all(v == 0.0 for v in values["m2"].values()) and any(v > 0.0 for v in values["m1"].values())
    got = run_summaries(spark, os.path.join(root, "runs"), os.path.join(root, "evaluations")).select("model", "metrics").collect()
    assert sorted(r["model"] for r in got) == ["m1", "m2"]
    assert {r["model"]: set(r["metrics"].values()) == {0.0} for r in got} == {"m1": False, "m2": True}


def test_failed_rows_are_tried_again(spark):
    task, samples = get_task("choice_qa"), _qa_samples(spark)
    path = scratch_path(spark, "failed-rows")

    def broken():
        def predict(messages, **_):
            raise ValueError("no")

        return predict

    first = run_generation(spark, task, samples, broken, path, on_error="null")
    assert first.where("error is not null").count() == 40
    again = run_generation(spark, task, samples, choice_model, path)
    assert again.count() == 40 and again.where("error is not null or prediction is null").count() == 0


def _letter_or(failure, broken):
    """Model that answers by question length, but fails with ``failure`` for questions of a length in ``broken``."""

    def factory():
        def predict(messages, **_):
            n = len(messages[-1]["content"][0]["text"])
            if n in broken:
                raise failure("no")
            return "The answer is " + "ABCDE"[n % 5]

        return predict

    return factory


def _lengths(samples):
    """Length of each sample's prompt text, by sample."""
    task = get_task("choice_qa")
    return {r.sample_id: r.n for r in samples.select("sample_id", F.length(F.element_at(task.messages(samples), -1)["content"][0]["text"]).alias("n")).collect()}


def test_failed_pass_keeps_every_finished_sample(spark):
    from evalframe.plans.run import GenerationFailed

    task, samples, path = get_task("choice_qa"), _qa_samples(spark), scratch_path(spark, "one-bad")
    bad = _lengths(samples)[17]
    with pytest.raises(GenerationFailed, match="1 samples failed.*ValueError"):
        run_generation(spark, task, samples.where("sample_id > 0"), _letter_or(ValueError, {bad}), path)
    kept = read_jsonl(spark, path, "sample_id long, prediction string, error string, run_pass long").collect()
    assert len(kept) == 39 and [r.sample_id for r in kept if r.error] == [17] and {r.run_pass for r in kept} == {1}
    again = run_generation(spark, task, samples, _letter_or(ValueError, set()), path)
    assert again.count() == 40 and again.where("error is not null").count() == 0
    ledger = read_jsonl(spark, path, "sample_id long, run_pass long").collect()
    assert sorted(r.sample_id for r in ledger if r.run_pass == 2) == [0, 17]  # nothing else is called again


def test_job_that_dies_keeps_its_finished_chunks(spark):
    """A worker that ends itself fails its chunk's job; the other chunks are stored."""
    task, samples, path = get_task("choice_qa"), _qa_samples(spark), scratch_path(spark, "died")
    with pytest.raises(Exception, match="SystemExit"):
        run_generation(spark, task, samples, _letter_or(SystemExit, {_lengths(samples)[5]}), path, chunks=8)
    chunk = {r.sample_id: r.c for r in samples.select("sample_id", F.pmod(F.xxhash64("sample_id"), F.lit(8)).alias("c")).collect()}
    kept = {r.sample_id for r in read_jsonl(spark, path, "sample_id long").collect()}
    assert kept == {i for i in chunk if chunk[i] != chunk[5]} and len(kept) >= 20
    again = run_generation(spark, task, samples, _letter_or(ValueError, set()), path, chunks=8)
    assert again.count() == 40
    assert read_jsonl(spark, path, "sample_id long").count() == 40


def test_changed_records_are_graded_again(spark):
    task, samples, root = get_task("choice_qa"), _qa_samples(spark), scratch_path(spark, "versions")
    records_path, graded_path = os.path.join(root, "records"), os.path.join(root, "graded")
    lengths = _lengths(samples)
    failed = run_generation(spark, task, samples, _letter_or(ValueError, {lengths[i] for i in (1, 3, 5, 7)}), records_path, on_error="null")
    evaluate_run(spark, task, failed, graded_path)
    n = read_jsonl(spark, graded_path, "sample_id long").count()
    records = run_generation(spark, task, samples, _letter_or(ValueError, set()), records_path)
    graded, metrics = evaluate_run(spark, task, records, graded_path)
    fresh, want = evaluate_run(spark, task, records, os.path.join(root, "graded-fresh"))
    key = lambda df: sorted((r.sample_id, r.evaluation.correct) for r in df.collect())
    assert key(graded) == key(fresh)
    assert sorted(map(tuple, metrics.collect())) == sorted(map(tuple, want.collect()))
    changed = {r.sample_id for r in read_jsonl(spark, graded_path, "sample_id long, grade_pass long").where("grade_pass = 2").collect()}
    shared = {lengths[i] for i in (1, 3, 5, 7)}
    assert n == 40 and changed == {i for i in lengths if lengths[i] in shared}


def test_judge_is_asked_again_for_failed_calls_only(spark):
    from evalframe.plans.run import criterion_results_of, details_location

    task, root = get_task("rubric_chat"), scratch_path(spark, "ledger")
    rows = [(i, f"q{i}", [(f"criterion {k} of {i}", None, float(k + 1), None) for k in range(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "sample_id long, prompt string, rubrics array<struct<criterion:string,text:string,weight:double,points:double>>")
    records = run_generation(spark, task, df, lambda: lambda messages, **_: "an answer", os.path.join(root, "records"))

    def judge(down):
        def factory():
            def predict(messages, **_):
                text = messages[-1]["content"][0]["text"]
                k, i = map(int, __import__("re").search(r"criterion (\d+) of (\d+)", text).groups())
                if down and k % 2 == 1:
                    raise ValueError("down")
                return json.dumps({"criteria_met": k <= 1})

            return predict

        return factory

    path = os.path.join(root, "graded")
    first, _ = evaluate_run(spark, task, records, path, judge=judge(True), on_error="null")
    assert {r.sample_id: r.evaluation.n_failed for r in first.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    second, metrics = evaluate_run(spark, task, records, path, judge=judge(False))
    got = {r.sample_id: r.evaluation for r in second.collect()}
    assert {i: e.n_failed for i, e in got.items()} == dict.fromkeys(range(5), 0)
    assert [got[i].rubric_score for i in range(5)] == pytest.approx([0.0, 1.0, 1.0, 3 / 6, 3 / 10])
    calls = spark.read.parquet(details_location(path))
    assert calls.where("grade_pass = 1").count() == 10 and calls.where("grade_pass = 2").count() == 4
    results = criterion_results_of(spark, path).collect()
    assert len(results) == 10 and all(r.error is None and r.criteria_met == (r.criterion_idx <= 1) for r in results)
    evaluate_run(spark, task, records, path, judge=judge(True))  # all is judged: the judge is not called
    assert spark.read.parquet(details_location(path)).count() == 14


def test_interrupted_grading_keeps_its_verdicts(spark):
    """Verdicts written by a pass that stored no evaluation are used by the next one."""
    from evalframe.plans.run import details_location

    task, root = get_task("rubric_chat"), scratch_path(spark, "interrupted-grading")
    rows = [(i, f"q{i}", [(f"c{k}", None, 1.0, None) for k in range(3)]) for i in range(4)]
    df = spark.createDataFrame(rows, "sample_id long, prompt string, rubrics array<struct<criterion:string,text:string,weight:double,points:double>>")
    records = run_generation(spark, task, df, lambda: lambda messages, **_: "an answer", os.path.join(root, "records"))
    from evalframe.sources.ledger import VERSION, record_version

    yes = lambda: lambda messages, **_: '{"criteria_met": true}'
    path = os.path.join(root, "graded")
    task.grade(records.withColumn(VERSION, record_version(records)), yes, details_location(path))  # no evaluation is stored

    def never():
        def predict(messages, **_):
            raise AssertionError("called again")

        return predict

    graded, _ = evaluate_run(spark, task, records, path, judge=never)
    assert [r.evaluation.rubric_score for r in graded.collect()] == [1.0] * 4


def test_plain_record_file_is_graded_apart_and_resumed(spark, tmp_dir):
    from evalframe.plans.run import evaluate_file

    path = os.path.join(tmp_dir, "results", "run a.jsonl")
    os.makedirs(os.path.dirname(path))
    with open(path, "w") as f:
        for i in range(6):
            f.write(json.dumps({"prediction": f"The answer is {'ABC'[i % 3]}", "reference": "A", "evaluation_sample": {"answer": "A", "category": f"c{i % 2}", "options": ["x", "y"]}}) + "\n")
    schema = "prediction string, reference string, evaluation_sample struct<answer:string, category:string, type:string, task_type:string, options:array<string>>"
    out = os.path.join(tmp_dir, "out")
    where, metrics = evaluate_file(spark, get_task("choice_qa"), path, schema, output_dir=out, grader_backend="b", grader_model="m")
    assert where == f"{out}/run a__graded-by-b-m.jsonl"
    rows = read_jsonl(spark, where).orderBy("sample_id").collect()
    assert rows[0].__fields__ == ["evaluation", "sample_id"] and [r.evaluation.correct for r in rows] == [1.0, 0.0, 0.0] * 2
    assert {r.metric: r.value for r in metrics.collect()} == pytest.approx({"accuracy": 1 / 3, "accuracy_c0": 1 / 3, "accuracy_c1": 1 / 3})
    evaluate_file(spark, get_task("choice_qa"), path, schema, output_dir=out, grader_backend="b", grader_model="m")
    assert read_jsonl(spark, where + "_grades").count() == 6  # nothing was graded twice
    with pytest.raises(FileNotFoundError):
        evaluate_file(spark, get_task("choice_qa"), path + ".none", schema, output_dir=out)
