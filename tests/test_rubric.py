"""Rubric scoring: flat and nested forms, explode, dataset metrics, published example."""

import pytest
from pyspark.sql import functions as F

from evalframe.operators.metrics import rubric_score_nested
from evalframe.operators.rubric import explode_criteria, rubric_dataset_metrics, score_all_samples, score_samples

SCORES = [
    ([True, True, True], None, 1.0),
    ([False, False], None, 0.0),
    ([True, False, True, False], None, 0.5),
    ([True, None, False], None, 0.5),
    ([None, None], None, 0.0),
    ([True, False], [2.0, 1.0], 2 / 3),
    ([], None, 0.0),
    ([True, False], [0.0, 0.0], 0.0),
]


def _long(spark):
    rows = []
    for sid, (judg, weights, _) in enumerate(SCORES):
        for k, j in enumerate(judg):
            rows.append((sid, k, f"c{k}", (weights or [1.0] * len(judg))[k], j))
    return spark.createDataFrame(rows, "sample_id int, criterion_idx int, criterion string, weight double, criteria_met boolean")


def test_flat_scores(spark):
    samples = spark.createDataFrame([(i,) for i in range(len(SCORES))], "sample_id int")
    got = {r.sample_id: r.rubric_score for r in score_all_samples(samples, score_samples(_long(spark), "sample_id"), "sample_id").collect()}
    for sid, (_, _, expected) in enumerate(SCORES):
        assert got[sid] == pytest.approx(expected)


def test_nested_equals_flat(spark):
    nested = _long(spark).groupBy("sample_id").agg(
        F.collect_list(F.struct("criterion", "weight", "criteria_met")).alias("results")
    )
    got = {r.sample_id: r.s for r in nested.select("sample_id", rubric_score_nested("results").alias("s")).collect()}
    for sid, (judg, _, expected) in enumerate(SCORES):
        if judg:
            assert got[sid] == pytest.approx(expected)


def test_dataset_metrics_count_rubricless_as_zero(spark):
    samples = spark.createDataFrame([(i,) for i in range(len(SCORES) + 2)], "sample_id int")
    m = rubric_dataset_metrics(samples, _long(spark), "sample_id").first()
    expected = sum(s for _, _, s in SCORES) / (len(SCORES) + 2)
    assert m.rubric_score == pytest.approx(expected)
    assert m.num_graded == sum(1 for j, _, _ in SCORES if j)


def test_explode_criteria_fields(spark):
    rub = "array<struct<criterion:string,text:string,weight:double,points:double>>"
    df = spark.createDataFrame(
        [
            (1, [("crit a", None, 2.0, 5.0), (None, "text b", None, -3.0), ("", "text c", None, None)], None),
            (2, [], [("from criteria", None, None, None)]),
            (3, None, None),
        ],
        f"sample_id int, rubrics {rub}, criteria {rub}",
    )
    out = explode_criteria(df, "sample_id", "rubrics", "criteria").orderBy("sample_id", "criterion_idx").collect()
    assert [(r.sample_id, r.criterion_idx, r.criterion, r.weight) for r in out] == [
        (1, 0, "crit a", 2.0),
        (1, 1, "text b", 1.0),
        (1, 2, "text c", 1.0),
        (2, 0, "from criteria", 1.0),
    ]
    pts = explode_criteria(df, "sample_id", "rubrics", "criteria", weight_field="points").where("sample_id = 1").orderBy("criterion_idx")
    assert [r.weight for r in pts.collect()] == [5.0, -3.0, 1.0]


def test_published_eight_sample_mean(spark):
    """Eight graded samples with (met, total) criteria as in the saved example run."""
    met_total = [(16, 19), (6, 10), (2, 2), (15, 20), (6, 13), (9, 12), (9, 14), (7, 11)]
    rows = [(sid, k, 1.0, k < met) for sid, (met, total) in enumerate(met_total) for k in range(total)]
    judged = spark.createDataFrame(rows, "sample_id int, criterion_idx int, weight double, criteria_met boolean")
    samples = spark.createDataFrame([(i,) for i in range(8)], "sample_id int")
    m = rubric_dataset_metrics(samples, judged, "sample_id").first()
    assert m.rubric_score == pytest.approx(0.710358062989642, abs=1e-12)
    assert m.num_graded == 8


def test_points_scoring_opt_in(spark):
    from evalframe.operators.metrics import points_score_expr

    rows = [(0, True, 5.0), (0, False, 3.0), (0, True, -2.0), (1, True, -4.0), (1, None, 2.0), (2, True, 10.0), (3, False, -1.0)]
    df = spark.createDataFrame(rows, "sid int, met boolean, points double")
    got = {r.sid: r.s for r in df.groupBy("sid").agg(points_score_expr("met", "points").alias("s")).collect()}
    assert got == {0: pytest.approx(3 / 8), 1: 0.0, 2: 1.0, 3: 0.0}


def test_rubric_shapes_of_real_files(spark):
    from evalframe.plans.tasks import get_task

    def rubrics_of(ddl, value):
        df = spark.createDataFrame([(value,)], f"rubrics {ddl}") if "variant" not in ddl else spark.sql(f"SELECT parse_json('{value}') AS rubrics")
        task = get_task("rubric_chat")
        row = df.select(task.payload(df).alias("p"), task.reference(df).alias("r")).first()
        return [(x.criterion, x.weight, x.points) for x in row.p.rubrics], row.r

    assert rubrics_of("array<struct<criterion:string,points:int>>", [("a", 3)]) == ([("a", None, 3.0)], "1 rubrics")
    assert rubrics_of("array<string>", ["a", "b"]) == ([("a", None, None), ("b", None, None)], "2 rubrics")
    assert rubrics_of("variant", '["a", {"text": "b", "weight": 2}, {"points": 1}]') == (
        [("a", None, None), ("b", 2.0, None), ('{"points":1}', None, 1.0)], "3 rubrics",
    )


def test_variant_conversation_through_payload(spark):
    from evalframe.plans.tasks import get_task

    df = spark.sql("""SELECT 1 AS sample_id, parse_json('[{"role": "user", "content": "q"}, [{"role": "tool", "content": "t"}], "s"]') AS conversation""")
    row = df.select(get_task("rubric_chat").payload(df).alias("p")).first()
    assert [(m.role, m.content) for m in row.p.conversation] == [("user", "q"), ("tool", "t"), ("user", "s")]
