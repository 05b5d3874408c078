"""Physical-plan properties of the registered queries (scale guards)."""

import pytest

import __spark_entry__ as entry_mod
from evalframe.catalog.fixtures import rubric_criteria
from evalframe.functions.verdict import with_verdict

SF = "/root/testdata/sf0.001"
# queries whose construction writes nothing (plans only, cheap to build)
PURE = [
    "qa_accuracy_by_category", "qa_batch_accuracy_mixed", "qa_record_grade", "normalize_answer", "extract_choice",
    "parse_verdict", "rubric_score_per_sample", "rubric_score_dataset", "chat_messages", "grading_history",
    "grader_prompt", "qa_prompt", "reference_column", "resume_pending", "merge_keyed", "merge_prefix",
    "evaluation_upsert", "run_key", "validate_dataset", "generate_stub", "grade_stub", "avg_response_length",
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_no_nested_loop_or_cartesian(spark, name):
    plan = _plan(entry_mod.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scan_prunes_columns(spark):
    plan = _plan(entry_mod.queries()["qa_accuracy_by_category"](spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("o_totalprice" not in s and "o_orderdate" not in s for s in scans)


def test_verdict_pieces_are_code_generated(spark):
    plan = _plan(with_verdict(rubric_criteria(spark, SF), "reply", "v"))
    assert "regexp_extract" in plan
    generated = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("*(")]
    assert any("regexp_extract" in line or "trim(" in line for line in generated)


def test_rubric_scores_aggregate_before_the_shuffle(spark):
    """A sample holding a third of all criteria still ships one partial row per task."""
    plan = _plan(entry_mod.queries()["rubric_score_per_sample"](spark, SF))
    exchange = plan.index("Exchange hashpartitioning(sample_id")
    assert "partial_sum" in plan[exchange:] and "partial_count" in plan[exchange:]


def test_history_concat_is_two_phase(spark):
    plan = _plan(entry_mod.queries()["grading_history"](spark, SF))
    assert plan.count("Exchange hashpartitioning(conv_id") >= 2
