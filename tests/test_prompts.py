"""Prompt building: grader prompt, chat messages, QA options and messages."""

import base64

from pyspark.sql import functions as F

from evalframe.functions.prompts import (
    QA_SYSTEM_PROMPT,
    format_options,
    grader_prompt,
    has_options,
    image_data_url,
    qa_messages,
    payload_messages,
    turn_line,
)
from evalframe.operators.conversation import chat_messages, grading_history, ordered_concat


def test_grader_prompt_contents(spark):
    df = spark.createDataFrame([("User: What is 2+2?", "The answer is 4.", "States the correct sum", "")], "h string, r string, c string, e string")
    row = df.select(grader_prompt("h", "r", "c").alias("p"), grader_prompt("e", "r", "c").alias("q")).first()
    for piece in ("What is 2+2?", "The answer is 4.", "States the correct sum", '"criteria_met"'):
        assert piece in row.p
    assert "## Original Conversation\nUser: \n\n" in row.q


def test_chat_messages_long_form(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "tool", "x"), (1, 3, "assistant", ""), (2, 0, "user", ""), (3, 5, None, "hello")],
        "conv_id int, turn int, role string, text string",
    )
    samples = spark.createDataFrame([(1, None), (2, "fallback prompt"), (3, None), (4, None)], "conv_id int, prompt string")
    out = chat_messages(turns, "conv_id", samples=samples, prompt="prompt").orderBy("conv_id", "msg_idx").collect()
    got = [(r.conv_id, r.msg_idx, r.role, r.content if r.role != "system" or r.msg_idx >= 0 else "SYS") for r in out]
    assert got == [
        (1, -1, "system", "SYS"), (1, 0, "system", "be brief"), (1, 1, "user", "hi"),
        (2, -1, "system", "SYS"), (2, 0, "user", "fallback prompt"),
        (3, -1, "system", "SYS"), (3, 5, "user", "hello"),
        (4, -1, "system", "SYS"), (4, 0, "user", ""),
    ]


def test_grading_history_two_phase(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "ASSISTANT", f"m{t}") for t in range(2500)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    small = grading_history(turns, "conv_id", bucket_rows=64).first().history
    big = grading_history(turns, "conv_id", bucket_rows=10_000).first().history
    expected = "\n\n".join(("User" if t % 2 == 0 else "Assistant") + f": m{t}" for t in range(2500))
    assert small == expected == big


def test_ordered_concat_sparse_orders(spark):
    rows = [(1, o, str(o)) for o in (5, 3000, 17, 999_999, 2)]
    df = spark.createDataFrame(rows, "k int, o long, v string")
    assert ordered_concat(df, "k", "o", "v", ",", 4).first().text == "2,5,17,3000,999999"


def _opts(spark, rows):
    ddl = "i int, options array<string>, option_A string, B string, choice_C string, option_D string"
    df = spark.createDataFrame(rows, ddl)
    keyed = {"option_A": "option_A", "B": "B", "choice_C": "choice_C", "option_D": "option_D"}
    return [
        (r.h, r.t)
        for r in df.select("i", has_options("options", None, keyed).alias("h"), format_options("options", None, keyed).alias("t")).orderBy("i").collect()
    ]


def test_format_options(spark):
    rows = [
        (0, ["p", "q", "r", "s", "t", "u"], None, None, None, None),  # list only, at most five
        (1, ["p", "q"], "a", None, None, None),  # keyed A, then the list from A
        (2, None, "a", "b", None, "d"),  # keyed only, gaps skipped
        (3, None, None, None, "c", None),  # choice_X alone does not make options
        (4, [], None, None, None, None),
    ]
    assert _opts(spark, rows) == [
        (True, "A. p\nB. q\nC. r\nD. s\nE. t"),
        (True, "A. a\nA. p\nB. q"),
        (True, "A. a\nB. b\nD. d"),
        (False, "C. c"),
        (False, ""),
    ]


def test_format_options_all_keyed_with_list(spark):
    """Every letter present plus a list: the keyed letters win and the list is unused."""
    df = spark.createDataFrame([(["p", "q"], "a", "b", "c", "d", "e")], "options array<string>, option_A string, option_B string, option_C string, option_D string, option_E string")
    keyed = {f"option_{x}": f"option_{x}" for x in "ABCDE"}
    row = df.select(format_options("options", None, keyed).alias("t")).first()
    assert row.t == "A. a\nB. b\nC. c\nD. d\nE. e"


def test_qa_messages_with_image(spark):
    img = bytes(range(200))
    df = spark.createDataFrame([("Q?", "A. x", True, img), ("Open?", "", False, None)], "q string, o string, h boolean, img binary")
    out = df.select(qa_messages("q", "o", "h", "img").alias("m"), image_data_url("img").alias("u")).collect()
    first, second = out[0].m, out[1].m
    assert first[0].role == "system" and first[0].content[0].text == QA_SYSTEM_PROMPT
    assert [p.type for p in first[1].content] == ["image_url", "text"]
    assert first[1].content[0].url == "data:image/jpeg;base64," + base64.b64encode(img).decode()
    assert first[1].content[1].text.startswith("Q?\n\nOptions:\nA. x\n\nAnswer with the letter")
    assert [p.type for p in second[1].content] == ["text"]
    assert second[1].content[0].text == "Open?\n\nAnswer as concisely as possible using only the final answer."
    assert out[1].u is None


def test_payload_lists_unroll_at_any_depth(spark):
    deep = "[" * 9 + '{"role": "assistant", "content": "a [b] \\"["}' + "]" * 9
    payload = f'["x", {deep}, [], [["y"], null, 3], {{"role": null, "content": "gone"}}]'
    rows = spark.createDataFrame([(payload,), ('""',), ("[]",), (None,)], "j string").selectExpr("parse_json(j) AS v")
    got = [[(m.role, m.content) for m in r[0]] for r in rows.select(payload_messages("v")).collect()]
    assert got == [[("user", "x"), ("assistant", 'a [b] "['), ("user", "y")], [], [], []]


def test_empty_option_without_choice_field_is_missing(spark):
    row = spark.createDataFrame([("", "x")], "option_A string, option_B string")
    text = row.select(format_options(keyed={"option_A": "option_A", "option_B": "option_B"})).first()[0]
    assert text == "B. x"


def test_null_role_reads_as_default_role(spark):
    assert spark.range(1).select(turn_line(F.lit(None).cast("string"), F.lit("hi"))).first()[0] == "User: hi"
