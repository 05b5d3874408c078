"""Grader-reply verdicts: literal cases and a randomised check of the JSON tier."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from frames import collect_ordered, one_col
from evalframe.functions.verdict import parse_verdict, with_verdict

CASES = [
    ('{"criteria_met": true, "explanation": "ok"}', True),
    ('```json\n{"criteria_met": false}\n```', False),
    ("Yes, the response meets the criterion.", True),
    ("No, it does not.", False),
    ("yes", True),
    ("no", False),
    ("I cannot determine this.", None),
    ("", None),
    ("   ", None),
    ('{"criteria_met": null, "explanation":"yes"}', True),
    ('{"criteria_met": "true"}', None),
    ("No ... but yes", True),
    ("nope, Norway", None),
    ('{"a": {"b": 1}, "criteria_met": true}', True),
    ('first {"criteria_met": true} then {"criteria_met": false}', True),
    ('```json\n{"criteria_met": false}\n``` and {"criteria_met": true}', False),
    ('{"criteria_met": false, "criteria_met": true}', True),
    ("{'criteria_met': true}", None),
    ('{"criteria_met": true} trailing', True),
    ('{"criteria_met": NaN}', None),
    ('{"x": {"criteria_met": false}} yes', False),
    ('[{"criteria_met": true}]', True),
    ('{"criteria_met": false} {"criteria_met": true}', True),
    ('{"x": "}{", "criteria_met": false}', False),
    ('{"a": [1, {"b": 2}], "criteria_met": false}}', False),
    ('"criteria_met":false', False),
    ('{"explanation": "says \\"no\\" twice\\n", "criteria_met": true}', True),
    ('{"explanation": "quote \\"criteria_met\\": false", "criteria_met": true}', True),
    ('{"explanation": "bad escape \\q", "criteria_met": true}', True),
    ('{"e": "\\u00e9", "criteria_met": false, "n": -1.5e3, "l": [1, "x"]}', False),
    # duplicate verdict keys: the last one counts, a non-boolean last value defers to the wording
    ('{"criteria_met": true, "x": 1} ```json\n{"criteria_met": false, "a": [], "criteria_met": "true"}\n```', True),
    ('{"a": {"b": 1}, "criteria_met": false, "criteria_met": true}', True),
    # a stray closing brace after an object is trailing content
    ('{"x": "no", "criteria_met": false}}{"criteria_met": true}', True),
    ('{"x": "k", "criteria_met": true}\n}\n```json\n{"e": "a \\"q\\" }", "criteria_met": false}\n```', False),
]


def test_literal_cases(spark):
    df = one_col(spark, [t for t, _ in CASES])
    got = collect_ordered(df.select("i", parse_verdict("x").alias("v")), "v")
    assert got == [v for _, v in CASES]
    got2 = collect_ordered(with_verdict(df, "x", "v"), "v")
    assert got2 == got


def _decisive(candidate):
    """True/False when the text is exactly one JSON object with a boolean verdict member."""
    try:
        obj = json.loads(candidate)
    except ValueError:
        return None
    member = obj.get("criteria_met") if type(obj) is dict else None
    return member if type(member) is bool else None


def _json_tier(text):
    """Expected JSON-tier outcome: whole reply, first fenced object, outermost brace span."""
    import re

    body = text.strip()
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", body, re.DOTALL)
    lo, hi = body.find("{"), body.rfind("}")
    spans = [body, fenced.group(1) if fenced else None, body[lo: hi + 1] if 0 <= lo < hi else None]
    return next((v for v in map(_decisive, filter(None, spans)) if v is not None), None)


_values = st.recursive(
    st.one_of(st.booleans(), st.none(), st.integers(-5, 5), st.text("ab{}[]\" ", max_size=4)),
    lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(st.sampled_from(["criteria_met", "x", "y"]), inner, max_size=3)),
    max_leaves=6,
)
_pieces = st.one_of(
    _values.map(json.dumps),
    st.sampled_from([" ", "\n", "```json\n", "\n```", "}", "{", "ok ", ",", '"criteria_met": 1']),
)


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(_pieces, min_size=1, max_size=4))
def test_json_tier_matches_strict_parse(spark, parts):
    text = "".join(parts)
    expected = _json_tier(text)
    if expected is None:
        return  # text tier decides; covered by the literal cases
    df = one_col(spark, [text])
    got = collect_ordered(df.select("i", parse_verdict("x").alias("v")), "v")[0]
    assert got == expected, text


def test_verdict_at_any_depth(spark):
    """A deep member before the verdict changes nothing (the outer value decides)."""
    replies = ['{"detail": {"criteria_met": true, "deep": ' + "[" * n + "1" + "]" * n + '}, "criteria_met": false}' for n in (1, 10, 16, 17, 20, 40)]
    df = spark.createDataFrame([(r,) for r in replies], "reply string")
    got = [r["verdict"] for r in with_verdict(df, "reply", "verdict").collect()]
    assert got == [False] * len(replies)
