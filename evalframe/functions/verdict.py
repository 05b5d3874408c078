"""Grader-reply verdict parsing: reply text → true / false / null.

A verdict is decided in two tiers, first hit wins:

* JSON tier — three candidate texts, in order: the stripped reply, the
  first fenced ```` ```json {..}``` ```` block (lazy) and the span from the
  first ``{`` to the last ``}``. The first candidate that is, as a whole, a
  JSON object whose ``criteria_met`` member is a JSON boolean decides.
* Text tier — on the lower-cased reply: ``"criteria_met": true`` → true,
  ``"criteria_met": false`` → false, the word ``yes`` → true, the word
  ``no`` → false. Otherwise null (the criterion is skipped when scoring).

Everything is a native expression. A reply with at most one ``{`` and at
most one ``}`` has at most one distinct parsable candidate, the brace span:
the usual flat object with one verdict key is decided by a regular
expression, anything else by ``from_json`` reading the member as VARIANT (so
a duplicated key's last value counts, with its JSON type). Replies with more
braces need a strict parse (``from_json`` ignores content after the first
value), so for those rows only each candidate must also be exactly one
object, checked by collapsing nested brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.text import NOT_WORD_AHEAD, NOT_WORD_BEHIND, WS, py_strip

# --- fixed values ---------------------------------------------------------
VERDICT_FIELD = "criteria_met"
FENCED_OBJECT = "```(?:json)?" + WS + "*(\\{.*?\\})" + WS + "*```"
BRACE_SPAN = "(\\{.*\\})"
TRUE_FIELD = '"criteria_met"' + WS + "*:" + WS + "*true"
FALSE_FIELD = '"criteria_met"' + WS + "*:" + WS + "*false"
YES_WORD = NOT_WORD_BEHIND + "yes" + NOT_WORD_AHEAD
NO_WORD = NOT_WORD_BEHIND + "no" + NOT_WORD_AHEAD
# A flat JSON object: escape-free keys; values that are JSON strings, JSON
# numbers, true, false or null; JSON whitespace only.
_JWS = "[ \\t\\n\\r]*"
# JSON string: plain characters or the JSON escapes; keys take no escapes, so
# a key can only spell the verdict field literally (duplicates stay countable).
_JSTRING = '"(?:[^"\\\\\\x00-\\x1f]|\\\\["\\\\/bfnrt]|\\\\u[0-9a-fA-F]{4})*+"'
_JVALUE = "(?:" + _JSTRING + '|true|false|null|-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)'
_JMEMBER = '"[^"\\\\\\x00-\\x1f]*"' + _JWS + ":" + _JWS + _JVALUE
FLAT_OBJECT = "^\\{" + _JWS + "(?:" + _JMEMBER + "(?:" + _JWS + "," + _JWS + _JMEMBER + ")*)?" + _JWS + "\\}$"
VERDICT_KEY = '"criteria_met"' + _JWS + ":"
# --------------------------------------------------------------------------

_JSON_OPTS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def text_rules(lowered: Column) -> Column:
    """Verdict from wording alone (input already lower-cased); null when nothing matches."""
    # each regex only runs when its literal occurs (a cheap substring test first)
    field = lowered.contains('"criteria_met"')
    return (
        F.when(field & lowered.rlike(TRUE_FIELD), F.lit(True))
        .when(field & lowered.rlike(FALSE_FIELD), F.lit(False))
        .when(lowered.contains("yes") & lowered.rlike(YES_WORD), F.lit(True))
        .when(lowered.contains("no") & lowered.rlike(NO_WORD), F.lit(False))
    )


def _one_object(c: Column) -> Column:
    """True when ``c`` is exactly one JSON object (JSON whitespace around it allowed), at any depth.

    As the only element of an array it must parse as one element, and as a
    member it must leave the member after it readable; both fail on trailing
    content and on unbalanced brackets.
    """
    element = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", _JSON_OPTS)
    member = F.from_json(F.concat(F.lit('{"v":'), c, F.lit(',"zz_end":1}')), "v string, zz_end int", _JSON_OPTS)
    starts = F.regexp_replace(c, "^[ \\t\\n\\r]+", "").startswith("{")
    return F.coalesce(starts & (F.size(element) == 1) & (member["zz_end"] == 1), F.lit(False))


def _json_verdict(candidate: Column, strict: bool) -> Column:
    # The member is read as VARIANT: with duplicate keys the last one wins and
    # keeps its JSON type, so only a final boolean decides (a boolean-typed
    # field would keep an earlier boolean when the last value is not one).
    member = F.from_json(candidate, "criteria_met variant", _JSON_OPTS)[VERDICT_FIELD]
    value = F.when(F.schema_of_variant(member) == "BOOLEAN", F.try_variant_get(member, "$", "boolean"))
    return F.when(_one_object(candidate), value) if strict else value


def _flat_verdict(span: Column) -> Column:
    """Decided JSON-tier value for a flat object with one verdict key: true/false, or
    null when the member is not a boolean."""
    v = F.regexp_extract(span, VERDICT_KEY + _JWS + "(true|false)", 1)
    return F.when(v == "true", F.lit(True)).when(v == "false", F.lit(False))


def _verdict_from(stripped: Column, span: Column, fenced: Column, simple: Column, flat: Column, flat_value: Column, by_text: Column) -> Column:
    json_tier = F.when(simple & flat, flat_value).when(simple, _json_verdict(span, strict=False)).otherwise(
        F.coalesce(_json_verdict(stripped, True), _json_verdict(fenced, True), _json_verdict(span, True))
    )
    return F.when(stripped != "", F.coalesce(json_tier, by_text))


def _pieces(stripped: Column) -> dict:
    n_open = F.length(stripped) - F.length(F.replace(stripped, F.lit("{"), F.lit("")))
    n_close = F.length(stripped) - F.length(F.replace(stripped, F.lit("}"), F.lit("")))
    span = F.nullif(F.regexp_extract(stripped, "(?s)" + BRACE_SPAN, 1), F.lit(""))
    simple = (n_open <= 1) & (n_close <= 1)
    # the usual reply shape is decided without a JSON parser
    flat = F.coalesce(span.rlike(FLAT_OBJECT) & (F.regexp_count(span, F.lit(VERDICT_KEY)) == 1), F.lit(False))
    flat_value = _flat_verdict(span)
    return {
        "span": span,
        # fenced blocks only matter for replies with several braces
        "fenced": F.when(~simple, F.nullif(F.regexp_extract(stripped, "(?s)" + FENCED_OBJECT, 1), F.lit(""))),
        # one brace pair at most: every parsable candidate is the brace span itself
        "simple": simple,
        "flat": flat,
        "flat_value": flat_value,
        # wording only matters when the JSON tier is not already decided by the flat path
        "by_text": F.when(~(simple & flat) | flat_value.isNull(), text_rules(F.lower(stripped))),
    }


def parse_verdict(c) -> Column:
    """Three-valued verdict of a grader reply (nullable boolean Column).

    For large inputs prefer ``with_verdict``, which evaluates the shared
    pieces once per row instead of once per use.
    """
    text = F.col(c) if isinstance(c, str) else c
    stripped = py_strip(text)
    return _verdict_from(stripped, **_pieces(stripped))


def with_verdict(df: DataFrame, reply: str, out: str = "criteria_met") -> DataFrame:
    """``df`` plus the verdict of its ``reply`` column.

    ``from_json`` runs outside whole-stage code generation, where repeated
    subexpressions are not shared; so the stripped reply and the candidate
    spans are computed in a code-generated projection first and the verdict
    reads them as columns.
    """
    cols = df.columns
    a = df.select("*", py_strip(F.col(reply)).alias("_v_stripped"))
    b = a.select("*", *[e.alias("_v_" + k) for k, e in _pieces(F.col("_v_stripped")).items()])
    v = _verdict_from(*[F.col("_v_" + k) for k in ("stripped", "span", "fenced", "simple", "flat", "flat_value", "by_text")])
    return b.select(*[F.col(c) for c in cols if c != out], v.alias(out))
