"""Prompt texts and prompt-building Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.functions.text import capitalize

# --- fixed values ---------------------------------------------------------
CHAT_SYSTEM_PROMPT = (
    "You are a knowledgeable and helpful medical AI assistant. "
    "Provide clear, accurate, and compassionate responses to health-related questions. "
    "Always recommend consulting a healthcare professional for personalized medical advice."
)
QA_SYSTEM_PROMPT = (
    "You are a multimodal AI assistant with strong visual understanding capabilities. "
    "You will be presented with an image and a question. "
    "Choose the single best answer from the provided options."
)
QA_CHOICE_TEMPLATE = (
    "{question}\n\nOptions:\n{options}\n\n"
    "Answer with the letter of the correct option only (e.g., A, B, C, or D)."
)
QA_OPEN_TEMPLATE = "{question}\n\nAnswer as concisely as possible using only the final answer."
GRADER_TEMPLATE = (
    "You are evaluating an AI assistant's response to a health-related question.\n\n"
    "## Original Conversation\n{history}\n\n"
    "## AI Response to Evaluate\n{response}\n\n"
    "## Evaluation Criterion\n{criterion}\n\n"
    "## Instructions\n"
    "Determine whether the AI response clearly satisfies the criterion above. "
    "Be precise and conservative.\n"
    "Respond with a JSON object using this schema: "
    '{{"explanation": "Brief explanation of your reasoning", "criteria_met": true/false}}'
)
EMPTY_HISTORY = "User: "
CHAT_ROLES = ("user", "assistant", "system")
OPTION_LETTERS = ("A", "B", "C", "D", "E")
IMAGE_URL_PREFIX = "data:image/jpeg;base64,"
GRADER_MAX_TOKENS = 256
# --------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template: str, **cols) -> Column:
    """Fill a ``str.format`` template with Columns (literal parts stay literals)."""
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(_c(cols[field]))
    return F.concat(*parts)


def turn_line(role, content) -> Column:
    """One history line ``"{Role}: {content}"`` (role capitalised, rest lower); a null role reads as the default role."""
    return F.concat(capitalize(F.coalesce(_c(role), F.lit("user"))), F.lit(": "), _c(content))


def grader_prompt(history, response, criterion) -> Column:
    """Prompt asking a grader whether ``response`` satisfies ``criterion``; an empty history reads ``User: ``."""
    h = F.coalesce(F.nullif(_c(history), F.lit("")), F.lit(EMPTY_HISTORY))
    return fill(GRADER_TEMPLATE, history=h, response=response, criterion=criterion)


def has_options(options=None, choices=None, keyed: dict | None = None, texts: list | None = None) -> Column:
    """A QA sample has options when its ``options``/``choices`` list is non-empty or any
    ``option_X``/``X`` field is present (``choice_X`` fields are not consulted). ``texts``:
    options or choices given as one text, which count unless empty."""
    conds = [F.coalesce(_c(t) != "", F.lit(False)) for t in texts or []]
    for lst in (options, choices):
        if lst is not None:
            conds.append(F.coalesce(F.size(_c(lst)) > 0, F.lit(False)))
    for letter in OPTION_LETTERS:
        for name in (f"option_{letter}", letter):
            if keyed and name in keyed:
                conds.append(_c(keyed[name]).isNotNull())
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def format_options(options=None, choices=None, keyed: dict | None = None, text=None) -> Column:
    """Lettered option list, or ``text`` (options given as one text) as it is where nothing is listed.

    For A..E the keyed value is ``option_X or X or choice_X``. Keyed letters are
    listed until the first missing one; at that point a non-empty options list
    (``options or choices``) is listed instead, lettered from A, at most five
    items, and listing stops. Without a list, missing letters are skipped.
    """
    if text is not None:
        return F.coalesce(F.nullif(format_options(options, choices, keyed), F.lit("")), _c(text), F.lit(""))
    keyed = keyed or {}
    lst = None
    for c in (options, choices):
        if c is not None:
            nonempty = F.when(F.size(_c(c)) > 0, _c(c))
            lst = nonempty if lst is None else F.coalesce(lst, nonempty)

    vals = []
    for letter in OPTION_LETTERS:
        first = [F.nullif(_c(keyed[n]), F.lit("")) for n in (f"option_{letter}", letter) if keyed.get(n) is not None]
        choice = keyed.get(f"choice_{letter}")
        vals.append(F.coalesce(*first, F.lit(None).cast("string") if choice is None else _c(choice)))
    keyed_lines = F.array(
        *[F.when(v.isNotNull(), F.concat(F.lit(f"{letter}. "), v)) for letter, v in zip(OPTION_LETTERS, vals)]
    )
    letters = F.array(*[F.lit(x) for x in OPTION_LETTERS])
    all_keyed = F.array_join(F.filter(keyed_lines, lambda x: x.isNotNull()), "\n")
    if lst is None:
        return all_keyed
    # index of the first missing keyed letter (0-based), 5 when none is missing
    missing_at = F.array_position(F.transform(keyed_lines, lambda x: x.isNull()), F.lit(True))  # 1-based, 0 = none
    first_missing = F.when(missing_at == 0, F.lit(5)).otherwise(missing_at - 1)
    before = F.slice(keyed_lines, F.lit(1), first_missing)
    listed = F.transform(
        F.slice(lst, 1, len(OPTION_LETTERS)),
        lambda x, i: F.concat(F.element_at(letters, i + 1), F.lit(". "), x.cast("string")),
    )
    with_list = F.array_join(F.concat(before, listed), "\n")
    return F.when(lst.isNotNull() & (first_missing < 5), with_list).otherwise(all_keyed)


def qa_user_text(question, options_text, has_opts) -> Column:
    """User text of a QA prompt: the multiple-choice or the open-ended template."""
    q = F.coalesce(_c(question), F.lit(""))
    return F.when(_c(has_opts), fill(QA_CHOICE_TEMPLATE, question=q, options=options_text)).otherwise(
        fill(QA_OPEN_TEMPLATE, question=q)
    )


def image_data_url(image) -> Column:
    """``data:image/jpeg;base64,...`` URL of image bytes (base64 without line breaks)."""
    b64 = F.replace(F.base64(_c(image)), F.lit("\r\n"), F.lit(""))
    return F.when(_c(image).isNotNull(), F.concat(F.lit(IMAGE_URL_PREFIX), b64))


def qa_messages(question, options_text, has_opts, image=None) -> Column:
    """Chat messages of a QA sample: system text, then one user message whose content
    parts are the optional image URL and the text."""
    part = "struct<type:string,text:string,url:string>"
    text_part = F.struct(F.lit("text").alias("type"), qa_user_text(question, options_text, has_opts).alias("text"), F.lit(None).cast("string").alias("url"))
    parts = F.array(text_part)
    if image is not None:
        img = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), image_data_url(image).alias("url"))
        parts = F.when(_c(image).isNotNull(), F.array(img, text_part)).otherwise(parts)
    sys_part = F.array(F.struct(F.lit("text").alias("type"), F.lit(QA_SYSTEM_PROMPT).alias("text"), F.lit(None).cast("string").alias("url")))
    return F.array(
        F.struct(F.lit("system").alias("role"), sys_part.cast(f"array<{part}>").alias("content")),
        F.struct(F.lit("user").alias("role"), parts.cast(f"array<{part}>").alias("content")),
    )


PAYLOAD_MESSAGE = "array<struct<role:string,content:string>>"
VARIANTS = "array<variant>"


def _is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def _bracket_depth(v: Column) -> Column:
    """How deep square brackets nest in a VARIANT's JSON text, string contents left out (0: no list)."""
    bare = F.regexp_replace(F.to_json(v), '"(?:[^"\\\\]|\\\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, "[^\\[\\]]", ""), "")
    step = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))

    def walk(acc, mark):
        at = acc["at"] + F.when(mark == "[", 1).when(mark == "]", -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(acc["top"], at).alias("top"))

    return F.aggregate(marks, step, walk, lambda acc: acc["top"])


def payload_items(v) -> Column:
    """The strings, objects and other scalars of a VARIANT payload in order, lists unrolled at any depth."""
    v = _c(v)
    rounds = F.when(_is_list(v), _bracket_depth(v)).otherwise(F.lit(0))
    turns = F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>"))

    def unroll(items, _):
        return F.flatten(F.transform(items, lambda x: F.when(_is_list(x), F.try_variant_get(x, "$", VARIANTS)).otherwise(F.array(x))))

    return F.aggregate(turns, F.array(v), unroll)


def raw_message(v: Column, default_role: str = "user") -> Column:
    """(role, content) of one payload item: absent role → default role; non-string content → JSON text."""
    kind = F.schema_of_variant(v)
    role_v = F.try_variant_get(v, "$.role", "variant")
    role = F.when(role_v.isNull(), F.lit(default_role)).when(~F.is_variant_null(role_v), F.try_variant_get(role_v, "$", "string"))
    content_v = F.try_variant_get(v, "$.content", "variant")
    content = F.when(content_v.isNull() | F.is_variant_null(content_v), F.lit(None).cast("string")).when(
        F.schema_of_variant(content_v) == "STRING", F.try_variant_get(content_v, "$", "string")
    ).otherwise(F.to_json(content_v))
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "STRING", F.struct(F.lit(default_role).alias("role"), text.alias("content"))).when(
        kind.startswith("OBJECT"), F.struct(role.alias("role"), content.alias("content"))
    )


def payload_messages(v, default_role: str = "user") -> Column:
    """Messages of a mixed-shape chat payload held as VARIANT.

    A string becomes one message with the default role when non-empty. An
    object is kept when its role (absent → default role; JSON null → dropped)
    is user/assistant/system and its content is neither null nor "";
    non-string content is kept as JSON text. A list contributes the messages
    of its items, in order, however deep lists nest. Anything else contributes
    nothing.
    """
    found = F.transform(payload_items(v), lambda x: raw_message(x, default_role))
    kept = F.filter(found, lambda m: F.coalesce(m["role"].isin(*CHAT_ROLES) & (m["content"] != ""), F.lit(False)))
    return F.coalesce(kept.cast(PAYLOAD_MESSAGE), F.array().cast(PAYLOAD_MESSAGE))


def variant_truthy(v) -> Column:
    """Python truthiness of a VARIANT value: null, "", 0, false, [] and {} are false."""
    v = _c(v)
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0)
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )
