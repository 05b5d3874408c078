"""Task plug-ins: how a dataset becomes prompts, records, grades and metrics.

A task is a ``TaskSpec`` of DataFrame/Column functions. Everything except
the model call is a Column expression, so a task's whole grading plan is one
Catalyst plan that works in batch and in Structured Streaming alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType, VariantType

from evalframe.functions.prompts import (
    CHAT_ROLES,
    CHAT_SYSTEM_PROMPT,
    GRADER_MAX_TOKENS,
    OPTION_LETTERS,
    format_options,
    grader_prompt,
    payload_items,
    payload_messages,
    raw_message,
    variant_truthy,
    has_options,
    qa_messages,
    turn_line,
)
from evalframe.functions.text import first_nonempty, py_strip
from evalframe.functions.verdict import with_verdict
from evalframe.operators.infer import GenerationConfig, RetryPolicy, generate
from evalframe.operators.metrics import avg_response_length, category_label, dataset_rubric_metrics, grade_qa, record_accuracy
from evalframe.operators.rubric import explode_criteria, score_samples
from evalframe.sources.files import read_if_exists
from evalframe.sources.ledger import GRADE_PASS, VERSION, newest, next_pass

Judge = Callable[[], Callable[..., str]]

_PART = "struct<type:string,text:string,url:string>"
MESSAGE_TYPE = f"array<struct<role:string,content:array<{_PART}>>>"


@dataclass
class TaskSpec:
    """Functions describing one evaluation task.

    messages(samples) → Column of model input messages
    reference(samples) → Column of reference text
    payload(samples) → Column (struct) kept with each record for later grading
    grade(records, judge, details_path, **judge_options) → DataFrame (sample_id, evaluation), with
        the records' record_version where they have one and the task carries it; a task with
        per-item details (rubric criteria) appends them under details_path;
        judge_options (partitions, concurrency, on_error, retry) are passed only when given
    aggregate(records_with_evaluation, judged) → DataFrame (metric, value, n)
    """

    name: str
    messages: Callable[[DataFrame], Column]
    reference: Callable[[DataFrame], Column]
    payload: Callable[[DataFrame], Column]
    grade: Callable[..., DataFrame]
    aggregate: Callable[[DataFrame, bool], DataFrame]
    description: str = ""
    complete: Callable[[Column], Column] | None = None  # of a stored evaluation: nothing is left to grade; None: always
    graded_by_model: bool = False  # grading needs a judge model; without one, aggregate(…, judged=False)


_REGISTRY: dict[str, TaskSpec] = {}


def register(spec: TaskSpec) -> TaskSpec:
    """Add (or replace) a task under its name."""
    _REGISTRY[spec.name] = spec
    return spec


def get_task(name: str) -> TaskSpec:
    if name not in _REGISTRY:
        raise ValueError(f"No task named '{name}'; registered: {', '.join(_REGISTRY)}")
    return _REGISTRY[name]


def list_tasks() -> list[str]:
    return list(_REGISTRY)


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """A column when the input has it, else a typed null (absent fields read as null)."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def base_reference(df: DataFrame) -> Column:
    """Default reference for a custom task: ``answer``, else ``label``, else "" (as text)."""
    return F.coalesce(col_or_null(df, "answer").cast("string"), col_or_null(df, "label").cast("string"), F.lit(""))


def _text_message(role, text) -> Column:
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("url"))
    return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), F.array(part).alias("content"))


# ---------------------------------------------------------------- QA task
def _keyed_options(df: DataFrame) -> dict:
    names = [f"{p}{x}" for x in OPTION_LETTERS for p in ("option_", "", "choice_")]
    return {n: n for n in names if n in df.columns}


def _option_columns(df: DataFrame) -> dict:
    """``options`` and ``choices`` by kind: lists under their own names, texts under ``texts``."""
    given = [n for n in ("options", "choices") if n in df.columns]
    texts = [n for n in given if isinstance(df.schema[n].dataType, StringType)]
    return {n: n if n in given and n not in texts else None for n in ("options", "choices")} | {"texts": texts}


def _qa_messages(df: DataFrame) -> Column:
    keyed, found = _keyed_options(df), _option_columns(df)
    opt = has_options(keyed=keyed, **found)
    text = format_options(found["options"], found["choices"], keyed, text="options" if "options" in found["texts"] else None)
    image = None
    for n in ("image", "Image"):
        if n in df.columns:
            image = F.col(n) if image is None else F.coalesce(image, F.col(n))
    question = F.coalesce(col_or_null(df, "question"), col_or_null(df, "Question"), F.lit(""))
    return qa_messages(question, text, opt, image).cast(MESSAGE_TYPE)


def _qa_answer(df: DataFrame) -> Column:
    return first_nonempty(col_or_null(df, "answer"), col_or_null(df, "Answer"), F.coalesce(col_or_null(df, "gt_answer"), F.lit("")))


def _qa_reference(df: DataFrame) -> Column:
    return F.upper(py_strip(_qa_answer(df)))


def _qa_payload(df: DataFrame, strict: bool = False) -> Column:
    found = _option_columns(df)
    opts, chs = found["options"], found["choices"]
    # strict: only a non-empty options/choices list survives persistence, so
    # samples given as option_X fields are graded by exact match later
    opt = has_options(keyed={} if strict else _keyed_options(df), **found)
    lst = None
    for c in (opts, chs):
        if c is not None:
            ne = F.when(F.size(c) > 0, F.col(c))
            lst = ne if lst is None else F.coalesce(lst, ne)
    lst = lst if lst is not None else F.lit(None).cast("array<string>")
    return F.struct(
        _qa_answer(df).alias("answer"),
        col_or_null(df, "category").alias("category"),
        col_or_null(df, "type").alias("type"),
        col_or_null(df, "task_type").alias("task_type"),
        F.when(opt, F.coalesce(lst, F.array().cast("array<string>"))).alias("options"),
        opt.alias("has_options"),
    )


def _offers_options(records: DataFrame):
    """Whether a record's question had options: its flag, or the stored options themselves (either may be absent)."""
    fields = records.schema["evaluation_sample"].dataType.names
    s = F.col("evaluation_sample")
    flag = F.coalesce(s["has_options"], F.lit(False)) if "has_options" in fields else F.lit(False)
    return flag | F.coalesce(F.size(s["options"]) > 0, F.lit(False)) if "options" in fields else flag


def _qa_grade(records: DataFrame, judge: Judge | None = None, details_path: str | None = None) -> DataFrame:
    s = F.col("evaluation_sample")
    ref = first_nonempty(F.col("reference"), F.upper(py_strip(F.coalesce(s["answer"], F.lit("")))))
    ev = F.struct(
        grade_qa(F.coalesce(F.col("prediction"), F.lit("")), ref, _offers_options(records)).alias("correct"),
        category_label(s["category"], s["type"], s["task_type"]).alias("category"),
    )
    return records.select("sample_id", *_version_of(records), ev.alias("evaluation"))


def _version_of(records: DataFrame) -> list[str]:
    return [VERSION] if VERSION in records.columns else []


def _qa_aggregate(records: DataFrame, judged: bool = True) -> DataFrame:
    return record_accuracy(records.select(F.col("evaluation.correct").alias("correct"), F.col("evaluation.category").alias("category")))


def choice_qa_task(strict_payload: bool = False) -> TaskSpec:
    """The QA task; ``strict_payload`` reproduces the original persisted payload,
    which keeps only an options list (keyed option fields are lost on save)."""
    return TaskSpec(
        name="choice_qa_strict" if strict_payload else "choice_qa",
        description="Image/text questions with lettered options or open answers; graded by choice or exact match.",
        messages=_qa_messages,
        reference=_qa_reference,
        payload=lambda df: _qa_payload(df, strict_payload),
        grade=_qa_grade,
        aggregate=_qa_aggregate,
    )


CHOICE_QA = register(choice_qa_task())
CHOICE_QA_STRICT = register(choice_qa_task(strict_payload=True))


# --------------------------------------------------------- rubric chat task
MESSAGE_IN = "array<struct<role:string,content:string>>"


def _norm_messages(arr: Column) -> Column:
    kept = F.filter(
        arr,
        lambda m: F.coalesce(m["role"], F.lit("user")).isin(*CHAT_ROLES) & m["content"].isNotNull() & (m["content"] != ""),
    )
    return F.transform(kept, lambda m: _text_message(F.coalesce(m["role"], F.lit("user")), m["content"]))


def _is_variant(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, VariantType)


def _payload_as_messages(df: DataFrame, name: str) -> Column:
    """Typed array of messages, or a mixed-shape VARIANT payload, as chat messages."""
    if _is_variant(df, name):
        return F.transform(payload_messages(F.col(name)), lambda m: _text_message(m["role"], m["content"]))
    return _norm_messages(F.coalesce(col_or_null(df, name, MESSAGE_IN), F.array().cast(MESSAGE_IN)))


def _prompt_messages(df: DataFrame) -> Column:
    """``prompt or question``: a string gives one user message; a VARIANT prompt
    may also be a message object or a list."""
    question = F.coalesce(col_or_null(df, "question"), F.lit(""))
    if _is_variant(df, "prompt"):
        p = F.col("prompt")
        truthy = variant_truthy(p)
        from_q = F.when(question != "", F.array(_text_message("user", question)))
        return F.when(truthy, F.transform(payload_messages(p), lambda m: _text_message(m["role"], m["content"]))).otherwise(from_q)
    prompt = first_nonempty(col_or_null(df, "prompt"), question)
    return F.when(prompt != "", F.array(_text_message("user", prompt)))


def _chat_messages(df: DataFrame) -> Column:
    from_conv = _payload_as_messages(df, "conversation")
    from_prompt = _prompt_messages(df)
    empty_user = F.array(_text_message("user", F.lit("")))
    body = F.coalesce(F.when(F.size(from_conv) > 0, from_conv), F.when(F.size(from_prompt) > 0, from_prompt), empty_user)
    return F.concat(F.array(_text_message("system", F.lit(CHAT_SYSTEM_PROMPT))), body).cast(MESSAGE_TYPE)


RUBRIC_IN = "array<struct<criterion:string,text:string,weight:double,points:double>>"


def _rubric(text, weight=None, points=None) -> Column:
    number = lambda x: (F.lit(None) if x is None else x).cast("double")
    return F.struct(text.alias("criterion"), F.lit(None).cast("string").alias("text"), number(weight).alias("weight"), number(points).alias("points"))


def _rubrics_in(df: DataFrame, name: str) -> Column:
    """A rubric list of any shape as ``RUBRIC_IN``: bare strings, structs with some of its
    fields, or VARIANT items of both kinds. A criterion without text is its JSON text."""
    if name not in df.columns:
        return F.lit(None).cast(RUBRIC_IN)
    kind, items = df.schema[name].dataType, F.col(name)
    if kind.simpleString() == RUBRIC_IN:
        return items
    if isinstance(kind, VariantType):
        items, kind = F.try_variant_get(items, "$", "array<variant>"), ArrayType(VariantType())
    if not isinstance(kind, ArrayType):
        raise ValueError(f"'{name}' must be an array or a VARIANT, not {kind.simpleString()}")
    inner = kind.elementType
    if isinstance(inner, VariantType):
        def one(x):
            get = lambda path, t: F.try_variant_get(x, path, t)
            bare = F.schema_of_variant(x) == "STRING"
            text = F.when(bare, get("$", "string")).otherwise(first_nonempty(get("$.criterion", "string"), get("$.text", "string"), F.to_json(x)))
            return _rubric(text, get("$.weight", "double"), get("$.points", "double"))
    elif isinstance(inner, StructType):
        names = set(inner.fieldNames())
        texts = [n for n in ("criterion", "text") if n in names]

        def one(x):
            text = first_nonempty(*[x[n].cast("string") for n in texts], F.to_json(x))
            return _rubric(text, x["weight"] if "weight" in names else None, x["points"] if "points" in names else None)
    else:
        def one(x):
            return _rubric(x.cast("string"))
    return F.transform(items, one).cast(RUBRIC_IN)


def _conversation_in(df: DataFrame) -> Column:
    """The stored conversation: every turn of a typed array or of a VARIANT payload (no role filter)."""
    if _is_variant(df, "conversation"):
        turns = F.filter(F.transform(payload_items(F.col("conversation")), lambda x: raw_message(x)), lambda m: m.isNotNull())
        return turns.cast(MESSAGE_IN)
    return col_or_null(df, "conversation", MESSAGE_IN)


def _rubric_list(df: DataFrame) -> Column:
    r, c = _rubrics_in(df, "rubrics"), _rubrics_in(df, "criteria")
    return F.coalesce(F.when(F.size(r) > 0, r), F.when(F.size(c) > 0, c), F.array().cast(RUBRIC_IN))


def _chat_reference(df: DataFrame) -> Column:
    return F.concat(F.size(_rubric_list(df)).cast("string"), F.lit(" rubrics"))


def _chat_payload(df: DataFrame) -> Column:
    return F.struct(
        F.coalesce(_conversation_in(df), F.array().cast(MESSAGE_IN)).alias("conversation"),
        (F.col("prompt") if "prompt" in df.columns else F.lit(None).cast("string")).alias("prompt"),
        col_or_null(df, "question").alias("question"),
        F.coalesce(_rubrics_in(df, "rubrics"), F.array().cast(RUBRIC_IN)).alias("rubrics"),
        F.coalesce(_rubrics_in(df, "criteria"), F.array().cast(RUBRIC_IN)).alias("criteria"),
    )


def grading_history_of(sample: Column, variant_prompt: bool = False) -> Column:
    """Grader history of one stored sample: the raw conversation when non-empty
    (every turn, no role filter); else the messages of ``prompt or question``."""
    conv = sample["conversation"]
    conv_lines = F.array_join(F.transform(conv, lambda m: turn_line(m["role"], F.coalesce(m["content"], F.lit("None")))), "\n\n")
    question = F.coalesce(sample["question"], F.lit(""))
    from_question = F.when(question != "", F.concat(F.lit("User: "), question)).otherwise(F.lit(""))
    if variant_prompt:
        p = sample["prompt"]
        msgs = payload_messages(p)
        from_prompt = F.array_join(F.transform(msgs, lambda m: turn_line(m["role"], m["content"])), "\n\n")
        fallback = F.when(variant_truthy(p), from_prompt).otherwise(from_question)
    else:
        prompt = first_nonempty(sample["prompt"], question)
        fallback = F.when(prompt != "", F.concat(F.lit("User: "), prompt)).otherwise(F.lit(""))
    return F.when(F.size(conv) > 0, conv_lines).otherwise(fallback)


def _stored_prompt_is_variant(records: DataFrame) -> bool:
    fields = records.schema["evaluation_sample"].dataType
    return "prompt" in fields.fieldNames() and isinstance(fields["prompt"].dataType, VariantType)


def newest_verdicts(ledger: DataFrame) -> DataFrame:
    """One row per (sample, record version, criterion) of a criterion ledger: the newest good call, else the newest failed one."""
    return newest(ledger, ["sample_id", VERSION, "criterion_idx"], F.struct(F.col("error").isNull(), GRADE_PASS))


def _judge_calls(crit: DataFrame, keys: list[str], judge: Judge, partitions: int | None, concurrency: int, on_error: str, retry: RetryPolicy | None) -> DataFrame:
    """Every criterion with the judge's reply, its error and the parsed verdict."""
    prompts = crit.select(
        *keys, "criterion", "weight",
        F.array(_text_message("user", grader_prompt("history", "prediction", "criterion"))).cast(MESSAGE_TYPE).alias("messages"),
    )
    replies = generate(
        prompts.repartition(partitions, *keys) if partitions else prompts.repartition(*keys),
        "messages",
        judge,
        out="reply",
        carry=[*keys, "criterion", "weight"],
        config=GenerationConfig(max_tokens=GRADER_MAX_TOKENS, temperature=0.0, options={"response_format": {"type": "json_object"}}),
        retry=retry or RetryPolicy(),
        on_error=on_error,
        concurrency=concurrency,
    )
    return with_verdict(replies, "reply", "criteria_met")


def _chat_grade(
    records: DataFrame,
    judge: Judge | None = None,
    details_path: str | None = None,
    *,
    partitions: int | None = None,
    concurrency: int = 1,
    on_error: str = "fail",
    retry: RetryPolicy | None = None,
) -> DataFrame:
    """Rubric grading. The judge's calls are dealt over ``partitions`` tasks by
    (sample, criterion), so one record's criteria do not wait for each other.

    With ``details_path`` the verdicts are a ledger of (sample, record version,
    criterion, pass) rows. A pass calls the judge only for criteria of the
    present records that have no good call there yet, adds its rows, and scores
    the records from the newest good call of each criterion, so a judge that
    was down for some calls is asked for those alone. ``on_error="null"`` keeps
    a failed call as a row with its error and no verdict; the evaluation counts
    them (``n_failed``) and is not complete before none is left."""
    version = _version_of(records)
    keys = ["sample_id", *version, "criterion_idx"]
    s = records.select(
        "sample_id",
        *version,
        F.coalesce(F.col("prediction"), F.lit("")).alias("prediction"),
        grading_history_of(F.col("evaluation_sample"), _stored_prompt_is_variant(records)).alias("history"),
        F.col("evaluation_sample.rubrics").alias("rubrics"),
        F.col("evaluation_sample.criteria").alias("criteria"),
    )
    crit = explode_criteria(s, "sample_id", "rubrics", "criteria", carry=[*version, "history", "prediction"])
    run_id = None
    if judge is None:
        judged = crit.select(*keys, "criterion", "weight", F.lit(None).cast("boolean").alias("criteria_met"), F.lit(None).cast("string").alias("error"))
    elif details_path is None or not version:
        judged = _judge_calls(crit, keys, judge, partitions, concurrency, on_error, retry)
    else:
        spark, run_id = records.sparkSession, uuid.uuid4().hex
        ledger = read_if_exists(spark.read.parquet, details_path)
        todo = crit if ledger is None else crit.join(ledger.where("error is null").select(*keys), keys, "left_anti")
        calls = _judge_calls(todo, keys, judge, partitions, concurrency, on_error, retry)
        calls.withColumns({GRADE_PASS: F.lit(next_pass(ledger, GRADE_PASS)).cast("bigint"), "grade_run": F.lit(run_id)}).write.mode("append").parquet(details_path)
        ledger = spark.read.parquet(details_path).join(s.select("sample_id", VERSION), ["sample_id", VERSION], "left_semi")
        judged = newest_verdicts(ledger)
    scored = score_samples(judged, "sample_id", failed="error")
    out = s.select("sample_id", *version).join(scored, "sample_id", "left")
    zero = F.lit(0).cast("bigint")
    ev = F.struct(
        F.coalesce("rubric_score", F.lit(0.0)).alias("rubric_score"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_criteria", "n_judged", "n_met", "n_failed")],
        F.lit(run_id).cast("string").alias("grade_run"),
    )
    return out.select("sample_id", *version, ev.alias("evaluation"))


def _chat_aggregate(records: DataFrame, judged: bool = True) -> DataFrame:
    if not judged:
        m = avg_response_length(records.select(F.coalesce("prediction", F.lit("")).alias("prediction")))
        return m.select(F.lit("avg_response_length").alias("metric"), F.col("avg_response_length").alias("value"), "n")
    stored = F.col("evaluation_sample")
    rubric_list = F.coalesce(F.when(F.size(stored["rubrics"]) > 0, stored["rubrics"]), F.when(F.size(stored["criteria"]) > 0, stored["criteria"]))
    per = records.select(
        F.col("evaluation.rubric_score").alias("rubric_score"),
        F.coalesce(F.size(rubric_list), F.lit(0)).alias("n_criteria"),  # samples with a non-empty rubric list
    )
    d = dataset_rubric_metrics(per)
    return d.select(
        F.explode(F.array(
            F.struct(F.lit("rubric_score").alias("metric"), F.col("rubric_score").alias("value")),
            F.struct(F.lit("num_graded").alias("metric"), F.col("num_graded").cast("double").alias("value")),
        )).alias("m"),
        F.col("num_samples").alias("n"),
    ).select("m.metric", "m.value", "n")


RUBRIC_CHAT = register(
    TaskSpec(
        name="rubric_chat",
        description="Chat conversations graded per rubric criterion by a grader model.",
        messages=_chat_messages,
        reference=_chat_reference,
        payload=_chat_payload,
        grade=_chat_grade,
        aggregate=_chat_aggregate,
        complete=lambda ev: F.coalesce(ev["n_failed"], F.lit(0)) == 0,
        graded_by_model=True,
    )
)
