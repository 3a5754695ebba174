"""Rules for model outputs: strict JSON extraction, evidence checks, consistency checks, error classes. JVM expressions."""

from __future__ import annotations

import builtins
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CORRECT, REF_OK_ANSWER_WRONG, REFS
from .text import normalize_text, normalized, redacted, strip
from .typed import check, told_of

# Kinds of a rejected output and the codes of failures.
KINDS = ("output_format", "field_schema", "label_enum", "ref_range", "empty_ref", "empty_quote", "evidence_substring", "consistency")
OUTPUT_INVALID, BUDGET_EXHAUSTED = "OUTPUT_INVALID", "BUDGET_EXHAUSTED"
# Codes that an error of a call may carry itself.
CALL_CODES = ("MODEL_RETRYABLE", "MODEL_PERMANENT", "CONTEXT_LIMIT", "OUTPUT_TRUNCATED", "CONFIG_INVALID")
RETRYABLE_STATUS = (408, 425, 429)
RETRYABLE_NAMES = ("APIConnectionError", "APITimeoutError", "ConnectError", "ConnectTimeout", "ConnectionError", "InternalServerError", "PoolTimeout", "ReadError", "ReadTimeout", "RemoteProtocolError", "Timeout", "TimeoutError", "WriteError", "WriteTimeout")
#: Names of the errors of the operating system: lost connections and timeouts among them.
OS_ERRORS = tuple(sorted(n for n, c in vars(builtins).items() if isinstance(c, type) and issubclass(c, OSError)))
# Scenarios of the simulated model and ids that force one.
SCENARIOS = ("correct", "insufficient", "wrong", "correction", "forced_review")
FORCED = {"FF-1": "forced_failure"}

_FENCE = r"(?s)```(?:json)?[ \t]*\r?\n(.*?)\r?\n?```"


def json_object(text: Column) -> Column:
    """The one JSON object of an output: the whole text, or the only fenced block in it; else null."""
    whole = strip(text)
    blocks = F.regexp_extract_all(whole, F.lit(_FENCE), F.lit(1))
    n = F.size(blocks)
    candidate = F.when(n == 1, strip(F.try_element_at(blocks, F.lit(1)))).when((n == 0) & whole.startswith("{"), whole)
    # The parser takes the first value of a text; inside a frame of two keys nothing may follow that value.
    frame = F.concat(F.lit('{"v":'), candidate, F.lit(',"end":1}'))
    whole_value = F.try_parse_json(frame).isNotNull() & (F.size(F.json_object_keys(frame)) == 2)
    is_object = F.schema_of_variant(F.try_parse_json(candidate)).startswith("OBJECT")
    return F.when(F.coalesce(whole_value & is_object, F.lit(False)), candidate)


def normalized_refs(refs: Column) -> Column:
    """The references as evidence is compared with them: once per record, not once per quote."""
    return F.struct(*[normalize_text(refs[r]).alias(r) for r in REFS])


def evidence_problem(item: Column, refs: Column) -> Column:
    """The kind of what is wrong with one piece of evidence, null if it quotes its (normalised) reference."""
    source = reduce(lambda c, r: c.when(item["ref_id"] == r, refs[r]), REFS, F.when(F.lit(False), F.lit(None).cast("string")))
    quote = normalize_text(item["quote"])
    known = F.coalesce(item["ref_id"].isin(*REFS), F.lit(False))
    return F.when(~known, "ref_range").when(source.isNull(), "empty_ref").when(F.coalesce(quote, F.lit("")) == "", "empty_quote").when(~F.contains(source, quote), "evidence_substring")


def first_evidence_problem(items: Column, refs: Column) -> Column:
    """The first problem of a list of evidence."""
    return F.try_element_at(F.filter(F.transform(items, lambda e: evidence_problem(e, refs)), lambda p: p.isNotNull()), F.lit(1))


def _blank(c: Column) -> Column:
    return F.coalesce(normalize_text(c), F.lit("")) == ""


def _none(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def stage1_rule(s: Column) -> Column:
    """Number of the first broken consistency rule of a stage-1 analysis (1..4), null if none."""
    return F.when(_none(s["required_points"]), 1).when(_blank(s["reason"]), 2).when((s["evidence_sufficiency"] == "sufficient") & _none(s["evidence"]), 3).when(_none(s["evidence"]) & _none(s["missing_information"]), 4)


def stage2_rule(s: Column) -> Column:
    """Number of the first broken consistency rule of a stage-2 judgement (1..8), null if none."""
    review = F.coalesce(s["review_required"], F.lit(False))
    short = s["evidence_sufficiency"] == "insufficient"
    # Corrections are judged one by one: the first that breaks a rule names it.
    bad = F.filter(F.transform(F.coalesce(s["stage1_corrections"], F.array()), lambda c: F.when(_blank(c["reason"]), 4).when(F.coalesce(c["affects_classification"], F.lit(False)) & ~review, 5)), lambda r: r.isNotNull())
    return (
        F.when(_blank(s["reason"]), 1).when(review & _none(s["review_reasons"]), 2).when((s["evidence_sufficiency"] == "uncertain") & ~review, 3)
        .when(F.size(bad) > 0, F.try_element_at(bad, F.lit(1)))
        .when((s["label"] == CORRECT) & short, 6).when((s["label"] == CORRECT) & _none(s["evidence"]), 7).when((s["label"] == REF_OK_ANSWER_WRONG) & short, 8)
    )


def stage1_problem(found: Column, errors: Column, parsed: Column, refs: Column) -> Column:
    """Kind of the first problem of a stage-1 output: its JSON object, the errors of its fields, that parsed by the stage-1 schema, and normalised references."""
    return F.when(found.isNull(), "output_format").when(F.size(errors) > 0, "field_schema").otherwise(F.coalesce(first_evidence_problem(parsed["evidence"], refs), F.when(stage1_rule(parsed).isNotNull(), "consistency")))


def stage2_problem(found: Column, errors: Column, parsed: Column, refs: Column) -> Column:
    """The same for a stage-2 output."""
    every = F.concat(F.coalesce(parsed["evidence"], F.array()), F.flatten(F.transform(F.coalesce(parsed["stage1_corrections"], F.array()), lambda c: F.coalesce(c["evidence"], F.array()))))
    return F.when(found.isNull(), "output_format").when(F.size(errors) > 0, "field_schema").otherwise(F.coalesce(first_evidence_problem(every, refs), F.when(stage2_rule(parsed).isNotNull(), "consistency")))


#: What the broken rule of a stage asks for, by its number.
RULES = {
    "stage1": ("no point is listed", "the reason is empty", "sufficient without evidence", "neither evidence nor what is missing"),
    "stage2": ("the reason is empty", "review without reasons", "uncertain without review", "a correction without a reason", "a correction that changes the class without review", "correct although the references are insufficient", "correct without evidence", "wrong answer although the references are insufficient"),
}


def _evidence_of(item: dict, refs: dict) -> tuple[str, str] | None:
    name = item["ref_id"]
    if name not in REFS:
        return "ref_range", f"{name!r} is no reference"
    if refs.get(name) is None:
        return "empty_ref", f"{name} is empty"
    quote = normalized(item["quote"])
    if not quote:
        return "empty_quote", f"the quote from {name} is empty"
    return None if quote in normalized(refs[name]) else ("evidence_substring", f"the quote isn't in {name}")


def _rule_of(stage: str, x: dict) -> int | None:
    """stage1_rule() and stage2_rule() of a typed object."""
    enough, review, label = x["evidence_sufficiency"], x.get("review_required"), x.get("label")
    if stage == "stage1":
        broken = (not x["required_points"], not normalized(x["reason"]), enough == "sufficient" and not x["evidence"], not x["evidence"] and not x["missing_information"])
    else:
        fix = next((4 if not normalized(c["reason"]) else 5 for c in x["stage1_corrections"] if not normalized(c["reason"]) or (c["affects_classification"] and not review)), 0)
        short = enough == "insufficient"
        broken = (not normalized(x["reason"]), review and not x["review_reasons"], enough == "uncertain" and not review, fix == 4, fix == 5, label == CORRECT and short, label == CORRECT and not x["evidence"], label == REF_OK_ANSWER_WRONG and short)
    return next((n for n, b in enumerate(broken, 1) if b), None)


def problem_of(stage: str, reply: dict, refs: dict) -> tuple[str, str] | None:
    """(kind, message) of the first problem of a JSON object inside a task, by the same rules as stage1_problem() and stage2_problem()."""
    x, errors = check(reply, stage)
    if errors:
        return "field_schema", told_of(errors)
    quotes = x["evidence"] + [e for c in x.get("stage1_corrections", ()) for e in c["evidence"]]
    for item in quotes:
        if bad := _evidence_of(item, refs):
            return bad
    rule = _rule_of(stage, x)
    return ("consistency", RULES[stage][rule - 1]) if rule else None


def error_code(status: Column, name: Column, text: Column) -> Column:
    """Class of a model error by HTTP status, else by exception name; what is unknown isn't retried."""
    by_status = F.when(status.isin(*RETRYABLE_STATUS) | status.between(500, 599), "MODEL_RETRYABLE").when((status == 400) & F.contains(F.lower(text), F.lit("context")), "CONTEXT_LIMIT").otherwise("MODEL_PERMANENT")
    return F.when(status.isNotNull(), by_status).when(name.isin(*RETRYABLE_NAMES, *OS_ERRORS), "MODEL_RETRYABLE").otherwise("MODEL_PERMANENT")


def error_of(error: BaseException, secrets: tuple[str, ...] = ()) -> tuple[str, str]:
    """(class, message) of an exception inside a task: its own `code` if it's a known one, else by its status, its kind or name; secrets don't get into the message."""
    name = type(error).__name__
    text = redacted(str(error), secrets).strip() or name
    status = next((s for s in (getattr(error, a, None) for a in ("status_code", "status")) if isinstance(s, int) and not isinstance(s, bool)), None)
    said = text if status is None else f"{text}；HTTP={status}"
    if (code := getattr(error, "code", None)) in CALL_CODES:
        return code, said
    if status is not None:
        if status in RETRYABLE_STATUS or 500 <= status <= 599:
            return "MODEL_RETRYABLE", said
        return "CONTEXT_LIMIT" if status == 400 and "context" in text.lower() else "MODEL_PERMANENT", said
    if name in RETRYABLE_NAMES or isinstance(error, OSError):
        return "MODEL_RETRYABLE", said
    return "MODEL_PERMANENT", f"{name}：{text}"


def error_code_of(error: BaseException) -> str:
    return error_of(error)[0]


def attempt_outcome(status: Column, code: Column) -> Column:
    return F.when(status == "succeeded", "ok").when(status == "unknown", "unknown_after_interrupt").when(code == OUTPUT_INVALID, "validation_error").otherwise("model_error")


def backoff(attempt: Column, seconds: tuple[int, ...] = (2, 4)) -> Column:
    """Seconds to wait after an attempt; the last value repeats."""
    return F.element_at(F.array(*map(F.lit, seconds)), F.least(attempt, F.lit(len(seconds))))


def first_ref(refs: Column) -> Column:
    """struct(ref_id, quote) of the first reference that isn't blank (40 characters of it), null without one."""
    return reduce(lambda rest, r: F.when(~_blank(refs[r]), F.struct(F.lit(r).alias("ref_id"), F.substring(refs[r], 1, 40).alias("quote"))).otherwise(rest), reversed(REFS), F.lit(None))


def scenario(record_id: Column, source_row: Column, refs: Column) -> Column:
    """Scenario of the simulated model for a record: no reference means insufficient, then forced ids, then a checksum of the id."""
    key = F.coalesce(F.nullif(record_id, F.lit("")), F.concat(F.lit("row:"), source_row.cast("string")))
    drawn = F.element_at(F.array(*map(F.lit, SCENARIOS)), (F.crc32(key.cast("binary")) % len(SCENARIOS) + 1).cast("int"))
    forced = reduce(lambda c, kv: c.when(record_id == kv[0], kv[1]), FORCED.items(), F.when(F.lit(False), ""))
    return F.when(first_ref(refs).isNull(), "insufficient").otherwise(F.coalesce(forced, drawn))
