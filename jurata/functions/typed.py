"""Model outputs as typed values: which fields of a JSON object break the contract of a stage, and what the others mean.

A contract is a list of fields (name, kind, required). A kind is "text", "flag", a tuple of legal texts, a list of one kind,
or a dict with a name and fields. A text may be nothing else; a flag is also 0 or 1 and the usual words for yes and no;
fields that a contract doesn't name are left alone. Errors come in the order of the fields, one for each place.

errors() and typed_flags() are expressions over a variant; check() is the same for an object inside a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LABELS

SUFFICIENCY = ("sufficient", "insufficient", "uncertain")
_EVIDENCE = {"name": "Evidence", "fields": [("ref_id", "text", True), ("quote", "text", True)]}
_CORRECTION = {"name": "Stage1Correction", "fields": [("corrected_item", "text", True), ("reason", "text", True), ("evidence", [_EVIDENCE], False), ("affects_classification", "flag", True)]}
#: The contracts of both stages.
CONTRACTS = {
    "stage1": [("required_points", ["text"], True), ("evidence_sufficiency", SUFFICIENCY, True), ("evidence", [_EVIDENCE], False), ("missing_information", ["text"], False), ("conflicts", ["text"], False), ("reason", "text", True)],
    "stage2": [("label", LABELS, True), ("reason", "text", True), ("issues", ["text"], False), ("evidence_sufficiency", SUFFICIENCY, True), ("evidence", [_EVIDENCE], False), ("review_required", "flag", True), ("review_reasons", ["text"], False), ("stage1_corrections", [_CORRECTION], False)],
}

# What is said of a wrong field (the wording of a public validation library), and the words of a flag.
_MISSING, _TEXT, _LIST, _FLAG, _WORD = "Field required", "Input should be a valid string", "Input should be a valid tuple", "Input should be a valid boolean", "Input should be a valid boolean, unable to interpret input"
_OBJECT = "Input should be a valid dictionary or instance of {}"
YES, NO = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")
#: Errors that are told in full.
TOLD = 3


def _choice(legal: tuple[str, ...]) -> str:
    quoted = [f"'{x}'" for x in legal]
    return f"Input should be {', '.join(quoted[:-1])} or {quoted[-1]}"


# -- expressions


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _number(v: Column) -> Column:
    return F.when(_type(v).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"), _get(v, "$", "double"))


def flag(v: Column) -> Column:
    """The flag that a variant means, null if none."""
    word = F.lower(F.when(_type(v) == "STRING", _get(v, "$", "string")))
    number = _number(v)
    return F.when(_type(v) == "BOOLEAN", _get(v, "$", "boolean")).when(word.isin(*YES) | (number == 1), True).when(word.isin(*NO) | (number == 0), False)


def _flag_error(v: Column) -> Column:
    number = _number(v)
    unread = (_type(v) == "STRING") | F.coalesce((F.abs(number) >= 2.0**53) | (number == F.floor(number)), F.lit(False))
    return F.when(flag(v).isNull(), F.when(unread, _WORD).otherwise(_FLAG))


def _one(message: Column, path: Column) -> Column:
    found = F.struct(path.alias("path"), message.alias("message"))
    return F.when(message.isNull(), F.array().cast("array<struct<path:string,message:string>>")).otherwise(F.array(found))


def _errors(v: Column, kind, path: Column) -> Column:
    """array<struct<path, message>> of a value that is there."""
    if kind == "text":
        return _one(F.when(_type(v) != "STRING", _TEXT), path)
    if kind == "flag":
        return _one(_flag_error(v), path)
    if isinstance(kind, tuple):
        return _one(F.when((_type(v) != "STRING") | ~F.coalesce(_get(v, "$", "string").isin(*kind), F.lit(False)), _choice(kind)), path)
    if isinstance(kind, list):
        each = F.transform(_get(v, "$", "array<variant>"), lambda x, i: _errors(x, kind[0], F.concat(path, F.lit("."), i.cast("string"))))
        return F.when(_type(v).startswith("ARRAY"), F.flatten(each)).otherwise(_one(F.lit(_LIST), path))
    return F.when(_type(v).startswith("OBJECT"), _fields(v, kind["fields"], path)).otherwise(_one(F.lit(_OBJECT.format(kind["name"])), path))


def _fields(v: Column, fields: list, path: Column | None) -> Column:
    parts = []
    for name, kind, required in fields:
        at = F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))
        own = _get(v, f"$.{name}", "variant")
        lacks = _one(F.lit(_MISSING) if required else F.lit(None).cast("string"), at)
        parts.append(F.when(own.isNull(), lacks).otherwise(_errors(own, kind, at)))
    return F.concat(*parts)


def errors(v: Column, stage: str) -> Column:
    """array<struct<path, message>>: the places of an object (a variant) that break the contract of a stage."""
    return _fields(v, CONTRACTS[stage], None)


def told(found: Column) -> Column:
    """The first errors as one text, with the number of the others; null without errors."""
    first = F.array_join(F.transform(F.slice(found, 1, TOLD), lambda e: F.concat_ws("：", e["path"], e["message"])), "；")
    return F.when(F.size(found) > TOLD, F.concat(first, F.format_string("；另有 %d 处问题", F.size(found) - TOLD))).when(F.size(found) > 0, first)


def typed_flags(parsed: Column, v: Column) -> Column:
    """A stage-2 struct read from JSON text, with its flags as the contract takes them."""
    fixes = F.transform(_get(v, "$.stage1_corrections", "array<variant>"), lambda x: flag(_get(x, "$.affects_classification", "variant")))
    mended = F.transform(parsed["stage1_corrections"], lambda c, i: c.withField("affects_classification", F.get(fixes, i)))
    return F.when(parsed.isNotNull(), parsed.withField("review_required", flag(_get(v, "$.review_required", "variant"))).withField("stage1_corrections", mended))


# -- the same inside a task


def _flag_of(x) -> bool | None:
    if isinstance(x, str):
        return True if x.lower() in YES else False if x.lower() in NO else None
    return bool(x) if isinstance(x, (bool, int, float)) and x in (0, 1) else None


def _check(x, kind, path: str, found: list[tuple[str, str]]):
    if kind == "text":
        wrong = None if isinstance(x, str) else _TEXT
    elif kind == "flag":
        wrong = None
        if _flag_of(x) is None:
            whole = isinstance(x, (str, int)) or (isinstance(x, float) and x.is_integer())
            wrong = _WORD if whole else _FLAG
        else:
            x = _flag_of(x)
    elif isinstance(kind, tuple):
        wrong = None if isinstance(x, str) and x in kind else _choice(kind)
    elif isinstance(kind, list):
        if isinstance(x, list):
            return [_check(e, kind[0], f"{path}.{i}", found) for i, e in enumerate(x)]
        wrong = _LIST
    else:
        if isinstance(x, dict):
            return _object(x, kind["fields"], f"{path}.", found)
        wrong = _OBJECT.format(kind["name"])
    if wrong:
        found.append((path, wrong))
    return x


def _object(x: dict, fields: list, path: str, found: list[tuple[str, str]]) -> dict:
    out = {}
    for name, kind, required in fields:
        if name in x:
            out[name] = _check(x[name], kind, path + name, found)
        elif required:
            found.append((path + name, _MISSING))
        else:
            out[name] = []
    return out


def check(x: dict, stage: str) -> tuple[dict, list[tuple[str, str]]]:
    """(the typed value, its errors as (path, message)) of a JSON object."""
    found: list[tuple[str, str]] = []
    return _object(x, CONTRACTS[stage], "", found), found


def told_of(found: list[tuple[str, str]]) -> str | None:
    """told() of check()'s errors."""
    first = "；".join("：".join(e) for e in found[:TOLD])
    return (first + (f"；另有 {len(found) - TOLD} 处问题" if len(found) > TOLD else "")) or None
