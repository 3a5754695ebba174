"""Cell and text expressions; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EXCEL_CELL_MAX, ID, INPUT_COLUMNS, REFS, TRUNCATION_MARK, A, Q

# What counts as white space at the ends of a text (as Python's str.strip has it).
_BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Error values of a cell.
ERROR_VALUES = ("#N/A", "#VALUE!", "#REF!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!", "#GETTING_DATA")
# Characters a worksheet can't hold, and first characters that would start a formula.
ILLEGAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FORMULA_STARTS = ("=", "+", "-", "@")
# What is shown for states.
RECORD_STATUS_TEXT = {"pending": "未处理", "stage1_done": "阶段一完成", "completed": "已分类", "failed": "技术失败", "input_invalid": "输入失败"}
RUN_STATUS_TEXT = {"queued": "排队中", "running": "执行中", "completed": "已完成", "partial_failed": "部分失败", "failed": "失败", "interrupted": "已中断"}
STAGE_TEXT = {"stage1": "阶段一", "stage2": "阶段二"}


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(c, F.lit(_BLANK))


def normalize_text(c: Column) -> Column:
    """Line ends as \\n, no white space at the ends."""
    return strip(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def normalized(text: str) -> str:
    """normalize_text() of a text inside a task."""
    return text.replace("\r\n", "\n").replace("\r", "\n").strip(_BLANK)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number_text(c: Column) -> Column:
    """Text of a number as a cell stores it: integers digit by digit, other numbers by the digits of their double, whole ones without a fraction.

    Very small numbers are scientific (1e-05). Where the JVM's own digits of a double aren't the shortest ones, neither are these.
    """
    plainly, signed = r"^(?:0|-?[1-9]\d*)$", r"^\s*[+]?(-?)0*(\d+)\s*$"
    sign = lambda digits: F.when(digits != "0", F.regexp_extract(c, signed, 1)).otherwise("")
    integer = lambda digits: F.when(digits != "", F.concat(sign(digits), digits)).otherwise(_with(c.try_cast("double"), lambda number: _with(number.cast("string"), lambda text: _real_text(number, text))))
    return F.when(c.rlike(plainly), c).otherwise(_with(F.regexp_extract(c, signed, 2), integer))


def _real_text(number: Column, text: Column) -> Column:
    """Text of a double, given its own text by the JVM."""
    size = F.abs(number)
    whole = F.when(size < 2.0**63, number.cast("bigint").cast("string")).otherwise(F.format_string("%.0f", number))
    plain = F.rtrim(number.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    exponent = F.regexp_extract(text, r"E-(\d+)$", 1)
    small = F.concat(F.regexp_replace(text, r"(\.0)?E.*$", ""), F.lit("e-"), F.when(F.length(exponent) < 2, F.lit("0")).otherwise(""), exponent)
    return F.when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf")).when(number == F.floor(number), whole).when(size < 1e-4, small).when(F.contains(text, F.lit("E")) | size.between(1e-4, 1e-3), plain).otherwise(text)


def cell_to_text(kind: Column, value: Column) -> Column:
    """Text of a cell by kind: n(umber), s(tring), b(oolean), e(rror), d(ate, as its text); whole numbers without .0, blanks as null."""
    truth = F.when(F.lower(value).isin("1", "true"), "TRUE").otherwise("FALSE")
    return F.when(value.isNull(), None).when(kind == "b", truth).when(kind == "n", number_text(value)).otherwise(F.nullif(normalize_text(value), F.lit("")))


def is_error_value(c: Column) -> Column:
    return strip(c).isin(*ERROR_VALUES)


def strip_control(c: Column) -> Column:
    """struct(text, removed): without characters that a worksheet can't hold."""
    clean = F.regexp_replace(c, ILLEGAL, "")
    return F.struct(clean.alias("text"), (F.length(c) - F.length(clean)).alias("removed"))


def excel_cell(c: Column) -> Column:
    """struct(text, truncated, guarded, sanitized): cleaned, then guarded against formulas, then cut to a cell's size."""
    formula = lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in FORMULA_STARTS])
    long = lambda y: F.length(y) > EXCEL_CELL_MAX
    cut = lambda y: F.when(long(y), F.concat(F.substring(y, 1, EXCEL_CELL_MAX - len(TRUNCATION_MARK)), F.lit(TRUNCATION_MARK))).otherwise(y)
    parts = lambda x, y: F.struct(F.coalesce(cut(y), F.lit("")).alias("text"), F.coalesce(long(y), F.lit(False)).alias("truncated"), F.coalesce(formula(x), F.lit(False)).alias("guarded"), F.coalesce(F.length(c) - F.length(x), F.lit(0)).alias("sanitized"))
    return _with(F.regexp_replace(c, ILLEGAL, ""), lambda x: _with(F.when(formula(x), F.concat(F.lit("'"), x)).otherwise(x), lambda y: parts(x, y)))


def shown(c: Column, texts: dict[str, str]) -> Column:
    """The text of a state; unknown states are shown as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def run_status_text(c: Column) -> Column:
    return F.concat(shown(c, RUN_STATUS_TEXT), F.lit("（"), c, F.lit("）"))


def yes_no(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c.cast("boolean"), "是").otherwise("否")


def format_evidence(c: Column) -> Column:
    """One line `ref：quote` for each piece of evidence."""
    line = lambda e: F.when(F.coalesce(e["ref_id"], F.lit("")) == "", F.coalesce(e["quote"], F.lit(""))).otherwise(F.concat(e["ref_id"], F.lit("："), F.coalesce(e["quote"], F.lit(""))))
    return F.coalesce(F.array_join(F.transform(c, line), "\n"), F.lit(""))


def cell_location(sheet: Column, column: Column, row: Column, length: Column) -> Column:
    return F.format_string("%s!%s 第 %d 行（原 %d 字符）", sheet, column, row.cast("int"), length.cast("int"))


def sanitized_location(sheet: Column, column: Column, row: Column, removed: Column) -> Column:
    return F.format_string("%s!%s 第 %d 行（清理 %d 个控制字符）", sheet, column, row.cast("int"), removed.cast("int"))


def short_id(c: Column, n: int = 8) -> Column:
    return F.substring(c, 1, max(n, 1))


def download_name(kind: Column, run_id: Column, export_id: Column) -> Column:
    stem = F.when(kind == "excel", "分类结果").when(kind == "jsonl", "两阶段明细")
    return F.concat(F.concat_ws("-", stem, short_id(run_id), short_id(export_id)), F.when(kind == "excel", ".xlsx").when(kind == "jsonl", ".jsonl"))


def q_preview(c: Column, n: int = 200) -> Column:
    """One line of at most n characters, cut ones end with an ellipsis."""
    one = lambda x: F.regexp_replace(x, rf"[{_BLANK}]+", " ")
    cut = lambda x: F.concat(F.substring(x, 1, n), F.lit("…"))
    whole = _with(strip(one(c)), lambda line: F.when(F.length(line) > n, cut(line)).otherwise(line))
    # The start of a text is enough where it is long enough as one line: n characters, one more, and a blank.
    return _with(one(F.substring(F.ltrim(c, F.lit(_BLANK)), 1, 4 * n)), lambda head: F.when(F.length(head) > n + 1, cut(head)).otherwise(whole))


def q_preview_short(c: Column, n: int = 60) -> Column:
    """The stripped text, cut at n characters; inner white space stays."""
    text = strip(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


# Fixed value: stands for the left-out middle of a raw output.
OUTPUT_GAP = "\n……（中间已省略）……\n"


def clip_output(c: Column, most: int = 8000, head: int = 6000, tail: int = 2000) -> Column:
    """A long raw output as its head and tail around a mark."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), F.lit(OUTPUT_GAP), F.right(c, F.lit(tail)))).otherwise(c)


# Patterns of key-like tokens and of drive or share paths.
_TOKEN, _PLACE = r"\bsk-[A-Za-z0-9_\-]{8,}\b", r"(?:[A-Za-z]:[\\/]|\\\\)[^\s'\"]*"


def redact(c: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Without the given secrets (longest first) and without key-like tokens."""
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        c = F.replace(c, F.lit(s), F.lit("***"))
    return F.regexp_replace(c, _TOKEN, "***")


def redacted(text: str, secrets: tuple[str, ...] = ()) -> str:
    """redact() of a text inside a task or on the driver."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = text.replace(s, "***")
    return re.sub(_TOKEN, "***", text, flags=re.ASCII)


def scrub_paths(c: Column, root: str | None = None, most: int = 300) -> Column:
    """First line of a message; the output root and what follows it reads <outputs>, other drive or share paths <path>."""
    c = strip(c)
    if root:
        for form in sorted({root, root.replace("\\", "/"), root.replace("\\", "\\\\")}, key=len, reverse=True):
            c = F.regexp_replace(c, "(?i)\\Q" + form + "\\E" + r"(?:[\\/][^\s'\"]*)?", "<outputs>")
    c = F.regexp_replace(c, _PLACE, "<path>")
    return F.substring(F.split(c, r"\n").getItem(0), 1, most)


def scrubbed(text: str, root: str | None = None, most: int = 300) -> str:
    """scrub_paths() of a text on the driver."""
    text = text.strip(_BLANK)
    for form in sorted({root, root.replace("\\", "/")}, key=len, reverse=True) if root else ():
        text = re.sub(f"(?i){re.escape(form)}" + r"(?:[\\/][^\s'\"]*)?", lambda _: "<outputs>", text)
    return re.sub(_PLACE, lambda _: "<path>", text).split("\n")[0][:most]


def key_refs(c: Column) -> Column:
    """A list of references, cut at commas, semicolons and white space; empty parts go."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)[,，、;；\s]+"), lambda x: x != "")


def sha_prefix(c: Column) -> Column:
    return F.lower(F.substring(F.trim(c), 1, 12))


def display_width(c: Column) -> Column:
    """Columns a text takes: two for wide characters."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{1100}-\x{115f}\x{2e80}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}]", ""))


def numeric_prefix(c: Column) -> Column:
    """The integer a text starts with, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def stage_number(c: Column) -> Column:
    """1 or 2 for the name of a stage; any other name is null."""
    return F.when(c == "stage1", 1).when(c == "stage2", 2)


def stage_name(c: Column) -> Column:
    return F.when(c.isin(1, 2), F.concat(F.lit("stage"), c.cast("string")))


def capped(c: Column, n: int, more: str = "…+%d") -> Column:
    """The first n of a list of texts; the number of the others stands in a last one."""
    return F.when(F.size(c) > n, F.concat(F.slice(c, 1, n), F.array(F.format_string(more, F.size(c) - n)))).otherwise(c)


def utc_text(c: Column) -> Column:
    """A time as ISO text in UTC, whole seconds; the session's time zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def new_key(*of: Column) -> Column:
    """A 32-digit key: of given values always the same one, else a random one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *of), 256), 1, 32) if of else F.replace(F.uuid(), F.lit("-"), F.lit(""))


def ref_count(refs: Column) -> Column:
    """Number of references that are there."""
    return F.size(F.array_compact(F.array(*[refs[r] for r in REFS])))


def raw_input(*columns: Column) -> Column:
    """The input columns of a record as a map in their order."""
    return F.map_from_arrays(F.array(*map(F.lit, INPUT_COLUMNS)), F.array(*columns))


def input_of(raw: Column) -> Column:
    """struct(record_id, q, a, refs) of such a map."""
    return F.struct(raw[ID].alias("record_id"), raw[Q].alias("q"), raw[A].alias("a"), F.struct(*[raw[r].alias(r) for r in REFS]).alias("refs"))
