"""Digests of texts and JSON values, reference JSON, and checked paths."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import REFS
from .text import _with


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


# A JSON string, a number, and what a text falls into: strings, runs that start like a number, single quotes, the rest.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_INPUT = rf'(?s)({_STRING}|[-+.0-9][-+.0-9A-Za-z]*+|[^"+.0-9-]++|")'
_OUTPUT = rf'(?s)(\["n[^"]*+"\]|{_STRING}|[,:]|[^",:\[]++|\[)'


def _shortest(number: Column, text: Column) -> Column:
    """The fewest of the digits of a double, given its text by the JVM, that still read as it: struct(digits, exponent of the first, value)."""
    mantissa = F.regexp_replace(text, r"^-|E.*$", "")
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    whole = F.regexp_extract(mantissa, r"^0*(\d*)\.", 1)
    behind = F.length(F.regexp_extract(mantissa, r"^0*\.(0*)", 1))  # zeros behind the point of a number below one
    digits = F.rtrim(F.ltrim(F.replace(mantissa, F.lit(".")), F.lit("0")), F.lit("0"))
    first = power + F.when(F.length(whole) > 0, F.length(whole) - 1).otherwise(-1 - behind)

    def cut(d: Column, e: Column) -> Column:
        n = F.length(d)
        read = lambda x, k: F.struct(F.rtrim(x, F.lit("0")).alias("digits"), (e + F.length(x) - k).alias("first"), F.concat(x, F.lit("E"), (e - k + 1).cast("string")).try_cast("double").alias("value"))
        up = lambda d, k: (F.substring(d, F.lit(1), k).cast("bigint") + 1).cast("string")
        both = lambda k, down: F.when(F.substring(d, k + 1, F.lit(1)) >= "5", F.array(read(up(d, k), k), down)).otherwise(F.array(down, read(up(d, k), k)))
        tried = F.flatten(F.transform(F.sequence(F.lit(15), n - 1), lambda k: both(k, read(F.substring(d, F.lit(1), k), k))))
        less = F.when(n > 15, F.try_element_at(F.filter(tried, lambda t: t["value"] == F.abs(number)), F.lit(1)))  # 15 digits are always a double's own
        return F.coalesce(less, F.struct(d.alias("digits"), e.alias("first"), F.abs(number).alias("value")))

    exact = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), F.abs(number).cast("bigint").cast("string"))
    of = F.when(exact.isNotNull(), F.struct(F.rtrim(exact, F.lit("0")).alias("d"), (F.length(exact) - 1).alias("e"))).otherwise(F.struct(digits.alias("d"), first.alias("e")))
    return _with(of, lambda x: cut(x["d"], x["e"]))


def _double_text(number: Column) -> Column:
    """A double as JSON: with a fraction from 0.0001 up to 1e16, scientific beyond."""
    sign = F.when(number.cast("string").startswith("-"), "-").otherwise("")
    exponent = lambda e: F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), F.lit("0")))
    point = lambda d, e: F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)).when(F.length(d) <= e + 1, F.concat(d, F.repeat(F.lit("0"), e + 1 - F.length(d)), F.lit(".0"))).otherwise(F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, F.length(d))))
    science = lambda d, e: F.concat(F.substring(d, 1, 1), F.when(F.length(d) > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), F.length(d)))).otherwise(""), exponent(e))
    finite = _with(_shortest(number, number.cast("string")), lambda s: F.when((s["first"] < -4) | (s["first"] >= 16), science(s["digits"], s["first"])).otherwise(point(s["digits"], s["first"])))
    return F.concat(sign, F.when(number == 0, "0.0").when(F.abs(number) == float("inf"), "Infinity").otherwise(finite))


def _number(token: Column) -> Column:
    """A number of a JSON text: integers keep their digits, others are doubles."""
    integer = token.rlike(r"^-?\d+$")
    return F.when(token == "-0", "0").when(integer, token).otherwise(_with(token.try_cast("double"), _double_text))


def _from(c: Column, place: int) -> Column:
    return F.substring(c, place, 2**31 - 1)


def _lower_escapes(string: Column) -> Column:
    """Escaped control characters with small letters."""
    pieces = F.regexp_extract_all(string, F.lit(r"(?s)(\\u[0-9A-F]{4}|\\.|[^\\]++)"))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("\\u"), F.lower(p)).otherwise(p)), "")


def canonical_json(c: Column) -> Column:
    """A JSON text with sorted keys, one space behind commas and colons, shortest numbers and nothing escaped that needn't be; null if it isn't JSON.

    The variant sorts the keys of every object, but would lose which numbers have a fraction. So strings go into it behind
    an s and numbers as a list of one string behind an n, which no string can look like, and lose both again on their way
    out. An object that names a key twice, NaN and Infinity aren't JSON; keys sort by UTF-16 code units.
    """
    number = lambda t: F.concat(F.lit('["n'), _number(t), F.lit('"]'))
    mark = lambda t: F.when(t.startswith('"') & (t != '"'), F.concat(F.lit('"s'), _from(t, 2))).when(t.rlike(f"^{_NUMBER}$"), number(t)).otherwise(t)
    marked = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_INPUT)), mark), "")
    # What stands behind a whole value is ignored by the variant's parser, so the value is the first of two and the second, which no text can imitate, must be there.
    pair = F.try_parse_json(F.concat(F.lit("["), marked, F.lit(',"e"]')))
    read = _with(pair, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == "e", _with(F.to_json(v), lambda t: F.substring(t, F.lit(2), F.length(t) - 6))))
    inner = lambda t: F.substring(t, F.lit(4), F.length(t) - 5)
    string = lambda t: F.when(F.contains(t, F.lit("\\u00")), _lower_escapes(F.concat(F.lit('"'), _from(t, 3)))).otherwise(F.concat(F.lit('"'), _from(t, 3)))
    plain = lambda t: F.when(t.startswith('"'), string(t)).when(t.startswith('["n'), inner(t)).when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(read, F.lit(_OUTPUT)), plain), "")


_LAID_OUT = rf"(?s)({_STRING}|\{{\}}|\[\]|[\[\]{{}},:]|[^\[\]{{}},:\"]++)"


def indented_json(c: Column) -> Column:
    """A JSON text without white space between its tokens, laid out: a line for each member, two more blanks a level, empty lists and objects as they are."""
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))
    put = lambda s, depth, text: F.struct(depth.alias("depth"), F.concat(s["out"], F.array(text)).alias("out"))

    def step(s: Column, t: Column) -> Column:
        opened, closed = s["depth"] + 1, s["depth"] - 1
        other = F.when(t == ",", F.concat(t, line(s["depth"]))).when(t == ":", ": ").otherwise(t)
        return F.when(t.isin("{", "["), put(s, opened, F.concat(t, line(opened)))).when(t.isin("}", "]"), put(s, closed, F.concat(line(closed), t))).otherwise(put(s, s["depth"], other))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(F.regexp_extract_all(c, F.lit(_LAID_OUT)), start, step)["out"], "")


def result_digest(c: Column) -> Column:
    return sha256(canonical_json(c))


def refs_json(refs: Column) -> Column:
    """The ten references as JSON in their order, absent ones as empty texts."""
    return F.to_json(F.struct(*[F.coalesce(refs[r], F.lit("")).alias(r) for r in REFS]))


def refs_of(text: Column) -> Column:
    """References of such JSON, empty texts as null."""
    parsed = F.from_json(text, ", ".join(f"{r} string" for r in REFS))
    return F.struct(*[F.nullif(parsed[r], F.lit("")).alias(r) for r in REFS])


def below(root: str, path: str) -> str:
    """root/path, unless it would leave root."""
    parts = PurePosixPath(path).parts
    if PurePosixPath(path).is_absolute() or ".." in parts:
        raise ValueError(f"{path!r} leaves its root")
    return str(PurePosixPath(root, *parts))


