"""JSON forms as expressions against the standard library."""

import json
import random
import struct

from pyspark.sql import functions as F

from jurata.functions import digest as D
from jurata.functions import prompts as P

LETTERS = list('ab"\\/{}[]:,n s1\n\t\x01\x1f\x7fé中😀\u2028')
#: Texts that aren't JSON, and some that hardly are.
ODD = ["01", "1.", "-", "+1", ".5", "{1:2}", '{"a" 1}', "1 2", '"a"1', "[1,]", '{"a":1,}', "NaN", "tru", "truetrue", '"\\x"', '"a\nb"', "", " ", "1e400", "-0", "-0.0", '"\\/"', "[1] x", "1],[2", '1,"e"] x', '"', '{"a":"b}', "1E5", "1.10", "0.10e-3", '{"b":1,"a":{"d":[],"c":{}}}', "\ufeff1", "9" * 60, '"n1"', '["n1"]', '{"n1":["n2", 2]}']


def _double(r):
    kind = r.random()
    if kind < 0.4:
        x = struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0]
        return x if x == x and abs(x) != float("inf") else 1.5
    return r.uniform(-1, 1) * 10 ** r.randint(-8, 20) if kind < 0.7 else round(r.uniform(-1000, 1000), r.randint(0, 4)) if kind < 0.9 else float(2 ** r.randint(-1000, 1000))


def _value(r, depth):
    text = lambda: "".join(r.choice(LETTERS) for _ in range(r.randint(0, 6)))
    kind = r.random()
    if depth and kind < 0.25:
        return {text(): _value(r, depth - 1) for _ in range(r.randint(0, 4))}
    if depth and kind < 0.4:
        return [_value(r, depth - 1) for _ in range(r.randint(0, 4))]
    return text() if kind < 0.6 else _double(r) if kind < 0.8 else r.choice([None, True, False, 0, -0.0, 1e16, 1e-5, 1e22, 10 ** r.randint(1, 40)])


def _refused(_):
    raise ValueError


def _canonical(text):
    try:
        return json.dumps(json.loads(text, parse_constant=_refused), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def test_canonical_json(spark):
    r = random.Random(3)
    texts = [json.dumps(_value(r, 3), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]), separators=r.choice([None, (",", ":")])) for _ in range(3000)] + ODD
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.canonical_json(F.col("t")).alias("c")).collect()
    assert {x.t: x.c for x in rows if x.c != _canonical(x.t)} == {}
    one = spark.createDataFrame([(None,), ('{"a":1,"a":2}',)], "t string").select(D.canonical_json(F.col("t")).alias("c")).collect()
    assert [x.c for x in one] == [None, None]  # nothing, and a key named twice


def test_long_canonical_json(spark):
    text = json.dumps({"b": "x\n\"\\" * 300_000, "a": list(range(20_000))})
    assert spark.createDataFrame([(text,)], "t string").select(D.canonical_json(F.col("t")).alias("c")).first().c == _canonical(text)


def test_indented_json(spark):
    r = random.Random(4)
    values = [_value(r, 3) for _ in range(500)] + [[], {}, [[]], {"a": {}}, "{[,:]}"]
    texts = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.indented_json(F.col("t")).alias("c")).collect()
    assert {x.t: x.c for x in rows if x.c != json.dumps(json.loads(x.t), ensure_ascii=False, indent=2)} == {}


def test_stored_stage1_in_messages(spark):
    stored = {"reason": "r", "evidence": [], "conflicts": None, "required_points": ["p"]}
    refs = F.struct(*[F.lit("x").alias(f"ref{i}") for i in range(1, 11)])
    two = P.stage2_messages(F.lit("P"), F.lit("q"), F.lit("a"), refs, F.lit(json.dumps(stored, separators=(",", ":"))), stored=True)
    assert spark.range(1).select(two.alias("m")).first().m[1].content.endswith("\n\n" + json.dumps(stored, indent=2))
