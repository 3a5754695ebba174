"""Text expressions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from jurata.functions import judgement as J
from jurata.functions import text as X
from jurata.operators import judge
from jurata.operators import records as R
from jurata.schemas import REFS, TRUNCATION_MARK

BLANKS = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000"


def values(spark, texts, *columns):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(*columns).collect()


def test_normalize_and_preview(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BLANKS + "ab中") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = values(spark, texts, X.normalize_text(F.col("t")), X.q_preview(F.col("t"), 5), X.q_preview_short(F.col("t"), 4))
    for t, (a, b, c) in zip(texts, got, strict=True):
        assert a == t.replace("\r\n", "\n").replace("\r", "\n").strip()
        one = " ".join(t.split())
        assert b == (one[:5] + "…" if len(one) > 5 else one)
        assert c == (t.strip()[:4] + "…" if len(t.strip()) > 4 else t.strip())


def test_cells(spark):
    rows = [("n", "7.0", "7"), ("n", "7", "7"), ("n", "0.25", "0.25"), ("s", "007", "007"), ("s", "  ", None), ("b", "1", "TRUE"), ("b", "0", "FALSE"), ("s", None, None), ("n", "-3.0", "-3")]
    df = spark.createDataFrame([r[:2] for r in rows], "kind string, value string").select(X.cell_to_text(F.col("kind"), F.col("value")))
    assert [r[0] for r in df.collect()] == [r[2] for r in rows]


def test_excel_cell(spark):
    long = "=" + "x" * 32998
    rows = values(spark, [None, "", "\x0b=1", "plain", long, "y" * 32767, "y" * 32768, "\x01"], X.excel_cell(F.col("t")).alias("c"))
    got = [tuple(r.c) for r in rows]
    assert got[:4] == [("", False, False, 0), ("", False, False, 0), ("'=1", False, True, 1), ("plain", False, False, 0)]
    text, cut, guarded, _ = got[4]
    assert cut and guarded and len(text) == 32767 and text.startswith("'=x") and text.endswith(TRUNCATION_MARK)
    assert not got[5][1] and got[6][1] and len(got[6][0]) == 32767 and got[7] == ("", False, False, 1)


def test_small_ones(spark):
    r = values(spark, ["12abc", "G-1", "-7", None, "９"], X.numeric_prefix(F.col("t")))
    assert [x[0] for x in r] == [12, 0, -7, 0, 0]
    r = values(spark, ["key sk-abcDEF12345 top", "secret longsecret"], X.redact(F.col("t"), ("secret", "longsecret")))
    assert [x[0] for x in r] == ["key *** top", "*** ***"]
    r = values(spark, ["fail at C:\\out\\run\\a.txt now\nmore", "see D:/x/y 'q'"], X.scrub_paths(F.col("t"), "C:\\out"))
    assert [x[0] for x in r] == ["fail at <outputs> now", "see <path> 'q'"]
    long = "h" * 7000 + "t" * 3000
    assert values(spark, [long], X.clip_output(F.col("t")))[0][0] == long[:6000] + X.OUTPUT_GAP + long[-2000:]
    assert values(spark, ["ref1，ref2; ref3、"], X.key_refs(F.col("t")))[0][0] == ["ref1", "ref2", "ref3"]
    kinds = spark.createDataFrame([("excel",), ("jsonl",)], "k string").select(X.download_name(F.col("k"), F.lit("r" * 12), F.lit("e12")))
    assert [x[0] for x in kinds.collect()] == ["分类结果-rrrrrrrr-e12.xlsx", "两阶段明细-rrrrrrrr-e12.jsonl"]
    assert [x[0] for x in values(spark, ["failed", "other"], X.shown(F.col("t"), X.RECORD_STATUS_TEXT))] == ["技术失败", "other"]


CASES = ['{"a":1}', '{"a":1} x', '{"a":1}}', "[1]", '{"a":1}] [{}', '{"a":1},"z":{}', '```json\n{"a":1}\n```', 'x ```\n{"b":2}\n``` y', "```json\n{}\n```\n```json\n{}\n```", "", '{"a":"x\ny"}', '{"a":1},"end":1', "null", ' {"a": {"b": [1,2]}} \n']


def test_json_object(spark):
    import json

    for t, (got,) in zip(CASES, values(spark, CASES, J.json_object(F.col("t"))), strict=True):
        assert (json.loads(got) if got else None) == judge.parse(t), t


def test_error_codes(spark):
    rows = [(408, "", "", "MODEL_RETRYABLE"), (500, "", "", "MODEL_RETRYABLE"), (400, "", "Context too long", "CONTEXT_LIMIT"), (400, "", "x", "MODEL_PERMANENT"), (None, "ReadTimeout", "", "MODEL_RETRYABLE"), (None, "KeyError", "", "MODEL_PERMANENT")]
    df = spark.createDataFrame([r[:3] for r in rows], "s int, n string, t string").select(J.error_code(F.col("s"), F.col("n"), F.col("t")))
    assert [r[0] for r in df.collect()] == [r[3] for r in rows]


def records(spark, rows):
    refs = ", ".join(f"{r}: string" for r in REFS)
    return spark.createDataFrame([(i, n, tuple(x.get(r) for r in REFS)) for i, n, x in rows], f"record_id string, source_row int, refs struct<{refs}>")


def test_simulated_judging(spark):
    import zlib

    rows = [(str(i), i + 2, {"ref2": f"原文 {i} " + "x" * 60}) for i in range(30)] + [("FF-1", 50, {"ref1": "abc"}), ("n", 51, {}), (None, 52, {"ref1": "abc"}), ("FF-1", 53, {"ref1": "  "})]
    got = {(r.record_id, r.source_row): r for r in judge.validated(judge.simulated(records(spark, rows))).collect()}
    names = ("correct", "insufficient", "wrong", "correction", "forced_review")
    for i, n, refs in rows:
        has = any(v.strip() for v in refs.values())
        want = "insufficient" if not has else "forced_failure" if i == "FF-1" else names[zlib.crc32((i or f"row:{n}").encode()) % 5]
        r = got[i, n]
        assert r.scenario == want and r.problem1 is None
        assert r.problem2 == ("evidence_substring" if want == "forced_failure" else None)
    out = {r.record_id: r for r in judge.judge_simulated(records(spark, rows[:31])).collect()}
    assert (out["FF-1"].status, out["FF-1"].failure_stage, out["FF-1"].failure_code, out["FF-1"].attempts2) == ("failed", "stage2", "OUTPUT_INVALID", 3)


def test_consistency_rules(spark):
    import json

    base1 = {"required_points": ["p"], "evidence_sufficiency": "sufficient", "evidence": [{"ref_id": "ref1", "quote": "bc"}], "missing_information": [], "conflicts": [], "reason": "r"}
    base2 = {"label": "回答正确", "reason": "r", "issues": [], "evidence_sufficiency": "sufficient", "evidence": [{"ref_id": "ref1", "quote": "bc"}], "review_required": False, "review_reasons": [], "stage1_corrections": []}
    fix = {"corrected_item": "i", "reason": "r", "evidence": [], "affects_classification": True}
    ones = [({}, None), ({"required_points": []}, "consistency"), ({"reason": " "}, "consistency"), ({"evidence": []}, "consistency"), ({"evidence": [{"ref_id": "ref2", "quote": "x"}]}, "empty_ref"), ({"evidence": [{"ref_id": "ref11", "quote": "x"}]}, "ref_range"), ({"evidence": [{"ref_id": "ref1", "quote": " "}]}, "empty_quote"), ({"evidence_sufficiency": "maybe"}, "field_schema")]
    twos = [({}, None), ({"label": "对"}, "field_schema"), ({"review_required": True}, "consistency"), ({"evidence_sufficiency": "uncertain"}, "consistency"), ({"stage1_corrections": [fix]}, "consistency"), ({"evidence_sufficiency": "insufficient"}, "consistency"), ({"evidence": []}, "consistency"), ({"evidence": [{"ref_id": "ref1", "quote": "%b"}]}, "evidence_substring")]
    rows = [(str(i), i, {"ref1": "abcd"}) for i in range(8)]
    df = records(spark, rows)
    replies = spark.createDataFrame([(str(i), json.dumps(base1 | a), json.dumps(base2 | b)) for i, ((a, _), (b, _)) in enumerate(zip(ones, twos, strict=True))], "record_id string, reply1 string, reply2 string")
    got = {int(r.record_id): r for r in judge.validated(df.join(replies, "record_id")).collect()}
    for i in range(8):
        assert (got[i].problem1, got[i].problem2) == (ones[i][1], twos[i][1]), i


def test_live_client(spark):
    df = spark.createDataFrame([("1", "good"), ("2", "never"), ("3", "late")], "record_id string, how string")

    def client():
        def call(record, stage, attempt):
            if record["how"] == "never" or (record["how"] == "late" and attempt < 3 and stage == "stage2"):
                return "no json"
            return '{"ok": true}'

        return call

    rows = judge.call_stages(df, client, lambda record, stage, reply: None).collect()
    tried = {k: [r.outcome for r in sorted(rows, key=lambda r: (r.stage, r.attempt_no)) if r.record_id == k] for k in "123"}
    assert tried == {"1": ["ok", "ok"], "2": ["validation_error"] * 3, "3": ["ok", "validation_error", "validation_error", "ok"]}


def test_diagnosis(spark):
    df = spark.createDataFrame([("abcdef", "xxabcdefyy"), ("abcZef", "xxabcdefyy"), ("abc", None)], "quote string, source string")
    a, b, c = judge.diagnosed(df).collect()
    assert a.is_substring and a.divergence is None and a.match_len == 6
    assert not b.is_substring and b.divergence == 3 and b.match == "abc" and c.ratio is None


def test_paging_errors(spark):
    df = spark.range(5)
    for kw in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            R.page(df, ["id"], **kw)
    with pytest.raises(ValueError):
        R.records_page(df, status="nope")


def test_digests(spark):
    import hashlib
    import json

    from jurata.functions import digest as D

    texts = ['{"b": 1, "a": "中"}', "no", None]
    got = values(spark, texts, D.canonical_json(F.col("t")).alias("c"), D.result_digest(F.col("t")).alias("d"))
    want = json.dumps({"a": "中", "b": 1}, ensure_ascii=False, sort_keys=True)
    assert [r.c for r in got] == [want, None, None] and got[0].d == hashlib.sha256(want.encode()).hexdigest()
    df = records(spark, [("1", 2, {"ref2": "x"})]).select(D.refs_json(F.col("refs")).alias("j")).select("j", D.refs_of(F.col("j")).alias("r"))
    r = df.first()
    assert list(json.loads(r.j)) == list(REFS) and r.r.ref2 == "x" and r.r.ref1 is None
    assert D.below("/out", "a/b.xlsx") == "/out/a/b.xlsx"
    for bad in ("../x", "/x", "a/../../x"):
        with pytest.raises(ValueError):
            D.below("/out", bad)


def test_numbers_as_python_writes_them(spark):
    """Cell numbers against Python: an integer's digits, else the shortest digits of the double."""
    rng = random.Random(9)
    texts = ["12345678.5", "12345678901234567", "1e-05", "0.1", "-0.5", "1E5", "007", "-0", "+7", "0.0001", "0.00012", "123456789.125", "1e-7", "-2.5E-10", "1e15", "9007199254740993", "123456789012345678901234567890", "0.00", "-12.50"]
    texts += [repr(rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-9, 14)) for _ in range(200)]
    want = [str(int(t)) if not set(t) & set(".eE") else str(int(float(t))) if float(t).is_integer() else str(float(t)) for t in texts]
    got = [r[0] for r in values(spark, texts, X.cell_to_text(F.lit("n"), F.col("t")))]
    # The JVM of this box doesn't always find the shortest digits of a double: the same number is enough there.
    assert all(g == w or ("." in w and float(g) == float(w)) for g, w in zip(got, want, strict=True))
    assert got[:19] == want[:19] and sum(g == w for g, w in zip(got, want, strict=True)) > 0.9 * len(want)


def naive_diagnosis(q, s):
    best = (0, 0, 0)
    for i in range(len(q)):
        for j in range(len(s)):
            n = 0
            while i + n < len(q) and j + n < len(s) and q[i + n] == s[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    return best


def test_diagnosis_against_loops(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    pairs = [("xyz", "abcdef" * 10), ("", "abcdef"), ("abc", None), ("abc", " "), ("abX", "zzabY"), ("abc", "ab")] + [(text(rng.randint(0, 12)), text(rng.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, quote string, source string")
    for r in judge.diagnosed(df).orderBy("i").collect():
        q, s = pairs[r.i][0], (pairs[r.i][1] or "").strip()
        assert (r.quote_len, r.source_len, r.ref_available) == (len(q), len(s), bool(s))
        if not s:
            assert r.match_len is None and r.divergence is None and not r.is_substring
            continue
        a, b, n = naive_diagnosis(q, s)
        assert (r.is_substring, r.match_len, r.match) == (q in s, n, q[a : a + n])
        assert r.window == s[max(0, b - 30) : b + n + 30]
        assert (r.divergence, r.quote_char, r.source_char) == ((None, None, None) if q in s else (a + n, q[a + n : a + n + 1] or None, s[b + n : b + n + 1] or None))


def test_client_errors(spark):
    """Errors are classed, waited out or final; rejected outputs come back with what to mend; budgets and committed stages count."""
    from jurata.operators.judge import ModelError

    how = ["good", "late", "limit", "cut", "odd", "never", "mended", "used", "done", "none"]
    rows = [(str(i), h, '{"was": 1}' if h == "done" else None, 3 if h == "used" else 1 if h == "late" else 0) for i, h in enumerate(how)]
    messages = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    df = spark.createDataFrame(rows, "record_id string, how string, stage1_json string, used1 int")
    for n in (1, 2):
        df = df.withColumn(f"messages{n}", F.array(*[F.struct(F.lit(m["role"]).alias("role"), F.lit(m["content"]).alias("content")) for m in messages]))

    def client():
        def call(record, stage, attempt):
            h = record["how"]
            if h == "late" and attempt < 3:
                raise TimeoutError("slow")
            if h == "limit":
                raise ModelError("context too long", status=400)
            if h == "odd":
                raise KeyError("what")
            if h == "never":
                raise ModelError("busy", status=503)
            if h == "cut":
                return {"content": "{", "finish_reason": "length"}
            if h == "none":
                return {"content": None}
            sent = record["messages"]
            if h == "mended" and stage == "stage1" and attempt == 1:
                return {"content": '{"bad": 1}', "model": "m2"}
            if h == "mended" and stage == "stage1":
                assert len(sent) == 4 and sent[2]["content"] == '{"bad": 1}' and "ref1—ref10" in sent[3]["content"]
            if stage == "stage2":
                assert sent[-1]["content"].endswith('{"was": 1}' if h == "done" else '{"ok": 1}')
            return {"content": '{"ok": 1}', "model": "m1", "simulated": True, "latency_ms": 5}

        return call

    waits = spark.sparkContext.accumulator(0)
    tries = judge.call_stages(df, client, lambda record, stage, reply: "ref_range: 12" if "bad" in reply else None, sleep=lambda s: waits.add(int(s))).cache()
    seen = {}
    for r in sorted(tries.collect(), key=lambda r: (r.stage, r.attempt_no)):
        seen.setdefault(how[int(r.record_id)], []).append((r.stage[-1], r.attempt_no, r.outcome, r.error_code))
    two = [("1", 1, "ok", None), ("2", 1, "ok", None)]
    assert seen["good"] == two and seen["done"] == two[1:]
    assert seen["late"] == [("1", 2, "model_error", "MODEL_RETRYABLE"), ("1", 3, "ok", None), ("2", 1, "model_error", "MODEL_RETRYABLE"), ("2", 2, "model_error", "MODEL_RETRYABLE"), ("2", 3, "ok", None)]
    assert seen["limit"] == [("1", 1, "model_error", "CONTEXT_LIMIT")] and seen["cut"] == [("1", 1, "model_error", "OUTPUT_TRUNCATED")] and seen["odd"] == [("1", 1, "model_error", "MODEL_PERMANENT")]
    assert seen["never"] == [("1", n, "model_error", "MODEL_RETRYABLE") for n in (1, 2, 3)] and waits.value == (4 + 2 + 4) + (2 + 4)
    assert seen["mended"] == [("1", 1, "validation_error", "OUTPUT_INVALID"), ("1", 2, "ok", None), ("2", 1, "ok", None)]
    assert seen["used"] == [("1", 3, "budget_exhausted", "BUDGET_EXHAUSTED")] and [o for _, _, o, _ in seen["none"]] == ["validation_error"] * 3
    out = {how[int(r.record_id)]: r for r in judge.results(tries).collect()}
    assert {h for h, r in out.items() if r.status == "completed"} == {"good", "late", "mended", "done"}
    assert out["mended"].models == ["m1", "m2"] and out["mended"].simulated and out["mended"].stage1_json == '{"ok": 1}' and out["mended"].failure is None
    assert (out["never"].failure_stage, out["never"].failure.code, out["never"].failure.attempt_count, out["never"].failure.retryable, out["never"].simulated) == ("stage1", "MODEL_RETRYABLE", 3, True, False)


def test_diagnostics(spark):
    """A document for each record that wasn't done cleanly, with every quote of its rejected outputs."""
    import json

    raw = json.dumps({"evidence": [{"ref_id": "ref1", "quote": "abX"}, {"ref_id": "ref9", "quote": "q"}, {"ref_id": None, "quote": "z"}], "stage1_corrections": [{"evidence": [{"ref_id": "ref1", "quote": "bc"}]}]})
    recs = records(spark, [("1", 2, {"ref1": "abc"}), ("2", 3, {"ref1": "abc"}), ("3", 4, {})]).withColumn("status", F.when(F.col("record_id") == "3", "failed").otherwise("completed")).withColumn("failure", F.lit(None).cast("string"))
    tries = spark.createDataFrame([("1", "stage1", 1, "ok", "{}", None, None, "m", 1, False), ("2", "stage2", 1, "validation_error", raw, "OUTPUT_INVALID", "p", "m", 1, False), ("2", "stage2", 2, "ok", "{}", None, None, "n", 1, False), ("3", "stage1", 1, "model_error", None, "MODEL_PERMANENT", "e", None, 1, None)], judge.ATTEMPT)
    got = {r.record_id: json.loads(r.value) for r in judge.diagnostics(recs, tries, "j", "mock", "now").collect()}
    assert set(got) == {"2", "3"} and got["2"]["models"] == ["m", "n"] and got["3"]["attempts"][0]["quote_diagnosis"] is None
    quotes = got["2"]["attempts"][0]["quote_diagnosis"]
    assert [(q["ref_id"], q["is_substring"], q["divergence"], q["quote_char"], q["source_char"], q["ref_available"]) for q in quotes] == [("ref1", False, 2, "X", "c", True), ("ref9", False, None, None, None, False), ("ref1", True, None, None, None, True)]
    assert got["2"]["attempts"][0]["raw_output"] == raw and got["2"]["attempts"][1]["raw_output"] is None


def test_quoted_in(spark):
    """Quotes in texts against a plain search: cut inside words, one word, white space alone, empty, null."""
    from jurata.operators.evidence import quoted_in

    rng = random.Random(15)
    texts = [None, "", " ", "ab", "\n\n\t"] + [rng.choice(["", " "]).join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    quotes = [None, "", " ", "\n", "  ", "\n ", "a", "b ", " a", "ab ba", "a  b", "zz", " zz b"] + [t[i : i + rng.randint(1, 14)] for t in texts[5:] for i in [rng.randrange(len(t))]]
    q = spark.createDataFrame([*enumerate(quotes)], "quote_id int, quote string")
    t = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    got = sorted(map(tuple, quoted_in(q, t).collect()))
    assert got == sorted((i, j) for i, x in enumerate(quotes) for j, y in enumerate(texts) if x is not None and y is not None and x in y)


def test_ranked(spark):
    from jurata.operators.ranks import ranked

    rows = [(i % 7, str(i)) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "k int, v string").repartition(5), ["k", "v"]).collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.k, r.v))] == list(range(1, 501))
    assert ranked(spark.createDataFrame([], "k int, v string"), ["k"]).count() == 0


def test_payloads(spark):
    import json

    tries = spark.createDataFrame([("1", "stage1", 1, "validation_error", "no", "OUTPUT_INVALID", "p", "m", 1, False), ("1", "stage1", 2, "ok", '{"a": 1}', None, None, "m", 1, False), ("1", "stage2", 1, "ok", '{"label": "L"}', None, None, "m", 1, True), ("2", "stage1", 1, "model_error", None, "CONTEXT_LIMIT", "e", None, 1, None)], judge.ATTEMPT)
    done = judge.results(tries).withColumn("source_row", F.lit(2))
    got = {r.record_id: json.loads(r.value) for r in judge.payloads(done, tries).collect()}
    one, two = got["1"], got["2"]
    assert (one["status"], one["label"], one["stage2"], one["simulated"], one["failure"]) == ("completed", "L", {"label": "L"}, True, None)
    assert [(a["stage"], a["attempt"], a["raw_output"]) for a in one["attempts"]] == [("stage1", 1, "no"), ("stage1", 2, None), ("stage2", 1, None)]
    assert (two["status"], two["label"], two["stage1"], two["failure_stage"], two["failure"]["code"], two["failure"]["retryable"]) == ("failed", None, None, "stage1", "CONTEXT_LIMIT", False)
