"""Error classes, typed outputs and the ledger."""

import json
import random
import socket
import urllib.error

import pytest
from pyspark.sql import functions as F

from jurata.functions import judgement as J
from jurata.functions import typed
from jurata.operators import judge, ledger
from jurata.schemas import LABELS, REFS

from .test_text import records


class Client(Exception):
    """As clients raise it: a status_code, and a code of the client's own."""

    def __init__(self, text, status_code=None, code=None):
        super().__init__(text)
        if status_code is not None:
            self.status_code = status_code
        self.code = code


def test_error_classes(spark):
    again, never = "MODEL_RETRYABLE", "MODEL_PERMANENT"
    cases = [
        (ConnectionResetError("reset"), again), (BrokenPipeError(), again), (ConnectionRefusedError("no"), again), (socket.gaierror("dns"), again), (TimeoutError("late"), again), (PermissionError("x"), again),
        (Client("busy", 429, "rate_limit_exceeded"), again), (Client("down", 503), again), (Client("no", 401, "invalid_api_key"), never), (Client("Context is too long", 400), "CONTEXT_LIMIT"), (Client("bad", 400), never),
        (Client("x", code="rate_limit_exceeded"), never), (Client("cut", code="OUTPUT_TRUNCATED"), "OUTPUT_TRUNCATED"), (Client("x", status_code="503"), never), (Client("x", status_code=True), never), (KeyError("k"), never),
        (urllib.error.HTTPError("u", 429, "slow down", None, None), again), (urllib.error.HTTPError("u", 404, "none", None, None), never), (urllib.error.URLError("unreachable"), again),
    ]
    for error, want in cases:
        assert J.error_of(error)[0] == want, error
    assert J.error_of(Client("key sk-abcdefgh12 of me", 401), ("me",))[1] == "key *** of ***；HTTP=401"
    assert J.error_of(ConnectionResetError())[1] == "ConnectionResetError" and J.error_of(KeyError("k"))[1] == "KeyError：'k'"
    names = [(type(e).__name__, w) for e, w in cases if isinstance(e, (OSError, KeyError)) and not isinstance(e, urllib.error.URLError) and type(e).__module__ == "builtins"]
    got = spark.createDataFrame(names, "n string, w string").select(J.error_code(F.lit(None).cast("int"), F.col("n"), F.lit("")).alias("c"), "w").collect()
    assert len(got) == 6 and all(r.c == r.w for r in got)


def test_retryable_errors_never_end_a_queue(spark):
    """Jobs whose runs raise what is worth another try are recorded as failed; the queue goes on."""
    from jurata.streaming import queue as S

    raised = [ConnectionResetError("x"), Client("busy", 429, "rate_limit_exceeded"), Client("down", 503), BrokenPipeError()]

    def classify(job):
        raise raised[int(job["job_id"])]

    jobs = spark.createDataFrame([(str(i), "r", "classify", "live", None, i) for i in range(4)], S.JOB_SCHEMA)
    out = []
    S.hand_out(jobs, S.routed(classify, classify), lambda: False, lambda df: out.extend(map(tuple, df.collect())))
    assert sorted(out) == [(str(i), "failed", "MODEL_RETRYABLE") for i in range(4)]


GOOD = {
    "stage1": {"required_points": ["p"], "evidence_sufficiency": "sufficient", "evidence": [{"ref_id": "ref1", "quote": "bc"}], "missing_information": [], "conflicts": [], "reason": "r"},
    "stage2": {"label": LABELS[0], "reason": "r", "issues": [], "evidence_sufficiency": "sufficient", "evidence": [{"ref_id": "ref1", "quote": "bc"}], "review_required": False, "review_reasons": [], "stage1_corrections": []},
}
FIX = {"corrected_item": "i", "reason": "r", "evidence": [{"ref_id": "ref1", "quote": "a"}], "affects_classification": "no"}


def replies(n=400, seed=5):
    """Replies of both stages with fields replaced, dropped and nested wrongly."""
    rng = random.Random(seed)
    odd = [None, 1, 0, 2, 1.0, 0.5, 1e300, 12345678901234567890123, "true", "Off", "maybe", "", True, [], [1, 2], [None], ["a", 3], {}, {"ref_id": "ref1"}, [{"ref_id": "ref1", "quote": "b"}, 7], [{"ref_id": 1, "quote": None}], [FIX], [{**FIX, "affects_classification": 3}], [{**FIX, "evidence": "x"}, {}], "sufficient", LABELS[2], [{"ref_id": "ref1", "quote": "zz"}], [{"ref_id": "ref2", "quote": "z"}]]
    out = []
    for i in range(n):
        stage = ("stage1", "stage2")[i % 2]
        x = dict(GOOD[stage])
        for name in rng.sample([*x, "extra"], rng.randint(0, 3)):
            if rng.random() < 0.2:
                x.pop(name, None)
            else:
                x[name] = rng.choice(odd)
        out.append((stage, x))
    return out + [(s, {**GOOD[s], "evidence": [{"ref_id": r, "quote": "zz"}]}) for s in GOOD for r in ("ref1", "ref2", "ref12")]


def test_typed_outputs(spark):
    """Expressions and the in-task rules find the same errors, messages and kinds."""
    made = replies()
    rows = [(i, stage, json.dumps(x, ensure_ascii=False)) for i, (stage, x) in enumerate(made)]
    refs = {"ref1": "abcd", "ref2": None}
    df = spark.createDataFrame(rows, "i int, stage string, t string").withColumn("refs", F.struct(*[F.lit(refs.get(r)).cast("string").alias(r) for r in REFS]))
    v = F.try_parse_json("t")
    found = F.when(F.col("stage") == "stage1", typed.errors(v, "stage1")).otherwise(typed.errors(v, "stage2"))
    got = {r.i: r for r in df.select("i", found.alias("e")).select("i", "e", typed.told(F.col("e")).alias("told")).collect()}
    kinds = {r.i: r for r in judge.validated(df.select("i", "stage", F.col("t").alias("reply1"), F.col("t").alias("reply2"), "refs")).collect()}
    seen = set()
    for i, (stage, x) in enumerate(made):
        value, want = typed.check(x, stage)
        assert [tuple(e) for e in got[i].e] == want and got[i].told == typed.told_of(want), (x, got[i].e, want)
        problem = J.problem_of(stage, x, refs)
        kind = kinds[i].problem1 if stage == "stage1" else kinds[i].problem2
        assert kind == (problem[0] if problem else None), (x, problem)
        seen.add(kind)
        if stage == "stage2" and not want:
            assert kinds[i].judgement.review_required == value["review_required"] and [c.affects_classification for c in kinds[i].judgement.stage1_corrections or []] == [c["affects_classification"] for c in value["stage1_corrections"]]
    assert seen >= {None, "field_schema", "consistency", "evidence_substring"}
    e = typed.check({"label": LABELS[0], "reason": 3, "issues": [None, "a"], "evidence_sufficiency": "x", "review_required": "1"}, "stage2")[1]
    assert typed.told_of(e) == "reason：Input should be a valid string；issues.0：Input should be a valid string；evidence_sufficiency：Input should be 'sufficient', 'insufficient' or 'uncertain'"


def asked(spark, n=6):
    one = "array<struct<role:string,content:string>>"
    df = records(spark, [(str(i), i, {"ref1": "abcd"}) for i in range(n)])
    return df.withColumns({f"messages{k}": F.array(F.struct(F.lit("user").alias("role"), F.lit(f"ask {k}").alias("content"))).cast(one) for k in (1, 2)}).repartition(2)


class Killed(BaseException):
    pass


def test_ledger(spark, tmp_path):
    """Attempts are written before their calls: a run that dies between both tables leaves them unknown, and they count."""
    calls = spark.sparkContext.accumulator(0)
    good1, good2 = json.dumps(GOOD["stage1"]), json.dumps(GOOD["stage2"])

    def client():
        def call(record, stage, attempt):
            calls.add(1)
            i = int(record["record_id"])
            if i == 1:
                return "no json"
            if i == 2 and stage == "stage2":
                raise ConnectionResetError("gone")
            if i == 3:
                raise Client("no", 401)
            if i == 4 and attempt == 2:  # after the attempt that was lost
                return {"content": '{"reason": 1}', "usage": {"total_tokens": 7}}
            if i == 4 and attempt == 3:
                sent = [m["content"] for m in record["messages"]]
                assert sent[1] == '{"reason": 1}' and "required_points：Field required" in sent[2]
            if stage == "stage2":
                assert record["messages"][0]["content"].endswith(good1)
            return {"content": good1 if stage == "stage1" else good2, "model": "m", "simulated": False}

        return call

    book = ledger.Ledger(spark, f"{tmp_path}/ledger")
    waits = []
    finish = book.finish
    book.finish = lambda rows, n: (_ for _ in ()).throw(Killed)
    with pytest.raises(Killed):
        ledger.judge_rounds(asked(spark), client, book, sleep=waits.append)
    assert {(r.record_id, r.outcome) for r in book.attempts().collect()} == {(str(i), judge.UNKNOWN) for i in range(6)} and calls.value == 0
    book.finish = finish
    tries = ledger.judge_rounds(asked(spark), client, ledger.Ledger(spark, f"{tmp_path}/ledger"), sleep=waits.append).cache()
    by = {}
    for r in sorted(tries.collect(), key=lambda r: (r.stage, r.attempt_no)):
        by.setdefault(int(r.record_id), []).append((r.stage[-1], r.attempt_no, r.outcome))
    lost, done = ("1", 1, judge.UNKNOWN), [("1", 2, "ok"), ("2", 1, "ok")]
    assert by[0] == by[5] == [lost, *done] and by[1] == [lost, ("1", 2, "validation_error"), ("1", 3, "validation_error")]
    assert by[2] == [lost, ("1", 2, "ok"), ("2", 1, "model_error"), ("2", 2, "model_error"), ("2", 3, "model_error")] and by[3] == [lost, ("1", 2, "model_error")]
    assert by[4] == [lost, ("1", 2, "validation_error"), ("1", 3, "ok"), ("2", 1, "ok")] and waits == [2, 4]
    assert calls.value == sum(1 for t in by.values() for x in t if x != lost)
    out = {r.record_id: r for r in judge.results(tries).collect()}
    assert {k for k, r in out.items() if r.status == "completed"} == {"0", "4", "5"} and out["2"].stage1_json == good1
    assert json.loads(tries.where("record_id = '4' and attempt_no = 2").first().usage) == {"prompt_tokens": None, "completion_tokens": None, "total_tokens": 7}
    assert ledger.judge_rounds(asked(spark), client, ledger.Ledger(spark, f"{tmp_path}/ledger"), sleep=waits.append).count() == tries.count()  # nothing is left to call
    lone = ledger.Ledger(spark, f"{tmp_path}/lone")
    lone.reserve(tries.where("record_id = '1'"), 1)
    assert judge.results(lone.attempts()).first().failure.code == "BUDGET_EXHAUSTED"
    lone.reserve(tries, 1)
    assert lone.attempts().count() == 3  # a round is written once


def test_calls_are_not_repeated(spark, tmp_path, monkeypatch):
    """A task that runs again makes no calls: its attempts are unknown."""
    from types import SimpleNamespace

    import pandas as pd

    made = []
    client = lambda: lambda record, stage, attempt: made.append(record["record_id"]) or json.dumps(GOOD[stage])
    rows = asked(spark, 3).drop("messages1", "messages2").selectExpr("*", "'stage1' as stage", "1 as attempt_no", "cast(null as array<struct<attempt_no:int,content:string,error_message:string>>) as tried", "cast(null as string) as stage1_json").toPandas()
    for number, outcome, calls in ((0, "ok", 3), (1, judge.UNKNOWN, 0)):
        made.clear()
        monkeypatch.setattr(ledger, "TaskContext", SimpleNamespace(get=lambda number=number: SimpleNamespace(attemptNumber=lambda: number)))
        out = pd.concat(ledger._calls(client, judge.by_rules)([rows]))
        assert set(out["outcome"]) == {outcome} and len(out) == 3 and len(made) == calls


def test_usage():
    class Used:
        prompt_tokens, completion_tokens, total_tokens = 3, None, True

    assert judge.usage_of(None) is None and judge.usage_of({"total_tokens": "7"}) is None
    assert json.loads(judge.usage_of(Used())) == {"prompt_tokens": 3, "completion_tokens": None, "total_tokens": None}


def test_gated_queue(spark, tmp_path):
    """Jobs held at the gate stay in the state over restarts and leave it in order; exports pass."""
    from jurata.streaming import queue as S

    jobs, gate = f"{tmp_path}/jobs", f"{tmp_path}/gate"
    add = lambda rows: spark.createDataFrame(rows, "job_id string, run_id string, kind string, created_at string, seq long").withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(jobs)
    turn = lambda rows: spark.createDataFrame(rows, "seq long, gate string").coalesce(1).write.mode("append").parquet(gate)

    def run():
        out = S.gated(spark.readStream.schema(S._JOB).parquet(jobs), spark.readStream.schema("seq long, gate string").parquet(gate), 3)
        return {r.job_id: (r.released_by, r.was_held) for r in S.to_table(spark, out, f"{tmp_path}/q", "g").collect()}

    add([("a", "r1", "classify", "2024-01-02", 1), ("b", "r1", "classify", "2024-01-01", 3), ("x", "r2", "export", "2024-01-01", 4), ("c", "r2", "classify", "2024-01-03", 5)])
    turn([(2, "pause")])
    assert run() == {"a": (1, False), "x": (4, False)}
    held = lambda: sorted((r.job_id, r.run_id, r.kind, r.seq) for r in S.held_jobs(spark, f"{tmp_path}/q/g/log").collect())
    assert held() == [("b", "r1", "classify", 3), ("c", "r2", "classify", 5)]
    add([("d", "r1", "classify", "2023-12-31", 6)])
    assert run() == {"a": (1, False), "x": (4, False)} and len(held()) == 3
    turn([(7, "resume"), (9, "pause")])
    add([("e", "r3", "classify", "2024-01-01", 8), ("f", "r3", "classify", "2024-01-01", 10)])
    assert run() == {"a": (1, False), "x": (4, False), "b": (7, True), "c": (7, True), "d": (7, True), "e": (8, False)}
    assert held() == [("f", "r3", "classify", 10)]


def test_gate_in_memory_and_state():
    """A part of a queue packs the gate's events, keeps waiting jobs in few values and lets them out as loops would."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from jurata.streaming import queue as S

    class Kept:
        def __init__(self):
            self.v, self.calls = {}, 0

        exists, get, clear, iterator = lambda s: 0 in s.v, lambda s: s.v[0], lambda s: s.v.clear(), lambda s: iter([*s.v.items()])

        def updateValue(self, k, v):  # noqa: N802
            self.v[k], self.calls = v, self.calls + 1

        def update(self, v):
            self.v[0] = v

    r, part = random.Random(5), S._Gate()
    part.closed, part.held = Kept(), Kept()
    closed, waiting, seq = False, [], 0
    for size in (3000, 1, 0, 20_000, 12_000):
        jobs, turns, want = [], [], []
        for _ in range(size):
            seq += 1
            if r.random() < 0.001 * (size < 15_000):
                closed = r.random() < 0.6
                turns.append((seq, closed))
                if not closed:
                    want += [(j[0], seq, True) for j in sorted(waiting, key=lambda j: (j[3], j[0]))]
                    waiting = []
            else:
                jobs.append((f"j{seq}", "r", r.choice(["classify", "export"]), r.randint(0, 50), seq))
                if closed and jobs[-1][2] != "export":
                    waiting.append(jobs[-1])
                else:
                    want.append((jobs[-1][0], seq, False))
        batch = pa.RecordBatch.from_pandas(pd.DataFrame(turns, columns=["seq", "closes"]).astype({"seq": "int64", "closes": bool}), preserve_index=False)
        packs = [x for p in S._packed(iter([batch])) for x in p.column(0).to_pylist()]
        assert sum(map(len, packs)) == 9 * len(turns)
        frames = [pd.DataFrame(jobs, columns=list(S._KNOWN)).assign(turns=None), pd.DataFrame({n: [None] * len(packs) for n in S._KNOWN} | {"turns": packs})]
        out = [*part.handleInputRows((0,), iter(frames), None)] if size else []
        got = [row for o in out for row in zip(o["job_id"], o["released_by"].tolist(), o["was_held"].tolist(), strict=True)]
        assert got == want
    assert part.held.calls < 60 and np.sum([len(v[0]) for v in part.held.v.values()]) == len(waiting)


def test_first_events(spark, tmp_path):
    """The first of each key, the least of a micro-batch's, none that was there in an earlier one; null keys are keys."""
    from jurata.streaming import queue as S

    schema, src = "k string, n int, seq long, v string", f"{tmp_path}/in"
    run = lambda: sorted(map(str, map(tuple, S.to_table(spark, S.first_events(spark.readStream.schema(schema).parquet(src), ["k", "n"]), f"{tmp_path}/t", "f").collect())))
    add = lambda rows: spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(src)
    add([("a", 1, 9, "late"), ("a", 1, 2, "first"), ("a", 2, 5, "x"), (None, None, 8, "none"), (None, None, 7, "null"), ("b", None, 1, "b")])
    once = sorted(map(str, [("a", 1, 2, "first"), ("a", 2, 5, "x"), (None, None, 7, "null"), ("b", None, 1, "b")]))
    assert run() == once
    add([("a", 1, 1, "too late"), (None, None, 1, "y"), ("c", 1, 4, "c2"), ("c", 1, 3, "c1")])
    assert run() == sorted([*once, str(("c", 1, 3, "c1"))])
    plan = S.first_events(spark.readStream.schema(schema).parquet(src), ["k", "n"])._jdf.queryExecution().logical().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan  # no call of Python per key


def test_first_rows_of_many_batches(monkeypatch):
    import pyarrow as pa

    from jurata.streaming import queue as S

    monkeypatch.setattr(S, "_REDUCED", 50)
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), i) for i in r.sample(range(2000), 2000)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("kns", x, strict=True)) for x in rows[i : i + 30]], pa.schema([("k", pa.string()), ("n", pa.int64()), ("s", pa.int64())])) for i in range(0, 2000, 30)]
    want = {(k, n): min(s for a, b, s in rows if (a, b) == (k, n)) for k, n, _ in rows}
    got = [tuple(x.values()) for b in S._least(["k", "n"], "s")(iter(batches)) for x in b.to_pylist()]
    assert len(got) == len(want) and {(k, n): s for k, n, s in got} == want and [*S._least(["k"], "s")(iter([]))] == []


def test_used_attempts(spark, tmp_path):
    from jurata.streaming import queue as S

    spark.createDataFrame([("k", "stage1", i) for i in range(5)] + [("m", "stage2", 9)], "record_key string, stage string, seq long").coalesce(1).write.parquet(f"{tmp_path}/in")
    S.to_table(spark, S.attempt_budget(spark.readStream.schema("record_key string, stage string, seq long").parquet(f"{tmp_path}/in")), f"{tmp_path}/t", "b")
    assert sorted(map(tuple, S.used_attempts(spark, f"{tmp_path}/t/b/log").collect())) == [("k", "stage1", 3), ("m", "stage2", 1)]
