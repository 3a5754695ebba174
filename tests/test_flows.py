"""End to end: split, evaluation, publication, streams, constraints, command line."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jurata import cli
from jurata.functions import prompts
from jurata.operators import constraints as C
from jurata.operators import records as R
from jurata.plans import evaluate, publish
from jurata.schemas import INPUT_COLUMNS, LABELS, REFS, A, Q
from jurata.sources.xlsx import XlsxDataSource
from jurata.streaming import queue as S


def gold(spark):
    rows = [(i, str(i + 1), LABELS[0] if i < 15 else LABELS[1] if i < 25 else LABELS[2], False) for i in range(33)] + [(33, "34", None, True)]
    df = spark.createDataFrame(rows, "pos int, record_id string, gold_label string, excluded boolean")
    for c in INPUT_COLUMNS:
        df = df.withColumn(c, F.col("record_id") if c == INPUT_COLUMNS[0] else F.lit("x") if c in (Q, A) else F.lit(None).cast("string"))
    return df


def test_split_and_evaluation(spark, tmp_path):
    g = gold(spark)
    m = evaluate.generate_split(g, f"{tmp_path}/split", {"sha256": "ab"}, "2026-01-01")
    assert m["counts"]["calibration_by_label"] == dict(zip(LABELS, (10, 5, 3), strict=True)) and m["counts"]["holdout_by_label"] == dict(zip(LABELS, (5, 5, 5), strict=True))
    assert list(m["assignments"]) == [str(i) for i in range(1, 34)]
    with pytest.raises(evaluate.Gate):
        evaluate.generate_split(g, f"{tmp_path}/split", {"sha256": "ab"}, "2026-01-01")
    spark.dataSource.register(XlsxDataSource)
    cells = spark.read.format("xlsx").load(f"{tmp_path}/split/holdout.xlsx")
    assert {r.value for r in cells.where("row = 1").collect()} == set(INPUT_COLUMNS) and cells.agg(F.max("row")).first()[0] == 16

    manifest = evaluate.read_manifest(spark, f"{tmp_path}/split/split.json")
    assert [r.record_id for r in manifest.orderBy("pos").collect()] == list(m["assignments"])
    held = manifest.where("split = 'holdout'")
    predicted = g.join(held.select("record_id"), "record_id").select("record_id", F.col("gold_label").alias("agent_label"), F.lit(False).alias("review_required"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("failure_stage"))
    report, rows = evaluate.run_evaluation(g, manifest, predicted, "holdout", "completed", f"{tmp_path}/out", ("ab", "ab"))
    assert report["passed"] and report["macro_f1"] == (1, 1) and rows.where("agree").count() == 15
    assert json.loads(Path(f"{tmp_path}/out/report.json").read_text())["agreement"] == [15, 15]
    assert "达标" in Path(f"{tmp_path}/out/report.md").read_text()

    closed = f"{tmp_path}/closed"
    for bad in ({"split": "other"}, {"run_status": "running"}, {"digests": ("ab", "cd")}, {"records": predicted.limit(14)}, {"records": predicted.union(predicted.limit(1).withColumn("record_id", F.lit("99")))}, {"records": predicted.union(predicted.limit(1).withColumn("record_id", F.lit(None).cast("string")))}):
        kw = {"records": predicted, "split": "holdout", "run_status": "completed", "digests": None} | bad
        with pytest.raises(evaluate.Gate):
            evaluate.run_evaluation(g, manifest, kw["records"], kw["split"], kw["run_status"], closed, kw["digests"])
    assert not Path(closed).exists()


@pytest.mark.parametrize("text", ["", "[]", '{"seed": 1}', '{"seed": 1, "gold": {"sha256": ""}, "assignments": {"1": "elsewhere"}}'])
def test_bad_manifest(spark, tmp_path, text):
    Path(f"{tmp_path}/m.json").write_text(text)
    with pytest.raises(evaluate.Gate):
        evaluate.read_manifest(spark, f"{tmp_path}/m.json")


def snapshot(spark, n=6):
    refs = ", ".join(f"{r}: string" for r in REFS)
    states = ("completed", "failed", "input_invalid")
    rows = []
    for i in range(n):
        s = states[i % 3]
        stage2 = json.dumps({"reason": "=r", "evidence": [{"ref_id": "ref1", "quote": "q"}], "review_reasons": []}) if s == "completed" else None
        rows.append(("run1", f"k{i}", str(i), i + 2, i, "y" * 40000 if i == 0 else "q\x01", "a", (None,) * 10, s, LABELS[0] if s == "completed" else None, True if s == "completed" else None, "stage1" if s == "failed" else None, ("C", "m", 3, False) if s == "failed" else None, None, stage2))
    return spark.createDataFrame(rows, f"run_id string, record_key string, record_id string, source_row int, order_index int, q string, a string, refs struct<{refs}>, status string, label string, review_required boolean, failure_stage string, failure struct<code: string, message: string, attempt_count: int, retryable: boolean>, stage1_json string, stage2_json string")


def test_publish(spark, tmp_path):
    out = publish.publish(snapshot(spark), f"{tmp_path}/e1", "e1", {"来源文件": "f.xlsx", "status": "partial_failed"})
    assert [a["kind"] for a in out["artifacts"]] == ["excel", "jsonl"]
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/e1/detail.jsonl").collect()]
    assert len(lines) == 6 and list(lines[0]) == list(publish.E.JSONL_FIELDS)
    one = next(x for x in lines if x["record_id"] == "0")
    assert len(one["q"]) == 40000 and one["evidence"] == [{"ref_id": "ref1", "quote": "q"}] and one["stage2"]["reason"] == "=r" and one["failure"] is None
    spark.dataSource.register(XlsxDataSource)
    cells = spark.read.format("xlsx").load(f"{tmp_path}/e1/result.xlsx")
    kv = {r.row: {} for r in cells.where("sheet = '运行概况'").collect()}
    for r in cells.where("sheet = '运行概况'").collect():
        kv[r.row][r.col] = r.value
    facts = {v[1]: v.get(2) for v in kv.values()}
    assert facts["总数"] == "6" and facts["被截断单元格数"] == "1" and "原 40000 字符" in facts["被截断单元格位置"] and facts["来源文件"] == "f.xlsx"
    assert int(facts["文本前缀防护单元格数"]) == 4 and facts["批次状态（捕获时）"] == "部分失败（partial_failed）"
    assert cells.where("sheet = '分类结果' and row > 1 and col = 1").count() == 6 and cells.where("sheet = '失败清单' and row > 1 and col = 1").count() == 2
    with pytest.raises(FileExistsError):
        publish.publish(snapshot(spark), f"{tmp_path}/e1", "e1", {})


def test_empty_run_is_empty_lines(spark, tmp_path):
    assert publish.E.json_lines(snapshot(spark).where("false"), "e").count() == 0


def test_messages(spark):
    df = snapshot(spark).limit(1).withColumn("refs", F.struct(*[F.lit("资料" if r == "ref2" else None).cast("string").alias(r) for r in REFS])).withColumn("q", F.lit("问")).withColumn("a", F.lit("回答文本"))
    one = prompts.stage1_messages(F.lit("P"), F.col("q"), F.col("refs"))
    two = prompts.stage2_messages(F.lit("P"), F.col("q"), F.col("a"), F.col("refs"), F.struct(F.lit("r").alias("reason")))
    r = df.select(one.alias("one"), two.alias("two"), prompts.leaks_answer(one, F.col("a")).alias("leak"), prompts.leaks_answer(two, F.col("a")).alias("shown"), prompts.missing_refs(two, F.col("refs")).alias("lost"), prompts.feedback(one, F.lit(""), F.lit("bad"), F.lit("label_enum")).alias("again")).first()
    assert [m.role for m in r.one] == ["system", "user"] and "[ref2]\n资料" in r.one[1].content and "[ref1]\n（本份资料为空）" in r.one[1].content
    assert not r.leak and r.shown and r.lost == [] and '"reason" : "r"' in r.two[1].content
    assert len(r.again) == 4 and r.again[2].content == "（上一次输出为空）" and "照抄标签" in r.again[3].content


def test_claims(spark, tmp_path):
    jobs = [("b", "r1", "classify", "2024-01-01 00:00:01"), ("a", "r2", "classify", "2024-01-01 00:00:01"), ("c", "r1", "export", "2024-01-01 00:00:00"), ("d", "r3", "classify", "2024-01-02 00:00:00")]
    src = f"{tmp_path}/jobs"
    spark.createDataFrame([(j, r, k, "mock", t, i) for i, (j, r, k, t) in enumerate(jobs)], "job_id string, run_id string, kind string, mode string, created_at string, seq long").withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(S.JOB_SCHEMA).parquet(src)
    ran, out = [], []
    keep = lambda df: out.extend((r.job_id, r.status) for r in df.collect())
    S.drain(S.claim_jobs(stream(), lambda j: ran.append(j["job_id"]), lambda: False, keep), f"{tmp_path}/c1")
    assert ran == ["c", "a", "b", "d"] and {s for _, s in out} == {"completed"}
    S.drain(S.claim_jobs(stream(), lambda j: ran.append(j["job_id"]), lambda: False, keep), f"{tmp_path}/c1")
    assert len(ran) == 4  # nothing is handed out again after a restart
    ran.clear(), out.clear()
    S.drain(S.claim_jobs(stream(), lambda j: ran.append(j["job_id"]), lambda: True, keep), f"{tmp_path}/c2")
    assert ran == ["c"] and dict(out) == {"a": "held", "b": "held", "c": "completed", "d": "held"}
    out.clear()
    with pytest.raises(Exception, match="CONFIG_INVALID"):
        S.drain(S.claim_jobs(stream(), lambda j: "CONFIG_INVALID" if j["job_id"] == "a" else None, lambda: False, keep), f"{tmp_path}/c3")
    assert dict(out) == {"c": "completed", "a": "failed", "b": "held", "d": "held"}


def test_budget_survives_restart(spark, tmp_path):
    src = f"{tmp_path}/requests"
    add = lambda rows: spark.createDataFrame(rows, "record_key string, stage string, seq long").coalesce(1).write.mode("append").parquet(src)
    run = lambda: S.to_table(spark, S.attempt_budget(spark.readStream.schema("record_key string, stage string, seq long").parquet(src)), f"{tmp_path}/t", "b")
    add([("k", "stage1", 1), ("k", "stage1", 2), ("m", "stage1", 3)])
    run()
    add([("k", "stage1", 4), ("k", "stage1", 5), ("k", "stage2", 6)])
    got = {r.seq: (r.attempt_no, r.outcome) for r in run().collect()}
    assert got == {1: (1, "reserved"), 2: (2, "reserved"), 3: (1, "reserved"), 4: (3, "reserved"), 5: (3, "BUDGET_EXHAUSTED"), 6: (1, "reserved")}


def test_constraints(spark):
    rows = [("1", "completed", LABELS[0], True, "q", "a"), ("2", "completed", None, True, "q", "a"), ("3", "failed", LABELS[0], None, "q", "a"), ("4", "pending", None, None, None, "a"), ("5", "input_invalid", None, None, None, None), ("5", "pending", None, None, "q", "a")]
    df = spark.createDataFrame(rows, "record_id string, status string, label string, review_required boolean, q string, a string")
    assert {r.rule: r.violations for r in C.row_violations(df, C.RECORD_RULES).collect()} == {"label_only_if_completed": 2, "review_only_if_completed": 0, "question_and_answer": 1}
    assert C.key_violations(df, "u", ["record_id"]).first().violations == 1 and C.key_violations(df, "u", ["record_id"], "status = 'failed'").first().violations == 0
    runs = spark.createDataFrame([(3, 2, 1), (3, 3, 1), (1, 0, 1)], "total int, valid int, input_invalid int")
    assert {r.rule: r.violations for r in C.row_violations(runs, C.RUN_RULES).collect()} == {"run_counts_add_up": 1, "run_has_valid": 1}
    assert C.reference_violations(df, runs.select(F.col("total").cast("string").alias("id")), "fk", "record_id", "id").first().violations == 4


def test_resume_and_recovery(spark):
    records = spark.createDataFrame([("r", "a", "pending", None, None), ("r", "b", "failed", "stage1", "OUTPUT_INVALID"), ("r", "c", "failed", "stage2", "OUTPUT_INVALID"), ("r", "d", "failed", "stage1", "CONTEXT_LIMIT"), ("r", "e", "completed", None, None), ("r", "f", "failed", "stage1", "X")], "run_id string, record_key string, status string, failure_stage string, failure_code string")
    campaigns = spark.createDataFrame([("1", "b", "stage1", 1), ("2", "b", "stage1", 2), ("3", "c", "stage2", 1)], "campaign_id string, record_key string, stage string, campaign_no int")
    attempts = spark.createDataFrame([("1",)] * 3 + [("2",)] + [("3",)] * 3, "campaign_id string")
    plan = lambda **k: {r.record_key: r.action for r in R.resume_plan(records, campaigns, attempts, **k).collect()}
    assert plan() == {"a": "continue", "b": "continue", "c": "skip_exhausted", "d": "skip_permanent", "f": "skip_exhausted"}
    assert plan(retry_failed=True) == {"a": "continue", "b": "continue", "c": "reopen", "d": "skip_permanent", "f": "reopen"}
    exports = spark.createDataFrame([("e1", "j1"), ("e2", "j2")], "export_id string, job_id string")
    jobs = spark.createDataFrame([("j1", "completed")], "job_id string, status string")
    files = spark.createDataFrame([("e1", "excel"), ("e1", "jsonl"), ("e2", "excel")], "export_id string, kind string")
    assert {r.export_id: (r.published, r.job_status) for r in R.exports_view(exports, jobs, files).collect()} == {"e1": (True, "completed"), "e2": (False, None)}


def test_command_line(spark, capsys):
    assert cli.main(["queries"]) == 0 and "confusion_matrix" in capsys.readouterr().out
    assert cli.main(["run", "nope", "/nowhere"]) == 2


def test_held_jobs_are_released(spark, tmp_path):
    """Jobs held at a closed gate run when it is open: with the next micro-batch, or at once."""
    src, log = f"{tmp_path}/jobs", f"{tmp_path}/log"
    frame = lambda rows: spark.createDataFrame([(j, r, k, "mock", t, i) for i, (j, r, k, t) in enumerate(rows)], "job_id string, run_id string, kind string, mode string, created_at string, seq long").withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1)
    frame([("b", "r1", "classify", "2024-01-01 00:00:01"), ("x", "r1", "export", "2024-01-01 00:00:02")]).write.parquet(src)
    ran = []
    keep = lambda df: df.coalesce(1).write.mode("append").parquet(log)
    held = lambda: S.waiting(spark.read.schema(S.JOB_SCHEMA).parquet(src), spark.read.schema("job_id string, status string, code string").parquet(log)) if Path(log).exists() else spark.createDataFrame([], S.JOB_SCHEMA)
    run = lambda j: ran.append(j["job_id"])
    stream = lambda: spark.readStream.schema(S.JOB_SCHEMA).parquet(src)
    S.drain(S.claim_jobs(stream(), run, lambda: True, keep, held), f"{tmp_path}/c")
    assert ran == ["x"] and [r.job_id for r in held().collect()] == ["b"]
    frame([("a", "r2", "classify", "2024-01-03 00:00:00")]).write.mode("append").parquet(src)
    S.drain(S.claim_jobs(stream(), run, lambda: True, keep, held), f"{tmp_path}/c")
    assert ran == ["x"] and {r.job_id for r in held().collect()} == {"a", "b"}
    S.hand_out(held(), run, lambda: False, keep)
    assert ran == ["x", "b", "a"] and held().isEmpty()
    frame([("z", "r2", "classify", "2024-01-04 00:00:00")]).write.mode("append").parquet(src)
    S.drain(S.claim_jobs(stream(), run, lambda: False, keep, held), f"{tmp_path}/c")
    assert ran == ["x", "b", "a", "z"]


def test_many_requests_of_one_key(spark, tmp_path):
    """A key with more requests than a frame holds: the least seq are reserved, in their order."""
    src = f"{tmp_path}/requests"
    spark.createDataFrame([("k", "stage1", (i * 7919) % 30011) for i in range(30000)], "record_key string, stage string, seq long").coalesce(1).write.parquet(src)
    got = S.to_table(spark, S.attempt_budget(spark.readStream.schema("record_key string, stage string, seq long").parquet(src)), f"{tmp_path}/t", "b")
    least = sorted((i * 7919) % 30011 for i in range(30000))[:3]
    assert [(r.seq, r.attempt_no) for r in got.where("outcome = 'reserved'").orderBy("seq").collect()] == [(s, n) for n, s in enumerate(least, 1)]
    assert got.count() == 30000 and got.where("outcome <> 'reserved' and attempt_no = 3").count() == 29997


def test_manifests_are_strict(spark, tmp_path):
    m = evaluate.generate_split(gold(spark), f"{tmp_path}/split", {"sha256": "ab"}, "2026-01-01")
    for change in ({"manifest_version": "2"}, {"counts": {**m["counts"], "holdout": 1}}, {"seed": None}):
        Path(f"{tmp_path}/m.json").write_text(json.dumps(m | change, ensure_ascii=False))
        with pytest.raises(evaluate.Gate):
            evaluate.read_manifest(spark, f"{tmp_path}/m.json")
    for key in m:
        Path(f"{tmp_path}/m.json").write_text(json.dumps({k: v for k, v in m.items() if k != key}, ensure_ascii=False))
        with pytest.raises(evaluate.Gate):
            evaluate.read_manifest(spark, f"{tmp_path}/m.json")


def test_published_digests(spark, tmp_path):
    out = publish.publish(snapshot(spark), f"{tmp_path}/e", "e", {})
    assert json.loads(Path(f"{tmp_path}/e/manifest.json").read_text()) == out and all(len(a["sha256"]) == 64 for a in out["artifacts"])
    assert publish.lines_digest(spark, f"{tmp_path}/e/detail.jsonl") == out["artifacts"][1]["sha256"]


def test_commands_on_stored_tables(spark, tmp_path, capsys):
    """resume, export and evaluate over a folder of tables."""
    g = gold(spark)
    evaluate.generate_split(g, f"{tmp_path}/split", {"sha256": "ab"}, "2026-01-01")
    refs = F.struct(*[F.lit(None).cast("string").alias(r) for r in REFS])
    held = evaluate.read_manifest(spark, f"{tmp_path}/split/split.json").where("split = 'holdout'").select("record_id", "pos")
    records = held.join(g.select("record_id", "gold_label"), "record_id").select(F.lit("r1").alias("run_id"), F.concat(F.lit("k"), "record_id").alias("record_key"), "record_id", F.col("pos").alias("source_row"), F.col("pos").alias("order_index"), F.lit("q").alias("q"), F.lit("a").alias("a"), refs.alias("refs"), F.lit("completed").alias("status"), F.col("gold_label").alias("label"), F.col("gold_label").alias("agent_label"), F.lit(False).alias("review_required"), F.lit(None).cast("string").alias("failure_stage"), F.lit(None).cast("string").alias("failure_code"), F.lit(None).cast("struct<code:string,message:string,attempt_count:int,retryable:boolean>").alias("failure"))
    tables = {
        "runs": spark.createDataFrame([("r1", "completed", 4)], "run_id string, status string, revision long"), "records": records, "gold": g,
        "results": records.select("record_key", F.lit(2).alias("stage"), F.lit('{"reason": "x"}').alias("result_json")),
        "attempts": records.select("record_key", F.lit("c").alias("campaign_id"), F.lit(1).alias("stage"), F.lit("succeeded").alias("status"), F.lit(True).alias("simulated")),
        "campaigns": spark.createDataFrame([], "campaign_id string, record_key string, stage string, campaign_no int, max_attempts int"),
        "jobs": spark.createDataFrame([], "job_id string, run_id string, kind string, status string, created_at timestamp"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/t/{name}.parquet")
    assert cli.main(["resume", f"{tmp_path}/t"]) == 0 and "ended" in capsys.readouterr().out
    assert cli.main(["export", f"{tmp_path}/t", "r1", f"{tmp_path}/e"]) == 0 and Path(f"{tmp_path}/e/manifest.json").exists()
    assert cli.main(["export", f"{tmp_path}/t", "r1", f"{tmp_path}/e"]) == 3 and cli.main(["export", f"{tmp_path}/t", "r9", f"{tmp_path}/x"]) == 2
    scored = lambda split, out: cli.main(["evaluate", f"{tmp_path}/t", "r1", f"{tmp_path}/split/split.json", split, f"{tmp_path}/{out}"])
    assert scored("holdout", "v") == 0 and json.loads(Path(f"{tmp_path}/v/report.json").read_text())["passed"]
    assert scored("calibration", "w") == 3 and not Path(f"{tmp_path}/w").exists()


def test_routing_and_heartbeat(spark, tmp_path):
    """Exceptions of jobs become codes; an export's never stops the queue; progress is passed on."""
    import time

    from jurata.operators.judge import ModelError

    src = f"{tmp_path}/jobs"
    spark.createDataFrame([(j, "r", k, "mock", i) for i, (j, k) in enumerate([("a", "export"), ("b", "classify"), ("c", "classify"), ("d", "classify")])], "job_id string, run_id string, kind string, mode string, seq long").withColumn("created_at", F.timestamp_seconds("seq")).select("job_id", "run_id", "kind", "mode", "created_at", "seq").coalesce(1).write.parquet(src)

    def classify(job):
        if job["job_id"] == "b":
            raise ModelError("busy", status=503)
        if job["job_id"] == "c":
            raise ModelError("refused", status=401)

    def export(job):
        raise OSError("disk full")

    out, beats = [], []
    listener = S.Heartbeat(lambda *b: beats.append(b))
    spark.streams.addListener(listener)
    with pytest.raises(Exception, match="MODEL_PERMANENT"):
        S.drain(S.claim_jobs(spark.readStream.schema(S.JOB_SCHEMA).parquet(src), S.routed(classify, export), lambda: False, lambda df: out.extend(map(tuple, df.collect()))), f"{tmp_path}/c")
    assert out == [("a", "failed", "EXPORT_FAILED"), ("b", "failed", "MODEL_RETRYABLE"), ("c", "failed", "MODEL_PERMANENT"), ("d", "held", None)]
    S.to_table(spark, spark.readStream.schema(S.JOB_SCHEMA).parquet(src), f"{tmp_path}/t", "copy")
    for _ in range(50):
        if beats:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert beats and beats[-1][2] == 4


def test_versions(spark):
    import hashlib

    snap = prompts.prompt_snapshot()
    assert all(snap[s]["sha256"] == hashlib.sha256(prompts.load_prompt(s).encode()).hexdigest() for s in ("stage1", "stage2"))
    with pytest.raises(ValueError):
        prompts.load_prompt("stage3")
    facts = evaluate.frozen({"run_id": "r", "revision": 3, "api_key": "x"}, {"gold_sha256": "ab", "token": "t"})
    assert facts == {"run_id": "r", "revision": "3", "prompt_stage1": snap["stage1"]["sha256"], "prompt_stage2": snap["stage2"]["sha256"], "gold_sha256": "ab"}
    assert evaluate.evaluation_folder("/out/", "r", "e") == "/out/evaluations/r/e"
    with pytest.raises(ValueError):
        evaluate.evaluation_folder("/out", "r", "../../x")
