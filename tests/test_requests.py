"""Resumes put in the queue, look-ups of jobs and artifacts, and metrics as they are shown."""

import json

from pyspark.sql import functions as F

from jurata.operators import evaluation, records
from jurata.operators import requests as Q


def test_metric_display(spark):
    """All ratios of small counts, and some of large ones, as Python formats their double."""
    pairs = [(n, d) for d in range(1, 301) for n in range(d + 1)] + [(n * 1001, d * 997) for n, d in ((1, 32), (7, 160), (12345, 20000), (99999, 100000))] + [(5, 3), (0, 7), (1, 0), (0, 0), (19999, 20000), (1, 20000), (3, 20000), (1, 40000)]
    df = spark.createDataFrame(pairs, "n long, d long").select("n", "d", evaluation.display_of(F.col("n"), F.col("d")).alias("t"))
    for r in df.collect():
        assert r.t == evaluation.display(r.n, r.d), (r.n, r.d, r.t)


def test_resumes(spark):
    plan = spark.createDataFrame([("a", "1", "continue"), ("a", "2", "reopen"), ("a", "3", "skip_permanent"), ("b", "4", "skip_exhausted"), ("c", "5", "continue"), ("d", "6", "continue")], "run_id string, record_key string, action string")
    jobs = spark.createDataFrame([("j1", "c", "classify", "running", 1), ("j2", "d", "export", "queued", 1), ("j3", "a", "classify", "completed", 1)], "job_id string, run_id string, kind string, status string, created_at int")
    assert {r.run_id: (r.outcome, r.selected, r.renewed) for r in Q.resume_outcomes(plan, jobs).collect()} == {"a": ("accepted", 2, 1), "b": (Q.NOTHING, 0, 0), "c": (Q.CONFLICT, 1, 0), "d": ("accepted", 1, 0)}
    at = F.lit("2024-01-01").cast("timestamp")
    new, targets = Q.resume_jobs(plan, jobs, at, retry_failed=True)
    ids = {r.run_id: r.job_id for r in new.collect()}
    assert set(ids) == {"a", "d"} and ids == {r.run_id: r.job_id for r in Q.resume_jobs(plan, jobs, at, retry_failed=True)[0].collect()}
    assert sorted(map(tuple, targets.collect())) == sorted([(ids["a"], "1", False), (ids["a"], "2", True), (ids["d"], "6", False)])
    campaigns = spark.createDataFrame([("2", "stage1", 1, None, None)], "record_key string, stage string, campaign_no int, created_by_job_id string, reason string")
    opened = records.reopened(targets.where("reopen").withColumn("stage", F.lit("stage1")), campaigns)
    assert [(r.record_key, r.campaign_no, r.created_by_job_id) for r in opened.collect()] == [("2", 2, ids["a"])]
    assert spark.range(1).select(Q.resume_scope(F.lit("r1"))).first()[0] == "POST /api/runs/r1/resume"


def test_look_ups(spark):
    artifacts = spark.createDataFrame([("x", "e", "jsonl", "e/d.jsonl", "n"), ("y", "e", "excel", "e/r.xlsx", "n"), ("z", "e", "other", "..\\up", "n"), ("w", "d", "excel", "C:\\x", "n")], "artifact_id string, export_id string, kind string, relative_path string, download_name string")
    assert [r.artifact_id for r in Q.artifacts_in_order(artifacts).collect()] == ["w", "y", "x", "z"]
    asked = spark.createDataFrame([(i,) for i in "wxyzv"], "artifact_id string")
    there = spark.createDataFrame([("/out/e/r.xlsx",)], "place string")
    assert {r.artifact_id: (r.place, r.problem) for r in Q.artifact_places(asked, artifacts, "/out").collect()} == {"x": ("/out/e/d.jsonl", None), "y": ("/out/e/r.xlsx", None), **{i: (None, Q.MISSING) for i in "wzv"}}
    assert {r.artifact_id for r in Q.artifact_places(asked, artifacts, "/out", there).where("problem is null").collect()} == {"y"}
    results = spark.createDataFrame([("a", 1, "A"), ("b", 1, "B"), ("b", 2, "B2")], "record_key string, stage int, result_json string")
    assert [tuple(r) for r in Q.results_asked(results, ["b", "q", "a", "b"], 1).orderBy("place").collect()] == [(0, "b", "B"), (2, "a", "A")]
    usage = spark.createDataFrame([((3, None, 5),), ((None, None, None),), (None,)], "u struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>")
    got = [r[0] for r in usage.select(Q.usage_json(F.col("u"))).collect()]
    assert json.loads(got[0]) == {"prompt_tokens": 3, "completion_tokens": None, "total_tokens": 5} and got[1:] == [None, None]
    state = spark.createDataFrame([("w", True, "why"), (None, False, None)], "worker_id string, paused boolean, pause_reason string")
    assert [(r.model_dispatch_paused, r.last_worker and r.last_worker.worker_id) for r in Q.execution_control(state).collect()] == [(True, "w"), (False, None)]


def test_diagnoses_are_an_aid(spark, tmp_path):
    """A failing write is told and changes nothing; a later one replaces the job's own folder alone."""
    from jurata.plans.publish import write_diagnoses

    docs = lambda *v: spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "record_id string, value string")
    read = lambda job: sorted(r.value for r in spark.read.text(f"{tmp_path}/d/{job}").collect())
    assert write_diagnoses(docs("a", "b"), f"{tmp_path}/d", "j1") is None and write_diagnoses(docs("c"), f"{tmp_path}/d", "j2") is None
    failing = docs("x").withColumn("value", F.expr("raise_error('no sk-abcdefgh12 here')"))
    said = write_diagnoses(failing, f"{tmp_path}/d", "j1")
    assert said and "sk-abc" not in said and str(tmp_path) not in said and read("j1") == ["a", "b"]
    assert write_diagnoses(docs("z"), f"{tmp_path}/d", "j1") is None and read("j1") == ["z"] and read("j2") == ["c"]
    (tmp_path / "file").write_text("")
    assert write_diagnoses(docs("z"), f"{tmp_path}/file", "j") is not None


def test_resume_command(spark, tmp_path, capsys):
    """The command puts a run's resume in the queue once a job for it is possible, and refuses it while one is running."""
    from jurata import cli

    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/t/{name}.parquet")
    put("runs", [("r", "running", 1)], "run_id string, status string, revision long")
    put("records", [("r", "a", "pending", None, None), ("r", "b", "failed", "stage1", "OUTPUT_INVALID"), ("s", "c", "pending", None, None)], "run_id string, record_key string, status string, failure_stage string, failure_code string")
    put("campaigns", [("1", "b", "stage1", 1)], "campaign_id string, record_key string, stage string, campaign_no int")
    put("attempts", [("1",)] * 3, "campaign_id string")
    put("jobs", [("j", "r", "classify", "running", "1")], "job_id string, run_id string, kind string, status string, created_at string")
    asked = ["resume", f"{tmp_path}/t", "--queue", f"{tmp_path}/q", "--run", "r", "--retry-failed"]
    assert cli.main(asked) == 3 and "STATE_CONFLICT" in capsys.readouterr().out
    put("jobs", [("j", "r", "classify", "completed", "1")], "job_id string, run_id string, kind string, status string, created_at string")
    assert cli.main(asked) == 0 and "accepted" in capsys.readouterr().out
    (job,) = spark.read.parquet(f"{tmp_path}/q/jobs").collect()
    assert (job.run_id, job.mode, job.selected, job.renewed) == ("r", "retry_failed", 2, 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/q/targets").collect())) == [(job.job_id, "a", False), (job.job_id, "b", True)]
