"""What requests ask of stored tables: resumes put in the queue, jobs and artifacts looked up, results in the order asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import new_key
from .records import active_jobs

# What a request is refused with, and kinds of artifacts in their order.
NOTHING, CONFLICT, MISSING = "NOTHING_TO_RESUME", "STATE_CONFLICT", "ARTIFACT_MISSING"
KINDS = ("excel", "jsonl")


def resume_scope(run_id: Column) -> Column:
    """The scope of a resume's idempotency key: keys of different runs are different."""
    return F.concat(F.lit("POST /api/runs/"), run_id, F.lit("/resume"))


def resume_outcomes(plan: DataFrame, jobs: DataFrame) -> DataFrame:
    """(run_id, outcome, selected, renewed, skipped_budget_exhausted, skipped_needs_new_batch) of a resume of each run of a plan (records.resume_plan)."""
    n = lambda action: F.count_if(F.col("action") == action)
    counts = plan.groupBy("run_id").agg((n("continue") + n("reopen")).alias("selected"), n("reopen").alias("renewed"), n("skip_exhausted").alias("skipped_budget_exhausted"), n("skip_permanent").alias("skipped_needs_new_batch"))
    busy = active_jobs(jobs).where("kind = 'classify'").select("run_id", F.lit(True).alias("_busy"))
    outcome = F.when(F.coalesce("_busy", F.lit(False)), CONFLICT).when(F.col("selected") == 0, NOTHING).otherwise("accepted")
    return counts.join(busy, "run_id", "left").select("run_id", outcome.alias("outcome"), *counts.columns[1:])


def resume_jobs(plan: DataFrame, jobs: DataFrame, at: Column, retry_failed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(jobs to append, their targets): a job for each run that can be resumed, and (job_id, record_key, reopen) for its records.

    Budgets aren't reopened here: that is done when a job is taken up, by records.reopened() over the targets that say so,
    so a resume that nobody takes up has spent nothing. A job's id follows from its run and time: a repeated call appends
    the same rows.
    """
    mode = "retry_failed" if retry_failed else "resume"
    accepted = resume_outcomes(plan, jobs).where("outcome = 'accepted'")
    new = accepted.select(new_key(F.col("run_id"), F.lit(mode), at.cast("string")).alias("job_id"), "run_id", F.lit("classify").alias("kind"), F.lit(mode).alias("mode"), F.lit("queued").alias("status"), at.alias("created_at"), "selected", "renewed")
    targets = plan.where(F.col("action").isin("continue", "reopen")).join(new.select("run_id", "job_id"), "run_id")
    return new, targets.select("job_id", "record_key", (F.col("action") == "reopen").alias("reopen"))


_JOB = ("job_id", "run_id", "kind", "mode", "status", "current_record_key", "current_stage", "worker_id", "created_at", "started_at", "last_activity_at", "finished_at", "error", "result")


def job_details(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs with what their log (job_id, seq, event, at, and any of worker_id, record_key, stage, error, result) says of them; their payload stays out.

    Events are started, progress and ended; the last of each counts.
    """
    have = lambda c: F.col(c) if c in log.columns else F.lit(None).cast("string")
    of = lambda event, c: F.max_by(F.when(F.col("event") == event, c), F.when(F.col("event") == event, F.col("seq")))
    facts = log.groupBy("job_id").agg(
        of("progress", have("record_key")).alias("current_record_key"), of("progress", have("stage")).alias("current_stage"), of("started", have("worker_id")).alias("worker_id"),
        of("started", F.col("at")).alias("started_at"), F.max("at").alias("last_activity_at"), of("ended", F.col("at")).alias("finished_at"), of("ended", have("error")).alias("error"), of("ended", have("result")).alias("result"),
    )
    out = jobs.join(facts, "job_id", "left")
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None).cast("string")).alias(c) for c in _JOB])


def execution_control(state: DataFrame) -> DataFrame:
    """The gate and the last worker (records.runtime_state()) as a view: facts only, a worker that is silent isn't called dead."""
    worker = F.when(F.col("worker_id").isNotNull(), F.struct("worker_id"))
    return state.select(F.col("paused").alias("model_dispatch_paused"), "pause_reason", worker.alias("last_worker"))


def artifacts_in_order(artifacts: DataFrame) -> DataFrame:
    """Artifacts of each export, in the order of their kinds."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return artifacts.orderBy("export_id", F.when(place == 0, len(KINDS) + 1).otherwise(place), "kind", "artifact_id")


def inside(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return ~path.rlike(r"^(?:[/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..") & (path != "")


def artifact_places(asked: DataFrame, artifacts: DataFrame, root: str, there: DataFrame | None = None) -> DataFrame:
    """(artifact_id, place, download_name, problem) of asked artifact_ids: only what is registered, stays below root and (by `there`, the places that exist) is there, has a place."""
    known = artifacts.select("artifact_id", "relative_path", "download_name")
    place = F.when(inside(F.col("relative_path")), F.concat(F.lit(f"{root.rstrip('/')}/"), F.col("relative_path")))
    out = asked.select("artifact_id").distinct().join(known, "artifact_id", "left").withColumn("place", place)
    if there is not None:
        out = out.join(there.select(F.col("place").alias("_place")).distinct(), F.col("place") == F.col("_place"), "left").withColumn("place", F.col("_place"))
    ok = F.col("place").isNotNull()
    return out.select("artifact_id", "place", F.when(ok, F.col("download_name")).alias("download_name"), F.when(~ok, MISSING).alias("problem"))


def results_asked(results: DataFrame, keys: Sequence[str], stage: int) -> DataFrame:
    """(place, record_key, result_json) of one stage for the asked keys, each once, in the order in which they were asked for first."""
    spark = results.sparkSession
    order = spark.createDataFrame([(list(keys),)], "keys array<string>").select(F.posexplode(F.array_distinct("keys")).alias("place", "record_key"))
    return order.join(results.where(F.col("stage") == stage).select(F.col("record_key").cast("string").alias("record_key"), "result_json"), "record_key").select("place", "record_key", "result_json")


def usage_json(usage: Column) -> Column:
    """Token counts of a call as stored JSON, null without any: a count that is missing is null there, never 0."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    any_known = F.coalesce(*[usage[n] for n in names]).isNotNull()
    return F.when(any_known, F.to_json(F.struct(*[usage[n].alias(n) for n in names]), {"ignoreNullFields": "false"}))
