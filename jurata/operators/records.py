"""Queries over records, runs, jobs, campaigns and attempts.

States are columns; zero-filled counts are conditional aggregates over a fixed list of states, so each is one hash
aggregate with partial aggregation. Latest-per-group uses max_by on a struct or number, not a sort, where one value wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import numeric_prefix
from ..schemas import JOB_STATES, MAX_ATTEMPTS, RECORD_STATES, STAGES


def page(df: DataFrame, order: Sequence[Column | str], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """A page in a total order; wrong limits are errors, never adjusted."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}, is {limit}")
    if offset < 0:
        raise ValueError(f"offset must not be negative, is {offset}")
    return df.orderBy(*order).offset(offset).limit(limit)


def filtered(df: DataFrame, **equals) -> DataFrame:
    """Rows where each given column has the given value; None means no condition. False never matches null."""
    conditions = [F.col(k) == F.lit(v) for k, v in equals.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def records_page(records: DataFrame, run_id: str | None = None, label=None, review_required=None, status=None, record_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of records in input order with the filtered total on each row."""
    if status is not None and status not in RECORD_STATES:
        raise ValueError(f"unknown status {status!r}")
    rows = filtered(records, run_id=run_id, label=label, review_required=review_required, status=status, record_id=record_id)
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, ["order_index"], limit, offset).join(F.broadcast(total))  # one row


def zero_filled(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], prefix: str = "n_") -> DataFrame:
    """Counts of each value of a state column by key, zeros included."""
    counts = [F.count_if(F.coalesce(F.col(column) == v, F.lit(False))).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def status_counts(records: DataFrame) -> DataFrame:
    return zero_filled(records, ["run_id"], "status", RECORD_STATES)


def job_counts(jobs: DataFrame) -> DataFrame:
    return zero_filled(jobs, [], "status", JOB_STATES)


def batch_counters(records: DataFrame) -> DataFrame:
    """Per run: total, classified, failed, input_invalid, processed, remaining, review_required, progress_percent (half to even)."""
    done = F.col("classified") + F.col("failed") + F.col("input_invalid")
    out = records.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("classified"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "input_invalid").alias("input_invalid"),
        F.count_if(F.coalesce("review_required", F.lit(False))).alias("review_required"),
    )
    out = out.withColumn("processed", done).withColumn("remaining", F.col("total") - done)
    return out.withColumn("progress_percent", F.bround(F.col("processed") / F.col("total") * 100, 1))


def runs_with_counts(runs: DataFrame, records: DataFrame) -> DataFrame:
    """Runs with their counters; runs without records have zeros."""
    counters = batch_counters(records)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counters.columns if c not in ("run_id", "progress_percent")]
    return runs.join(counters, "run_id", "left").select(*runs.columns, *zero, F.coalesce("progress_percent", F.lit(0.0)).alias("progress_percent"))


def run_status(records: DataFrame) -> DataFrame:
    """Final state of each run; a run with records left has none."""
    c = batch_counters(records)
    valid = F.col("total") - F.col("input_invalid")
    clean = (F.col("failed") == 0) & (F.col("input_invalid") == 0) & (F.col("classified") >= valid)
    return c.select("run_id", F.when(F.col("remaining") > 0, None).when(clean, "completed").otherwise("partial_failed").alias("status"))


def attempt_statistics(records: DataFrame, campaigns: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per run and stage: attempts, succeeded, failed, unknown, simulated; both stages for every run."""
    joined = attempts.join(campaigns.select("campaign_id", "record_key", "stage"), "campaign_id").join(records.select("record_key", "run_id"), "record_key")
    by = joined.groupBy("run_id", "stage").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
        F.count_if(F.col("simulated")).alias("simulated"),
    )
    spine = records.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    return spine.join(by, ["run_id", "stage"], "left").na.fill(0, ["attempts", "succeeded", "failed", "unknown", "simulated"])


def attempts_by_stage(campaigns: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per record and stage the attempts in order, as an array (at most a few per campaign)."""
    joined = attempts.join(campaigns.select("campaign_id", "record_key", "stage", "campaign_no"), "campaign_id")
    entry = F.struct("campaign_no", "attempt_no", "status")
    return joined.groupBy("record_key", "stage").agg(F.array_sort(F.collect_list(entry)).alias("attempts"))


def latest_campaign(campaigns: DataFrame) -> DataFrame:
    """Per record and stage: the newest campaign and the number of the next."""
    return campaigns.groupBy("record_key", "stage").agg(F.max_by("campaign_id", "campaign_no").alias("campaign_id"), F.max("campaign_no").alias("campaign_no"), (F.coalesce(F.max("campaign_no"), F.lit(0)) + 1).alias("next_campaign_no"))


def attempts_used(attempts: DataFrame) -> DataFrame:
    """Attempts of each campaign, failed and unknown ones included."""
    return attempts.groupBy("campaign_id").agg(F.count("*").alias("used"))


def numbered_attempts(attempts: DataFrame) -> DataFrame:
    """attempt_no within each campaign in the order of start (a campaign has at most a few attempts)."""
    return attempts.withColumn("attempt_no", F.row_number().over(W.partitionBy("campaign_id").orderBy("started_at", "seq")))


def newest_first(df: DataFrame, keys: Sequence[str], n: int = 1) -> DataFrame:
    """The newest n rows per key: created_at, then seq, descending. The rank limit is pushed below the exchange."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("seq")))
    return df.withColumn("position", rank).where(F.col("position") <= n)


def queue_heads(jobs: DataFrame, paused: bool = False) -> DataFrame:
    """The oldest queued job of each kind; a paused queue hands out exports only."""
    rows = jobs.where("status = 'queued'")
    rows = rows.where("kind = 'export'") if paused else rows
    return rows.groupBy("kind").agg(F.min(F.struct("created_at", "job_id")).alias("head")).select("kind", "head.created_at", "head.job_id")


def active_jobs(jobs: DataFrame) -> DataFrame:
    """The oldest queued or running job of each run and kind."""
    rows = jobs.where(F.col("status").isin("queued", "running"))
    return rows.groupBy("run_id", "kind").agg(F.min(F.struct("created_at", "job_id")).alias("head")).select("run_id", "kind", "head.job_id")


def failures(records: DataFrame, n: int = 50) -> DataFrame:
    """The first n failed records in input order; `truncated` says that there are more."""
    rows = records.where("status = 'failed'")
    more = rows.agg((F.count("*") > n).alias("truncated"))
    return rows.orderBy("order_index").limit(n).join(F.broadcast(more))


def resume_plan(records: DataFrame, campaigns: DataFrame, attempts: DataFrame, retry_failed: bool = False, never: Sequence[str] = ("CONTEXT_LIMIT", "OUTPUT_TRUNCATED")) -> DataFrame:
    """What a resume does with each unfinished record: continue, reopen, or why it is skipped.

    Pending and half-done records continue. A failed one continues while its newest campaign has attempts left, by the
    campaign's own max_attempts (MAX_ATTEMPTS where it has none); used-up ones (or ones without a campaign) are reopened if
    asked; some failures are never tried again.
    """
    limit = F.coalesce("max_attempts", F.lit(MAX_ATTEMPTS)) if "max_attempts" in campaigns.columns else F.lit(MAX_ATTEMPTS)
    newest = campaigns.groupBy("record_key", "stage").agg(F.max("campaign_no").alias("campaign_no"), F.max_by(F.struct("campaign_id", limit.alias("most")), "campaign_no").alias("c"))
    newest = newest.select("record_key", "stage", "campaign_no", "c.*").join(attempts_used(attempts), "campaign_id", "left")
    stage = F.coalesce("failure_stage", F.lit(STAGES[0]))
    rows = records.where(F.col("status").isin("pending", "stage1_done", "failed")).withColumn("stage", stage)
    rows = rows.join(newest.select("record_key", "stage", "campaign_no", "used", "most"), ["record_key", "stage"], "left")
    left = F.coalesce(F.col("campaign_no").isNotNull() & (F.coalesce("used", F.lit(0)) < F.col("most")), F.lit(False))
    again = F.lit("reopen") if retry_failed else F.lit("skip_exhausted")
    action = F.when(F.col("status") != "failed", "continue").when(F.col("failure_code").isin(*never), "skip_permanent").when(left, "continue").otherwise(again)
    return rows.select("run_id", "record_key", "status", action.alias("action"))


def resume_counts(plan: DataFrame) -> DataFrame:
    return zero_filled(plan, ["run_id"], "action", ("continue", "reopen", "skip_exhausted", "skip_permanent"))


def in_numeric_order(df: DataFrame, column: str = "record_id") -> list[Column]:
    """Order by the number a text starts with, then by the text."""
    return [numeric_prefix(F.col(column)), F.col(column)]


def input_order(rows: DataFrame) -> DataFrame:
    """order_index of the rows that aren't blank, by file (a file's rows are bounded by contract); source_row stays."""
    return rows.where(~F.col("blank")).withColumn("order_index", F.row_number().over(W.partitionBy("file").orderBy("source_row")) - 1)


def with_initial_status(records: DataFrame, row_errors: DataFrame) -> DataFrame:
    """input_invalid for rows with an error, else pending."""
    bad = row_errors.select("run_id", "source_row").distinct().withColumn("_bad", F.lit(True))
    return records.join(bad, ["run_id", "source_row"], "left").withColumn("status", F.when(F.col("_bad"), "input_invalid").otherwise("pending")).drop("_bad")


def valid_records(records: DataFrame, row_errors: DataFrame) -> DataFrame:
    return records.join(row_errors, ["run_id", "source_row"], "left_anti")


def invalid_records(records: DataFrame, row_errors: DataFrame) -> DataFrame:
    return records.join(row_errors, ["run_id", "source_row"], "left_semi")


def duplicate_ids(records: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Ids that occur more than once with their rows in order, invalid rows included."""
    rows = records.where(F.col("record_id").isNotNull())
    out = rows.groupBy(*keys, "record_id").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("source_row")).alias("source_rows"))
    return out.where("n_rows > 1")


def reconcile(expected: DataFrame, actual: DataFrame, key: str = "record_id") -> DataFrame:
    """Ids of either side with where they are: both, missing or extra."""
    left = expected.select(key).distinct().withColumn("_l", F.lit(1))
    right = actual.select(key).distinct().withColumn("_r", F.lit(1))
    both = left.join(right, key, "full")
    return both.select(key, F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").otherwise("both").alias("side"))


def deduplicated(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first event (by seq) of each key, as idempotency keys and automatic exports need."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("e")).select(*keys, "e.*")


def idempotency(requests: DataFrame) -> DataFrame:
    """Each request as first, replayed (same body as the first) or conflict."""
    first = requests.groupBy("scope", "key").agg(F.min_by("digest", "seq").alias("_digest"), F.min("seq").alias("_seq"))
    out = F.when(F.col("seq") == F.col("_seq"), "first").when(F.col("digest") == F.col("_digest"), "replayed").otherwise("conflict")
    return requests.join(first, ["scope", "key"]).select(*requests.columns, out.alias("outcome"))


def revisions(events: DataFrame) -> DataFrame:
    """Revision of each run: its events that bear one (finishing a run doesn't)."""
    bearing = F.col("event").isin("stage_committed", "record_failed", "checkpoint_reset", "run_reopened")
    return events.groupBy("run_id").agg(F.count_if(bearing).alias("revision"))


def latest_state(events: DataFrame, key: str, state: Sequence[str]) -> DataFrame:
    """The newest state of each key from an append-only log, in place of updates."""
    return events.groupBy(key).agg(F.max_by(F.struct(*state), "seq").alias("s")).select(key, "s.*")


def recovered(jobs: DataFrame, attempts: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after a crash: running attempts are unknown, running jobs interrupted, and runs whose classify job ran are interrupted."""
    hit = jobs.where("status = 'running' and kind = 'classify'").select("run_id").distinct().withColumn("_hit", F.lit(True))
    interrupted = lambda df, to: df.withColumn("status", F.when(F.col("status") == "running", to).otherwise(F.col("status")))
    runs = runs.join(hit, "run_id", "left").withColumn("status", F.when(F.col("_hit") & (F.col("status") == "running"), "interrupted").otherwise(F.col("status"))).drop("_hit")
    return interrupted(jobs, "interrupted"), interrupted(attempts, "unknown"), runs


def exports_view(exports: DataFrame, jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Exports with the state of their job and their artifacts; only a pair of both kinds counts as published."""
    files = artifacts.groupBy("export_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    pair = F.coalesce(F.col("kinds") == F.array(F.lit("excel"), F.lit("jsonl")), F.lit(False))
    return exports.join(jobs.select("job_id", F.col("status").alias("job_status")), "job_id", "left").join(files, "export_id", "left").withColumn("published", pair)


def records_page_with_results(records: DataFrame, results: DataFrame, runs: DataFrame, **asked) -> DataFrame:
    """A page of records (as records_page()) with the reason of their stage 2 and the run's revision; only the page's results are joined."""
    rows = records_page(records, **asked)
    two = results.where(F.col("stage") == 2).select("record_key", F.get_json_object("result_json", "$.reason").alias("reason"))
    return rows.join(two, "record_key", "left").join(runs.select("run_id", "revision"), "run_id", "left")


def record_details(records: DataFrame, results: DataFrame, attempts: DataFrame) -> DataFrame:
    """Records with both results as they were stored and their attempts in order; raw outputs stay out."""
    stored = results.groupBy("record_key").agg(*[F.max(F.when(F.col("stage") == k, F.col("result_json"))).alias(f"stage{k}_json") for k in (1, 2)])
    entry = F.struct("stage", "campaign_no", "attempt_no", "status", "error_code")
    tried = attempts.groupBy("record_key").agg(F.array_sort(F.collect_list(entry)).alias("attempt_summary"))
    return records.join(stored, "record_key", "left").join(tried, "record_key", "left")


def attempts_in_all(statistics: DataFrame) -> DataFrame:
    """(run_id, attempts, simulated) over both stages of attempt_statistics()."""
    return statistics.groupBy("run_id").agg(F.sum("attempts").alias("attempts"), F.sum("simulated").alias("simulated"))


def run_facts(attempts: DataFrame, key: str = "run_id") -> DataFrame:
    """Per key: whether any attempt was simulated, and the models used, in order and once each."""
    return attempts.groupBy(key).agg(F.coalesce(F.bool_or("simulated"), F.lit(False)).alias("simulated"), F.array_sort(F.collect_set("model")).alias("models"))


# States of a run that can be resumed, and those in which nothing but the ending may be left.
RESUMABLE, ENDING = ("queued", "running", "partial_failed", "failed", "interrupted"), ("queued", "running", "interrupted")
# Why an action isn't allowed.
ACTIVE, ENDED, NEW_BATCH, USED_UP, NOTHING = "active_job", "ended", "needs_new_batch", "budget_exhausted", "nothing_to_resume"


def allowed_actions(runs: DataFrame, records: DataFrame, campaigns: DataFrame, attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """What may be done with each run now: both resume plans counted, the ending, and one export at a time.

    A run with a queued or running classification, or one that has ended, can't be resumed and its plans count as nothing.
    """
    both = resume_plan(records, campaigns, attempts, retry_failed=True)  # one plan: without retrying, reopened ones are skipped
    c = {a: F.col(f"n_{a}") for a in ("continue", "reopen", "skip_permanent")}
    counts = resume_counts(both).join(records.groupBy("run_id").agg(F.count_if(F.col("status").isin("pending", "stage1_done")).alias("remaining")), "run_id", "full")
    busy = active_jobs(jobs).groupBy("run_id").agg(F.bool_or(F.col("kind") == "classify").alias("classifying"), F.bool_or(F.col("kind") == "export").alias("exporting"))
    df = runs.select("run_id", "status").join(counts, "run_id", "left").join(busy, "run_id", "left").na.fill(0).na.fill(False)
    open_ = ~F.col("classifying") & F.col("status").isin(*RESUMABLE)
    n = lambda col: F.when(open_, col).otherwise(0)
    ending = open_ & (c["continue"] == 0) & (F.col("remaining") == 0) & F.col("status").isin(*ENDING)
    work = open_ & ((c["continue"] > 0) | ending)
    why = F.when(F.col("classifying"), ACTIVE).when(~open_, ENDED).when(work, None).when((c["skip_permanent"] > 0) & (c["reopen"] == 0), NEW_BATCH).when((c["reopen"] > 0) & (c["skip_permanent"] == 0), USED_UP).otherwise(NOTHING)
    return df.select(
        "run_id", work.alias("can_resume"), (open_ & (c["reopen"] > 0)).alias("can_retry_failed"), ending.alias("finalization_required"),
        n(c["continue"]).alias("selected"), n(c["reopen"]).alias("skipped_budget_exhausted"), n(c["skip_permanent"]).alias("skipped_needs_new_batch"),
        n(c["continue"] + c["reopen"]).alias("retry_selected"), n(c["reopen"]).alias("retry_renewed"), n(F.col("remaining")).alias("remaining"),
        why.alias("disabled_reason"), (~F.col("exporting")).alias("can_export"),
    )


def checkpoints(records: DataFrame, results: DataFrame, runs: DataFrame, schema_version: str) -> DataFrame:
    """Where each record's execution starts: at stage 2 with its committed stage 1, else at stage 1; or why it can't.

    A stage 1 of another schema version or prompt than the run's is never used and never done again. `reset` marks records
    whose state isn't that of their checkpoint (failed ones).
    """
    one = results.where(F.col("stage") == 1).select("record_key", "result_json", "schema_version", "prompt_sha256")
    df = records.select("run_id", "record_key", "status").join(one, "record_key", "left").join(runs.select("run_id", "stage1_sha256"), "run_id", "left")
    stored = F.col("result_json").isNotNull()
    same = (F.col("schema_version") == schema_version) & F.col("prompt_sha256").eqNullSafe(F.col("stage1_sha256"))
    problem = F.when(F.col("status").isin("input_invalid", "completed"), "STATE_CONFLICT").when(F.col("stage1_sha256").isNull() | (stored & ~F.coalesce(same, F.lit(False))), "VERSION_INCOMPATIBLE")
    at = F.when(problem.isNull(), F.when(stored, "stage1_done").otherwise("pending"))
    return df.select("run_id", "record_key", at.alias("checkpoint"), F.when(problem.isNull(), F.col("result_json")).alias("stage1_json"), (at != F.col("status")).alias("reset"), problem.alias("problem"))


EXPLICIT = "explicit_retry"


def reopened(requests: DataFrame, campaigns: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Campaigns (record_key, stage, campaign_no, max_attempts, reason, created_by_job_id) to append for the reopen plans (job_id, record_key, stage) of jobs.

    A stage whose newest campaign was already opened by the same job is left out, so a job that is run again opens none twice.
    """
    newest = campaigns.groupBy("record_key", "stage").agg(F.max("campaign_no").alias("campaign_no"), F.max_by(F.struct("created_by_job_id", "reason"), "campaign_no").alias("by"))
    asked = requests.select("job_id", "record_key", "stage").distinct().join(newest, ["record_key", "stage"], "left")
    own = F.coalesce((F.col("by.created_by_job_id") == F.col("job_id")) & (F.col("by.reason") == EXPLICIT), F.lit(False))
    number = (F.coalesce("campaign_no", F.lit(0)) + 1).cast("int")
    return asked.where(~own).select("record_key", "stage", number.alias("campaign_no"), F.lit(max_attempts).alias("max_attempts"), F.lit(EXPLICIT).alias("reason"), F.col("job_id").alias("created_by_job_id"))


def finalized(jobs: DataFrame, runs: DataFrame, records: DataFrame, exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endings, exports) of the classify jobs that have run: the states of runs and jobs, and the automatic exports to append.

    A run with records left has no end (its ending is null: an error of the caller). A run's revision is exported
    automatically once.
    """
    states = run_status(records)
    ended = jobs.where("kind = 'classify'").select("job_id", "run_id").join(runs.select("run_id", "revision"), "run_id").join(states, "run_id", "left")
    done = exports.where("source = 'automatic'").select("run_id", F.col("scheduled_revision").alias("revision"))
    new = ended.where("status is not null").select("run_id", "revision").distinct().join(done, ["run_id", "revision"], "left_anti")
    return ended, new.select("run_id", F.col("revision").alias("scheduled_revision"), F.lit("automatic").alias("source"))


def manual_exports(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (seq, run_id) with `outcome`: accepted, or STATE_CONFLICT while an export of the run is queued or running (by then the first request's own is)."""
    busy = active_jobs(jobs).where("kind = 'export'").select("run_id").distinct().withColumn("_busy", F.lit(True))
    first = requests.groupBy("run_id").agg(F.min("seq").alias("_first"))
    taken = F.coalesce("_busy", F.lit(False)) | (F.col("seq") != F.col("_first"))
    return requests.join(first, "run_id").join(busy, "run_id", "left").select(*requests.columns, F.when(taken, "STATE_CONFLICT").otherwise("accepted").alias("outcome"))


def captured(snapshot: DataFrame, runs: DataFrame, at: str) -> DataFrame:
    """A snapshot of records with the revision and time at which it was taken, the same for all its rows."""
    return snapshot.join(runs.select("run_id", F.col("revision").alias("captured_revision")), "run_id").withColumn("captured_at", F.lit(at))


def record_states(events: DataFrame) -> DataFrame:
    """State of each record from its log (record_key, seq, event, label, review_required, failure_stage, failure_code).

    Every transition sets all columns: only completed records have a label and a review mark, only failed ones a failure.
    """
    status = F.when(F.col("event").isin("stage1_done", "completed", "failed"), F.col("event")).when(F.col("event") == "reset_stage1_done", "stage1_done").otherwise("pending")
    only = lambda c, of: F.when(status == of, F.col(c)).alias(c)
    rows = events.select("record_key", "seq", status.alias("status"), only("label", "completed"), only("review_required", "completed"), only("failure_stage", "failed"), only("failure_code", "failed"))
    return latest_state(rows, "record_key", ["status", "label", "review_required", "failure_stage", "failure_code"])


def attempt_states(log: DataFrame) -> DataFrame:
    """(campaign_id, attempt_no, status, error_code) of reserved attempts: running until their end is logged; an end without a reservation is none."""
    ended = F.col("event") == "finished"
    out = log.groupBy("campaign_id", "attempt_no").agg(F.bool_or(F.col("event") == "reserved").alias("_reserved"), F.min_by(F.when(ended, F.struct("status", "error_code")), F.when(ended, F.col("seq"))).alias("e"))
    return out.where("_reserved").select("campaign_id", "attempt_no", F.coalesce("e.status", F.lit("running")).alias("status"), F.col("e.error_code").alias("error_code"))


def runtime_state(log: DataFrame) -> DataFrame:
    """One row: the last worker, and whether dispatch is paused: by the last pause, unless a worker has cleared it since."""
    started = F.col("event") == "worker_started"
    turn = (F.col("event") == "paused") | (started & F.coalesce("clear_pause", F.lit(False)))
    out = log.agg(F.max_by(F.when(started, F.col("worker_id")), F.when(started, F.col("seq"))).alias("worker_id"), F.max_by(F.struct("event", "reason"), F.when(turn, F.col("seq"))).alias("t"))
    paused = F.coalesce(F.col("t.event") == "paused", F.lit(False))
    return out.select("worker_id", paused.alias("paused"), F.when(paused, F.col("t.reason")).alias("pause_reason"))


def evaluations_view(evaluations: DataFrame, runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Evaluations with their run's file and state and the paths of their reports; a run that is gone leaves nulls."""
    files = reports.groupBy("evaluation_id").agg(F.array_sort(F.collect_set("path")).alias("reports"))
    return evaluations.join(runs.select("run_id", "source_filename", F.col("status").alias("run_status")), "run_id", "left").join(files, "evaluation_id", "left")
