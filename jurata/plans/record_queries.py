"""Registered queries over records, runs, campaigns, attempts and jobs, each with its comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as C
from ..operators import records as R
from ..operators.ranks import ranked
from ..schemas import JOB_STATES, RECORD_STATES
from . import adapter as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a function of (spark, sf_dir) under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in RECORD_STATES)


@query(f"WITH {V.RECORDS_SQL}, f AS (SELECT record_id, run_id, order_index, label, count(*) OVER () AS total FROM records WHERE status = 'completed' AND review_required) SELECT * FROM f ORDER BY order_index LIMIT 20 OFFSET 10")
def records_page_filtered(spark, d):
    return R.records_page(V.records(spark, d), review_required=True, status="completed", limit=20, offset=10).select("record_id", "run_id", "order_index", "label", "total")


@query(f"WITH {V.RECORDS_SQL} SELECT run_id, {_COUNTS} FROM records GROUP BY run_id")
def status_counts_zero_filled(spark, d):
    return R.status_counts(V.records(spark, d))


@query(f"WITH {V.JOBS_SQL} SELECT {', '.join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in JOB_STATES)} FROM jobs")
def job_counts_zero_filled(spark, d):
    return R.job_counts(V.jobs(spark, d))


_BATCH = "SELECT run_id, count(*) AS total, count(*) FILTER (status = 'completed') AS classified, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'input_invalid') AS input_invalid, count(*) FILTER (coalesce(review_required, false)) AS review_required FROM records GROUP BY run_id"


@query(f"WITH {V.RECORDS_SQL}, b AS ({_BATCH}) SELECT *, classified + failed + input_invalid AS processed, total - classified - failed - input_invalid AS remaining FROM b")
def batch_counters(spark, d):
    return R.batch_counters(V.records(spark, d)).drop("progress_percent")


@query(f"WITH {V.ORDER_RECORDS_SQL}, b AS ({_BATCH}) SELECT cast(c_custkey AS varchar) AS run_id, c_name AS source_filename, coalesce(total, 0) AS total, coalesce(classified, 0) AS classified, coalesce(failed, 0) AS failed, coalesce(total - classified - failed - input_invalid, 0) AS remaining FROM customer LEFT JOIN b ON b.run_id = cast(c_custkey AS varchar)")
def runs_list_counts(spark, d):
    return R.runs_with_counts(V.runs(spark, d), V.order_records(spark, d)).select("run_id", "source_filename", "total", "classified", "failed", "remaining")


@query(f"WITH {V.ORDER_RECORDS_SQL}, b AS ({_BATCH}) SELECT run_id, CASE WHEN total > classified + failed + input_invalid THEN NULL WHEN failed = 0 AND input_invalid = 0 AND classified >= total - input_invalid THEN 'completed' ELSE 'partial_failed' END AS status FROM b")
def run_status_rollup(spark, d):
    return R.run_status(V.order_records(spark, d))


@query("SELECT cast(c_custkey AS varchar) AS run_id, c_custkey % 97 AS created_at FROM customer WHERE c_nationkey % 3 = 1 ORDER BY created_at DESC, run_id DESC LIMIT 50 OFFSET 5")
def runs_page_newest(spark, d):
    rows = R.filtered(V.runs(spark, d), status="running")
    return R.page(rows, [F.desc("created_at"), F.desc("run_id")], 50, 5, 100).select("run_id", "created_at")


_STATS = "count(*) AS attempts, count(*) FILTER (a.status = 'succeeded') AS succeeded, count(*) FILTER (a.status = 'failed') AS failed, count(*) FILTER (a.status = 'unknown') AS unknown, count(*) FILTER (simulated) AS simulated"


@query(f"WITH {V.ORDER_RECORDS_SQL}, {V.CAMPAIGNS_SQL}, {V.ATTEMPTS_SQL}, s AS (SELECT run_id, stage, {_STATS} FROM attempts a JOIN campaigns USING (campaign_id) JOIN records USING (record_key) GROUP BY ALL), p AS (SELECT DISTINCT run_id, unnest(['stage1', 'stage2']) AS stage FROM records) SELECT run_id, stage, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('attempts', 'succeeded', 'failed', 'unknown', 'simulated'))} FROM p LEFT JOIN s USING (run_id, stage)")
def attempt_statistics_3way(spark, d):
    return R.attempt_statistics(V.order_records(spark, d), V.campaigns(spark, d), V.attempts(spark, d))


@query(f"WITH {V.CAMPAIGNS_SQL}, {V.ATTEMPTS_SQL} SELECT record_key, stage, string_agg(campaign_no || ':' || attempt_no || ':' || status, ',' ORDER BY campaign_no, attempt_no, status) AS attempts FROM attempts JOIN campaigns USING (campaign_id) GROUP BY ALL")
def attempts_grouped_by_stage(spark, d):
    out = R.attempts_by_stage(V.campaigns(spark, d), V.attempts(spark, d))
    return out.withColumn("attempts", F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["campaign_no"], a["attempt_no"], a["status"])), ","))


@query(f"WITH {V.CAMPAIGNS_SQL} SELECT record_key, stage, max_by(campaign_id, campaign_no) AS campaign_id, max(campaign_no) AS campaign_no, max(campaign_no) + 1 AS next_campaign_no FROM campaigns GROUP BY ALL")
def latest_campaign(spark, d):
    return R.latest_campaign(V.campaigns(spark, d))


@query("SELECT l_orderkey AS campaign_id, l_linenumber AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS attempt_no FROM lineitem")
def numbered_attempts(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("campaign_id"), F.col("l_shipdate").alias("started_at"), F.col("l_linenumber").alias("seq"))
    return R.numbered_attempts(rows).select("campaign_id", "seq", "attempt_no")


@query(f"WITH {V.JOBS_SQL} SELECT run_id, job_id, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, seq DESC) AS r FROM jobs) WHERE r <= 10")
def recent_jobs_per_run(spark, d):
    return R.newest_first(V.jobs(spark, d), ["run_id"], 10).select("run_id", "job_id", "position")


@query(f"WITH {V.JOBS_SQL} SELECT kind, arg_min(job_id, (created_at, job_id)) AS job_id FROM jobs WHERE status = 'queued' GROUP BY kind")
def queue_head_per_kind(spark, d):
    return R.queue_heads(V.jobs(spark, d)).select("kind", "job_id")


@query(f"WITH {V.JOBS_SQL} SELECT kind, arg_min(job_id, (created_at, job_id)) AS job_id FROM jobs WHERE status = 'queued' AND kind = 'export' GROUP BY kind")
def queue_head_paused(spark, d):
    return R.queue_heads(V.jobs(spark, d), paused=True).select("kind", "job_id")


@query(f"WITH {V.JOBS_SQL} SELECT run_id, kind, arg_min(job_id, (created_at, job_id)) AS job_id FROM jobs WHERE status IN ('queued', 'running') GROUP BY ALL")
def active_job_per_run(spark, d):
    return R.active_jobs(V.jobs(spark, d))


@query(f"WITH {V.RECORDS_SQL} SELECT record_id, failure_stage, failure_code, (SELECT count(*) > 50 FROM records WHERE status = 'failed') AS truncated FROM records WHERE status = 'failed' ORDER BY order_index LIMIT 50")
def failures_topk_truncated(spark, d):
    return R.failures(V.records(spark, d)).select("record_id", "failure_stage", "failure_code", "truncated")


def _failed_campaigns(spark, d):
    """Campaigns and attempts for failed document records: attempts by the length, none for every ninth."""
    failed = V.records(spark, d).where("status = 'failed'").select("record_key", F.col("failure_stage").alias("stage"), F.length("q").alias("n"), F.col("order_index").alias("o"))
    camps = failed.where("o % 9 <> 0").select(F.concat("record_key", F.lit("c")).alias("campaign_id"), "record_key", "stage", F.lit(1).alias("campaign_no"), "n")
    tries = camps.select("campaign_id", F.explode(F.sequence(F.lit(1), (F.col("n") % 3 + 1).cast("int"))).alias("attempt_no"))
    return camps.drop("n"), tries


@query(f"WITH {V.RECORDS_SQL} SELECT run_id, record_key, status, CASE WHEN status <> 'failed' THEN 'continue' WHEN failure_code IN ('CONTEXT_LIMIT', 'OUTPUT_TRUNCATED') THEN 'skip_permanent' WHEN order_index % 9 <> 0 AND length(q) % 3 + 1 < 3 THEN 'continue' ELSE 'reopen' END AS action FROM records WHERE status IN ('pending', 'stage1_done', 'failed')")
def resume_plan(spark, d):
    return R.resume_plan(V.records(spark, d), *_failed_campaigns(spark, d), retry_failed=True)


@query(f"WITH {V.RECORDS_SQL}, p AS (SELECT run_id, CASE WHEN status <> 'failed' THEN 'continue' WHEN failure_code IN ('CONTEXT_LIMIT', 'OUTPUT_TRUNCATED') THEN 'skip_permanent' WHEN order_index % 9 <> 0 AND length(q) % 3 + 1 < 3 THEN 'continue' ELSE 'skip_exhausted' END AS action FROM records WHERE status IN ('pending', 'stage1_done', 'failed')) SELECT run_id, {', '.join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in ('continue', 'reopen', 'skip_exhausted', 'skip_permanent'))} FROM p GROUP BY run_id")
def resume_counts(spark, d):
    return R.resume_counts(R.resume_plan(V.records(spark, d), *_failed_campaigns(spark, d)))


@query(f"WITH {V.RECORDS_SQL}, {V.GOLD_SQL}, c AS (SELECT record_id FROM records WHERE status = 'completed') SELECT coalesce(g.record_id, c.record_id) AS record_id, CASE WHEN c.record_id IS NULL THEN 'missing' WHEN g.record_id IS NULL THEN 'extra' ELSE 'both' END AS side FROM gold g FULL JOIN c USING (record_id)")
def id_set_reconcile(spark, d):
    return R.reconcile(V.gold(spark, d), V.records(spark, d).where("status = 'completed'"))


@query("SELECT lang AS run_id, cast(n_chars AS varchar) AS record_id, count(*) AS n_rows, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS source_rows FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("run_id"), F.col("n_chars").cast("string").alias("record_id"), F.col("doc_id").alias("source_row"))
    return R.duplicate_ids(rows).withColumn("source_rows", F.array_join("source_rows", ","))


def _errors(spark, d):
    return V.records(spark, d).where("status = 'input_invalid'").select("run_id", "source_row", F.lit("q missing").alias("reason"))


@query(f"WITH {V.RECORDS_SQL} SELECT record_id, run_id FROM records WHERE status <> 'input_invalid'")
def valid_records_anti(spark, d):
    return R.valid_records(V.records(spark, d), _errors(spark, d)).select("record_id", "run_id")


@query(f"WITH {V.RECORDS_SQL} SELECT record_id, run_id FROM records WHERE status = 'input_invalid'")
def invalid_records_semi(spark, d):
    return R.invalid_records(V.records(spark, d), _errors(spark, d)).select("record_id", "run_id")


@query(f"WITH {V.RECORDS_SQL} SELECT record_id, CASE WHEN status = 'input_invalid' THEN 'input_invalid' ELSE 'pending' END AS status FROM records")
def initial_status(spark, d):
    return R.with_initial_status(V.records(spark, d).drop("status"), _errors(spark, d)).select("record_id", "status")


@query("SELECT lang || '-' || n_chars AS record_id, cast(row_number() OVER (ORDER BY n_chars, lang) AS bigint) AS rank FROM (SELECT DISTINCT lang, n_chars FROM documents)")
def order_numeric_prefix(spark, d):
    ids = spark.read.parquet(f"{d}/documents.parquet").select(F.concat_ws("-", F.col("n_chars").cast("string"), "lang").alias("x")).distinct()
    out = ranked(ids, R.in_numeric_order(ids, "x"), "rank")
    return out.select(F.concat_ws("-", F.split_part("x", F.lit("-"), F.lit(2)), F.split_part("x", F.lit("-"), F.lit(1))).alias("record_id"), "rank")


@query("SELECT user_id AS run_id, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS revision FROM events GROUP BY user_id")
def revision_counter(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {"view": "stage_committed", "click": "record_failed", "purchase": "checkpoint_reset"}.items() for x in kv])
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("run_finished")).alias("event"))
    return R.revisions(ev)


@query("SELECT user_id AS run_id, revision, min(event_id) AS seq FROM (SELECT *, cast(event_id % 7 AS integer) AS revision FROM events) GROUP BY ALL")
def auto_export_dedupe(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.expr("cast(event_id % 7 as int)").alias("revision"), F.col("event_id").alias("seq"))
    return R.deduplicated(ev, ["run_id", "revision"])


@query("WITH r AS (SELECT event_id AS seq, event_type AS scope, user_id AS k, cast(value AS integer) % 2 AS digest FROM events), f AS (SELECT scope, k, min(seq) AS s, arg_min(digest, seq) AS d FROM r GROUP BY ALL) SELECT seq, CASE WHEN seq = s THEN 'first' WHEN digest = d THEN 'replayed' ELSE 'conflict' END AS outcome FROM r JOIN f USING (scope, k)")
def idempotency_outcomes(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("scope"), F.col("user_id").alias("key"), F.expr("cast(rint(value) as int) % 2").alias("digest"))
    return R.idempotency(ev).select("seq", "outcome")


@query("SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, max(event_id) AS at FROM events GROUP BY user_id")
def latest_state_from_log(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"))
    return R.latest_state(ev, "run_id", ["status", "at"])


@query(f"WITH {V.JOBS_SQL}, h AS (SELECT DISTINCT run_id FROM jobs WHERE status = 'running' AND kind = 'classify'), u AS (SELECT 'job' AS what, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM jobs UNION ALL SELECT 'attempt', CASE WHEN l_returnflag = 'N' THEN 'unknown' WHEN l_returnflag = 'A' THEN 'succeeded' ELSE 'failed' END FROM lineitem UNION ALL SELECT 'run', CASE WHEN c_nationkey % 3 = 1 AND h.run_id IS NOT NULL THEN 'interrupted' WHEN c_nationkey % 3 = 1 THEN 'running' WHEN c_nationkey % 3 = 0 THEN 'completed' ELSE 'partial_failed' END FROM customer LEFT JOIN h ON h.run_id = cast(c_custkey AS varchar)) SELECT what, status, count(*) AS n FROM u GROUP BY ALL")
def crash_recovery(spark, d):
    attempts = V.attempts(spark, d).withColumn("status", F.when(F.col("status") == "unknown", "running").otherwise(F.col("status")))
    parts = R.recovered(V.jobs(spark, d), attempts, V.runs(spark, d))
    named = [p.select(F.lit(n).alias("what"), "status") for n, p in zip(("job", "attempt", "run"), parts, strict=True)]
    return named[0].union(named[1]).union(named[2]).groupBy("what", "status").agg(F.count("*").alias("n"))


@query(f"WITH {V.RECORDS_SQL}, {V.CAMPAIGNS_SQL} SELECT 'label_only_if_completed' AS rule, count(*) FILTER ((label IS NOT NULL) <> (status = 'completed')) AS violations FROM records UNION ALL SELECT 'review_only_if_completed', count(*) FILTER ((review_required IS NOT NULL) <> (status = 'completed')) FROM records UNION ALL SELECT 'question_and_answer', count(*) FILTER (NOT (status = 'input_invalid' OR (q IS NOT NULL AND a IS NOT NULL))) FROM records UNION ALL SELECT 'unique_record_id', count(*) FROM (SELECT a, length(q) FROM records GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'campaign_has_record', count(*) FROM campaigns c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = c.record_key AND o_orderstatus <> 'P')")
def constraint_violations(spark, d):
    records = V.records(spark, d)
    known = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'P'")
    out = C.row_violations(records, C.RECORD_RULES)
    out = out.union(C.key_violations(records.withColumn("n", F.length("q")), "unique_record_id", ["a", "n"]))
    return out.union(C.reference_violations(V.campaigns(spark, d), known, "campaign_has_record", "record_key", "o_orderkey"))
