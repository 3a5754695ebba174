"""Registered queries of record pages, checkpoints, campaigns, endings, exports and logs, each with its comparison SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import export as E
from ..operators import records as R
from ..operators.ranks import shared_folder
from ..schemas import INPUT_COLUMNS, LABELS, REFS
from ..sources.pinned import Version
from . import adapter as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a function of (spark, sf_dir) under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- pages and details


def _results(spark, d):
    """Both stage results of every other record and the first stage of every third, as stored."""
    r = V.records(spark, d).select("record_key", "order_index")
    one = r.where("order_index % 3 <> 1").select("record_key", F.lit(1).alias("stage"), F.expr("""concat('{"reason": "one ', order_index, '"}')""").alias("result_json"))
    return one.union(r.where("order_index % 2 = 0").select("record_key", F.lit(2), F.expr("""concat('{"reason": "two ', order_index, '"}')""")))


def _sources(spark, d):
    return V.records(spark, d).groupBy("run_id").agg(F.count("*").alias("revision"))


@query(f"WITH {V.RECORDS_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS revision FROM records), f AS (SELECT *, count(*) OVER () AS total FROM t WHERE status = 'completed') SELECT record_id, run_id, label, total, revision, CASE WHEN order_index % 2 = 0 THEN 'two ' || order_index END AS reason FROM f ORDER BY order_index LIMIT 60 OFFSET 20")
def records_page_results(spark, d):
    out = R.records_page_with_results(V.records(spark, d), _results(spark, d), _sources(spark, d), status="completed", limit=60, offset=20)
    return out.select("record_id", "run_id", "label", "total", "revision", "reason")


_TRIED = "cast((l_linenumber + 1) // 2 AS integer)"


@query(f"WITH {V.ORDER_RECORDS_SQL}, t AS (SELECT l_orderkey AS record_key, string_agg(CASE WHEN l_linenumber % 2 = 1 THEN 'stage1' ELSE 'stage2' END || ':' || {_TRIED} || ':' || CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'unknown' END, ',' ORDER BY l_linenumber % 2 = 0, {_TRIED}, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 3 END) AS attempts, count(*) AS n FROM lineitem GROUP BY 1) SELECT r.record_key, r.status, CASE WHEN r.record_key % 3 <> 1 THEN 'one' END AS stage1, CASE WHEN r.record_key % 2 = 0 THEN 'two' END AS stage2, coalesce(t.attempts, '') AS attempts FROM records r LEFT JOIN t USING (record_key)")
def record_details(spark, d):
    records = V.order_records(spark, d)
    one = records.where("record_key % 3 <> 1").select("record_key", F.lit(1).alias("stage"), F.lit("one").alias("result_json"))
    results = one.union(records.where("record_key % 2 = 0").select("record_key", F.lit(2), F.lit("two")))
    attempts = _table(spark, d, "lineitem").selectExpr("l_orderkey as record_key", "if(l_linenumber % 2 = 1, 'stage1', 'stage2') as stage", "cast((l_linenumber + 1) div 2 as int) as campaign_no", "1 as attempt_no", "case l_returnflag when 'A' then 'succeeded' when 'R' then 'failed' else 'unknown' end as status", "cast(null as string) as error_code")
    out = R.record_details(records, results, attempts)
    shown = F.array_join(F.transform("attempt_summary", lambda a: F.concat_ws(":", a["stage"], a["campaign_no"], a["status"])), ",")
    return out.select("record_key", "status", F.col("stage1_json").alias("stage1"), F.col("stage2_json").alias("stage2"), F.coalesce(shown, F.lit("")).alias("attempts"))


@query(f"WITH {V.ORDER_RECORDS_SQL}, {V.CAMPAIGNS_SQL}, {V.ATTEMPTS_SQL}, s AS (SELECT run_id, count(*) AS attempts, count(*) FILTER (simulated) AS simulated FROM attempts JOIN campaigns USING (campaign_id) JOIN records USING (record_key) GROUP BY 1), p AS (SELECT DISTINCT run_id FROM records) SELECT run_id, CAST(coalesce(attempts, 0) AS BIGINT) AS attempts, CAST(coalesce(simulated, 0) AS BIGINT) AS simulated FROM p LEFT JOIN s USING (run_id)")
def attempts_in_all(spark, d):
    return R.attempts_in_all(R.attempt_statistics(V.order_records(spark, d), V.campaigns(spark, d), V.attempts(spark, d)))


@query("SELECT l_suppkey AS run_id, bool_or(l_linestatus = 'O' AND l_quantity > 45) AS simulated, coalesce(string_agg(DISTINCT CASE WHEN l_linenumber < 6 THEN 'm' || l_linenumber END, ',' ORDER BY CASE WHEN l_linenumber < 6 THEN 'm' || l_linenumber END), '') AS models FROM lineitem GROUP BY 1")
def run_facts(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.expr("l_linestatus = 'O' and l_quantity > 45").alias("simulated"), F.expr("case when l_linenumber < 6 then 'm' || l_linenumber end").alias("model"))
    return R.run_facts(rows).withColumn("models", F.array_join("models", ","))


# -- what can be done with a run


def _failed_orders(spark, d):
    """Orders as records: failures by the order's number, a campaign with a budget of its own for most of them."""
    r = V.order_records(spark, d).withColumns({"failure_stage": F.expr("if(status = 'failed', 'stage1', null)"), "failure_code": F.expr("case when status <> 'failed' then null when record_key % 5 = 0 then 'CONTEXT_LIMIT' else 'OUTPUT_INVALID' end")})
    c = r.where("status = 'failed' and record_key % 7 <> 0").select(F.col("record_key").alias("campaign_id"), "record_key", F.lit("stage1").alias("stage"), F.lit(1).alias("campaign_no"), F.expr("cast(1 + record_key % 5 as int)").alias("max_attempts"))
    return r, c, c.select("campaign_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt_no"))


_ACTIONS = f"""WITH {V.ORDER_RECORDS_SQL}, {V.JOBS_SQL}, p AS (
  SELECT run_id, CASE WHEN status <> 'failed' THEN 'continue' WHEN record_key % 5 = 0 THEN 'permanent' WHEN record_key % 7 <> 0 AND 1 + record_key % 5 > 3 THEN 'continue' ELSE 'reopen' END AS a FROM records WHERE status IN ('pending', 'failed')
), n AS (SELECT run_id, count(*) FILTER (a = 'continue') AS c, count(*) FILTER (a = 'reopen') AS r, count(*) FILTER (a = 'permanent') AS p FROM p GROUP BY 1
), m AS (SELECT run_id, count(*) FILTER (status = 'pending') AS remaining FROM records GROUP BY 1
), b AS (SELECT run_id, bool_or(kind = 'classify') AS classifying, bool_or(kind = 'export') AS exporting FROM jobs WHERE status IN ('queued', 'running') GROUP BY 1
), x AS (
  SELECT cast(c_custkey AS varchar) AS run_id, CASE c_nationkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'partial_failed' END AS status, coalesce(c, 0) AS c, coalesce(r, 0) AS r, coalesce(p, 0) AS p, coalesce(remaining, 0) AS remaining, coalesce(classifying, false) AS k, coalesce(exporting, false) AS e
  FROM customer LEFT JOIN n ON n.run_id = cast(c_custkey AS varchar) LEFT JOIN m ON m.run_id = cast(c_custkey AS varchar) LEFT JOIN b ON b.run_id = cast(c_custkey AS varchar)
), y AS (SELECT *, NOT k AND status <> 'completed' AS o FROM x
), z AS (SELECT *, o AND c = 0 AND remaining = 0 AND status = 'running' AS f FROM y)
SELECT run_id, o AND (c > 0 OR f) AS can_resume, o AND r > 0 AS can_retry_failed, f AS finalization_required, CASE WHEN o THEN c ELSE 0 END AS selected, CASE WHEN o THEN r ELSE 0 END AS skipped_budget_exhausted, CASE WHEN o THEN p ELSE 0 END AS skipped_needs_new_batch,
  CASE WHEN o THEN c + r ELSE 0 END AS retry_selected, CASE WHEN o THEN r ELSE 0 END AS retry_renewed, CASE WHEN o THEN remaining ELSE 0 END AS remaining,
  CASE WHEN k THEN 'active_job' WHEN NOT o THEN 'ended' WHEN c > 0 OR f THEN NULL WHEN p > 0 AND r = 0 THEN 'needs_new_batch' WHEN r > 0 AND p = 0 THEN 'budget_exhausted' ELSE 'nothing_to_resume' END AS disabled_reason, NOT e AS can_export FROM z"""


@query(_ACTIONS)
def allowed_actions(spark, d):
    return R.allowed_actions(V.runs(spark, d), *_failed_orders(spark, d), V.jobs(spark, d))


@query(f"WITH {V.ORDER_RECORDS_SQL} SELECT record_key, CASE WHEN status = 'failed' AND record_key % 5 = 0 THEN 'skip_permanent' WHEN status = 'failed' AND (record_key % 7 = 0 OR 1 + record_key % 5 <= 3) THEN 'skip_exhausted' ELSE 'continue' END AS action FROM records WHERE status IN ('pending', 'failed')")
def resume_plan_own_budgets(spark, d):
    return R.resume_plan(*_failed_orders(spark, d)).select("record_key", "action")


@query(f"WITH {V.RECORDS_SQL}, s AS (SELECT record_key, order_index % 3 <> 1 AS stored, order_index % 4 = 0 AS old, order_index % 8 = 0 AS other, run_id, status FROM records), p AS (SELECT *, CASE WHEN status IN ('completed', 'input_invalid') THEN 'STATE_CONFLICT' WHEN run_id = 'src3' OR (stored AND (old OR other)) THEN 'VERSION_INCOMPATIBLE' END AS problem FROM s) SELECT record_key, problem, CASE WHEN problem IS NULL THEN CASE WHEN stored THEN 'stage1_done' ELSE 'pending' END END AS checkpoint, CASE WHEN problem IS NULL THEN CASE WHEN stored THEN 'stage1_done' ELSE 'pending' END <> status END AS reset FROM p")
def checkpoints(spark, d):
    records = V.records(spark, d)
    results = _results(spark, d).join(records.select("record_key", "order_index"), "record_key").withColumns({"schema_version": F.expr("if(order_index % 4 = 0, '1', '2')"), "prompt_sha256": F.expr("if(order_index % 8 = 0, 'other', 'sha')")})
    runs = _sources(spark, d).select("run_id", F.expr("if(run_id = 'src3', null, 'sha')").alias("stage1_sha256"))
    return R.checkpoints(records, results, runs, "2").select("record_key", "problem", "checkpoint", "reset")


@query(f"WITH {V.CAMPAIGNS_SQL}, n AS (SELECT record_key, stage, max(campaign_no) AS campaign_no, max_by(campaign_id % 2, campaign_no) AS opener FROM campaigns GROUP BY ALL), q AS (SELECT o_orderkey AS record_key, unnest(['stage1', 'stage2']) AS stage FROM orders WHERE o_orderkey % 3 = 0) SELECT record_key, stage, cast(coalesce(campaign_no, 0) + 1 AS integer) AS campaign_no, 3 AS max_attempts, 'explicit_retry' AS reason, 'j1' AS created_by_job_id FROM q LEFT JOIN n USING (record_key, stage) WHERE opener IS DISTINCT FROM 1")
def reopened_campaigns(spark, d):
    campaigns = V.campaigns(spark, d).withColumns({"created_by_job_id": F.expr("concat('j', campaign_id % 2)"), "reason": F.lit(R.EXPLICIT)})
    asked = _table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.lit("j1").alias("job_id"), F.col("o_orderkey").alias("record_key"), F.explode(F.array(F.lit("stage1"), F.lit("stage2"))).alias("stage"))
    return R.reopened(asked.union(asked), campaigns)  # a plan that is handed in twice opens nothing twice


def _ended(spark, d):
    runs = V.runs(spark, d).withColumn("revision", F.expr("cast(run_id as bigint) % 9"))
    jobs = runs.select(F.concat(F.lit("j"), "run_id").alias("job_id"), "run_id", F.expr("if(cast(run_id as bigint) % 4 = 0, 'export', 'classify')").alias("kind"))
    records = V.order_records(spark, d).withColumn("status", F.expr("if(status = 'pending' and record_key % 10 < 8, 'completed', status)"))
    exports = runs.select("run_id", F.lit(4).cast("bigint").alias("scheduled_revision"), F.expr("if(cast(run_id as bigint) % 2 = 0, 'manual', 'automatic')").alias("source"))
    return R.finalized(jobs, runs, records, exports)


_ENDED = f"{V.ORDER_RECORDS_SQL}, s AS (SELECT run_id, CASE WHEN status = 'pending' AND record_key % 10 < 8 THEN 'completed' ELSE status END AS status FROM records), u AS (SELECT run_id, CASE WHEN count(*) FILTER (status = 'pending') > 0 THEN NULL WHEN count(*) FILTER (status = 'failed') = 0 THEN 'completed' ELSE 'partial_failed' END AS status FROM s GROUP BY 1), e AS (SELECT 'j' || c_custkey AS job_id, cast(c_custkey AS varchar) AS run_id, c_custkey % 9 AS revision, u.status FROM customer LEFT JOIN u ON u.run_id = cast(c_custkey AS varchar) WHERE c_custkey % 4 <> 0)"


@query(f"WITH {_ENDED} SELECT * FROM e")
def finalized_runs(spark, d):
    return _ended(spark, d)[0]


@query(f"WITH {_ENDED} SELECT run_id, revision AS scheduled_revision, 'automatic' AS source FROM e WHERE status IS NOT NULL AND NOT (revision = 4 AND cast(run_id AS bigint) % 2 = 1)")
def automatic_exports(spark, d):
    return _ended(spark, d)[1]


@query(f"WITH {V.JOBS_SQL}, b AS (SELECT DISTINCT run_id FROM jobs WHERE kind = 'export' AND status IN ('queued', 'running')), q AS (SELECT o_orderkey AS seq, cast(o_custkey AS varchar) AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT seq, run_id, CASE WHEN r > 1 OR run_id IN (SELECT run_id FROM b) THEN 'STATE_CONFLICT' ELSE 'accepted' END AS outcome FROM q")
def manual_exports(spark, d):
    asked = _table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("run_id"))
    return R.manual_exports(asked, V.jobs(spark, d))


@query(f"WITH {V.RECORDS_SQL}, n AS (SELECT run_id, count(*) AS captured_revision FROM records GROUP BY 1), t AS (SELECT order_index, order_index % 4 AS k FROM records) SELECT r.record_key, n.captured_revision, 'now' AS captured_at, CASE WHEN order_index % 3 <> 1 THEN 'one ' || order_index END AS one, CASE WHEN order_index % 2 = 0 THEN 'two ' || order_index END AS two, CASE WHEN k = 0 THEN NULL ELSE k || '/' || least(k, 2) || '/' || CASE WHEN k = 3 THEN 1 ELSE 0 END || '/1' END AS tried FROM records r JOIN n USING (run_id) JOIN t USING (order_index)")
def captured_snapshot(spark, d):
    """Every fourth record has no attempts, the others one to three: the first two of stage 1, the first simulated, all succeeded."""
    records = V.records(spark, d)
    attempts = records.where("order_index % 4 > 0").select("record_key", F.explode(F.sequence(F.lit(1), F.col("order_index") % 4)).alias("n")).selectExpr("record_key", "if(n < 3, 1, 2) as stage", "'succeeded' as status", "n = 1 as simulated")
    out = R.captured(E.snapshot(records, _results(spark, d), attempts), _sources(spark, d), "now")
    s = F.col("attempt_summary")
    return out.select("record_key", "captured_revision", "captured_at", F.get_json_object("stage1_json", "$.reason").alias("one"), F.get_json_object("stage2_json", "$.reason").alias("two"), F.concat(s["total"], F.lit("/"), s["stage1"], F.lit("/"), s["stage2"], F.lit("/"), s["simulated"]).alias("tried"))


# -- logs in place of updates


@query(f"WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'stage1_done' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'reset_stage1_done' ELSE 'reset_pending' END AS event FROM events), x AS (SELECT user_id AS record_key, arg_max(event, event_id) AS event, max(event_id) AS e FROM l GROUP BY 1) SELECT record_key, CASE event WHEN 'reset_stage1_done' THEN 'stage1_done' WHEN 'reset_pending' THEN 'pending' ELSE event END AS status, CASE WHEN event = 'completed' THEN '{LABELS[0]}' END AS label, CASE WHEN event = 'completed' THEN e % 2 = 0 END AS review_required, CASE WHEN event = 'failed' THEN 'stage2' END AS failure_stage, CASE WHEN event = 'failed' THEN 'C' || e % 3 END AS failure_code FROM x")
def record_states(spark, d):
    kind = F.expr("case event_type when 'view' then 'stage1_done' when 'click' then 'completed' when 'error' then 'failed' when 'signup' then 'reset_stage1_done' else 'reset_pending' end")
    log = _table(spark, d, "events").select(F.col("user_id").alias("record_key"), F.col("event_id").alias("seq"), kind.alias("event"), F.lit(LABELS[0]).alias("label"), F.expr("event_id % 2 = 0").alias("review_required"), F.lit("stage2").alias("failure_stage"), F.expr("concat('C', event_id % 3)").alias("failure_code"))
    return R.record_states(log)


@query("WITH l AS (SELECT user_id AS campaign_id, cast(event_id % 11 AS integer) AS attempt_no, event_id, event_type <> 'error' AS finish FROM events), x AS (SELECT campaign_id, attempt_no, bool_or(NOT finish) AS reserved, min(event_id) FILTER (finish) AS e FROM l GROUP BY ALL) SELECT campaign_id, attempt_no, CASE WHEN e IS NULL THEN 'running' WHEN e % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN e % 2 = 1 THEN 'OUTPUT_INVALID' END AS error_code FROM x WHERE reserved")
def attempt_states(spark, d):
    log = _table(spark, d, "events").selectExpr("user_id as campaign_id", "cast(event_id % 11 as int) as attempt_no", "event_id as seq", "if(event_type = 'error', 'reserved', 'finished') as event", "if(event_id % 2 = 0, 'succeeded', 'failed') as status", "if(event_id % 2 = 1, 'OUTPUT_INVALID', null) as error_code")
    return R.attempt_states(log)


@query("WITH l AS (SELECT event_id, user_id, CASE WHEN value > 100 THEN 'worker_started' WHEN value < 20 THEN 'paused' ELSE 'other' END AS event, event_type = 'signup' AS clear_pause FROM events), t AS (SELECT max(event_id) FILTER (event = 'paused') AS p, max(event_id) FILTER (event = 'worker_started' AND clear_pause) AS c FROM l) SELECT (SELECT arg_max('w' || user_id, event_id) FROM l WHERE event = 'worker_started') AS worker_id, coalesce(p > coalesce(c, -1), false) AS paused, CASE WHEN p > coalesce(c, -1) THEN 'r' || p END AS pause_reason FROM t")
def runtime_state(spark, d):
    log = _table(spark, d, "events").selectExpr("event_id as seq", "case when value > 100 then 'worker_started' when value < 20 then 'paused' else 'other' end as event", "concat('w', user_id) as worker_id", "event_type = 'signup' as clear_pause", "concat('r', event_id) as reason")
    return R.runtime_state(log)


@query("WITH f AS (SELECT o_orderkey % 40 AS evaluation_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS reports FROM orders GROUP BY 1) SELECT p_partkey AS evaluation_id, c_name AS source_filename, CASE c_nationkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'partial_failed' END AS run_status, coalesce(reports, '') AS reports FROM part LEFT JOIN customer ON c_custkey = p_partkey * 3 LEFT JOIN f ON f.evaluation_id = p_partkey")
def evaluations_view(spark, d):
    evaluations = _table(spark, d, "part").select(F.col("p_partkey").alias("evaluation_id"), (F.col("p_partkey") * 3).cast("string").alias("run_id"))
    reports = _table(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("evaluation_id"), F.col("o_orderpriority").alias("path"))
    out = R.evaluations_view(evaluations, V.runs(spark, d), reports)
    return out.select("evaluation_id", "source_filename", "run_status", F.coalesce(F.array_join("reports", ","), F.lit("")).alias("reports"))


# -- values


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey % 8 AS kind, CASE l_orderkey % 8 WHEN 0 THEN (12345678901234567 + l_orderkey) || '' WHEN 1 THEN CAST(l_extendedprice * 1000 + 0.5 AS VARCHAR) WHEN 2 THEN CAST(l_orderkey / 1e9 AS VARCHAR) WHEN 3 THEN '00' || l_orderkey WHEN 4 THEN '00' || l_orderkey WHEN 5 THEN (l_linenumber % 2) || '' WHEN 6 THEN l_quantity || '' ELSE ' x' || chr(13) || chr(10) || l_orderkey || chr(9) END AS v FROM lineitem)
SELECT k, CASE kind WHEN 0 THEN v WHEN 1 THEN CASE WHEN CAST(v AS DOUBLE) = floor(CAST(v AS DOUBLE)) THEN CAST(CAST(v AS DOUBLE) AS BIGINT) || '' ELSE v END WHEN 2 THEN CASE WHEN v = '0.0' THEN '0' ELSE v END WHEN 3 THEN ltrim(v, '0') WHEN 4 THEN v WHEN 5 THEN CASE v WHEN '1' THEN 'TRUE' ELSE 'FALSE' END WHEN 6 THEN CAST(CAST(v AS DOUBLE) AS BIGINT) || '' ELSE 'x' || chr(10) || substr(v, 5, length(v) - 5) END AS text FROM c""")
def cell_text_encode(spark, d):
    """Numbers with long digits, fractions, exponents and leading zeros, texts that look like numbers, truth values."""
    kind, key = F.col("l_orderkey") % 8, F.col("l_orderkey")
    value = F.when(kind == 0, (key + 12345678901234567).cast("string")).when(kind == 1, (F.col("l_extendedprice") * 1000 + 0.5).cast("string")).when(kind == 2, (key / 1e9).cast("string")).when(kind.isin(3, 4), F.concat(F.lit("00"), key)).when(kind == 5, (F.col("l_linenumber") % 2).cast("string")).when(kind == 6, F.col("l_quantity").cast("string")).otherwise(F.concat(F.lit(" x\r\n"), key, F.lit("\t")))
    shown = F.when(kind.isin(4, 7), "s").when(kind == 5, "b").otherwise("n")
    return _table(spark, d, "lineitem").select((key * 10 + F.col("l_linenumber")).alias("k"), X.cell_to_text(shown, value).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN cast(event_id % 3 + 1 AS integer) END AS number, CASE WHEN event_id % 4 IN (1, 2) THEN 'stage' || event_id % 4 END AS name, array_to_string(CASE WHEN event_id % 6 > 3 THEN list_transform(range(3), lambda i: 'x' || i) || ['…+' || (event_id % 6 - 3)] ELSE list_transform(range(event_id % 6), lambda i: 'x' || i) END, ',') AS capped, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def names_and_caps(spark, d):
    e = _table(spark, d, "events")
    n = F.col("event_id") % 6
    listed = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("x"), i))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", X.stage_number(F.concat(F.lit("stage"), F.col("event_id") % 3 + 1)).alias("number"), X.stage_name((F.col("event_id") % 4).cast("int")).alias("name"), F.array_join(X.capped(listed, 3), ",").alias("capped"), X.utc_text(F.col("ts")).alias("at"))


@query("SELECT doc_id, cast(doc_id % 11 AS integer) AS n_refs, array_to_string(['" + "', '".join(INPUT_COLUMNS) + "'], ',') AS names, doc_id || '|' || text || '|' || lang || '|' || CASE WHEN doc_id % 11 > 0 THEN source ELSE '' END AS read FROM documents")
def raw_inputs(spark, d):
    """The input columns as a map in their order, and read back from it; the number of references."""
    docs = _table(spark, d, "documents")
    refs = [F.when(F.col("doc_id") % 11 > i, F.col("source")) for i in range(10)]
    raw = docs.select("doc_id", F.struct(*[c.alias(r) for c, r in zip(refs, REFS, strict=True)]).alias("refs"), X.raw_input(F.col("doc_id").cast("string"), F.col("text"), F.col("lang"), *refs).alias("raw"))
    back = raw.select("doc_id", X.ref_count(F.col("refs")).alias("n_refs"), F.array_join(F.map_keys("raw"), ",").alias("names"), X.input_of(F.col("raw")).alias("r"))
    return back.select("doc_id", "n_refs", "names", F.concat_ws("|", "r.record_id", "r.q", "r.a", F.coalesce("r.refs.ref1", F.lit(""))).alias("read"))


@query("WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT events.* FROM events, n WHERE event_id * 2 < n.n) SELECT user_id AS record_key, arg_max(event_type, event_id) AS status, count(*) AS n_states, (SELECT max(event_id) FROM e) AS captured_revision FROM e GROUP BY 1")
def pinned_version(spark, d):
    """States of records in a version captured between two appends: what is appended afterwards changes nothing."""
    events = _table(spark, d, "events").select(F.col("user_id").alias("record_key"), F.col("event_id").alias("revision"), F.col("event_type").alias("status"))
    half, folder = events.count() / 2, f"{shared_folder(spark)}/jurata/version-{uuid.uuid4().hex}"
    early = F.col("revision") < half
    ahead = events.where(~early & (F.col("revision") % 10 == 0))  # rows are there before their revision is raised
    events.where(early).union(ahead).write.parquet(f"{folder}/states")
    events.where(early).select("revision").write.parquet(f"{folder}/log")
    version = Version.capture(spark, f"{folder}/log", {"states": f"{folder}/states"})
    version.store(f"{folder}/version.json")
    events.where(~early).write.mode("append").parquet(f"{folder}/states")
    events.where(~early).select("revision").write.mode("append").parquet(f"{folder}/log")
    rows = Version.load(spark, f"{folder}/version.json").read("states")
    return rows.groupBy("record_key").agg(F.max_by("status", "revision").alias("status"), F.count("*").alias("n_states"), F.lit(version.revision).cast("long").alias("captured_revision"))
