"""Registered queries of the judging rules and the ledger: replies, errors and attempts derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judgement as J
from ..functions import typed
from ..operators import evaluation, judge, ledger
from ..operators import requests as Q
from ..operators.records import resume_plan
from ..schemas import LABELS, REFS
from . import adapter as V
from .state_queries import _failed_orders

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


_ONE = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_linestatus)"
_OUT = "CASE WHEN l_returnflag = 'A' AND l_linenumber > 2 THEN 'ok' WHEN l_partkey % 2 = 0 THEN 'validation_error' ELSE 'model_error' END"
_BAD = "CASE WHEN l_returnflag = 'A' AND l_linenumber > 2 THEN NULL WHEN l_partkey % 2 = 0 THEN 'OUTPUT_INVALID' WHEN l_suppkey % 3 = 0 THEN 'CONTEXT_LIMIT' ELSE 'MODEL_RETRYABLE' END"


@query(
    f"""WITH r AS (SELECT l_orderkey::varchar AS record_id, CASE WHEN l_linenumber % 2 = 1 THEN 'stage1' ELSE 'stage2' END AS stage, cast((l_linenumber + 1) // 2 AS integer) AS attempt_no, l_returnflag <> 'N' AS ended, {_OUT} AS outcome, {_BAD} AS code, l_linestatus || l_partkey AS content FROM lineitem QUALIFY {_ONE} = 1),
t AS (SELECT *, CASE WHEN ended THEN outcome ELSE 'unknown' END AS o FROM r),
l AS (SELECT record_id, stage, max(attempt_no) AS used, arg_max(o, attempt_no) AS last, arg_max_null(CASE WHEN ended THEN code END, attempt_no) AS last_code, bool_or(o = 'ok') AS done, arg_max(content, attempt_no) FILTER (o = 'ok') AS content, count(*) FILTER (o = 'validation_error') AS n_tried FROM t GROUP BY ALL)
SELECT record_id, stage, used, CASE WHEN done THEN 'done' WHEN last = 'model_error' AND last_code <> 'MODEL_RETRYABLE' THEN 'failed' WHEN used >= 3 THEN 'exhausted' ELSE 'open' END AS next, content, cast(n_tried AS integer) AS n_tried FROM l"""
)
def ledger_states(spark, d):
    """What each stage of each order may do next: every line is a reserved attempt, those not returned have no outcome."""
    line = _table(spark, d, "lineitem").withColumn("one", F.expr(_ONE)).where("one = 1").selectExpr("cast(l_orderkey as string) as record_id", "if(l_linenumber % 2 = 1, 'stage1', 'stage2') as stage", "cast((l_linenumber + 1) div 2 as int) as attempt_no", "l_returnflag", f"{_OUT} as outcome", "l_linestatus || l_partkey as content", f"{_BAD} as error_code", "'m' as error_message")
    none = {"model": "string", "latency_ms": "long", "simulated": "boolean", "usage": "string"}
    finished = line.where("l_returnflag <> 'N'").withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    out = ledger.states(ledger.attempts(line, finished))
    return out.select("record_id", "stage", "used", "next", "content", F.size("tried").alias("n_tried"))


_NAMES = ("ConnectionResetError", "BrokenPipeError", "ConnectionRefusedError", "PermissionError", "TimeoutError", "ReadTimeout", "KeyError", "ValueError", "RateLimitError")


@query(f"WITH e AS (SELECT event_id, [{', '.join(repr(n) for n in _NAMES)}][event_id % 9 + 1] AS name, CASE user_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 401 END END AS status FROM events) SELECT event_id, CASE WHEN status IN (429, 503) THEN 'MODEL_RETRYABLE' WHEN status = 401 THEN 'MODEL_PERMANENT' WHEN name IN ('KeyError', 'ValueError', 'RateLimitError') THEN 'MODEL_PERMANENT' ELSE 'MODEL_RETRYABLE' END AS code FROM e")
def error_classes(spark, d):
    """Classes of errors by status, else by the kind of the exception: what the operating system raises is worth another try."""
    e = _table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 9).cast("int")).alias("name"), F.expr("case user_id % 4 when 0 then 429 when 1 then 503 when 2 then if(event_id % 2 = 0, 401, null) end").alias("status"))
    return e.select("event_id", J.error_code(F.col("status"), F.col("name"), F.lit("")).alias("code"))


# Stage-2 replies of events: every field has forms that keep and forms that break the contract.
_REPLY = """concat('{', '"label": ', CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"x"' ELSE '"%s"' END,
CASE WHEN event_id %% 7 = 0 THEN '' WHEN event_id %% 7 = 1 THEN ', "reason": 12' ELSE ', "reason": "r"' END,
CASE event_id %% 4 WHEN 0 THEN ', "issues": "a"' WHEN 1 THEN ', "issues": ["a", null, 3, "b"]' WHEN 2 THEN ', "issues": []' ELSE '' END,
', "evidence_sufficiency": "', CASE WHEN event_id %% 3 = 0 THEN 'sufficient' ELSE event_type END, '"',
CASE event_id %% 6 WHEN 0 THEN ', "evidence": {}' WHEN 1 THEN ', "evidence": [{"ref_id": "ref1"}, 5, {"ref_id": 1, "quote": "q", "more": 1}]' ELSE ', "evidence": [{"ref_id": "ref2", "quote": "q"}]' END,
', "review_required": ', CASE event_id %% 11 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN '"Yes"' WHEN 3 THEN '0.0' WHEN 4 THEN '2' WHEN 5 THEN '0.5' WHEN 6 THEN '"maybe"' WHEN 7 THEN 'null' WHEN 8 THEN '[]' WHEN 9 THEN '"OFF"' ELSE 'false' END, '}')""".replace("event_id % 5", "event_id %% 5") % LABELS[0]  # fmt: skip

_SUFFICIENT = typed._choice(typed.SUFFICIENCY).replace("'", "''")
_LABELLED = typed._choice(LABELS).replace("'", "''")
_KIND = "json_type(json_extract({0}, '{1}'))"
_FIELD_ERRORS = f"""WITH r AS (SELECT event_id, {_REPLY}::json AS j FROM events),
e AS (
SELECT event_id, 1 AS f, 0 AS i, 'label' AS path, '{_LABELLED}' AS m FROM r WHERE json_extract_string(j, '$.label') IS NULL OR json_extract_string(j, '$.label') NOT IN ({', '.join(f"'{x}'" for x in LABELS)})
UNION ALL SELECT event_id, 2, 0, 'reason', CASE WHEN json_exists(j, '$.reason') THEN 'Input should be a valid string' ELSE 'Field required' END FROM r WHERE coalesce({_KIND.format('j', '$.reason')}, '') <> 'VARCHAR'
UNION ALL SELECT event_id, 3, 0, 'issues', 'Input should be a valid tuple' FROM r WHERE {_KIND.format('j', '$.issues')} <> 'ARRAY'
UNION ALL SELECT event_id, 3, i, 'issues.' || i, 'Input should be a valid string' FROM (SELECT event_id, i, json_type(json_extract(j, '$.issues[' || i || ']')) AS k FROM r, range(10) t(i) WHERE i < json_array_length(j, '$.issues')) WHERE k <> 'VARCHAR'
UNION ALL SELECT event_id, 4, 0, 'evidence_sufficiency', '{_SUFFICIENT}' FROM r WHERE json_extract_string(j, '$.evidence_sufficiency') NOT IN ('sufficient', 'insufficient', 'uncertain')
UNION ALL SELECT event_id, 5, 0, 'evidence', 'Input should be a valid tuple' FROM r WHERE {_KIND.format('j', '$.evidence')} <> 'ARRAY'
UNION ALL SELECT event_id, 5, 2 * i + n, CASE WHEN k = 'OBJECT' THEN 'evidence.' || i || '.' || name ELSE 'evidence.' || i END, CASE WHEN k <> 'OBJECT' THEN 'Input should be a valid dictionary or instance of Evidence' WHEN v IS NULL THEN 'Field required' ELSE 'Input should be a valid string' END
  FROM (SELECT event_id, i, n, name, json_type(x) AS k, json_type(json_extract(x, '$.' || name)) AS v FROM (SELECT event_id, i, json_extract(j, '$.evidence[' || i || ']') AS x FROM r, range(10) t(i) WHERE i < json_array_length(j, '$.evidence')), (VALUES (0, 'ref_id'), (1, 'quote')) f(n, name)) WHERE CASE WHEN k = 'OBJECT' THEN coalesce(v, '') <> 'VARCHAR' ELSE n = 0 END
UNION ALL SELECT event_id, 6, 0, 'review_required', CASE WHEN event_id % 11 IN (4, 6) THEN 'Input should be a valid boolean, unable to interpret input' ELSE 'Input should be a valid boolean' END FROM r WHERE event_id % 11 IN (4, 5, 6, 7, 8)
), n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY f, i) AS p FROM e)
SELECT event_id, count(p) AS n_errors, string_agg(path || '：' || m, '；' ORDER BY p) FILTER (p <= 3) || CASE WHEN count(p) > 3 THEN '；另有 ' || (count(p) - 3) || ' 处问题' ELSE '' END AS message FROM r LEFT JOIN n USING (event_id) GROUP BY event_id"""


@query(_FIELD_ERRORS)
def stage_field_errors(spark, d):
    """Places of stage-2 replies that break their contract, with what a model is told of them."""
    v = _table(spark, d, "events").select("event_id", F.try_parse_json(F.expr(_REPLY)).alias("v"))
    out = v.select("event_id", typed.errors(F.col("v"), "stage2").alias("e"))
    return out.select("event_id", F.size("e").cast("long").alias("n_errors"), typed.told(F.col("e")).alias("message"))


_QUOTED = "CASE doc_id % 6 WHEN 0 THEN substr(text, 1, 30) WHEN 1 THEN 'no such words' WHEN 2 THEN '' ELSE substr(text, 5, 20) END"
_RULED = f"""WITH r AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS s, replace(replace({_QUOTED}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS q, doc_id % 5 = 0 AS review, doc_id % 10 = 0 AS reasons, ['{"', '".join(LABELS)}'][doc_id % 3 + 1] AS label, ['sufficient', 'insufficient', 'uncertain', 'sufficient'][doc_id % 4 + 1] AS enough, doc_id % 13 <> 0 AS quoted, CASE WHEN doc_id % 17 = 0 THEN 'ref99' WHEN doc_id % 19 = 0 THEN 'ref3' ELSE 'ref2' END AS ref FROM documents)
SELECT doc_id, CASE WHEN quoted AND ref = 'ref99' THEN 'ref_range' WHEN quoted AND ref = 'ref3' THEN 'empty_ref' WHEN quoted AND trim(q, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'empty_quote' WHEN quoted AND NOT contains(s, trim(q, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) THEN 'evidence_substring'
WHEN review AND NOT reasons THEN 'consistency' WHEN enough = 'uncertain' AND NOT review THEN 'consistency' WHEN label = '{LABELS[0]}' AND (enough = 'insufficient' OR NOT quoted) THEN 'consistency' WHEN label = '{LABELS[2]}' AND enough = 'insufficient' THEN 'consistency' END AS problem FROM r"""


@query(_RULED)
def judging_rules(spark, d):
    """The first broken rule of stage-2 replies that quote documents, right and wrong."""
    docs = _table(spark, d, "documents")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % n).cast("int"))
    ref = F.expr("case when doc_id % 17 = 0 then 'ref99' when doc_id % 19 = 0 then 'ref3' else 'ref2' end")
    evidence = F.when(F.col("doc_id") % 13 != 0, F.array(F.struct(ref.alias("ref_id"), F.coalesce(F.expr(_QUOTED), F.lit("")).alias("quote")))).otherwise(F.array().cast("array<struct<ref_id:string,quote:string>>"))
    review = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("why"))).otherwise(F.array().cast("array<string>"))
    reply = F.to_json(F.struct(pick(LABELS, 3).alias("label"), F.lit("r").alias("reason"), pick(("sufficient", "insufficient", "uncertain", "sufficient"), 4).alias("evidence_sufficiency"), evidence.alias("evidence"), (F.col("doc_id") % 5 == 0).alias("review_required"), review.alias("review_reasons")))
    refs = F.struct(*[F.when(F.lit(r == "ref2"), F.coalesce("text", F.lit(""))).alias(r) for r in REFS])
    rows = docs.select("doc_id", F.lit(None).cast("string").alias("reply1"), reply.alias("reply2"), refs.alias("refs"))
    return judge.validated(rows).select("doc_id", F.col("problem2").alias("problem"))


@query(
    """WITH p AS (SELECT p_partkey, lower(p_name) AS q, lower(concat(p_type, ' ', p_brand, ' ', p_name[2:9])) AS s FROM part),
n AS (SELECT p_partkey, i, n FROM p, range(1, 60) a(i), range(1, 60) b(n) WHERE i + n - 1 <= length(q) AND contains(s, substr(q, cast(i AS integer), cast(n AS integer)))),
m AS (SELECT p_partkey, max(n) AS n FROM n GROUP BY 1)
SELECT p_partkey, contains(s, q) AS is_substring, cast(coalesce(m.n, 0) AS integer) AS match_len, coalesce(substr(q, cast((SELECT min(i) FROM n WHERE n.p_partkey = p.p_partkey AND n.n = m.n) AS integer), cast(m.n AS integer)), '') AS match FROM p LEFT JOIN m USING (p_partkey)"""
)
def quote_common_part(spark, d):
    """The longest part of each part's name that also stands in its description."""
    part = _table(spark, d, "part").selectExpr("p_partkey", "lower(p_name) as quote", "lower(concat(p_type, ' ', p_brand, ' ', substr(p_name, 2, 8))) as source")
    part = part.repartition(4 * spark.sparkContext.defaultParallelism)  # a small file of short texts is one partition
    return judge.diagnosed(part).select("p_partkey", "is_substring", "match_len", "match")


_PLAN = f"{V.ORDER_RECORDS_SQL}, {V.JOBS_SQL}, p AS (SELECT record_key, run_id, CASE WHEN status <> 'failed' THEN 'continue' WHEN record_key % 5 = 0 THEN 'permanent' WHEN record_key % 7 <> 0 AND 1 + record_key % 5 > 3 THEN 'continue' ELSE 'reopen' END AS a FROM records WHERE status IN ('pending', 'failed')), b AS (SELECT DISTINCT run_id FROM jobs WHERE status IN ('queued', 'running') AND kind = 'classify'), n AS (SELECT run_id, count(*) FILTER (a <> 'permanent') AS selected, count(*) FILTER (a = 'reopen') AS renewed, count(*) FILTER (a = 'permanent') AS never FROM p GROUP BY 1), o AS (SELECT n.*, CASE WHEN b.run_id IS NOT NULL THEN 'STATE_CONFLICT' WHEN selected = 0 THEN 'NOTHING_TO_RESUME' ELSE 'accepted' END AS outcome FROM n LEFT JOIN b USING (run_id))"


def _resumed(spark, d):
    return resume_plan(*_failed_orders(spark, d), retry_failed=True), V.jobs(spark, d)


@query(f"WITH {_PLAN} SELECT run_id, outcome, selected, renewed, never FROM o")
def resume_outcomes(spark, d):
    out = Q.resume_outcomes(*_resumed(spark, d))
    return out.select("run_id", "outcome", "selected", "renewed", F.col("skipped_needs_new_batch").alias("never"))


@query(f"WITH {_PLAN} SELECT run_id, record_key, a = 'reopen' AS reopen FROM p JOIN o USING (run_id) WHERE outcome = 'accepted' AND a <> 'permanent'")
def resume_targets(spark, d):
    """The records that the jobs of accepted resumes are for, and which of them get a new budget when the job is taken up."""
    jobs, targets = Q.resume_jobs(*_resumed(spark, d), F.lit("2024-01-01").cast("timestamp"), retry_failed=True)
    return targets.join(jobs.select("job_id", "run_id"), "job_id").select("run_id", "record_key", "reopen")


@query("WITH l AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'progress' WHEN 'error' THEN 'ended' END AS event, 'w' || event_id % 3 AS worker_id, 'k' || event_id AS record_key FROM events) SELECT cast(job_id AS varchar) AS job_id, arg_max(worker_id, seq) FILTER (event = 'started') AS worker_id, arg_max(record_key, seq) FILTER (event = 'progress') AS current_record_key, max(seq) FILTER (event = 'started') AS started_at, max(seq) AS last_activity_at, max(seq) FILTER (event = 'ended') AS finished_at FROM l GROUP BY 1")
def job_details(spark, d):
    """Users as jobs whose events are their log."""
    events = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.expr("case event_type when 'view' then 'started' when 'click' then 'progress' when 'purchase' then 'progress' when 'error' then 'ended' end").alias("event"), F.col("event_id").alias("at"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("worker_id"), F.concat(F.lit("k"), "event_id").alias("record_key"))
    out = Q.job_details(events.select("job_id").distinct(), events)
    return out.select("job_id", "worker_id", "current_record_key", "started_at", "last_activity_at", "finished_at")


_PATH = "case o_orderkey % 6 when 0 then '../x' when 1 then '/etc/x' when 2 then 'a/../../x' when 3 then '' else concat('e', o_orderkey, '/f..xlsx') end"


@query(f"WITH a AS (SELECT o_orderkey, {_PATH} AS path FROM orders WHERE o_orderkey % 11 <> 0), q AS (SELECT DISTINCT o_orderkey FROM orders) SELECT cast(q.o_orderkey AS varchar) AS artifact_id, CASE WHEN q.o_orderkey % 6 > 3 AND path IS NOT NULL THEN '/out/' || path END AS place, CASE WHEN q.o_orderkey % 6 > 3 AND path IS NOT NULL THEN NULL ELSE 'ARTIFACT_MISSING' END AS problem FROM q LEFT JOIN a USING (o_orderkey)")
def artifact_places(spark, d):
    orders = _table(spark, d, "orders")
    artifacts = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").cast("string").alias("artifact_id"), F.expr(_PATH).alias("relative_path"), F.lit("n").alias("download_name"))
    return Q.artifact_places(orders.select(F.col("o_orderkey").cast("string").alias("artifact_id")), artifacts, "/out/").drop("download_name")


@query("WITH r AS (SELECT l_partkey % 300 + 1 AS den, l_suppkey * 7 % (l_partkey % 300 + 2) AS num FROM lineitem) SELECT DISTINCT num, den, printf('%.4f', num / den) || '（' || num || '/' || den || '）' AS shown FROM r UNION ALL SELECT 1, 0, '不可计算（分母为 0）'")
def metric_display(spark, d):
    """Ratios of counts as they are shown."""
    r = _table(spark, d, "lineitem").selectExpr("l_suppkey * 7 % (l_partkey % 300 + 2) as num", "l_partkey % 300 + 1 as den").distinct()
    r = r.union(r.agg(F.lit(1).cast("long"), F.lit(0).cast("long")))
    return r.select("num", "den", evaluation.display_of(F.col("num"), F.col("den")).alias("shown"))
