"""The engine's tables (records, gold, runs, campaigns, attempts, jobs, exports) as views of the driver's tables.

Each view is one projection of its base table, or one join where it needs two, so filters and column lists reach the
Parquet scan. *_SQL are the same views for the comparison SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LABELS

_STATUS = "case when doc_id % 11 = 0 then 'input_invalid' when doc_id % 7 = 0 then 'pending' when doc_id % 13 = 0 then 'stage1_done' when n_chars % 5 = 0 then 'failed' else 'completed' end"
_LABEL = f"case when n_chars % 5 in (1, 2) then '{LABELS[0]}' when n_chars % 5 = 3 then '{LABELS[1]}' else '{LABELS[2]}' end"
_GOLD = f"case when quality = 1 and toxic = 0 then '{LABELS[0]}' when quality = 0 then '{LABELS[1]}' else '{LABELS[2]}' end"
_CODE = "case doc_id % 4 when 0 then 'OUTPUT_INVALID' when 1 then 'CONTEXT_LIMIT' when 2 then 'MODEL_RETRYABLE' else 'OUTPUT_TRUNCATED' end"

#: column -> expression over documents, in SQL that both engines read alike; s is the status.
_RECORD = {
    "record_key": "'k' || cast(doc_id as {string})", "record_id": "cast(doc_id as {string})", "run_id": "source",
    "source_row": "cast(doc_id + 2 as {int})", "order_index": "cast(doc_id as {int})", "q": "text", "a": "lang", "status": "s",
    "agent_label": f"case when s = 'completed' then {_LABEL} end", "label": f"case when s = 'completed' then {_LABEL} end",
    "review_required": "case when s = 'completed' then n_chars % 2 = 1 end",
    "failure_stage": "case when s = 'failed' then case when doc_id % 2 = 0 then 'stage1' else 'stage2' end end",
    "failure_code": f"case when s = 'failed' then {_CODE} end",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("s", F.expr(_STATUS))
    return docs.select(*[F.expr(e.format(string="string", int="int")).alias(k) for k, e in _RECORD.items()])


RECORDS_SQL = "records AS (SELECT " + ", ".join(f"{e.format(string='varchar', int='integer')} AS {k}" for k, e in _RECORD.items()) + f" FROM (SELECT *, {_STATUS} AS s FROM documents))"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.expr(_GOLD).alias("gold_label"), F.expr("doc_id % 17 = 0").alias("excluded"), F.col("doc_id").alias("pos"))


GOLD_SQL = f"gold AS (SELECT cast(doc_id AS varchar) AS record_id, {_GOLD} AS gold_label, doc_id % 17 = 0 AS excluded, doc_id AS pos FROM labels)"
SCORED_SQL = f"{RECORDS_SQL}, {GOLD_SQL}, scored AS (SELECT g.*, r.agent_label, r.review_required, r.status, r.failure_stage FROM gold g LEFT JOIN records r USING (record_id) WHERE NOT g.excluded)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs of orders."""
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.col("c_name").alias("source_filename"), F.expr("case c_nationkey % 3 when 0 then 'completed' when 1 then 'running' else 'partial_failed' end").alias("status"), F.expr("c_custkey % 97").alias("created_at"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the records of their customer's run."""
    status = "case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end"
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_key"), F.col("o_custkey").cast("string").alias("run_id"), F.expr(status).alias("status"), F.expr("o_orderkey % 3 = 0").alias("review_required"))


ORDER_RECORDS_SQL = "records AS (SELECT o_orderkey AS record_key, cast(o_custkey AS varchar) AS run_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end AS status, o_orderkey % 3 = 0 AS review_required FROM orders)"


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campaign per line of an order: odd lines are stage 1."""
    line = _table(spark, sf_dir, "lineitem")
    return line.select(F.expr("l_orderkey * 10 + l_linenumber").alias("campaign_id"), F.col("l_orderkey").alias("record_key"), F.expr("if(l_linenumber % 2 = 1, 'stage1', 'stage2')").alias("stage"), F.expr("cast((l_linenumber + 1) div 2 as int)").alias("campaign_no"))


CAMPAIGNS_SQL = "campaigns AS (SELECT l_orderkey * 10 + l_linenumber AS campaign_id, l_orderkey AS record_key, CASE WHEN l_linenumber % 2 = 1 THEN 'stage1' ELSE 'stage2' END AS stage, cast((l_linenumber + 1) // 2 AS integer) AS campaign_no FROM lineitem)"
_ATTEMPT = "case l_returnflag when 'A' then 'succeeded' when 'R' then 'failed' else 'unknown' end"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per line, its outcome by the return flag."""
    line = _table(spark, sf_dir, "lineitem")
    return line.select(F.expr("l_orderkey * 10 + l_linenumber").alias("campaign_id"), F.expr("cast(1 + l_partkey % 3 as int)").alias("attempt_no"), F.expr(_ATTEMPT).alias("status"), F.expr("l_linestatus = 'O'").alias("simulated"), F.col("l_shipdate").alias("started_at"), F.col("l_partkey").alias("seq"))


ATTEMPTS_SQL = f"attempts AS (SELECT l_orderkey * 10 + l_linenumber AS campaign_id, cast(1 + l_partkey % 3 AS integer) AS attempt_no, {_ATTEMPT} AS status, l_linestatus = 'O' AS simulated, l_shipdate AS started_at, l_partkey AS seq FROM lineitem)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue rows, several to a run (user)."""
    kind = "if(event_type in ('purchase', 'signup'), 'export', 'classify')"
    status = "case event_id % 5 when 0 then 'queued' when 1 then 'running' when 2 then 'completed' when 3 then 'failed' else 'interrupted' end"
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").cast("string").alias("run_id"), F.expr(kind).alias("kind"), F.expr(status).alias("status"), F.date_trunc("hour", "ts").alias("created_at"), F.col("event_id").alias("seq"))


JOBS_SQL = "jobs AS (SELECT event_id AS job_id, cast(user_id AS varchar) AS run_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'export' ELSE 'classify' END AS kind, case event_id % 5 when 0 then 'queued' when 1 then 'running' when 2 then 'completed' when 3 then 'failed' else 'interrupted' end AS status, date_trunc('hour', ts) AS created_at, event_id AS seq FROM events)"
