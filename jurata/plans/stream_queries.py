"""Registered streaming queries: drained over the event table, so their results can be compared like the others'."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.ranks import shared_folder
from ..streaming import queue as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/jurata/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    """The table as a file stream: the folder, narrowed to the table's file."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def stateful_budget_stream(spark, d):
    requests = _events(spark, d).select(F.col("user_id").cast("string").alias("record_key"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"))
    return S.to_table(spark, S.attempt_budget(requests), _folder(spark), "budget")


def deduplicated_stream(spark, d):
    events = _events(spark, d).select("user_id", "event_type", F.col("event_id").alias("seq"))
    return S.to_table(spark, S.first_events(events, ["user_id", "event_type"]), _folder(spark), "first")


def _gated(spark, d, folder, opens="true"):
    """Errors close and open the gate of a queue of all other events, the latter where `opens` says so."""
    events = _events(spark, d)
    kind = F.when(F.col("event_type") == "purchase", "export").otherwise("classify")
    jobs = events.where("event_type <> 'error'").select(F.col("event_id").cast("string").alias("job_id"), F.col("user_id").cast("string").alias("run_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("seq"))
    gate = events.where(f"event_type = 'error' and (user_id % 2 = 0 or {opens})").select(F.col("event_id").alias("seq"), F.when(F.col("user_id") % 2 == 0, "pause").otherwise("resume").alias("gate"))
    return S.to_table(spark, S.gated(jobs, gate, 8), folder, "gated")


def gated_queue_stream(spark, d):
    return _gated(spark, d, _folder(spark))


def held_jobs_state(spark, d):
    """Jobs that still wait at the end, counted in the state of the queue itself; the gate isn't opened in the last tenth."""
    folder, n = _folder(spark), spark.read.parquet(f"{d}/events.parquet").count()
    _gated(spark, d, folder, f"event_id * 10 < {n} * 9")
    return S.held_jobs(spark, f"{folder}/gated/log").groupBy("run_id").agg(F.count("*").alias("waiting"), F.min("seq").alias("first"))


def used_attempts_state(spark, d):
    folder = _folder(spark)
    requests = _events(spark, d).select(F.col("user_id").cast("string").alias("record_key"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"))
    S.to_table(spark, S.attempt_budget(requests), folder, "budget")
    return S.used_attempts(spark, f"{folder}/budget/log")


_GATE = """WITH g AS (SELECT event_id AS seq, user_id % 2 = 0 AS closes FROM events WHERE event_type = 'error' AND (user_id % 2 = 0 OR {0})), j AS (SELECT event_id AS seq, user_id, CASE WHEN event_type = 'purchase' THEN 'export' ELSE 'classify' END AS kind FROM events WHERE event_type <> 'error'),
h AS (SELECT j.*, j.kind <> 'export' AND coalesce(g.closes, false) AS held FROM j ASOF LEFT JOIN g ON j.seq >= g.seq), o AS (SELECT seq AS open_seq FROM g WHERE NOT closes), r AS (SELECT h.*, o.open_seq FROM h ASOF LEFT JOIN o ON h.seq <= o.open_seq)"""

QUERIES |= {"gated_queue_stream": gated_queue_stream, "held_jobs_state": held_jobs_state, "used_attempts_state": used_attempts_state}
ORACLE |= {
    "gated_queue_stream": f"{_GATE.format('true')} SELECT seq || '' AS job_id, user_id || '' AS run_id, kind, seq, CASE WHEN held THEN open_seq ELSE seq END AS released_by, held AS was_held FROM r WHERE NOT held OR open_seq IS NOT NULL",
    "held_jobs_state": f"{_GATE.format('event_id * 10 < (SELECT count(*) FROM events) * 9')} SELECT user_id || '' AS run_id, count(*) AS waiting, min(seq) AS first FROM r WHERE held AND open_seq IS NULL GROUP BY 1",
    "used_attempts_state": "SELECT user_id || '' AS record_key, event_type AS stage, cast(least(count(*), 3) AS integer) AS used FROM events GROUP BY ALL",
}
QUERIES |= {"stateful_budget_stream": stateful_budget_stream, "deduplicated_stream": deduplicated_stream}
ORACLE |= {
    "stateful_budget_stream": "WITH n AS (SELECT cast(user_id AS varchar) AS record_key, event_id AS seq, event_type AS stage, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) SELECT record_key, seq, stage, cast(least(r, 3) AS integer) AS attempt_no, CASE WHEN r <= 3 THEN 'reserved' ELSE 'BUDGET_EXHAUSTED' END AS outcome FROM n",
    "deduplicated_stream": "SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY ALL",
}
