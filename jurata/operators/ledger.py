"""Judging in rounds with a write-ahead ledger: an attempt is written before its call is made, and never given back.

The ledger is a folder of two append-only tables, one folder a round in each: `reserved` (record_id, stage, attempt_no) and
`finished` (the outcomes). A round asks the ledger which records may try which stage again, writes their next attempts to
`reserved`, makes the calls, and writes what came of them to `finished`. A folder of a round appears whole, by a rename,
and is never written again, so both steps can be repeated; where a run ends between them, the attempts of its last round
stay without an outcome: they are unknown, and count.

No call is made twice under one attempt: the calls of a round read a written table in one stage, and a task that Spark runs
again (a lost executor, speculation) makes none: its rows are unknown. Their records go on in the next round with what is
left of the budget.

Nothing but the number of the last round comes to the driver. A round costs a few jobs over the records and the ledger;
there are at most two stages times `most` rounds, and one more for each interruption.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import judgement as J
from ..functions.prompts import answered, with_stage1
from ..functions.text import clip_output
from ..schemas import MAX_ATTEMPTS
from ..sources import files
from .judge import ATTEMPT, UNKNOWN, attempted, by_rules

KEYS = ["record_id", "stage", "attempt_no"]
RESERVED = "record_id string, stage string, attempt_no int"
FINISHED = f"{ATTEMPT}, usage string"


def attempts(reserved: DataFrame, finished: DataFrame) -> DataFrame:
    """Every reserved attempt with its outcome; one without is unknown. An outcome without a reservation is none."""
    known = finished.dropDuplicates(KEYS).select(*FINISHED_NAMES)
    return reserved.select(*KEYS).distinct().join(known, KEYS, "left").withColumn("outcome", F.coalesce("outcome", F.lit(UNKNOWN))).select(*FINISHED_NAMES)


FINISHED_NAMES = [c.split()[0] for c in FINISHED.split(", ")]


def states(tries: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """(record_id, stage, used, next, content, tried) of each stage with attempts.

    next: done (an output was accepted: `content`), failed (the last error isn't worth another try), exhausted, or open.
    tried are the rejected outputs in order.
    """
    ok, bad = F.col("outcome") == "ok", F.col("outcome") == "validation_error"
    last = F.max_by(F.struct("outcome", "error_code"), "attempt_no")
    out = tries.groupBy("record_id", "stage").agg(
        F.max("attempt_no").alias("used"), last.alias("last"), F.max_by(F.when(ok, F.col("content")), F.when(ok, F.col("attempt_no"))).alias("content"), F.bool_or(ok).alias("ok"),
        F.array_sort(F.collect_list(F.when(bad, F.struct("attempt_no", "content", "error_message")))).alias("tried"),
    )
    final = (F.col("last.outcome") == "model_error") & (F.col("last.error_code") != "MODEL_RETRYABLE")
    step = F.when(F.col("ok"), "done").when(final, "failed").when(F.col("used") >= most, "exhausted").otherwise("open")
    return out.select("record_id", "stage", "used", step.alias("next"), "content", "tried", (F.col("last.outcome") == "model_error").alias("after_error"))


def next_calls(records: DataFrame, state: DataFrame) -> DataFrame:
    """records whose next stage may be tried, with stage, attempt_no, stage1_json, tried and after_error: stage 2 comes once stage 1 is done."""
    own = lambda n: state.where(F.col("stage") == f"stage{n}").select("record_id", *[F.col(c).alias(f"_{c}{n}") for c in ("used", "next", "content", "tried", "after_error")])
    out = records.join(own(1), "record_id", "left").join(own(2), "record_id", "left")
    given = F.col("stage1_json") if "stage1_json" in records.columns else F.lit(None).cast("string")
    one = F.coalesce("_content1", given)
    second = one.isNotNull()
    pick = lambda c: F.when(second, F.col(f"_{c}2")).otherwise(F.col(f"_{c}1"))
    made = {"stage": F.when(second, "stage2").otherwise("stage1"), "attempt_no": F.coalesce(pick("used"), F.lit(0)) + 1, "tried": pick("tried"), "after_error": F.coalesce(pick("after_error"), F.lit(False)), "stage1_json": one}
    out = out.where(F.coalesce(pick("next"), F.lit("open")) == "open")
    return out.select(*[c for c in records.columns if c not in made], *[v.alias(k) for k, v in made.items()])


class Ledger:
    """The tables of a ledger below a folder, on any of Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, kind: str, schema: str) -> DataFrame:
        if not files.exists(self.spark, f"{self.folder}/{kind}"):
            return self.spark.createDataFrame([], f"{schema}, round int")
        return self.spark.read.schema(f"{schema}, round int").parquet(f"{self.folder}/{kind}")

    def _append(self, rows: DataFrame, kind: str, n: int) -> None:
        """Writes the rows of a round; a round that is there already stays as it is."""
        at = f"{self.folder}/{kind}/round={n}"
        if not files.exists(self.spark, at):
            part = f"{self.folder}/_{kind}-{n}"
            rows.write.mode("overwrite").parquet(part)
            files.move(self.spark, part, at)

    def last_round(self) -> int:
        return self._table("reserved", RESERVED).agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]

    def reserve(self, calls: DataFrame, n: int) -> None:
        self._append(calls.select(*KEYS), "reserved", n)

    def finish(self, outcomes: DataFrame, n: int) -> None:
        self._append(outcomes.select(*FINISHED_NAMES), "finished", n)

    def attempts(self) -> DataFrame:
        return attempts(self._table("reserved", RESERVED), self._table("finished", FINISHED))


def _calls(client: Callable, accept: Callable):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = TaskContext.get().attemptNumber() > 0  # its calls may have been made already
        call = None if again else client()
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                stage, attempt = record["stage"], int(record["attempt_no"])
                if again:
                    rows.append((record["record_id"], stage, attempt, UNKNOWN, *[None] * 7))
                    continue
                messages = record.get(f"messages{stage[-1]}")
                record["messages"] = [dict(m) for m in messages] if messages is not None else []
                if stage == "stage2" and record["messages"]:
                    record["messages"] = with_stage1(record["messages"], record["stage1_json"])
                for t in record["tried"] if record["tried"] is not None and record["messages"] else ():
                    record["messages"] = answered(record["messages"], t["content"], t["error_message"], t["error_message"].split(":")[0])
                rows.append((record["record_id"], stage, attempt, *attempted(record, stage, call, accept, attempt)))
            yield pd.DataFrame(rows, columns=FINISHED_NAMES).astype({"latency_ms": "Int64", "simulated": "boolean"})

    return run


def judge_rounds(records: DataFrame, client: Callable, ledger: Ledger, accept: Callable = by_rules, most: int = MAX_ATTEMPTS, wait: tuple[float, ...] = (2, 4), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Calls until no record may try again, and returns every attempt of the ledger (FINISHED).

    client, accept and the columns of records are those of judge.call_stages(), but for used1 and used2: the ledger has
    them. What a rejected output is answered with is its stored, clipped form. A round that follows retryable errors waits
    once, by the largest of their attempts.
    """
    n = ledger.last_round()
    while True:
        n += 1
        at = f"{ledger.folder}/_calls-{n}"
        next_calls(records, states(ledger.attempts(), most)).write.mode("overwrite").parquet(at)
        calls = ledger.spark.read.parquet(at)
        asked, late = calls.agg(F.count("*"), F.max(F.when(F.col("after_error"), F.col("attempt_no") - 1))).first()
        if asked:
            if late:
                sleep(wait[min(late, len(wait)) - 1])
            ledger.reserve(calls, n)
            made = calls.mapInPandas(_calls(client, accept), FINISHED)
            ledger.finish(made.withColumn("content", F.when(F.col("outcome") == "validation_error", clip_output(F.col("content"))).otherwise(F.col("content"))), n)
        files.remove(ledger.spark, at)
        if not asked:
            return ledger.attempts()
