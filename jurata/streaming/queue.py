"""The job queue and its stateful parts as Structured Streaming.

A queue is a folder of job events. claim_jobs() hands out jobs in order, one micro-batch at a time (the single slot),
past a gate that holds all but exports while paused; held jobs stay waiting, and are handed out with the next micro-batch
or by hand_out() once the gate is open. gated() has the gate inside the stream: waiting jobs are in its state, and pause
and resume are events. held_jobs() and used_attempts() read the state of a queue as tables. attempt_budget() keeps each record's attempts per stage in the state
store: an attempt is reserved before a call and never given back, and a restart goes on from the checkpoint.
first_events() and revisions() are the deduplication of automatic exports and the revision counter.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions.judgement import BUDGET_EXHAUSTED, error_code_of
from ..schemas import MAX_ATTEMPTS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_SCHEMA = "job_id string, run_id string, kind string, mode string, created_at timestamp, seq long"


class Systemic(RuntimeError):
    """A failure that stops the whole queue: wrong configuration or a model that refuses for good."""


# Codes that stop a queue (a context limit or a cut output don't).
SYSTEMIC = ("CONFIG_INVALID", "MODEL_PERMANENT")


#: Outcomes that are recorded together.
KEPT = 100


def waiting(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The jobs that were held and not run since: `outcomes` is all that was recorded of them."""
    held = outcomes.groupBy("job_id").agg(F.bool_and(F.col("status") == "held").alias("held")).where("held")
    return jobs.join(held.select("job_id"), "job_id", "left_semi")


def hand_out(jobs: DataFrame, run: Callable[[dict], str | None], paused: Callable[[], bool], record: Callable[[DataFrame], None]) -> None:
    """Runs jobs in the order (created_at, job_id); a systemic code ends it after its outcome was recorded, the rest are held."""
    done: list[tuple] = []
    stop = None

    def keep() -> None:
        if done:
            record(jobs.sparkSession.createDataFrame(done, "job_id string, status string, code string"))
            done.clear()

    for job in jobs.orderBy("created_at", "job_id").toLocalIterator():
        if stop or (paused() and job["kind"] != "export"):
            done.append((job["job_id"], "held", None))
        else:
            code = run(job.asDict())
            done.append((job["job_id"], "failed" if code else "completed", code))
            stop = code if code in SYSTEMIC else None
        if len(done) >= KEPT:
            keep()
    keep()
    if stop:
        raise Systemic(stop)


def claim_jobs(jobs: DataFrame, run: Callable[[dict], str | None], paused: Callable[[], bool], record: Callable[[DataFrame], None], held: Callable[[], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that runs the jobs of each micro-batch in the order (created_at, job_id), those that held() gives among them.

    run(job) returns an error code or None. Outcomes go to record() as (job_id, status, code): completed, failed, or held
    while the gate is closed. A systemic code stops the query after its outcome was recorded. A micro-batch that is
    repeated after a crash runs its jobs again, so run() must be idempotent by job_id.
    """

    def batch(df: DataFrame, _: int) -> None:
        hand_out(df if held is None else df.unionByName(held().select(*df.columns)).dropDuplicates(["job_id"]), run, paused, record)

    return jobs.writeStream.foreachBatch(batch)


# Fixed value: the code of an export that failed; it never stops a queue.
EXPORT_FAILED = "EXPORT_FAILED"


def routed(classify: Callable[[dict], str | None], export: Callable[[dict], str | None]) -> Callable[[dict], str | None]:
    """run() for claim_jobs() by the kind of a job: whatever is raised becomes a code, an export's failure that job's alone."""

    def run(job: dict) -> str | None:
        try:
            return (export if job["kind"] == "export" else classify)(job)
        except Exception as e:  # noqa: BLE001 - a job that fails is recorded, the queue goes on unless the code is systemic
            return EXPORT_FAILED if job["kind"] == "export" else error_code_of(e)

    return run


class Heartbeat(StreamingQueryListener):
    """Passes each micro-batch's progress (name, batch, rows) to beat(); it shows that a queue moves and decides nothing."""

    def __init__(self, beat: Callable[[str | None, int, int], None]):
        self.beat = beat

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names of the listener's methods
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.beat(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class _Budget(StatefulProcessor):
    """Attempts used per stage of one record's campaign."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "stage string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Only the requests with the least seq can be reserved: as many are kept as the budget has left, all others go at once."""
        names = ["record_key", "seq", "stage", "attempt_no", "outcome"]
        first: dict[str, list[int]] = {}
        used: dict[str, int] = {}
        for frame in rows:
            out = []
            for seq, stage in zip(frame["seq"].tolist(), frame["stage"], strict=True):
                if stage not in used:
                    used[stage], first[stage] = self.used.getValue((stage,))[0] if self.used.containsKey((stage,)) else 0, []
                heapq.heappush(first[stage], -seq)
                if len(first[stage]) > self.most - used[stage]:
                    out.append((key[0], -heapq.heappop(first[stage]), stage, self.most, BUDGET_EXHAUSTED))
            yield pd.DataFrame(out, columns=names)
        out = []
        for stage, kept in first.items():
            out += [(key[0], seq, stage, n, "reserved") for n, seq in enumerate(sorted(-s for s in kept), used[stage] + 1)]
            if kept:
                self.used.updateValue((stage,), (used[stage] + len(kept),))
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def attempt_budget(requests: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """(record_key, seq, stage, attempt_no, outcome) of a stream of requests (record_key, stage, seq)."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return requests.select("record_key", "stage", "seq").groupBy("record_key").transformWithStateInPandas(statefulProcessor=_Budget(most), outputStructType="record_key string, seq long, stage string, attempt_no int, outcome string", outputMode="Append", timeMode="None")


#: Parts that a gated queue keeps its waiting jobs in, and jobs that stand together in its state or go out together.
SHARDS, _TOGETHER = 64, 5000
_JOB = "job_id string, run_id string, kind string, created_at timestamp, seq long"
#: What a part knows of a job: created_at in microseconds.
_KNOWN = {"job_id": pa.string(), "run_id": pa.string(), "kind": pa.string(), "created": pa.int64(), "seq": pa.int64()}
_LISTS = "job_id array<string>, run_id array<string>, kind array<string>, created array<bigint>, seq array<bigint>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a gate (seq, closes) as one value a batch: all numbers, then a byte for each that says whether it closes."""
    for batch in batches:
        if batch.num_rows:
            seq, closes = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("seq", "closes"))
            yield pa.RecordBatch.from_arrays([pa.array([seq.astype(np.int64).tobytes() + closes.astype(bool).tobytes()], pa.binary())], ["turns"])


def _unpacked(packs: list[bytes], closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(seq, closes) of those packed events that turn the gate, in the order of seq; the packs are used up."""
    n = sum(map(len, packs)) // 9
    seq, closes, end = np.empty(n, np.int64), np.empty(n, bool), 0
    while packs:
        pack = packs.pop(0)
        k = len(pack) // 9
        seq[end : end + k], closes[end : end + k] = np.frombuffer(pack, np.int64, k), np.frombuffer(pack, bool, k, 8 * k)
        end += k
    order = np.argsort(seq, kind="stable")
    closes = closes[order]
    turns = np.flatnonzero(closes != np.concatenate(([closed], closes[:-1]))) if n else order
    return seq[order[turns]], closes[turns]


class _Gate(StatefulProcessor):
    """The waiting jobs of one part of a queue, and whether its gate is closed.

    Waiting jobs are kept _TOGETHER at a time under numbers of their own: a list would be read again for each job added.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "yes boolean, n long")
        self.held = handle.getMapState("held", "no long", _LISTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Events in their order: exports pass always, other jobs while the gate is open; it lets out in order when it opens."""
        packs: list[bytes] = []
        came: dict[str, list[pa.Array]] = {n: [pa.array([], t)] for n, t in _KNOWN.items()}
        for frame in rows:  # what a micro-batch has for this part
            turn = frame["turns"].notna()
            packs += frame["turns"][turn].tolist()
            own = frame[~turn]
            for n, t in _KNOWN.items():
                came[n].append(pa.array(own[n], t, from_pandas=True))
        jobs = pa.table({n: pa.chunked_array(came.pop(n)).combine_chunks() for n in _KNOWN})
        closed, n = self.closed.get() if self.closed.exists() else (False, 0)
        at, closes = _unpacked(packs, bool(closed))

        seq = jobs["seq"].to_numpy()
        shut = np.concatenate(([closed], closes))[np.searchsorted(at, seq, "right")]
        waits = shut & ~pc.fill_null(pc.equal(jobs["kind"], "export"), False).to_numpy(zero_copy_only=False)
        opens = at[~closes]
        turn = np.searchsorted(opens, seq, "right")  # the event that opens the gate next
        stays = waits & (turn == len(opens))
        by = np.where(waits, np.append(opens, 0)[turn], seq)
        fresh = np.flatnonzero(stays)
        del seq, shut, turn

        if len(opens) and n:  # jobs from before go out first of all
            before = [v for _, v in self.held.iterator()]
            self.held.clear()
            old = pa.table({c: pa.chunked_array([pa.array(list(v[i]), t) for v in before]) for i, (c, t) in enumerate(_KNOWN.items())})
            jobs, n = pa.concat_tables([jobs, old]).combine_chunks(), 0
            more = np.ones(len(old), bool)
            stays, waits, by = np.append(stays, ~more), np.append(waits, more), np.append(by, np.full(len(old), opens[0]))
        for start in range(0, len(fresh), _TOGETHER):
            some = jobs.take(pa.array(fresh[start : start + _TOGETHER]))
            self.held.updateValue((n,), tuple(some[c].to_pylist() for c in _KNOWN))
            n += 1
        self.closed.update((bool(closes[-1]) if len(closes) else bool(closed), n))

        goes = np.flatnonzero(~stays)
        order = pc.sort_indices(pa.table({"by": by[goes], "created": jobs["created"].take(goes), "job_id": jobs["job_id"].take(goes)}), [(c, "ascending") for c in ("by", "created", "job_id")])
        goes = goes[order.to_numpy()]
        jobs = jobs.select(["job_id", "run_id", "kind", "seq"])
        del order
        for start in range(0, len(goes), _TOGETHER):
            some = goes[start : start + _TOGETHER]
            yield jobs.take(pa.array(some)).to_pandas().assign(released_by=by[some], was_held=waits[some])

    def close(self) -> None:
        pass


def gated(jobs: DataFrame, gate: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(job_id, run_id, kind, seq, released_by, was_held) of the jobs of a stream as a gate lets them out.

    jobs are (job_id, run_id, kind, created_at, seq), gate is a stream (seq, gate) of `pause` and `resume`. Events count in
    the order of seq, which must grow from micro-batch to micro-batch. While the gate is closed all jobs but exports wait
    in the state store, and a restart keeps them; a resume lets them out by (created_at, job_id), each run's in one task.
    Runs are dealt to `shards` parts, each of which gets every event of the gate, packed (9 bytes each): there is no single
    task for all. A part holds a micro-batch's events and, when the gate opens, its waiting jobs in memory, as columns.
    """
    jobs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = jobs.select(F.pmod(F.xxhash64("run_id"), F.lit(shards)).cast("int").alias("shard"), "job_id", "run_id", "kind", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"), "seq", F.lit(None).cast("binary").alias("turns"))
    packs = gate.where("gate is not null").select("seq", (F.col("gate") == "pause").alias("closes")).mapInArrow(_packed, "turns binary")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("job_id", "string"), ("run_id", "string"), ("kind", "string"), ("created", "long"), ("seq", "long"))]
    turns = packs.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *none, "turns")
    return own.unionByName(turns).groupBy("shard").transformWithStateInPandas(statefulProcessor=_Gate(), outputStructType="job_id string, run_id string, kind string, seq long, released_by long, was_held boolean", outputMode="Append", timeMode="None")


def held_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job_id, run_id, kind, created_at, seq) of the jobs that wait in a gated queue, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).select("user_map_value.*")
    each = state.select(F.inline(F.arrays_zip("job_id", "run_id", "kind", "created", "seq")))
    return each.select("job_id", "run_id", "kind", F.timestamp_micros("created").alias("created_at"), "seq")


def used_attempts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(record_key, stage, used) of an attempt budget, read from its state: what was reserved, whether or not it came to an end."""
    state = spark.read.format("statestore").option("stateVarName", "used").load(checkpoint)
    return state.select(F.col("key.record_key").alias("record_key"), F.col("user_map_key.stage").alias("stage"), F.col("user_map_value.n").alias("used"))


class _First(StatefulProcessor):
    """The first row of each key of those that come one to a micro-batch; keys are forgotten after `ttl` milliseconds."""

    def __init__(self, names: list[str], ttl: int):
        self.names, self.ttl = names, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield next(frame for frame in rows if len(frame))[self.names]

    def close(self) -> None:
        pass


#: Rows that are kept besides the least ones before these are looked for again.
_REDUCED = 50_000


def _least(keys: list[str], order: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The row of each key with the least order, of all batches of a task."""

    def reduced(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(order, "ascending")]))  # nulls last
        first = rows.select(keys).append_column("_row", pa.array(np.arange(len(rows)))).group_by(keys, use_threads=False).aggregate([("_row", "min")])
        return rows.take(first["_row_min"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, more = None, []
        for batch in batches:
            more.append(batch)
            if sum(b.num_rows for b in more) > max(_REDUCED, len(kept or ())):
                kept, more = reduced(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(more)])), []
        if more:
            kept = reduced(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(more)]))
        if kept:
            yield from kept.combine_chunks().to_batches(10_000)

    return run


def first_events(events: DataFrame, keys: list[str], order: str = "seq", hours: int | None = None) -> DataFrame:
    """The first event of each key, by `order` among those of a micro-batch: automatic exports, idempotency keys. Keys are forgotten after `hours`, if given.

    The events of a key meet in a task, which keeps the least of a micro-batch's; Spark's own deduplication keeps the keys.
    Keys are columns of plain types; a task holds as many rows as it has keys in a micro-batch.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    least = events.repartition(*keys).mapInArrow(_least(keys, order), events.schema)
    if not hours:
        return least.dropDuplicates(keys)
    return least.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_First(events.columns, hours * 3_600_000), outputStructType=events.schema, outputMode="Append", timeMode="ProcessingTime")


def revisions(events: DataFrame) -> DataFrame:
    """Running revision of each run (complete or update mode)."""
    return events.where(F.col("event").isin("stage_committed", "record_failed", "checkpoint_reset", "run_reopened")).groupBy("run_id").agg(F.count("*").alias("revision"))


def drain(writer: DataStreamWriter, checkpoint: str, timeout: int = 600) -> StreamingQuery:
    """Runs a stream over what is there now and waits for its end."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream didn't end within {timeout} s")
    return query


def to_table(spark: SparkSession, stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Drains an append-mode stream into a table below folder and reads it."""
    path = f"{folder.rstrip('/')}/{name}"
    drain(stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows"), f"{path}/log")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
