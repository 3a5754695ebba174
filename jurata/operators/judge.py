"""Two-stage judging of records with a bounded retry budget per stage.

call_stages() runs the state machine with any client: a factory builds one per task, and mapInPandas hands it the records
of its partition, so partitions are judged in parallel. simulated() is the offline client as expressions in the JVM.
Results are keyed by record. A task of call_stages() that is run again calls its records again; where every call must be
counted before it is made, operators/ledger.py calls in rounds whose attempts are written first.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judgement as J
from ..functions.prompts import answered, with_stage1
from ..functions.text import clip_output, normalize_text
from ..functions.typed import errors, typed_flags
from ..schemas import LABELS, MAX_ATTEMPTS, STAGE1, STAGE2
from .quotes import longest_common, similarity

CORRECT, NO_REF, WRONG = LABELS

# Phrases of the simulated model.
_FAKE_QUOTE = "（演示）此句不在任何资料之中。"
_NO_REFS = "（演示）十份资料都没有内容"
_PART_REFS = "（演示）资料没有写到全部要点"


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def simulated(records: DataFrame) -> DataFrame:
    """records (record_id, source_row, refs and others) with scenario and the replies of both stages as JSON text."""
    has = J.first_ref(F.col("refs"))
    df = records.withColumn("scenario", J.scenario(F.col("record_id"), F.col("source_row"), F.col("refs"))).withColumn("_ref", has)
    s = F.col("scenario")
    lean = s == "insufficient"
    evidence = F.when(F.col("_ref").isNull() | lean, F.array().cast(STAGE1["evidence"].dataType)).otherwise(F.array("_ref"))
    enough = F.when(lean, "insufficient").when(s == "forced_review", "uncertain").otherwise("sufficient")
    gap = F.when(lean, F.array(F.when(F.col("_ref").isNull(), _NO_REFS).otherwise(_PART_REFS))).when(s == "forced_review", _texts("（演示）不知道问题的日期")).otherwise(_texts())
    why1 = F.when(lean, "（演示）资料不足。").when(s == "forced_review", "（演示）资料是否适用尚不清楚。").otherwise(F.concat(F.lit("（演示）"), F.col("_ref.ref_id"), F.lit(" 写到了要点。")))
    points = F.when(s == "forced_review", _texts("要点一", "要点二")).otherwise(_texts("要点一"))
    stage1 = F.struct(points.alias("required_points"), enough.alias("evidence_sufficiency"), evidence.alias("evidence"), gap.alias("missing_information"), _texts().alias("conflicts"), why1.alias("reason"))

    ref = F.col("_ref.ref_id")
    by = lambda **c: F.when(s == "correct", c["correct"]).when(s == "wrong", c["wrong"]).when(s == "correction", c["correction"]).when(s == "forced_review", c["forced_review"]).when(s == "forced_failure", c["forced_failure"]).otherwise(c["insufficient"])
    text = lambda tail: F.concat(F.lit("（演示）"), ref, F.lit(tail))
    label = by(correct=F.lit(CORRECT), wrong=F.lit(WRONG), correction=F.lit(NO_REF), forced_review=F.lit(NO_REF), forced_failure=F.lit(CORRECT), insufficient=F.lit(NO_REF))
    why2 = by(correct=text(" 与回答一致。"), wrong=text(" 的要点回答没有写全。"), correction=F.lit("（演示）重读之后，阶段一的结论改为资料不足。"), forced_review=F.lit("（演示）没有日期，不能选定资料。"), forced_failure=F.lit("（演示）这里引用了不存在的句子。"), insufficient=F.lit("（演示）依现有资料不能作答。"))
    issues = by(correct=_texts(), wrong=_texts("（演示）少写一个要点"), correction=_texts("（演示）用了不完整的资料"), forced_review=_texts("（演示）版本不明"), forced_failure=_texts(), insufficient=_texts())
    quoted = F.when(s == "forced_failure", F.array(F.struct(F.coalesce(ref, F.lit("ref1")).alias("ref_id"), F.lit(_FAKE_QUOTE).alias("quote")))).otherwise(evidence)
    review = s.isin("wrong", "correction", "forced_review")
    reasons = by(correct=_texts(), wrong=_texts("（演示）判断没有把握"), correction=_texts("（演示）更正改变了分类"), forced_review=_texts("（演示）日期缺失"), forced_failure=_texts(), insufficient=_texts())
    fix = F.struct(F.lit("evidence_sufficiency").alias("corrected_item"), text(" 只写到一部分。").alias("reason"), evidence.alias("evidence"), F.lit(True).alias("affects_classification"))
    fixes = F.when(s == "correction", F.array(fix)).otherwise(F.array().cast(STAGE2["stage1_corrections"].dataType))
    stage2 = F.struct(label.alias("label"), why2.alias("reason"), issues.alias("issues"), F.when(s == "correction", "insufficient").otherwise(enough).alias("evidence_sufficiency"), quoted.alias("evidence"), review.alias("review_required"), reasons.alias("review_reasons"), fixes.alias("stage1_corrections"))
    return df.withColumn("reply1", F.to_json(stage1)).withColumn("reply2", F.to_json(stage2)).drop("_ref")


def validated(replies: DataFrame) -> DataFrame:
    """replies (reply1, reply2, refs) with problem1 and problem2, the kinds of their first problems, errors1 and errors2, the fields that break the contract, and judgement, the parsed stage 2.

    Each reply's JSON object and each normalised reference is a column of its own, so that it's made once.
    """
    df = replies.select("*", J.json_object(F.col("reply1")).alias("_found1"), J.json_object(F.col("reply2")).alias("_found2"), J.normalized_refs(F.col("refs")).alias("_refs"))
    df = df.select("*", F.try_parse_json("_found1").alias("_v1"), F.try_parse_json("_found2").alias("_v2"))
    df = df.select("*", errors(F.col("_v1"), "stage1").alias("errors1"), errors(F.col("_v2"), "stage2").alias("errors2"), F.from_json("_found1", STAGE1).alias("_stage1"), typed_flags(F.from_json("_found2", STAGE2), F.col("_v2")).alias("judgement"))
    one = J.stage1_problem(F.col("_found1"), F.col("errors1"), F.col("_stage1"), F.col("_refs"))
    two = J.stage2_problem(F.col("_found2"), F.col("errors2"), F.col("judgement"), F.col("_refs"))
    return df.select("*", one.alias("problem1"), two.alias("problem2")).drop("_found1", "_found2", "_refs", "_stage1", "_v1", "_v2")


def outcomes(checked: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """State of each record whose replies don't change between attempts: a rejected reply uses the stage's whole budget.

    Stage 2 runs whatever stage 1 found sufficient; a stage-2 failure keeps the stage-1 result.
    """
    one, two = F.col("problem1").isNull(), F.col("problem2").isNull()
    done = one & two
    used1, used2 = F.when(one, 1).otherwise(max_attempts), F.when(~one, 0).when(two, 1).otherwise(max_attempts)
    return checked.select(
        "record_id", "scenario",
        F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(done, F.col("judgement.label")).alias("label"),
        F.when(done, F.col("judgement.review_required")).alias("review_required"),
        F.when(~one, "stage1").when(~two, "stage2").alias("failure_stage"),
        F.when(~done, J.OUTPUT_INVALID).alias("failure_code"),
        F.coalesce("problem1", F.when(one, F.col("problem2"))).alias("problem"),
        used1.cast("int").alias("attempts1"), used2.cast("int").alias("attempts2"),
    )


def judge_simulated(records: DataFrame) -> DataFrame:
    """Records judged by the simulated model, wholly as expressions."""
    return outcomes(validated(simulated(records)))


def parse(text: str) -> dict | None:
    """The one JSON object of a reply, by the same rule as json_object(), for clients that answer inside a task."""
    text = (text or "").strip()
    blocks = re.findall(r"```(?:json)?[ \t]*\r?\n(.*?)\r?\n?```", text, re.S)
    chosen = blocks[0].strip() if len(blocks) == 1 else text if not blocks and text.startswith("{") else ""
    try:
        found = json.loads(chosen)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


class ModelError(RuntimeError):
    """A call that gave no output. `code` is its class; without one it follows from the HTTP status or the exception's kind."""

    def __init__(self, message: str, status: int | None = None, code: str | None = None):
        super().__init__(message)
        self.status_code, self.code = status, code


# Fixed value: the outcome of an attempt that was begun and of which nothing more is known.
UNKNOWN = "unknown_after_interrupt"
ATTEMPT = "record_id string, stage string, attempt_no int, outcome string, content string, error_code string, error_message string, model string, latency_ms long, simulated boolean"


def _content(reply: str | dict) -> tuple[str, dict]:
    """The text of a reply and its facts; a reply that was cut for length is an error, one without text is an empty text."""
    facts = {"content": reply} if isinstance(reply, str) or reply is None else dict(reply)
    if facts.get("finish_reason") == "length":
        raise ModelError("the output was cut for its length", code="OUTPUT_TRUNCATED")
    text = facts.get("content")
    return text if isinstance(text, str) else "", facts


def by_rules(record: dict, stage: str, reply: dict) -> str | None:
    """The accept() of the library: "kind: message" of a reply's first problem, held against the record's `refs`."""
    refs = record["refs"]
    bad = J.problem_of(stage, reply, refs if isinstance(refs, dict) else refs.asDict())
    return ": ".join(bad) if bad else None


def attempted(record: dict, stage: str, call: Callable, accept: Callable, attempt: int) -> tuple:
    """(outcome, content, error_code, error_message, model, latency_ms, simulated, usage) of one call; a rejected output is answered in the record's messages."""
    began = time.monotonic()
    try:
        text, facts = _content(call(record, stage, attempt))
    except Exception as e:  # noqa: BLE001 - whatever a client raises is the outcome of one attempt, not of the job
        return "model_error", None, *J.error_of(e), None, round((time.monotonic() - began) * 1000), None, None
    took = facts.get("latency_ms", round((time.monotonic() - began) * 1000))
    reply = parse(text)
    problem = "output_format" if reply is None else accept(record, stage, reply)
    known = (facts.get("model"), took, facts.get("simulated"), usage_of(facts.get("usage")))
    if problem is None:
        return "ok", text, None, None, *known
    if record.get("messages"):
        record["messages"] = answered(record["messages"], text, problem, problem.split(":")[0])
    return "validation_error", text, J.OUTPUT_INVALID, problem, *known


#: What a service says of the tokens of a call.
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def usage_of(usage: object) -> str | None:
    """Token counts of a call (a dict or an object) as JSON text, null where there are none: a missing count is null, never 0."""
    get = usage.get if isinstance(usage, dict) else lambda n: getattr(usage, n, None)
    found = {n: v if isinstance(v := get(n), int) and not isinstance(v, bool) else None for n in USAGE}
    return json.dumps(found) if any(v is not None for v in found.values()) else None


def _stage(record: dict, stage: str, call: Callable, accept: Callable, used: int, most: int, wait: tuple[float, ...], sleep: Callable[[float], None]) -> Iterator[tuple]:
    """Attempts of one stage after `used` ones, until one is accepted, the budget is used up, or an error isn't worth another try."""
    if used >= most:
        yield stage, used, "budget_exhausted", None, J.BUDGET_EXHAUSTED, f"{most} attempts are used", None, None, None
        return
    for attempt in range(used + 1, most + 1):
        row = attempted(record, stage, call, accept, attempt)
        yield stage, attempt, *row[:-1]
        if row[0] == "ok" or (row[0] == "model_error" and row[2] != "MODEL_RETRYABLE"):
            return
        if row[0] == "model_error" and attempt < most:
            sleep(wait[min(attempt, len(wait)) - 1])


def call_stages(records: DataFrame, client: Callable[[], Callable[[dict, str, int], str | dict]], accept: Callable[[dict, str, dict], str | None] = by_rules, max_attempts: int = MAX_ATTEMPTS, wait: tuple[float, ...] = (2, 4), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Every attempt (ATTEMPT) of both stages with a live client.

    client() is built once per task and called as client(record, stage, attempt_no); it returns a text, or a dict with
    `content` and any of model, latency_ms, simulated and finish_reason; what it raises is classed, and retryable errors are
    tried again after a wait. accept(record, stage, reply) names a problem (a kind, or "kind: more") or returns None; by
    default it holds the reply against the contract of the stage and the record's refs.
    Columns of records that count: stage1_json, a committed stage 1, which isn't called again; used1 and used2, attempts of
    the current campaigns (null or NaN for none), which aren't refunded; messages1 and messages2 (stage 2's made with a null stage 1): the client
    finds the messages to send in record["messages"], with every rejected output and what to mend behind them. Stage 2 is
    called only after stage 1 was accepted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                one = record.get("stage1_json")
                for n, stage in enumerate(("stage1", "stage2"), 1):
                    if stage == "stage1" and isinstance(one, str):
                        continue
                    messages = record.get(f"messages{n}")
                    record["messages"] = [dict(m) for m in messages] if messages is not None else []
                    if n == 2 and record["messages"]:
                        record["messages"] = with_stage1(record["messages"], one)
                    used = record.get(f"used{n}")
                    for row in _stage(record, stage, call, accept, int(used) if used == used and used is not None else 0, max_attempts, wait, sleep):
                        rows.append((record["record_id"], *row))
                    if row[2] != "ok":
                        break
                    one = row[3]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ATTEMPT.split(", ")]).astype({"latency_ms": "Int64", "simulated": "boolean"})

    out = records.mapInPandas(run, ATTEMPT)
    return out.withColumn("content", F.when(F.col("outcome") == "validation_error", clip_output(F.col("content"))).otherwise(F.col("content")))


def results(attempts: DataFrame) -> DataFrame:
    """State of each record after its attempts: status, both results, the failure, its models in order and whether any attempt was simulated.

    A failure of stage 2 keeps stage 1; there is no label without stage 2.
    """
    place = F.struct("stage", "attempt_no")
    ok = F.col("outcome") == "ok"
    own = lambda stage: F.max_by(F.when(ok & (F.col("stage") == stage), F.col("content")), F.when(ok & (F.col("stage") == stage), F.col("attempt_no")))
    last = attempts.groupBy("record_id").agg(
        own("stage1").alias("stage1_json"), own("stage2").alias("stage2_json"),
        F.max_by(F.struct("stage", "outcome", "error_code", "error_message", "attempt_no"), place).alias("last"),
        F.coalesce(F.bool_or("simulated"), F.lit(False)).alias("simulated"), F.array_sort(F.collect_set("model")).alias("models"),
    )
    done = F.col("last.stage").eqNullSafe("stage2") & (F.col("last.outcome") == "ok")
    code = F.coalesce("last.error_code", F.when(F.col("last.outcome") == UNKNOWN, J.BUDGET_EXHAUSTED))
    failure = F.struct(code.alias("code"), F.col("last.error_message").alias("message"), F.col("last.attempt_no").alias("attempt_count"), (F.col("last.error_code") == "MODEL_RETRYABLE").alias("retryable"))
    return last.select("record_id", F.when(done, "completed").otherwise("failed").alias("status"), "stage1_json", "stage2_json", F.when(~done, F.col("last.stage")).alias("failure_stage"), F.when(~done, failure).alias("failure"), "simulated", "models")


def payloads(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """(record_id, value): one JSON object for each record's result, with its attempts in order; raw outputs of rejected attempts only.

    records are results() with source_row; a record without stage 2 has no label.
    """
    raw = F.when(F.col("outcome") == "validation_error", F.col("content")).alias("raw_output")
    entry = F.struct("stage", F.col("attempt_no").alias("attempt"), "outcome", "model", "latency_ms", "simulated", "error_code", "error_message", raw)
    tried = attempts.groupBy("record_id").agg(F.array_sort(F.collect_list(entry)).alias("attempts"))
    two = F.try_parse_json("stage2_json")
    value = F.struct("record_id", "source_row", "status", F.get_json_object("stage2_json", "$.label").alias("label"), "simulated", F.try_parse_json("stage1_json").alias("stage1"), two.alias("stage2"), "failure_stage", "failure", "attempts")
    return records.join(tried, "record_id", "left").select("record_id", F.to_json(value, {"ignoreNullFields": "false"}).alias("value"))


# Characters that are compared for similarity, those shown of the common part, and those around it.
_SIMILAR, _ECHO, _AROUND = 4000, 200, 30


def _diagnosis(quote: pd.Series, source: pd.Series) -> pd.DataFrame:
    """How a quote differs from its source: their longest common part, similarity, and where they part behind it."""
    names = ["ref_available", "is_substring", "quote_len", "source_len", "match_len", "match", "ratio", "divergence", "quote_char", "source_char", "window"]
    rows = []
    for q, s in zip(quote, source, strict=True):
        if not s:
            rows.append((False, False, len(q), 0, None, None, None, None, None, None, None))
            continue
        a, b, n = longest_common(q, s)
        ratio = round(similarity(q[:_SIMILAR], s[:_SIMILAR]), 4)
        inside = q in s
        # The common part is as long as can be, so the texts part right behind it.
        parts = (None, None, None) if inside else (a + n, q[a + n : a + n + 1] or None, s[b + n : b + n + 1] or None)
        rows.append((True, inside, len(q), len(s), n, q[a : a + n][:_ECHO], ratio, *parts, s[max(0, b - _AROUND) : b + n + _AROUND]))
    return pd.DataFrame(rows, columns=names).astype({"match_len": "Int32", "divergence": "Int32"})


def diagnosed(evidence: DataFrame) -> DataFrame:
    """evidence (quote, source and others) with the facts of _diagnosis(), both texts normalised."""
    diagnosis = F.pandas_udf(_diagnosis, "struct<ref_available:boolean,is_substring:boolean,quote_len:int,source_len:int,match_len:int,match:string,ratio:double,divergence:int,quote_char:string,source_char:string,window:string>")
    return evidence.select("*", diagnosis(F.coalesce(normalize_text(F.col("quote")), F.lit("")), F.coalesce(normalize_text(F.col("source")), F.lit(""))).alias("d")).select("*", "d.*").drop("d")


_QUOTES = "struct<evidence:array<struct<ref_id:string,quote:string>>,stage1_corrections:array<struct<evidence:array<struct<ref_id:string,quote:string>>>>>"


def diagnostics(records: DataFrame, attempts: DataFrame, job_id: str, mode: str, written_at: str) -> DataFrame:
    """(record_id, value): a JSON document for each record that deserves a look, with the facts of every quote of its rejected outputs.

    records have record_id, status, source_row, refs and failure. Write them with a folder per job: a failure to write them
    is a failure of this job alone, never of the judging, whose tables are written before.
    """
    seen = attempts.groupBy("record_id").agg(F.collect_list("outcome").alias("outcomes"), F.array_sort(F.collect_set("model")).alias("models"))
    asked = records.join(seen, "record_id").where(needs_diagnosis(F.col("status"), F.col("outcomes")))
    tries = attempts.join(asked.select("record_id", "refs"), "record_id")
    raw = F.from_json(J.json_object(F.when(F.col("outcome") == "validation_error", F.col("content"))), _QUOTES)
    quotes = F.concat(F.coalesce(raw["evidence"], F.array()), F.coalesce(F.flatten(F.transform(raw["stage1_corrections"], lambda c: F.coalesce(c["evidence"], F.array()))), F.array()))
    by_name = F.create_map(*[x for r in J.REFS for x in (F.lit(r), F.col("refs")[r])])
    each = tries.select("record_id", "stage", "attempt_no", "refs", F.posexplode(quotes).alias("pos", "e")).where("e.ref_id is not null and e.quote is not null")
    facts = diagnosed(each.select("record_id", "stage", "attempt_no", "pos", "e.ref_id", "e.quote", F.try_element_at(by_name, F.col("e.ref_id")).alias("source"))).drop("source", "quote")
    found = facts.groupBy("record_id", "stage", "attempt_no").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in facts.columns if c not in ("record_id", "stage", "attempt_no", "pos")]))).alias("quote_diagnosis"))
    own = ["stage", "attempt_no", "outcome", "latency_ms", "error_code", "error_message"]
    rows = tries.join(found, ["record_id", "stage", "attempt_no"], "left").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(*own, F.when(F.col("outcome") == "validation_error", F.col("content")).alias("raw_output"), "quote_diagnosis"))).alias("attempts"))
    document = F.struct(F.lit(job_id).alias("job_id"), "record_id", "source_row", F.lit(mode).alias("mode"), F.col("status").alias("record_status"), F.lit(written_at).alias("written_at"), "models", "failure", "attempts")
    return asked.join(rows, "record_id").select("record_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def needs_diagnosis(status: Column, outcomes_: Column) -> Column:
    """Whether a record's attempts deserve a look: all but those completed with every attempt accepted."""
    return ~((status == "completed") & F.forall(outcomes_, lambda o: o == "ok"))


