"""Registered queries of cell encoding, exports, evidence checks, model outputs and judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judgement as J
from ..functions import text as X
from ..operators import export as E
from ..operators import judge
from ..operators import records as R
from ..operators.evidence import quoted_in
from ..schemas import REFS
from . import adapter as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(r"WITH t AS (SELECT conv_id, turn, chr(13) || chr(10) || chr(9) || text || chr(160) || chr(13) AS x FROM conversations) SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(x, chr(13) || chr(10) || '|' || chr(13), chr(10), 'g'), '^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ''), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '') AS text FROM t")
def normalize_text(spark, d):
    raw = F.concat(F.lit("\r\n\t"), "text", F.lit(" \r"))
    return _table(spark, d, "conversations").select("conv_id", "turn", X.normalize_text(raw).alias("text"))


@query("SELECT doc_id, CASE WHEN length(x) > 200 THEN x[1:200] || '…' ELSE x END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)")
def q_preview(spark, d):
    return _table(spark, d, "documents").select("doc_id", X.q_preview(F.col("text")).alias("preview"))


_CELL = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '=' || text WHEN 1 THEN chr(11) || '-' || text WHEN 2 THEN '@' || repeat(text, 9) ELSE repeat(text, 4) END AS v FROM documents"
_CLEAN = r"regexp_replace(v, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


@query(f"WITH c AS ({_CELL}), e AS (SELECT doc_id, {_CLEAN} AS x, length(v) - length({_CLEAN}) AS sanitized FROM c), g AS (SELECT *, x[1] IN ('=', '+', '-', '@') AS guarded FROM e), h AS (SELECT *, CASE WHEN guarded THEN chr(39) || x ELSE x END AS y FROM g) SELECT doc_id, md5(CASE WHEN length(y) > 32767 THEN y[1:32749] || '…【已截断，完整原文见 JSONL】' ELSE y END) AS cell, length(y) > 32767 AS truncated, guarded, cast(sanitized AS integer) AS sanitized FROM h")
def excel_cell_encode(spark, d):
    v = F.expr("case doc_id % 5 when 0 then concat('=', text) when 1 then concat(chr(11), '-', text) when 2 then concat('@', repeat(text, 9)) else repeat(text, 4) end")
    c = _table(spark, d, "documents").select("doc_id", X.excel_cell(v).alias("c"))
    return c.select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("cell"), "c.truncated", "c.guarded", "c.sanitized")


@query("WITH k AS (SELECT event_id, 'ref' || event_id % 12 || '，ref' || user_id % 11 || ' ;' AS v FROM events), p AS (SELECT event_id, list_filter(regexp_split_to_array(v, '[,，、;；\\s]+'), lambda x: x <> '') AS refs FROM k) SELECT event_id, array_to_string(refs, '|') AS refs, len(list_filter(refs, lambda r: NOT regexp_full_match(r, 'ref([1-9]|10)'))) AS n_unknown FROM p")
def key_ref_split(spark, d):
    v = F.concat(F.lit("ref"), F.col("event_id") % 12, F.lit("，ref"), F.col("user_id") % 11, F.lit(" ;"))
    refs = _table(spark, d, "events").select("event_id", X.key_refs(v).alias("r"))
    unknown = F.size(F.filter("r", lambda x: ~x.isin(*REFS))).cast("long")
    return refs.select("event_id", F.array_join("r", "|").alias("refs"), unknown.alias("n_unknown"))


@query("SELECT item_id, count(d.doc_id) AS n_sources FROM benchmark LEFT JOIN documents d ON contains(d.text, benchmark.text) GROUP BY item_id")
def evidence_substring_check(spark, d):
    """How many documents hold each whole benchmark item word for word."""
    hits = quoted_in(_table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), _table(spark, d, "documents").select("doc_id", "text"))
    n = hits.groupBy(F.col("quote_id").alias("item_id")).agg(F.count("*").alias("n"))
    return _table(spark, d, "benchmark").select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_sources"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props ELSE NULL END AS found FROM events")
def json_strict_extract(spark, d):
    raw = F.expr("case event_id % 4 when 0 then concat(' ', props, '\n') when 1 then concat('text\n```json\n', props, '\n```') when 2 then concat(props, ' tail') else concat('[', props, ']') end")
    return _table(spark, d, "events").select("event_id", J.json_object(raw).alias("found"))


@query("WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 400 WHEN 1 THEN 408 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 END AS status, CASE WHEN event_id % 7 = 5 THEN 'ReadTimeout' ELSE 'ValueError' END AS name, event_type = 'click' AS ctx FROM events) SELECT event_id, CASE WHEN status IN (408, 429, 503) THEN 'MODEL_RETRYABLE' WHEN status = 400 AND ctx THEN 'CONTEXT_LIMIT' WHEN status IS NULL AND name = 'ReadTimeout' THEN 'MODEL_RETRYABLE' ELSE 'MODEL_PERMANENT' END AS code FROM e")
def error_classification(spark, d):
    e = _table(spark, d, "events").select("event_id", F.expr("case event_id % 7 when 0 then 400 when 1 then 408 when 2 then 429 when 3 then 503 when 4 then 404 end").alias("s"), F.expr("if(event_id % 7 = 5, 'ReadTimeout', 'ValueError')").alias("n"), F.expr("if(event_type = 'click', 'Context length', 'bad')").alias("t"))
    return e.select("event_id", J.error_code(F.col("s"), F.col("n"), F.col("t")).alias("code"))


@query("SELECT cast(l_orderkey AS varchar) || ':' || l_linenumber AS attempt, CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'unknown_after_interrupt' ELSE CASE WHEN l_linestatus = 'F' THEN 'validation_error' ELSE 'model_error' END END AS outcome, CASE WHEN l_linenumber = 1 THEN 2 ELSE 4 END AS wait FROM lineitem")
def attempt_outcomes(spark, d):
    line = _table(spark, d, "lineitem")
    status = F.expr("case l_returnflag when 'A' then 'succeeded' when 'N' then 'unknown' else 'failed' end")
    return line.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("attempt"), J.attempt_outcome(status, F.expr("if(l_linestatus = 'F', 'OUTPUT_INVALID', 'MODEL_RETRYABLE')")).alias("outcome"), J.backoff(F.col("l_linenumber")).alias("wait"))


def _snapshot(spark, d):
    """Documents as an export snapshot: stage-2 JSON for completed records, a failure for failed ones."""
    r = V.records(spark, d)
    judged = F.to_json(F.struct(F.concat(F.lit("reason "), "record_id").alias("reason"), F.array(F.struct(F.lit("ref1").alias("ref_id"), F.substring("q", 1, 20).alias("quote"))).alias("evidence")))
    failure = F.when(F.col("status") == "failed", F.struct(F.col("failure_code").alias("code"), F.lit("m").alias("message"), F.lit(3).alias("attempt_count"), (F.col("failure_code") == "MODEL_RETRYABLE").alias("retryable")))
    refs = F.struct(*[(F.col("a") if i < 2 else F.lit(None).cast("string")).alias(k) for i, k in enumerate(REFS)])
    return r.withColumn("stage2_json", F.when(F.col("status") == "completed", judged)).withColumn("stage1_json", F.lit(None).cast("string")).withColumn("failure", failure).withColumn("refs", refs)


_SHOW = "CASE status WHEN 'pending' THEN '未处理' WHEN 'stage1_done' THEN '阶段一完成' WHEN 'completed' THEN '已分类' WHEN 'failed' THEN '技术失败' ELSE '输入失败' END"
_YES = "CASE WHEN review_required THEN '是' WHEN NOT review_required THEN '否' ELSE '' END"


@query(f"WITH {V.RECORDS_SQL} SELECT cast(order_index + 1 AS integer) AS ordinal, record_id, source_row, label, CASE WHEN status = 'completed' THEN 'reason ' || record_id END AS reason, CASE WHEN status = 'completed' THEN 'ref1：' || q[1:20] END AS evidence, {_YES} AS review, {_SHOW} AS state FROM records")
def export_classification(spark, d):
    return E.classification_rows(_snapshot(spark, d)).drop("order_index").toDF("ordinal", "record_id", "source_row", "label", "reason", "evidence", "review", "state")


@query(f"WITH {V.RECORDS_SQL} SELECT record_id, source_row, a AS ref2, NULL::varchar AS ref3, label, 'reason ' || record_id AS reason, NULL::varchar AS human FROM records WHERE review_required")
def export_review(spark, d):
    out = E.review_rows(_snapshot(spark, d))
    return out.select(F.col("原始编号").alias("record_id"), F.col("来源行").alias("source_row"), "ref2", "ref3", F.col("原预测").alias("label"), F.col("理由").alias("reason"), F.col("人工判断").alias("human"))


@query(f"WITH {V.RECORDS_SQL} SELECT record_id, CASE failure_stage WHEN 'stage1' THEN '阶段一' ELSE '阶段二' END AS stage, failure_code AS code, 3 AS tries, CASE WHEN failure_code = 'MODEL_RETRYABLE' THEN '是' ELSE '否' END AS again FROM records WHERE status = 'failed'")
def export_failures(spark, d):
    out = E.failure_rows(_snapshot(spark, d))
    return out.select(F.col("原始编号").alias("record_id"), F.col("失败阶段").alias("stage"), F.col("错误码").alias("code"), F.col("尝试次数").alias("tries"), F.col("是否可重试").alias("again"))




@query(f"WITH {V.RECORDS_SQL}, b AS (SELECT run_id, count(*) AS total, count(*) FILTER (status = 'completed') AS classified, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'input_invalid') AS input_invalid, count(*) FILTER (status IN ('pending', 'stage1_done')) AS remaining FROM records GROUP BY run_id), k AS (SELECT DISTINCT unnest([{', '.join(chr(39) + k + chr(39) for k in E.SUMMARY)}]) AS k, unnest(range(28)) AS ord) SELECT run_id, cast(ord AS integer) AS ord, k.k AS item, CASE k.k WHEN '批次标识' THEN run_id WHEN '批次状态（捕获时）' THEN '部分失败（partial_failed）' WHEN '总数' THEN cast(total AS varchar) WHEN '已分类' THEN cast(classified AS varchar) WHEN '技术失败' THEN cast(failed AS varchar) WHEN '输入失败' THEN cast(input_invalid AS varchar) WHEN '未处理' THEN cast(remaining AS varchar) WHEN 'Excel 文件摘要' THEN '{E.EXCEL_DIGEST_NOTE}' ELSE '' END AS value FROM k, b")
def export_summary_kv(spark, d):
    run = R.batch_counters(V.records(spark, d)).drop("review_required").withColumn("status", F.lit("partial_failed"))
    return E.summary_rows(run).toDF("run_id", "ord", "item", "value")


@query(f"WITH {V.RECORDS_SQL}, r AS (SELECT order_index, q, row_number() OVER (ORDER BY order_index) + 1 AS row FROM records WHERE status = 'completed') SELECT cast(row AS integer) AS sheet_row, '分类结果!q 第 ' || row || ' 行（原 ' || length(q) * 12 || ' 字符）' AS location FROM r WHERE length(q) * 12 > 32767")
def export_rewrites(spark, d):
    rows = E.sheet_rows(V.records(spark, d).where("status = 'completed'").select("order_index", F.repeat("q", 12).alias("q")))
    return E.rewrites(rows, E.SHEETS[0]).where("truncated").select("sheet_row", "location")


@query("WITH a AS (SELECT o_custkey AS export_id, CASE WHEN o_orderkey % 2 = 0 THEN 'excel' ELSE 'jsonl' END AS kind FROM orders) SELECT export_id, count(DISTINCT kind) = 2 AS publish FROM a GROUP BY export_id")
def export_pair_publish(spark, d):
    a = _table(spark, d, "orders").select(F.col("o_custkey").alias("export_id"), F.expr("if(o_orderkey % 2 = 0, 'excel', 'jsonl')").alias("kind"))
    return E.publishable(a)


@query()
def jsonl_export(spark, d):
    """No SQL: the text of JSON objects isn't the same in both engines."""
    return E.json_lines(_snapshot(spark, d), "e1").orderBy("order_index")


@query(f"WITH {V.RECORDS_SQL} SELECT order_index, {len(E.JSONL_FIELDS)} AS n_fields, 'e1' AS export_id, cast(order_index + 1 AS varchar) AS ordinal, record_id, md5(q) AS q, status, label, CASE WHEN review_required THEN 'true' WHEN NOT review_required THEN 'false' END AS review, CASE WHEN status = 'completed' THEN 'reason ' || record_id END AS reason, CASE WHEN status = 'completed' THEN q[1:20] END AS quote, CASE WHEN status = 'failed' THEN failure_code END AS code, a AS ref2 FROM records")
def jsonl_fields(spark, d):
    """The lines of jsonl_export, read back."""
    lines = E.json_lines(_snapshot(spark, d), "e1")
    get = lambda path: F.get_json_object("value", f"$.{path}")
    return lines.select("order_index", F.size(F.json_object_keys("value")).alias("n_fields"), get("export_id").alias("export_id"), get("ordinal").alias("ordinal"), get("record_id").alias("record_id"), F.md5(get("q").cast("binary")).alias("q"), get("status").alias("status"), get("label").alias("label"), get("review_required").alias("review"), get("reason").alias("reason"), get("evidence[0].quote").alias("quote"), get("failure.code").alias("code"), get("refs.ref2").alias("ref2"))


def _judged_records(spark, d):
    docs = _table(spark, d, "documents")
    refs = F.struct(*[F.when((F.col("doc_id") % 6 != 0) & (F.lit(i) == F.col("doc_id") % 10), F.col("text")).alias(k) for i, k in enumerate(REFS)])
    return docs.select(F.when(F.col("doc_id") % 50 == 1, "FF-1").otherwise(F.col("doc_id").cast("string")).alias("record_id"), (F.col("doc_id") + 2).cast("int").alias("source_row"), refs.alias("refs"))


@query()
def judge_two_stage_mock(spark, d):
    """No SQL: the scenario is drawn by a checksum that the other engine lacks; tests hold it against plain Python."""
    return judge.judge_simulated(_judged_records(spark, d))


@query()
def quote_diagnosis(spark, d):
    """No SQL for the similarity; tests hold it against plain loops, and quote_common_part has SQL for the longest common part."""
    items = _table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), F.overlay("text", F.lit("#"), 30).alias("source"))
    return judge.diagnosed(items).drop("quote", "source")
