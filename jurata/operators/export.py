"""Export documents of a run: three record sheets, a key-value summary and JSON lines, from one snapshot of the records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import REFS
from .ranks import ranked

# Sheet names and their columns.
SHEETS = ("分类结果", "复核清单", "失败清单", "运行概况")
CLASSIFICATION = ("序号", "原始编号", "来源行", "原预测", "理由", "证据", "需复核", "处理状态")
REVIEW = ("序号", "原始编号", "来源行", "q", "a", *REFS, "原预测", "理由", "证据", "需复核", "人工判断", "复核说明")
FAILURES = ("序号", "原始编号", "来源行", "失败阶段", "错误码", "错误信息", "尝试次数", "是否可重试")
# Rows of the summary sheet, in order.
SUMMARY = ("批次标识", "来源文件", "工作表", "输入摘要", "批次状态（捕获时）", "捕获时间", "捕获修订", "总数", "有效记录", "输入失败", "已分类", "技术失败", "未处理", "需复核", "被截断单元格数", "被截断单元格位置", "文本前缀防护单元格数", "清理控制字符单元格数", "清理控制字符位置", "程序版本", "提示词版本", "阶段一 schema 版本", "阶段二 schema 版本", "输入合同版本", "导出合同版本", "JSONL 文件", "JSONL 文件摘要", "Excel 文件摘要")
EXCEL_DIGEST_NOTE = "见批次详情导出区块（文件无法包含自身摘要）"
# Fields of a JSON line, in order.
JSONL_FIELDS = ("export_id", "run_id", "ordinal", "record_key", "record_id", "source_row", "order_index", "q", "a", "refs", "status", "label", "review_required", "reason", "evidence", "review_reasons", "stage1", "stage2", "failure", "attempt_summary", "versions")


def snapshot(records: DataFrame, results: DataFrame, attempts: DataFrame) -> DataFrame:
    """Records with both stage results and an attempt summary, by three left joins on the record."""
    stage = lambda k: results.where(F.col("stage") == k).select("record_key", F.col("result_json").alias(f"stage{k}_json"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    summary = attempts.groupBy("record_key").agg(F.struct(F.count("*").alias("total"), count(F.col("stage") == 1).alias("stage1"), count(F.col("stage") == 2).alias("stage2"), count(F.col("status") == "failed").alias("failed"), count(F.col("status") == "unknown").alias("unknown_after_interrupt"), count(F.col("simulated")).alias("simulated")).alias("attempt_summary"))
    return records.join(stage(1), "record_key", "left").join(stage(2), "record_key", "left").join(summary, "record_key", "left")


def _ordinal() -> Column:
    return F.col("order_index") + 1


def _result_columns() -> dict[str, Column]:
    done = F.col("status") == "completed"
    return {
        "原预测": F.when(done, F.col("label")),
        "理由": F.when(done, F.get_json_object("stage2_json", "$.reason")),
        "证据": F.when(done, X.format_evidence(F.from_json(F.get_json_object("stage2_json", "$.evidence"), "array<struct<ref_id:string,quote:string>>"))),
        "需复核": X.yes_no(F.col("review_required")),
    }


def classification_rows(snap: DataFrame) -> DataFrame:
    """Every record; what a record lacks is empty."""
    c = {"序号": _ordinal(), "原始编号": F.col("record_id"), "来源行": F.col("source_row"), **_result_columns(), "处理状态": X.shown(F.col("status"), X.RECORD_STATUS_TEXT)}
    return snap.select("order_index", *[c[k].alias(k) for k in CLASSIFICATION])


def review_rows(snap: DataFrame) -> DataFrame:
    """Flagged records with their whole input and two empty columns for people."""
    c = {"序号": _ordinal(), "原始编号": F.col("record_id"), "来源行": F.col("source_row"), "q": F.col("q"), "a": F.col("a"), **{r: F.col(f"refs.{r}") for r in REFS}, **_result_columns(), "人工判断": F.lit(None).cast("string"), "复核说明": F.lit(None).cast("string")}
    return snap.where("review_required").select("order_index", *[c[k].alias(k) for k in REVIEW])


def failure_rows(snap: DataFrame) -> DataFrame:
    """Technical failures only; invalid input is another state."""
    c = {"序号": _ordinal(), "原始编号": F.col("record_id"), "来源行": F.col("source_row"), "失败阶段": X.shown(F.col("failure_stage"), X.STAGE_TEXT), "错误码": F.col("failure.code"), "错误信息": F.col("failure.message"), "尝试次数": F.col("failure.attempt_count"), "是否可重试": X.yes_no(F.col("failure.retryable"))}
    return snap.where("status = 'failed'").select("order_index", *[c[k].alias(k) for k in FAILURES])


def sheet_rows(rows: DataFrame, run: str | None = None) -> DataFrame:
    """With the physical row in the sheet, the header being row 1: order_index, one to a row, is ranked by itself and joined.

    Rows of several runs need the column that tells their runs apart: each run's sheet begins anew.
    """
    keys = [rows["order_index"].alias("_index"), (rows[run] if run else F.lit(0)).alias("_run")]
    places = ranked(rows.select(*keys), ["_run", "_index"], "_place")
    first = places.groupBy(F.col("_run").alias("_of")).agg((F.min("_place") - 2).alias("_before"))  # the header's row is 1
    places = places.join(first, F.col("_run").eqNullSafe(F.col("_of"))).select("_run", "_index", (F.col("_place") - F.col("_before")).cast("int").alias("sheet_row"))
    own = F.col("order_index") == F.col("_index")
    return rows.join(places, own & F.col(run).eqNullSafe(F.col("_run")) if run else own).drop("_run", "_index")


def rewrites(rows: DataFrame, sheet: str, run: str | None = None) -> DataFrame:
    """(sheet, column_name, sheet_row, truncated, guarded, sanitized, location) of the cells that a workbook changes, and the run they are of if it's a column."""
    names = [n for n, t in rows.dtypes if t == "string" and n != run]
    kept = [run, "sheet_row"] if run else ["sheet_row"]
    cells = rows.select(*kept, F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("value"), X.excel_cell(F.col(f"`{n}`")).alias("cell")) for n in names])).alias("c")).select(*kept, "c.*")
    hit = cells.where("cell.truncated or cell.guarded or cell.sanitized > 0")
    place = F.when(F.col("cell.truncated"), X.cell_location(F.lit(sheet), F.col("column_name"), F.col("sheet_row"), F.length("value"))).when(F.col("cell.sanitized") > 0, X.sanitized_location(F.lit(sheet), F.col("column_name"), F.col("sheet_row"), F.col("cell.sanitized")))
    return hit.select(*kept[:-1], F.lit(sheet).alias("sheet"), "column_name", "sheet_row", "cell.truncated", "cell.guarded", "cell.sanitized", place.alias("location"))


def summary_rows(run: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """(ord, 项目, 值) and run_id: the summary sheet of each run of a table of counters and facts, all rows in their fixed order."""
    extra = dict(extra or {})
    known = {"批次标识": "run_id", "来源文件": "source_filename", "工作表": "sheet_name", "输入摘要": "input_digest", "捕获时间": "captured_at", "捕获修订": "revision", "总数": "total", "有效记录": "valid", "输入失败": "input_invalid", "已分类": "classified", "技术失败": "failed", "未处理": "remaining", "需复核": "review_required", "被截断单元格数": "truncated", "文本前缀防护单元格数": "guarded", "清理控制字符单元格数": "sanitized"}

    def value(name: str) -> Column:
        if name in extra:
            return F.lit(extra[name])
        if name == "批次状态（捕获时）" and "status" in run.columns:
            return X.run_status_text(F.col("status"))
        if known.get(name) in run.columns:
            return F.col(known[name]).cast("string")
        return F.lit(EXCEL_DIGEST_NOTE if name == SUMMARY[-1] else "")

    return run.select("run_id", F.posexplode(F.array(*[F.struct(F.lit(k).alias("项目"), value(k).alias("值")) for k in SUMMARY])).alias("ord", "kv")).select("run_id", "ord", "kv.*")


def json_lines(snap: DataFrame, export_id: str, versions: Mapping[str, str] | None = None) -> DataFrame:
    """(order_index, value): one JSON object per record, every field in order, nulls kept, nothing cut."""
    stage2 = F.col("stage2_json")
    c: dict[str, Column] = {
        "export_id": F.lit(export_id), "ordinal": _ordinal(),
        "reason": F.get_json_object(stage2, "$.reason"),
        "evidence": F.from_json(F.get_json_object(stage2, "$.evidence"), "array<struct<ref_id:string,quote:string>>"),
        "review_reasons": F.from_json(F.get_json_object(stage2, "$.review_reasons"), "array<string>"),
        "stage1": F.try_parse_json("stage1_json"), "stage2": F.try_parse_json("stage2_json"),
        "versions": F.create_map(*[F.lit(x) for kv in (versions or {"export": "1.0"}).items() for x in kv]),
    }
    line = F.to_json(F.struct(*[c.get(k, F.col(k) if k in snap.columns else F.lit(None).cast("string")).alias(k) for k in JSONL_FIELDS]), {"ignoreNullFields": "false"})
    return snap.select("order_index", line.alias("value"))


def publishable(artifacts: DataFrame) -> DataFrame:
    """(export_id, publish): an export is published only with both of its files."""
    return artifacts.groupBy("export_id").agg((F.array_sort(F.collect_set("kind")) == F.array(F.lit("excel"), F.lit("jsonl"))).alias("publish"))
