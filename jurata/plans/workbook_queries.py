"""Registered queries of prechecks and gold sets, over cells made of the documents table, each with its comparison SQL.

A source of documents is a file; a document is a row of it, in the order of doc_id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..schemas import GOLD_COLUMNS, GOLD_META, INPUT_COLUMNS, LABELS
from ..sources import workbook as B
from .state_queries import _table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _sheet(spark, d, columns: dict):
    """Cells of the given columns (name -> (kind, value) of a document) below a header, a file per source and kind of defect."""
    docs = numbered(_table(spark, d, "documents").select("doc_id", "source", "lang", "text").where("source is not null"), ["source"], ["doc_id"], "row")
    docs = docs.withColumn("row", (F.col("row") + 1).cast("int"))
    cell = lambda i, kind, value: F.struct(F.lit(i).alias("col"), kind.alias("kind"), value.cast("string").alias("value"))
    body = docs.select(F.col("source").alias("file"), "row", F.explode(F.array(*[cell(i, k, v) for i, (k, v) in enumerate(columns.values(), 1)])).alias("c"))
    head = docs.select("source").distinct().select(F.col("source").alias("file"), F.lit(1).alias("row"), F.explode(F.array(*[cell(i, F.lit("s"), F.lit(n)) for i, n in enumerate([*columns, "q"], 1)])).alias("c"))
    # Files lack a column or have one twice by the last digit of their name.
    last = F.substring("file", -1, 1)
    named = head.union(body).select("file", "row", "c.*").where((last != "4") | (F.col("col") != 3)).where((last == "5") | (F.col("col") <= len(columns)))
    return named.where("value is not null").select("file", F.lit("QA_REF").alias("sheet"), F.lit(True).alias("visible"), "row", "col", "kind", "value", F.lit(None).cast("string").alias("cached"), F.lit(None).cast("string").alias("cached_kind"))


def _inputs(spark, d):
    s, key = F.lit("s"), F.col("doc_id")
    number = F.when(key % 9 == 0, (key - 9).cast("string")).otherwise(key.cast("string"))  # every ninth repeats an id
    columns = {INPUT_COLUMNS[0]: (F.when(F.col("source").endswith("7"), "n").otherwise("s"), number), "q": (s, F.when(key % 13 == 0, "#N/A").when(key % 17 != 0, F.col("text"))), "a": (s, F.when(key % 19 != 0, F.col("lang")))}
    columns |= {r: (s, F.when(key % 10 == i, F.col("source"))) for i, r in enumerate(INPUT_COLUMNS[3:])}
    return _sheet(spark, d, columns)


_BLANK = "regexp_full_match(coalesce(text, ''), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]*')"
_ROWS = f"w AS (SELECT source AS file, doc_id, CASE WHEN doc_id % 9 = 0 THEN doc_id - 9 ELSE doc_id END AS id, right(source, 1) AS last, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1 AS row, CASE WHEN doc_id % 13 = 0 THEN 'q：不可读取（单元格为 Excel 错误值 #N/A）' WHEN doc_id % 17 = 0 OR {_BLANK} THEN 'q：缺失或为空' END AS bad_q, CASE WHEN doc_id % 19 = 0 OR lang IS NULL THEN 'a：缺失或为空' END AS bad_a FROM documents WHERE source IS NOT NULL)"


@query(f"WITH {_ROWS}, n AS (SELECT file, any_value(last) AS last, count(*) AS total, count(*) FILTER (bad_q IS NULL AND bad_a IS NULL) AS valid FROM w GROUP BY 1), t AS (SELECT DISTINCT file FROM (SELECT file, id FROM w GROUP BY ALL HAVING count(*) > 1)) SELECT file, CASE WHEN last = '4' THEN 'MISSING_COLUMNS' WHEN last = '5' THEN 'DUPLICATE_COLUMNS' ELSE concat_ws(',', CASE WHEN t.file IS NOT NULL THEN 'DUPLICATE_RECORD_ID' END, CASE WHEN total > 60 THEN 'TOO_MANY_RECORDS' END, CASE WHEN valid = 0 THEN 'NO_VALID_RECORDS' END) END AS blockers, CASE WHEN last NOT IN ('4', '5') THEN total END AS total, CASE WHEN last NOT IN ('4', '5') THEN valid END AS valid, CASE WHEN last NOT IN ('4', '5') THEN total - valid END AS input_invalid, CASE WHEN last = '7' THEN 'NUMERIC_RECORD_ID_LEADING_ZEROS' ELSE '' END AS warnings FROM n LEFT JOIN t USING (file)")
def precheck_files(spark, d):
    out = B.precheck(_inputs(spark, d), max_records=60)
    return out.select("file", F.array_join("blockers", ",").alias("blockers"), "total", "valid", "input_invalid", F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {_ROWS} SELECT file, id || '' AS record_id, cast(row AS integer) AS source_row, cast(row - 2 AS integer) AS order_index, nullif(concat_ws('；', bad_q, bad_a), '') AS reason FROM w WHERE last NOT IN ('4', '5')")
def input_records(spark, d):
    """The records of the files that have all columns once, with what is wrong with them."""
    out = B.input_records(_inputs(spark, d)).where(~F.col("file").rlike("[45]$"))
    return out.select("file", "record_id", "source_row", "order_index", "reason")


_GOLD = f"g AS (SELECT source AS file, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1 AS row, CASE WHEN doc_id % 9 = 0 THEN doc_id - 9 ELSE doc_id END AS id, doc_id % 6 = 5 AS excluded, CASE WHEN doc_id % 7 = 1 THEN NULL WHEN doc_id % 7 = 2 THEN 'x' ELSE '{LABELS[0]}' END AS judged, doc_id % 4 > 0 AS why, CASE doc_id % 5 WHEN 0 THEN 'ref1' WHEN 1 THEN 'ref2' WHEN 2 THEN 'ref12' END AS keys, {_BLANK} AS no_q FROM documents WHERE source IS NOT NULL AND NOT regexp_matches(source, '[45]$'))"
_PROBLEMS = "concat_ws(',', CASE WHEN excluded AND judged IS NOT NULL THEN 'GOLD_EXCLUDED_HAS_LABEL' END, CASE WHEN excluded AND doc_id % 8 = 1 THEN 'GOLD_EXCLUSION_REASON_MISSING' END, CASE WHEN NOT excluded AND judged IS NULL THEN 'GOLD_UNDECIDED' END, CASE WHEN NOT excluded AND judged = 'x' THEN 'GOLD_LABEL_INVALID' END, CASE WHEN keys = 'ref12' THEN 'GOLD_KEY_REF_UNKNOWN' END, CASE WHEN keys IN ('ref2', 'ref12') THEN 'GOLD_KEY_REF_EMPTY' END, CASE WHEN no_q THEN 'GOLD_INPUT_FIELD_MISSING' END)"


@query(f"WITH {_GOLD}, p AS (SELECT *, {_PROBLEMS} AS problems FROM g), s AS (SELECT *, row_number() OVER (PARTITION BY file, id, problems = '' ORDER BY row) AS r FROM p) SELECT file, cast(row AS integer) AS source_row, id || '' AS record_id, excluded, CASE WHEN problems = '' AND r > 1 THEN 'GOLD_ID_DUPLICATE' ELSE problems END AS problems, CASE WHEN NOT excluded AND judged <> 'x' AND NOT why THEN 'GOLD_REASON_MISSING' ELSE '' END AS warnings FROM s")
def gold_rows(spark, d):
    s, key = F.lit("s"), F.col("doc_id")
    judged = F.when(key % 7 == 2, "x").when(key % 7 != 1, LABELS[0])
    columns = {INPUT_COLUMNS[0]: (s, F.when(key % 9 == 0, key - 9).otherwise(key)), "q": (s, F.col("text")), "a": (s, F.lit("a"))}
    columns |= {r: (s, F.lit("r") if r == "ref1" else F.lit(None).cast("string")) for r in INPUT_COLUMNS[3:]}
    columns |= dict(zip(GOLD_COLUMNS, ((s, judged), (s, F.when(key % 4 > 0, "w")), (s, F.expr("case doc_id % 5 when 0 then 'ref1' when 1 then 'ref2' when 2 then 'ref12' end")), (s, F.when(key % 6 == 5, "是").when(key % 6 == 4, "否")), (s, F.when(key % 8 != 1, "o"))), strict=True))
    out = B.gold_rows(_sheet(spark, d, columns)).where(~F.col("file").rlike("[45]$"))
    return out.select("file", "source_row", F.col(INPUT_COLUMNS[0]).alias("record_id"), "excluded", F.array_join("problems", ",").alias("problems"), F.array_join("warnings", ",").alias("warnings"))


@query("SELECT 'f' || c_custkey AS file, CASE WHEN c_custkey % 5 = 0 THEN 'GOLD_META_MISSING' ELSE concat_ws(',', CASE WHEN c_custkey % 4 = 1 THEN 'GOLD_META_INCOMPLETE' END, CASE WHEN c_custkey % 3 = 0 THEN 'GOLD_META_INVALID_DATE' END, CASE WHEN c_custkey % 4 <> 1 AND c_custkey % 7 = 0 THEN 'GOLD_META_INVALID_SHA256' END) END AS problems FROM customer")
def gold_metadata(spark, d):
    """A key-value sheet for four files of five; a key's second value counts."""
    c = _table(spark, d, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("file"), "c_custkey")
    key = F.col("c_custkey")
    values = [F.lit("1"), F.lit("p"), F.when(key % 3 == 0, "soon").otherwise("2024-01-31"), F.when(key % 7 == 0, "xyz").otherwise("ABCDEF012345")]
    pairs = [(0, GOLD_META[0], F.lit("0")), *((i, k, v) for i, (k, v) in enumerate(zip(GOLD_META, values, strict=True), 1))]
    each = F.array(*[F.struct(F.lit(i + 1).alias("row"), F.lit(n).alias("col"), (F.lit(k) if n == 1 else v).alias("value")) for i, k, v in pairs for n in (1, 2)])
    cells = c.where("c_custkey % 5 <> 0").select("file", "c_custkey", F.explode(each).alias("e")).select("file", "c_custkey", "e.*").where("not (c_custkey % 4 = 1 and row = 5)")
    cells = cells.select("file", "row", "col", F.lit("s").alias("kind"), "value", F.lit(None).cast("string").alias("cached"), F.lit(None).cast("string").alias("cached_kind"))
    return B.gold_metadata(cells, c.select("file")).select("file", F.array_join("problems", ",").alias("problems"))
