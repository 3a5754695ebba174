"""Checks of input batches and gold sets over a table of cells (as the xlsx source gives them).

Works on many files at once: steps are keyed by file and row (or id), so a file of any length is dealt to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ranks import kept, numbered
from ..schemas import GOLD_COLUMNS, GOLD_META, ID, INPUT_COLUMNS, LABELS, REFS, A, Q

# Sheet that is preferred, and the reasons a cell can't be read.
INPUT_SHEET = "QA_REF"
_NO_CACHE, _FORMULA_ERROR, _CELL_ERROR = "公式单元格没有缓存值（文件未经 Excel 计算保存）", "公式结果为 Excel 错误值 ", "单元格为 Excel 错误值 "
_SHA, _DATE = r"^[0-9a-f]{12}$", r"^\d{4}-\d{2}-\d{2}$"


def verified(stored: DataFrame, records: DataFrame, again: DataFrame, keys: Sequence[str] = ("file", "source_row")) -> DataFrame:
    """(file, problem) of stored inputs that aren't what was validated: another digest, or rows that read otherwise now.

    stored holds (file, sha256, sha256_now); records and again are the rows as they were stored and as they read now.
    """
    digest = stored.where(~F.col("sha256").eqNullSafe(F.col("sha256_now"))).select("file", F.lit("DIGEST_CHANGED").alias("problem"))
    rest = [c for c in records.columns if c not in keys]
    row = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    other = row(records, "was").join(row(again, "now"), list(keys), "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return digest.union(other.select("file", F.lit("ROWS_CHANGED").alias("problem")).distinct())


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def selected_sheet(catalog: DataFrame, requested: str | None = None) -> DataFrame:
    """(file, sheet): the requested sheet (null if absent), else the preferred one, else the only visible one."""
    named = lambda n: F.max(F.when(F.col("sheet") == n, F.col("sheet")))
    chosen = named(requested) if requested is not None else F.coalesce(named(INPUT_SHEET), F.when(F.count_if("visible") == 1, F.max(F.when(F.col("visible"), F.col("sheet")))))
    return catalog.groupBy("file").agg(chosen.alias("sheet"))


def _shown(cells: DataFrame) -> tuple[Column, Column]:
    """(kind, value) that a cell shows: a formula's stored result with the kind it was stored as."""
    formula = F.col("kind") == "f"
    stored = F.col("cached_kind") if "cached_kind" in cells.columns else F.when(F.col("cached").isNotNull(), "s")
    return F.when(formula, stored).otherwise(F.col("kind")), F.when(formula, F.col("cached")).otherwise(F.col("value"))


def headers(cells: DataFrame) -> DataFrame:
    """(file, name, col, again): first-row names; again marks a repeated one."""
    first = cells.where("row = 1").select("file", "col", X.cell_to_text(*_shown(cells)).alias("name")).where("name is not null")
    return first.withColumn("again", F.row_number().over(W.partitionBy("file", "name").orderBy("col")) > 1)


def header_problems(cells: DataFrame, required: Sequence[str] = INPUT_COLUMNS) -> DataFrame:
    """(file, code, names): missing columns, else repeated ones."""
    found = headers(cells).groupBy("file").agg(F.collect_set("name").alias("names"), F.array_sort(F.collect_set(F.when(F.col("again"), F.col("name")))).alias("twice"))
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("names"))
    code = F.when(F.size(missing) > 0, "MISSING_COLUMNS").when(F.size("twice") > 0, "DUPLICATE_COLUMNS")
    return found.select("file", code.alias("code"), F.when(F.size(missing) > 0, missing).otherwise(F.col("twice")).alias("names")).where("code is not null")


def unreadable(kind: Column, value: Column, cached: Column) -> Column:
    """Why a cell has no usable value, null if it has."""
    formula = F.when(cached.isNull(), _NO_CACHE).when(X.is_error_value(cached), F.concat(F.lit(_FORMULA_ERROR), X.strip(cached)))
    return F.when(kind == "f", formula).when((kind == "e") | X.is_error_value(value), F.concat(F.lit(_CELL_ERROR), X.strip(value)))


def _laid(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, row, col, kind, text, why) of every cell, and the files' headers (file, header) as (col, name) in order, which are written: the cells' first rows are read by themselves."""
    kind, used = _shown(cells)
    why = unreadable(F.col("kind"), F.col("value"), F.col("cached"))
    each = cells.select("file", "row", "col", kind.alias("shown"), used.alias("used"), why.alias("why"))
    # A header cell is named by what it shows, whatever it says.
    each = each.select("file", "row", "col", F.col("shown").alias("kind"), F.when(F.col("why").isNull() | (F.col("row") == 1), X.cell_to_text(F.col("shown"), F.col("used"))).alias("text"), "why")
    names = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("col", F.col("text").alias("name")))))
    return each, kept(each.where("row = 1").groupBy("file").agg(names.alias("header")), "headers")


def _named(laid: tuple[DataFrame, DataFrame], columns: Sequence[str]) -> DataFrame:
    """All rows with the columns' texts, why map, numeric_id and the number of cells below a name (the first of equal names).

    Each cell gets its name by a join and meets its row alone, so a file's rows are dealt to all tasks.
    """
    each, header = laid
    first = header.select(F.col("file").alias("_file"), F.explode("header").alias("h")).groupBy("_file", F.col("h.name").alias("name")).agg(F.min("h.col").alias("_col"))
    each = each.join(first, each["file"].eqNullSafe(F.col("_file")) & (F.col("col") == F.col("_col")), "left").select("file", "row", "col", "kind", "text", "why", "name")
    cell = lambda name: F.min(F.when(F.col("name") == name, F.struct("kind", "text", "why")))
    reasons = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull() & F.col("why").isNotNull(), F.struct("col", "name", "why"))))
    rows = each.repartition("file", "row").groupBy("file", "row").agg(*[cell(c).alias(f"_{i}") for i, c in enumerate(columns)], cell(ID).alias("_id"), reasons.alias("_why"), F.count("name").cast("int").alias("named"))
    why = F.map_from_entries(F.transform("_why", lambda c: F.struct(c["name"], c["why"])))
    return rows.select("file", F.col("row").alias("source_row"), *[F.col(f"_{i}")["text"].alias(c) for i, c in enumerate(columns)], why.alias("why"), F.coalesce(F.col("_id")["kind"] == "n", F.lit(False)).alias("numeric_id"), "named")


def rows_of(cells: DataFrame, columns: Sequence[str] = INPUT_COLUMNS) -> DataFrame:
    """(file, source_row, columns..., why map, numeric_id): the data rows of a sheet; blank rows between them included."""
    return _named(_laid(cells), columns).where("source_row > 1 and named > 0").drop("named")


def _blank(columns: Sequence[str]) -> Column:
    return F.forall(F.array(*[F.col(f"`{c}`") for c in columns]), lambda c: c.isNull()) & (F.size("why") == 0)


def _reason() -> Column:
    """What is wrong with a row of an input, null if nothing is."""
    unread = lambda c: F.when(F.try_element_at("why", F.lit(c)).isNotNull(), F.concat(F.lit(f"{c}：不可读取（"), F.try_element_at("why", F.lit(c)), F.lit("）")))
    needed = lambda c: F.coalesce(unread(c), F.when(F.col(f"`{c}`").isNull(), f"{c}：缺失或为空"))
    return F.nullif(F.array_join(F.array_compact(F.array(*map(needed, (ID, Q, A)), *map(unread, REFS))), "；"), F.lit(""))


def input_records(cells: DataFrame) -> DataFrame:
    """(file, record_id, source_row, order_index, q, a, refs, reason): records in order; reason is null for valid ones."""
    rows = rows_of(cells).where(~_blank(INPUT_COLUMNS))
    rows = rows.select("file", F.col(ID).alias("record_id"), "source_row", Q, A, F.struct(*REFS).alias("refs"), _reason().alias("reason"), "numeric_id")
    rows = numbered(rows, ["file"], ["source_row"], "order_index")
    return rows.select("file", "record_id", "source_row", (F.col("order_index") - 1).cast("int").alias("order_index"), Q, A, "refs", "reason", "numeric_id")


def precheck(cells: DataFrame, max_records: int = 1000) -> DataFrame:
    """(file, status, total, valid, input_invalid, skipped_blank_rows, blockers, warnings): a report per file.

    Header problems block with null counts, missing columns before repeated ones; then repeated ids, too many records and
    no valid record block with their counts. The cells are read once besides the first rows and shuffled once, by row.
    """
    laid = _laid(cells)
    rows = _named(laid, INPUT_COLUMNS)
    rows = rows.select("file", "source_row", ((F.col("source_row") > 1) & (F.col("named") > 0) & ~_blank(INPUT_COLUMNS)).alias("record"), F.col(ID).alias("id"), _reason().alias("reason"), "numeric_id")
    # Rows without an id repeat none: each by itself.
    same = F.count_if("record").over(W.partitionBy("file", "id", F.when(F.col("id").isNull(), F.col("source_row"))))
    df = rows.withColumn("again", F.col("record") & F.col("id").isNotNull() & (same > 1)).groupBy("file").agg(
        F.count_if("record").alias("n"), F.count_if(F.col("record") & F.col("reason").isNull()).alias("good"), F.bool_or(F.col("record") & F.col("numeric_id")).alias("numeric"),
        F.bool_or("again").alias("again"), F.coalesce(F.max(F.when(F.col("source_row") > 1, F.col("source_row"))) - 1, F.lit(0)).alias("rows"),
    )
    names = laid[1].select(F.col("file").alias("_file"), F.transform("header", lambda h: h["name"]).alias("names"))
    df = df.join(names, df["file"].eqNullSafe(F.col("_file")), "left")
    there = F.coalesce(F.size("names"), F.lit(0)) > 0
    missing, repeated = F.size(F.array_except(F.array(*map(F.lit, INPUT_COLUMNS)), "names")) > 0, F.size("names") > F.size(F.array_distinct("names"))
    code = F.when(there & missing, "MISSING_COLUMNS").when(there & repeated, "DUPLICATE_COLUMNS")
    extra = there & (F.size(F.array_except("names", F.array(*map(F.lit, INPUT_COLUMNS)))) > 0)
    df = df.select("file", code.alias("code"), F.coalesce(extra, F.lit(False)).alias("extra"), "n", "good", "numeric", "again", "rows")
    ok = F.col("code").isNull()
    blockers = F.array_compact(F.array(F.col("code"), F.when(ok & F.col("again"), "DUPLICATE_RECORD_ID"), F.when(ok & (F.col("n") > max_records), "TOO_MANY_RECORDS"), F.when(ok & (F.col("good") == 0), "NO_VALID_RECORDS")))
    warnings = F.array_compact(F.array(F.when(ok & F.col("extra"), "EXTRA_COLUMNS_UNUSED"), F.when(ok & F.col("numeric"), "NUMERIC_RECORD_ID_LEADING_ZEROS")))
    return df.select("file", F.when(F.size(blockers) > 0, "blocked").otherwise("passed").alias("status"), F.when(ok, F.col("n")).alias("total"), F.when(ok, F.col("good")).alias("valid"), F.when(ok, F.col("n") - F.col("good")).alias("input_invalid"), F.when(ok, F.col("rows") - F.col("n")).alias("skipped_blank_rows"), blockers.alias("blockers"), warnings.alias("warnings"))


def gold_rows(cells: DataFrame) -> DataFrame:
    """Gold rows with all their problems (array of codes), warnings, parsed key_refs and excluded; repeats of an id that parsed first are problems too."""
    judged, why, keys, out, out_why = GOLD_COLUMNS
    rows = rows_of(cells, (*INPUT_COLUMNS, *GOLD_COLUMNS)).where(~_blank((*INPUT_COLUMNS, *GOLD_COLUMNS)))
    c = lambda n: F.col(f"`{n}`")
    refs = X.key_refs(c(keys))
    excluded = F.coalesce(c(out) == "是", F.lit(False))
    filled = F.array_compact(F.array(*[F.when(c(r).isNotNull(), r) for r in REFS]))
    problems = [
        F.when(c(ID).isNull(), "GOLD_ID_MISSING"),
        F.when(c(out).isNotNull() & ~c(out).isin("是", "否"), "GOLD_EXCLUDED_INVALID"),
        F.when(excluded & c(judged).isNotNull(), "GOLD_EXCLUDED_HAS_LABEL"),
        F.when(excluded & c(out_why).isNull(), "GOLD_EXCLUSION_REASON_MISSING"),
        F.when(~excluded & c(judged).isNull(), "GOLD_UNDECIDED"),
        F.when(~excluded & ~c(judged).isin(*LABELS), "GOLD_LABEL_INVALID"),
        F.when(F.size(F.array_except(refs, F.array(*map(F.lit, REFS)))) > 0, "GOLD_KEY_REF_UNKNOWN"),
        F.when(F.size(F.array_except(refs, filled)) > 0, "GOLD_KEY_REF_EMPTY"),
        F.when(c(Q).isNull() | c(A).isNull(), "GOLD_INPUT_FIELD_MISSING"),
    ]
    df = rows.withColumn("problems", F.array_compact(F.array(*problems))).withColumn("key_refs", refs).withColumn("excluded", excluded)
    df = df.withColumn("warnings", F.array_compact(F.array(F.when(~excluded & c(judged).isin(*LABELS) & c(why).isNull(), "GOLD_REASON_MISSING"))))
    good = F.size("problems") == 0
    # Rows with problems aren't counted: each by itself.
    seen = F.row_number().over(W.partitionBy("file", ID, F.when(~good, F.col("source_row"))).orderBy("source_row"))
    return df.withColumn("problems", F.when(good & (seen > 1), F.array(F.lit("GOLD_ID_DUPLICATE"))).otherwise(F.col("problems")))


def gold_metadata(cells: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, four values, problems) of key-value sheets, the last value of a key counts; of `files` (file), those without such a sheet say so."""
    text = X.cell_to_text(*_shown(cells))
    pairs = cells.groupBy("file", "row").agg(F.max(F.when(F.col("col") == 1, text)).alias("k"), F.max(F.when(F.col("col") == 2, text)).alias("v")).where("v is not null")
    value = [F.max_by(F.when(F.col("k") == m, F.col("v")), F.when(F.col("k") == m, F.col("row"))).alias(m) for m in GOLD_META]
    df = pairs.groupBy("file").agg(*value)
    c = lambda m: F.col(f"`{m}`")
    lacking = F.array_compact(F.array(*[F.when(c(m).isNull(), m) for m in GOLD_META]))
    problems = F.array(F.when(F.size(lacking) > 0, "GOLD_META_INCOMPLETE"), F.when(~c(GOLD_META[2]).rlike(_DATE), "GOLD_META_INVALID_DATE"), F.when(~X.sha_prefix(c(GOLD_META[3])).rlike(_SHA), "GOLD_META_INVALID_SHA256"))
    df = df.withColumn("problems", F.array_compact(problems))
    if files is None:
        return df
    present = cells.select("file").distinct().withColumn("there", F.lit(True))
    df = files.select("file").distinct().join(present, "file", "left").join(df, "file", "left")
    none = F.when(F.col("there"), F.array(F.lit("GOLD_META_INCOMPLETE"))).otherwise(F.array(F.lit("GOLD_META_MISSING")))
    return df.withColumn("problems", F.coalesce("problems", none)).drop("there")
