"""Contracts of the judged tables: column names, states and Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The labels, in the order that every report keeps.
LABELS = ("回答正确", "未检索到正确资料", "检索到正确资料但回答错误")
CORRECT, NO_CORRECT_REF, REF_OK_ANSWER_WRONG = LABELS

# States of records, runs, jobs and attempts.
RECORD_STATES = ("pending", "stage1_done", "completed", "failed", "input_invalid")
RUN_STATES = ("queued", "running", "completed", "partial_failed", "failed", "interrupted")
JOB_STATES = ("queued", "running", "completed", "failed", "interrupted")
STAGES = ("stage1", "stage2")
SPLITS = ("calibration", "holdout")

# Columns of an input workbook and of the human annotations.
ID, Q, A = "编号", "q", "a"
REFS = tuple(f"ref{i}" for i in range(1, 11))
INPUT_COLUMNS = (ID, Q, A, *REFS)
GOLD_COLUMNS = ("人工判断", "人工理由", "关键ref", "是否排除", "排除理由")
GOLD_META = ("数据版本", "核定人", "核定日期", "原始文件sha256前12位")

# Limits.
MAX_ATTEMPTS = 3
EXCEL_CELL_MAX = 32767
TRUNCATION_MARK = "…【已截断，完整原文见 JSONL】"
MIN_CLASS_SUPPORT, MAX_WRONG_AS_CORRECT, MIN_MACRO_F1 = 5, 0.05, 0.80

REF_STRUCT = T.StructType([T.StructField(r, T.StringType()) for r in REFS])
RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("source_row", T.IntegerType()), T.StructField("order_index", T.IntegerType()), T.StructField("q", T.StringType()), T.StructField("a", T.StringType()), T.StructField("refs", REF_STRUCT)])
CELL = T.StructType([T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("visible", T.BooleanType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("cached", T.StringType())])
EVIDENCE = T.ArrayType(T.StructType([T.StructField("ref_id", T.StringType()), T.StructField("quote", T.StringType())]))
STAGE1 = T.StructType([T.StructField("required_points", T.ArrayType(T.StringType())), T.StructField("evidence_sufficiency", T.StringType()), T.StructField("evidence", EVIDENCE), T.StructField("missing_information", T.ArrayType(T.StringType())), T.StructField("conflicts", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])
CORRECTION = T.StructType([T.StructField("corrected_item", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("evidence", EVIDENCE), T.StructField("affects_classification", T.BooleanType())])
STAGE2 = T.StructType([T.StructField("label", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("issues", T.ArrayType(T.StringType())), T.StructField("evidence_sufficiency", T.StringType()), T.StructField("evidence", EVIDENCE), T.StructField("review_required", T.BooleanType()), T.StructField("review_reasons", T.ArrayType(T.StringType())), T.StructField("stage1_corrections", T.ArrayType(CORRECTION))])
