"""Publishes the export of a run: one workbook of four sheets and JSON lines, both or neither.

The snapshot is written once below the export's folder and every sheet and line is made of what was written, so all of them
are of one version, whatever is appended meanwhile; it goes when the export is there. The workbook is bounded by contract
(a run's records fit a sheet, MOST_ROWS and MOST_BYTES) and goes through the driver, row by row into the archive; JSON
lines are written by the cluster. All of them are written by Spark's own file systems, below any path that its writers
take. The manifest that makes an export visible is written last, after both files are there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excel_cell, redacted, scrubbed
from ..operators import export as E
from ..operators.records import batch_counters
from ..sources import files
from ..sources.pinned import Version
from ..sources.xlsx import workbook_bytes

#: Records of a run that a workbook takes, and the bytes of their texts.
MOST_ROWS, MOST_BYTES = 100_000, 256 << 20


def _encoded(rows: DataFrame) -> DataFrame:
    return rows.select(*[excel_cell(F.col(f"`{n}`"))["text"].alias(n) if t == "string" else F.col(f"`{n}`") for n, t in rows.dtypes])


def document(snap: DataFrame, run: Mapping[str, str]) -> dict[str, DataFrame]:
    """The four sheets of a snapshot with its rewritten cells counted in the summary."""
    sheets = dict(zip(E.SHEETS, (E.classification_rows(snap), E.review_rows(snap), E.failure_rows(snap)), strict=False))
    changed = None
    for name, rows in sheets.items():
        own = E.rewrites(E.sheet_rows(rows), name)
        changed = own if changed is None else changed.union(own)
    counts = changed.agg(F.count_if("truncated").alias("truncated"), F.count_if("guarded").alias("guarded"), F.count_if(F.col("sanitized") > 0).alias("sanitized"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("truncated"), F.col("location")))), "\n").alias("cut"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("truncated") & (F.col("sanitized") > 0), F.col("location")))), "\n").alias("cleaned")).first()
    facts = batch_counters(snap).withColumns({"valid": F.col("total") - F.col("input_invalid"), "status": F.lit(run.get("status", "completed")), "truncated": F.lit(counts.truncated), "guarded": F.lit(counts.guarded), "sanitized": F.lit(counts.sanitized)})
    extra = {k: v for k, v in run.items() if k in E.SUMMARY} | {"被截断单元格位置": counts.cut or "", "清理控制字符位置": counts.cleaned or ""}
    ordered = {n: r.orderBy("order_index").drop("order_index") for n, r in sheets.items()}
    return ordered | {E.SHEETS[3]: E.summary_rows(facts, extra).orderBy("ord").drop("ord", "run_id")}


def publish(snap: DataFrame, folder: str, export_id: str, run: Mapping[str, str], version: Version | None = None) -> dict:
    """Writes detail.jsonl (a folder of parts), result.xlsx and manifest.json below folder; returns the manifest.

    snap is a snapshot of one run. The version it was read from, if given, is kept as version.json; the manifest names its
    revision.
    """
    spark = snap.sparkSession
    if files.exists(spark, f"{folder}/manifest.json"):
        raise FileExistsError(f"{folder} is published already")
    kept = f"{folder}/_snapshot"
    snap.write.mode("overwrite").parquet(kept)
    snap = spark.read.schema(snap.schema).parquet(kept)
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    runs = F.count_distinct("run_id") if "run_id" in snap.columns else F.lit(1)
    n, total, n_runs = snap.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), runs).first()
    if n > MOST_ROWS or total > MOST_BYTES:
        raise ValueError(f"a workbook takes {MOST_ROWS} records of {MOST_BYTES} bytes together, not {n} of {total}")
    if n_runs > 1:
        raise ValueError("an export is of one run")
    lines = E.json_lines(snap, export_id).orderBy("order_index").select("value")
    lines.write.mode("overwrite").text(f"{folder}/detail.jsonl")
    tables = {name: (df.columns, map(tuple, _encoded(df).toLocalIterator())) for name, df in document(snap, run).items()}
    book = workbook_bytes(tables)
    files.put(spark, f"{folder}/result.xlsx", book)
    manifest = {"export_id": export_id, "artifacts": [{"kind": "excel", "path": "result.xlsx", "sha256": hashlib.sha256(book).hexdigest()}, {"kind": "jsonl", "path": "detail.jsonl", "sha256": lines_digest(spark, f"{folder}/detail.jsonl")}]}
    if version is not None:
        version.store(f"{folder}/version.json")
        manifest["captured_revision"] = version.revision
    files.put(spark, f"{folder}/manifest.json", json.dumps(manifest, ensure_ascii=False).encode())
    files.remove(spark, kept)
    return manifest


def lines_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted names and digests of the parts of a folder of lines; each part is hashed where it is read."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return hashlib.sha256("".join(f"{r.name} {r.digest}\n" for r in parts.orderBy("name").collect()).encode()).hexdigest()


def write_diagnoses(documents: DataFrame, folder: str, job_id: str) -> str | None:
    """Writes the documents (record_id, value) of judge.diagnostics() of a job, a line each, to a folder of its own.

    They are an aid: a write that fails returns its message without paths and secrets, and changes neither the judging nor
    what an earlier call of the same job wrote, as a new folder takes the older one's place only when it's complete.
    """
    spark = documents.sparkSession
    part, at = f"{folder}/_{job_id}", f"{folder}/{job_id}"
    try:
        documents.select("value").write.mode("overwrite").text(part)
        files.remove(spark, at)
        files.move(spark, part, at)
    except Exception as e:  # noqa: BLE001 - whatever fails here is told, not raised
        return scrubbed(redacted(str(e)), folder) or type(e).__name__
    return None
