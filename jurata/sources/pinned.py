"""One version of append-only tables: the files that were there at a capture, and nothing that came later.

A table is a folder of files that are never changed, only added to. A capture lists the files of each table once and keeps
the lists with the schemas as a small JSON file; later reads take these files and no others, so whatever is appended (or
read again by a lost task) gives the same rows. Writers add rows first and raise the revision in the log last; a capture
lists the log first, takes its highest revision, and reads of tables with a revision leave out rows above it. So rows whose
revision wasn't raised yet aren't in, though their files may be.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files


class Version:
    """The files of tables at one capture."""

    def __init__(self, spark: SparkSession, revision: int, tables: Mapping[str, dict]):
        self.spark, self.revision, self.tables = spark, revision, dict(tables)

    @staticmethod
    def capture(spark: SparkSession, log: str, tables: Mapping[str, str]) -> Version:
        """The version of tables (name -> folder) at the highest `revision` of the log."""
        pins = {"log": _pinned(spark, log)}
        revision = _read(spark, pins["log"]).agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]
        return Version(spark, revision, pins | {name: _pinned(spark, path) for name, path in tables.items()})

    def read(self, name: str) -> DataFrame:
        """The rows of a table in this version."""
        rows = _read(self.spark, self.tables[name])
        return rows.where(F.col("revision") <= self.revision) if "revision" in rows.columns else rows

    def store(self, path: str) -> None:
        files.put(self.spark, path, json.dumps({"revision": self.revision, "tables": self.tables}, ensure_ascii=False).encode())

    @staticmethod
    def load(spark: SparkSession, path: str) -> Version:
        found = json.loads(files.get(spark, path))
        return Version(spark, found["revision"], found["tables"])


def _pinned(spark: SparkSession, path: str) -> dict:
    table = spark.read.parquet(path)
    return {"base": path, "schema": table.schema.json(), "files": sorted(table.inputFiles())}


def _read(spark: SparkSession, pin: dict) -> DataFrame:
    schema = StructType.fromJson(json.loads(pin["schema"]))
    if not pin["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", pin["base"]).parquet(*pin["files"])
