"""A corpus pipeline of five operators; each stage's result is a written table that the next one reads.

quality          documents that the classifier rejects go
near_dedup       one document (the smallest doc_id) of each group of near copies stays, repeated rows of it once
substring_dedup  words of passages that started in an earlier document go; the texts' n_chars follow
decontamination  documents that contain a benchmark item go
sentencepieces   the texts that are left become ids

Stages keep the columns of documents, whatever further ones there are, and the last one returns ids. A row without doc_id
is never dropped as a copy of a document with one; rows that agree in doc_id (null included) and text are one row after
near_dedup, rows of one doc_id with different texts stay. Once a stage's result is written its intermediate tables and the
result of the stage before are deleted; what stays behind run() is the input of the last stage and that stage's own tables,
as the DataFrame returned reads them.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurata.llm import decontamination, near_dedup, quality, sentencepieces, substring_dedup
from jurata.llm._store import settled, table, unused, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = written(near_dedup.near_duplicates(docs).select("doc_id", "kept"), "judged")
    gone = judged.where("not kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = written(judged.where("kept or doc_id is null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    name = unused(docs, "again")
    same = docs["doc_id"].eqNullSafe(F.col(name))
    again = again.withColumnRenamed("doc_id", name)
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.encoded(docs, sentencepieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("sentencepieces", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spent: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), f"stage-{name}", spent)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Model fitting, clustering and merging don't fit in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
