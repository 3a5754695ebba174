"""Chat formatting: collapses cumulative snapshots of logged conversations, then renders the maximal ones.

A turn's prefix hash is the hash of the previous turn's prefix hash, its role and its text, so two conversations agree up
to a turn exactly if their hashes there are equal. A conversation whose last hash is a proper prefix hash of any other
is a snapshot of a longer one and is taken out by an anti-join against the distinct prefix hashes; of equal
conversations the one with the smallest id stays. Only DataFrame functions are used.

Turns go by (turn, role, text); rows that repeat a turn wholly count once. Null roles and texts are values of their own
(unlike empty ones) and render as nothing; a null turn sorts first; rows without conv_id are left out; an empty table
gives no rows; extra columns aren't read. A conversation is one output row, so its turns meet in one row; nothing else
is gathered (copies of a conversation or of a first turn meet only in partial aggregates and in a join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import table


def _chained(turns: F.Column) -> F.Column:
    """The prefix hash after each turn of a sorted array of (turn, role, text)."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    start = F.array().cast("array<string>")
    return F.aggregate(turns, start, lambda seen, t: F.concat(seen, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("")), F.lit("|"), value(t["role"]), value(t["text"])), 256))))


def rendered(turns: F.Column) -> F.Column:
    """One string for a sorted array of turns, each between start and end marks."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>"))), "\n")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, last_hash, n_copies) of the conversations that are no prefix of another one."""
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns")).withColumn("hashes", _chained(F.col("turns"))).withColumn("last_hash", F.element_at("hashes", -1))
    shorter = convs.select(F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("last_hash")).distinct()
    first = convs.groupBy("last_hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    keep = first.join(shorter, "last_hash", "left_anti")
    return convs.select("conv_id", "turns").join(keep, "conv_id")


def chat_documents(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the maximal conversations, rendered."""
    return maximal_conversations(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", rendered(F.col("turns")).alias("text"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_documents(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLE = {
    "op1_chat_format": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS p
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), f AS (SELECT conv_id, n, p FROM m WHERE k = n
), g AS (SELECT p, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM f GROUP BY p, n)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(p, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>'), chr(10)) AS text
FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k < m.n AND m.k = g.n AND m.p = g.p)"""
}
