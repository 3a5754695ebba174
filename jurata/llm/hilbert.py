"""Sharding in the order of a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**BITS cells of about equal weight: numbers by approximate percentiles (one mergeable
aggregate), strings by the running count of their distinct values in sorted order. The cells give a point on a Hilbert
curve; rows
are range-sorted by (curve index, digest of the text, doc_id) and the order is cut into runs of equal row counts, so a
shard covers a compact region of all dimensions and readers can prune files by any of them. Copies of a text go where
the first of them on the curve goes, so they lie next to each other; a group larger than a shard runs on into the next.

No row passes through the driver and no shard or group meets in one task: places come from a range sort, in-partition
positions and one count per partition.

Edge cases: a null text has no bytes and the checksum of an empty one; null dimensions sort first; ties and repeated
rows each get a place of their own; an empty table gives no rows; with fewer rows than shards some shards are empty;
other columns are not read. write_shards() writes every row, also those without doc_id or of one doc_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import table, unused, written

BITS = 5


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (one column per dimension, each below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the top bit down
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


TEXTS = ("string", "binary")


def _value(df: DataFrame, name: str) -> F.Column:
    """A dimension's value: a text (binary as hex) or a number."""
    kind = dict(df.dtypes)[name]
    if kind in TEXTS:
        return F.col(name) if kind == "string" else F.hex(name)
    return (F.col(name).cast("timestamp") if kind == "date" else F.col(name)).cast("double")


def _running(rows: DataFrame, weight: F.Column) -> tuple[DataFrame, int]:
    """Rows of a sorted, written table (at: monotonically increasing id) with `before`, the weight of all rows in partitions before their own, and the whole weight."""
    rows = rows.withColumn("part", F.shiftright("at", 33))
    sums = sorted(rows.groupBy("part").agg(F.sum(weight)).collect())  # one row per sorted partition
    before = np.concatenate(([0], np.cumsum([c for _, c in sums]))).astype(int).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sums, before, strict=False)], "part long, before long")
    return rows.join(F.broadcast(offsets), "part"), before[-1]


def _text_cuts(rows: DataFrame, name: str) -> list[str]:
    """At most 2**BITS - 1 texts that cut the rows in cells of about equal weight."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    values = written(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()), "values")
    placed, total = _running(values, F.col("n"))
    place = F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("at")) - F.col("n")
    cells = placed.select("value", F.expr(f"cast({1 << BITS} as long)").alias("cells"), place.alias("place")).withColumn("cell", F.expr(f"place * cells div {max(total, 1)}L"))
    return sorted(r["value"] for r in cells.groupBy("cell").agg(F.min("value").alias("value")).where("cell > 0").collect())


def _cell(value: F.Column, cuts: list) -> F.Column:
    """Number of cuts at or below the value; null is in the first cell."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)), F.lit(0)) if cuts else F.lit(0)


def _curve(cells: pd.DataFrame) -> pd.Series:
    return pd.Series(curve_index(cells.to_numpy()))


def sharded(docs: DataFrame, dimensions: list[str], shards: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) and the columns to keep: shard counts are at most one apart, slots run from 0.

    dimensions may name columns of docs, or `size` (bytes of the text and 16).
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.withColumn("size", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long"))
    names = [f"d{i}" for i in range(len(dimensions))]
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"), *[_value(docs, d).alias(n) for d, n in zip(dimensions, names, strict=True)], *kept)
    rows = written(rows, "metadata")
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    numbers = [n for n in names if dict(rows.dtypes)[n] not in TEXTS]
    found = rows.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in numbers]).first().asDict() if numbers else {}
    cuts = {n: sorted(set(found[n] or [])) if n in numbers else _text_cuts(rows, n) for n in names}  # at most 2**BITS - 1 a dimension
    rows = written(rows.withColumn("own", F.pandas_udf(_curve, "long")(F.struct(*[_cell(F.col(n), cuts[n]).alias(n) for n in names]))), "curve")
    copies = rows.groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(written(copies, "copies"), "digest", "left").withColumn("curve", F.coalesce("first", "own"))
    order = ["curve", "digest", "doc_id"]
    rows = rows.select("doc_id", "size", "text_crc32", *order[:2], *[f"k{i}" for i in range(len(keep))]).repartitionByRange(*order).sortWithinPartitions(*order)
    rows, total = _running(written(rows.withColumn("at", F.monotonically_increasing_id()), "sorted"), F.lit(1))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    out = rows.withColumn("place", place).withColumn("shard", F.expr(f"cast(place * {shards} div {max(total, 1)} as int)"))
    slot = F.expr(f"place - (shard * {max(total, 1)}L + {shards - 1}) div {shards}").cast("long").alias("slot")
    return out.select("doc_id", "size", "text_crc32", "curve", "shard", slot, *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number `row` for each row, written, so that places can be joined to rows whose doc_id is null or repeated."""
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def write_shards(docs: DataFrame, places: DataFrame, path: str) -> None:
    """Writes docs as one folder per shard (shard=N), each sorted by slot.

    Rows are joined by `row` where both have it (numbered(docs), and sharded(..., keep=("row",)) of it), else by doc_id; a
    repeated doc_id (null included) is an error then, as its rows can't be told apart.
    """
    by_row = "row" in docs.columns and "row" in places.columns
    key = "row" if by_row else "doc_id"
    if not by_row and not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("doc_id is repeated: number the rows with numbered() and keep `row`")
    own, slot, shard = (unused(docs, n) for n in ("key", "slot", "shard"))
    places = places.select(F.col(key).alias(own), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = docs.join(places, docs[key].eqNullSafe(F.col(own))).drop(own, *(["row"] if by_row else []))
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"), ["lang", "source", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


QUERIES = {"op3_hilbert_shards": op3_hilbert_shards}
ORACLE: dict[str, str] = {}
