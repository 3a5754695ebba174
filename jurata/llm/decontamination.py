"""Benchmark passages inside documents: size-partitioned MinHash containment search, verified on exact shingle sets.

Items are partitioned by their number of five-word shingles, (8, 16], (16, 32] and so on. For a partition with upper
bound u the shingles of a document are cut in blocks of u; a window is two neighbouring blocks, so a whole item always
lies in one window, and the containment bound t becomes a similarity of at least t * u/2 / (2u + u/2) there whatever the
document's length. A window and an item that share a minimum under any of PERMS hash functions are candidates (for a
passage in one piece the chance of a miss is about 1e-6 at t = 0.8). Candidates are verified by exact containment in the
whole document.

Shingles that more than COMMON items share (an instruction line) would make every text that holds them a candidate of all
these items. They take no part in the minima of items and windows alike, so a minimum leads to COMMON items at most (to
more only for items that are equal in their other shingles too). An item that loses more than a tenth of its shingles by
this (the chance of a miss stays below 1e-5 up to there), or has at most 8, is looked up exactly instead: a text that
contains at least t of its n shingles holds one of any n - t * n + 1 of them, so those are taken that are rarest in the
documents, which the same pass counts.

The minima and shingles of the items are a table (size class, hash function, value). One pass over the documents keeps
what has its bit set in bitmaps of the items' values; the bitmaps are aggregated by the cluster and hold MARK_BYTES at
most each, however many items there are. What is kept is joined to the table, and the candidate pairs, one for each
different text, are verified with a bounded number of items to a row.

Edge cases: items and texts that are null or have no words match nothing; an item or text under five words is one
shingle; rows repeated under one id and rows without an id are reported row by row; other columns are passed on or not
read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel as K
from ._store import bound_batches, parted, table, unused, written
from .near_dedup import _set

PERMS = 64
SMALL = 8
#: Items that may share a shingle before it takes no part in minima, and the share of its shingles that an item must keep.
COMMON, KEEP = 8, 0.9
#: Bytes of all bitmaps together, and what one piece of them holds.
MARK_BYTES, PIECE_BITS = 16 << 20, 1 << 15
#: Items that are verified in one row with a text.
BLOCK_ITEMS = 64


def _factors() -> np.ndarray:
    return np.random.default_rng(97).integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, value): the different shingles of each item."""
    for batch in batches:
        for part in K.chunks(batch):
            h, first = K.shingles(K.words(part.column("text"), lower=True))
            own = [np.unique(h[a:b]) for a, b in zip(first, first[1:], strict=False)]
            items = np.repeat(part.column("item").to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["item", "value"])


def _item_keys(sent):
    """(level, perm, value, item): minima of each item by size class; of items that are looked up (level 0) all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, perms, common = _factors(), np.arange(PERMS), sent.value
        for batch in batches:
            for part in K.chunks(batch):
                h, first = K.shingles(K.words(part.column("text"), lower=True))
                items = part.column("item").to_numpy()
                found = [np.zeros((4, 0), np.int64)]
                for i, item in enumerate(items):
                    own = np.unique(h[first[i] : first[i + 1]])
                    kept = np.delete(own, common.hit(0, 0, own)) if common.bits else own
                    if len(own) > SMALL and len(kept) >= KEEP * len(own):
                        values = np.array([(kept * f).min() >> np.uint64(32) for f in factors], np.int64)
                        found.append(np.stack((np.full(PERMS, int(np.ceil(np.log2(len(own) / SMALL)))), perms, values, np.full(PERMS, item))))
                    elif len(own):
                        found.append(np.stack((np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), own.view(np.int64), np.full(len(own), item))))
                columns = np.concatenate(found, 1)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array(columns[3])], ["level", "perm", "value", "item"])

    return run


class Marks:
    """Bitmaps of the values of each size class and hash function, by the low bits of a value."""

    def __init__(self, bits: dict[int, int], pieces: list):
        self.bits = bits
        self.maps = {level: np.zeros((PERMS if level else 1, 1 << n >> 3), np.uint8) for level, n in bits.items()}
        size = PIECE_BITS >> 3
        for level, perm, piece, data in pieces:
            self.maps[level][perm, piece * size : (piece + 1) * size] = np.frombuffer(data, np.uint8)

    def hit(self, level: int, perm: int, values: np.ndarray) -> np.ndarray:
        """Indices of the values that may be an item's."""
        at = (values & values.dtype.type((1 << self.bits[level]) - 1)).astype(np.int64)
        return np.flatnonzero(self.maps[level][perm][at >> 3] >> (at & 7).astype(np.uint8) & 1)


def marks(keys: DataFrame) -> Marks:
    """The bitmaps of a table of keys: 64 bits or more to a value while MARK_BYTES allow, a power of two to each class."""
    counts = {r["level"]: r["n"] for r in keys.where("perm = 0").groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row per size class
    share = MARK_BYTES * 8 // max(sum(PERMS if level else 1 for level in counts), 1)
    most = max(share.bit_length() - 1, PIECE_BITS.bit_length() - 1)
    bits = {level: min(max((64 * n - 1).bit_length(), PIECE_BITS.bit_length() - 1), most) for level, n in counts.items()}
    mask = F.element_at(F.create_map(*[F.lit(x) for level, n in bits.items() for x in (level, (1 << n) - 1)]), F.col("level")) if bits else F.lit(0)
    slot = F.col("value").bitwiseAND(mask)
    pieces = keys.select("level", "perm", F.shiftright(slot, 15).alias("piece"), slot.bitwiseAND(PIECE_BITS - 1).alias("bit"))
    return Marks(bits, pieces.groupBy("level", "perm", "piece").agg(F.bitmap_construct_agg("bit")).collect())  # MARK_BYTES at most


def _window_keys(sent):
    """(level, perm, value, text_id) of the windows of each text whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, common), factors = sent.value, _factors()
        for batch in batches:
            for part in K.chunks(batch):
                found = _windows(part.column("text"), own, common, factors)
                ids = part.column("text_id").take(pa.array(found[3]))
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int32()), pa.array(found[2]), ids], ["level", "perm", "value", "text_id"])

    return run


#: The minimum of a window all of whose shingles are common.
_NONE = np.uint64(0xFFFFFFFF)


def _windows(texts: pa.Array, own: Marks, common: Marks, factors: np.ndarray) -> np.ndarray:
    """Rows (level, perm, value, row), as columns."""
    h, first = K.shingles(K.words(texts, lower=True))
    found = [np.zeros((4, 0), np.int64)]

    def add(level: int, perm: int, values: np.ndarray, rows: np.ndarray) -> None:
        at = own.hit(level, perm, values)
        if level and len(gone):
            at = at[values[at] != _NONE]
        if len(at):
            found.append(np.stack((np.full(len(at), level), np.full(len(at), perm), values[at].astype(np.int64), rows[at])))

    gone = common.hit(0, 0, h) if common.bits and len(h) else ()

    def spread(factor: np.uint64) -> np.ndarray:
        out = h * factor
        out[gone] = _NONE << np.uint64(32)
        return out

    if len(h) and own.bits:
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if 0 in own.bits:
            add(0, 0, h.view(np.int64), row)
        inside = np.arange(len(h)) - first[row]
        begin = np.flatnonzero(inside % (2 * SMALL) == 0)
        block_row = row[begin]
        mins = np.stack([np.minimum.reduceat(spread(f) if len(gone) else h * f, begin) >> np.uint64(32) for f in factors]).astype(np.uint32) if max(own.bits) else None
        for level in range(1, max(own.bits) + 1):
            if level > 1:
                fresh = np.ones(len(block_row), bool)
                fresh[1:] = block_row[1:] != block_row[:-1]
                origin = np.maximum.accumulate(np.where(fresh, np.arange(len(block_row)), 0))
                begin = np.flatnonzero((np.arange(len(block_row)) - origin) % 2 == 0)
                mins, block_row = np.minimum.reduceat(mins, begin, axis=1), block_row[begin]
            if level in own.bits:
                pair, joined = mins.copy(), block_row[1:] == block_row[:-1]
                pair[:, :-1] = np.where(joined, np.minimum(mins[:, 1:], mins[:, :-1]), mins[:, :-1])
                for p in range(PERMS):
                    add(level, p, pair[p], block_row)
    return np.unique(np.concatenate(found, 1), axis=1)


def _verified(percent: int):
    """(text_id, item_id, n_item, n_shared) with 100 * n_shared >= percent * n_item."""
    names, types = ["text_id", "item_id", "n_item", "n_shared"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                own = _set(batch.column("text")[i].as_py())
                for item in batch.column("items")[i].as_py():
                    asked = _set(item["text"])
                    shared = len(own & asked)
                    if 100 * shared >= percent * len(asked):
                        rows.append((batch.column("text_id")[i].as_py(), item["item_id"], len(asked), shared))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _text_id() -> F.Column:
    return F.md5(F.col("text").cast("binary"))


def _rarest(keys: DataFrame, hits: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """keys with those of items that are looked up narrowed to the n - t * n + 1 shingles that fewest texts hold."""
    met = written(hits.where("level = 0").groupBy("value").agg(F.count("*").alias("texts")), "texts-of-shingles")
    exact = keys.where("level = 0").join(met, "value", "left").join(shared, "value", "left")
    cost = F.coalesce("texts", F.lit(0)) * F.coalesce("items", F.lit(1))
    place, n = F.row_number().over(W.partitionBy("item").orderBy("cost", "value")), F.count("*").over(W.partitionBy("item"))
    exact = exact.withColumn("cost", cost).select(*keys.columns, place.alias("place"), n.alias("n"))
    return keys.where("level > 0").unionByName(exact.where(f"place <= n - (n * {percent} + 99) div 100 + 1").select(*keys.columns))


def candidates(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(text_id, item): different texts and numbered items that may match; a text is known by the digest of its content."""
    spark = docs.sparkSession
    sets = written(items.select("item", "text").mapInArrow(_item_shingles, "item long, value long"), "item-shingles")
    shared = written(sets.groupBy("value").agg(F.count("*").alias("items")).where(F.col("items") > COMMON), "shared-shingles")
    common = marks(shared.select(F.lit(0).alias("level"), F.lit(0).alias("perm"), "value"))
    keys = written(items.select("item", "text").mapInArrow(_item_keys(spark.sparkContext.broadcast(common)), "level int, perm int, value long, item long"), "item-keys")
    sent = spark.sparkContext.broadcast((marks(keys), common))
    texts = docs.where("text is not null").select(_text_id().alias("text_id"), "text")
    hits = written(texts.mapInArrow(_window_keys(sent), "level int, perm int, value long, text_id string"), "windows")
    return written(hits.join(_rarest(keys, hits, shared, percent), ["level", "perm", "value"]).select("text_id", "item").distinct(), "candidates")


def numbered_items(items: DataFrame) -> DataFrame:
    """(item_id, text, item): the different items, numbered and written."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return written(items.withColumn("item", F.monotonically_increasing_id()), "items")


def matches(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(text_id, item_id, n_item, n_shared) of every different text and item with containment of at least percent / 100."""
    bound_batches(docs.sparkSession)
    items = numbered_items(items)
    pairs = candidates(docs, items, percent)
    texts = docs.where("text is not null").select(_text_id().alias("text_id"), "text")
    asked = parted(pairs, ["text_id"], BLOCK_ITEMS).join(items, "item").groupBy("text_id", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    few = written(pairs.select("text_id").distinct(), "asked")  # a table of known size: the planner shuffles the corpus only if it is large
    one = written(texts.join(few, "text_id", "left_semi").dropDuplicates(["text_id"]), "texts")
    return written(one.join(asked, "text_id").select("text_id", "text", "items").mapInArrow(_verified(percent), "text_id string, item_id long, n_item long, n_shared long"), "matches")


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document and item with containment of at least percent / 100."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _text_id().alias("text_id"))
    return rows.join(matches(docs, items, percent), "text_id").select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that contain an item."""
    name = unused(docs, "text_id")
    found = matches(docs, items, percent).select(F.col("text_id").alias(name)).distinct()
    return docs.withColumn(name, _text_id()).join(found, name, "left_anti").select(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE = {
    "op9_decontamination": r"""
WITH t AS (SELECT 0 AS k, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t
), s AS (
  SELECT k, id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM w WHERE len(ws) >= 5
  UNION SELECT k, id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), n AS (SELECT id, count(*) AS n FROM s WHERE k = 1 GROUP BY id
), p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM s d JOIN s i ON d.g = i.g AND d.k = 0 AND i.k = 1 GROUP BY ALL)
SELECT doc_id, item_id, n.n AS n_item, shared AS n_shared, shared::DOUBLE / n.n AS containment FROM p JOIN n ON n.id = item_id WHERE 100 * shared >= 80 * n.n"""
}
