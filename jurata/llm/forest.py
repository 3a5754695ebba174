"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long hash string (signs of random projections); the strings of a segment of about SEGMENT rows
are kept as one sorted array per tree. A query descends in all trees to its longest matching prefixes, then all trees
ascend together, one bit at a time, until they hold enough candidates between them; the candidates are measured exactly.

All rows are indexed. A hash deals the distinct vectors to segments, and every query is sent to every segment; one shuffle
brings a segment's vectors and, sorted behind them, the queries to a task, which builds the segment's forest once and
answers the queries batch by batch. The best of each segment are merged by rank. Vectors are read once whatever the number
of queries, and nothing passes through the driver.

The trees ascend from the first level at which they hold START vectors (counted with repeats) and measure what each level
adds. They stop once a level that adds vectors leaves the k nearest as they are, or when they hold share * rows of the
segment and at least `least`. Among near neighbours that are clearly nearer than the rest the first rule stops early: on
clustered vectors a query measures a few hundredths of all rows at a recall above 0.9. On vectors without structure, as the
driver's are, the k nearest go on changing and only the second rule ends it; recall of 0.9 needs a share this large there.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than the
query's. Equal vectors of a segment are indexed once and stand for their smallest distinct ids. A neighbour is an id, so
repeated rows count once, before any cut; an id with several vectors counts at the least distance between its vectors and
the query's. Ties go to the smaller id (no candidate at the distance of the last one is cut unseen); a query's own id is
no candidate; with fewer candidates than asked all found are returned; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import bound_batches, table, written

SEGMENT = 1 << 14
TREES, DEPTH = 48, 32
#: What `share` and `least` are by default, and the vectors that the first level looked at holds.
SHARE, LEAST, START = 0.5, 2000, 256


def usable(name: str) -> F.Column:
    v = F.col(name)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


@lru_cache(4)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, TREES]).standard_normal((dim, TREES * DEPTH)).astype(np.float32)


def _strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(trees, rows) hash strings, the first bit on top."""
    bits = (x.astype(np.float32) @ planes > 0).reshape(len(x), TREES, DEPTH)
    return np.ascontiguousarray((bits.astype(np.int64) << np.arange(DEPTH - 1, -1, -1)).sum(2).T)


class Segment:
    """Sorted arrays of hash strings over some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, planes: np.ndarray, k: int):
        self.x, of = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        ids, of = ids[order], of.ravel()[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1]))  # repeated rows count once
        ids, of = ids[new], of[new]
        first = np.searchsorted(of, np.arange(len(self.x) + 1))
        self.ids = [ids[a : min(b, a + k + 1)] for a, b in zip(first, first[1:], strict=False)]  # k besides the query itself
        self.norm = (self.x**2).sum(1)
        self.measured = 0
        strings = _strings(self.x, planes)
        self.order = np.argsort(strings, axis=1)
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def search(self, ids: np.ndarray, q: np.ndarray, planes: np.ndarray, k: int, enough: float) -> Iterator[tuple[int, int, float]]:
        """(query, id, distance) of the k nearest found; `enough` gathered vectors (with repeats) end a search in any case."""
        strings = _strings(q, planes)
        low, high = np.zeros((DEPTH + 1, TREES, len(q)), np.int64), np.zeros((DEPTH + 1, TREES, len(q)), np.int64)
        for bits in range(DEPTH + 1):  # the range of every prefix length in every tree
            rest = (1 << (DEPTH - bits)) - 1
            for t in range(TREES):
                low[bits, t] = np.searchsorted(self.sorted[t], strings[t] & ~rest, "left")
                high[bits, t] = np.searchsorted(self.sorted[t], strings[t] | rest, "right")
        held = (high - low).sum(1)
        level = np.maximum((held >= min(START, enough)).sum(0) - 1, 0)  # deepest level with so many; level 0 holds everything
        for i, (own, v) in enumerate(zip(ids.tolist(), q, strict=True)):
            best, seen, rough = {}, np.zeros(len(self.x), bool), np.empty(len(self.x))
            for at in range(level[i], -1, -1):
                now = seen.copy()
                for t in range(TREES):
                    now[self.order[t, low[at, t, i] : high[at, t, i]]] = True
                fresh = np.flatnonzero(now & ~seen)
                if not len(fresh):
                    continue
                rough[fresh] = self.norm[fresh] - 2 * (self.x[fresh] @ v)
                self.measured += len(fresh)
                found, seen, before = np.flatnonzero(now), now, best
                best = self._best(found, rough[found], own, v, k)
                if len(best) >= k and (held[at, i] >= enough or list(before)[:k] == list(best)[:k]):
                    break
            yield from ((own, j, d) for j, d in islice(best.items(), k))

    def _best(self, found: np.ndarray, rough: np.ndarray, own: int, v: np.ndarray, k: int) -> dict[int, float]:
        """The ids other than `own` of the nearest vectors found, nearest first: k or more, or all."""
        slack = 1e-9 * (self.norm.max() + v @ v)  # far above the error of `rough`, so that no tie is lost to it
        near = k + 1  # one may be the query itself
        while True:
            some = found[rough <= np.partition(rough, near - 1)[near - 1] + slack] if near < len(found) else found
            exact = np.sqrt(((self.x[some] - v) ** 2).sum(1))
            best: dict[int, float] = {}
            for d, j in sorted((float(d), int(j)) for d, c in zip(exact, some, strict=True) for j in self.ids[c] if j != own):
                best.setdefault(j, d)
            if len(best) >= k or len(some) == len(found):
                return best
            near *= 4


def _search(k: int, share: float, least: int):
    """Answers of segments: their vectors (kind 0) come before the queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, segment = None, [], [], None
        for b in batches:
            found: list[tuple[int, int, float]] = []
            own, marks = b.column("id").to_numpy(), np.stack([b.column(c).to_numpy() for c in ("dim", "part", "kind")], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                dim, part, kind = marks[lo].tolist()
                if (dim, part) != key:
                    key, ids, rows, segment = (dim, part), [], [], None
                x = b.column("v").slice(lo, hi - lo).flatten().to_numpy().reshape(-1, dim)
                if not kind:
                    ids.append(own[lo:hi].copy())
                    rows.append(x.copy())
                elif ids:
                    if segment is None:
                        segment = Segment(np.concatenate(ids), np.concatenate(rows), _planes(dim), k)
                    found += segment.search(own[lo:hi], x, _planes(dim), k, max(least, share * len(segment.x)))
            columns = zip(*found, strict=True) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, asked: F.Column, k: int = 10, share: float | None = None, least: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, embedding) where `asked` holds, its k nearest others by Euclidean distance."""
    bound_batches(rows.sparkSession)
    good = rows.where(F.col("vec_id").isNotNull()).where(usable("embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    good = written(good.groupBy("id", "v").agg(F.bool_or("asked").alias("asked")), "vectors").withColumn("dim", F.size("v"))
    sizes = written(good.groupBy("dim").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("parts")), "segments")  # a row per length
    dealt = good.join(sizes, "dim").withColumn("v", F.col("v").cast("array<double>"))
    vectors = dealt.select("dim", F.expr("cast(pmod(xxhash64(id, v), parts) as int)").alias("part"), F.lit(0).alias("kind"), "id", "v")
    queries = dealt.where("asked").select("dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "v")
    met = vectors.union(queries).repartition("dim", "part").sortWithinPartitions("dim", "part", "kind", "id")
    out = met.mapInArrow(_search(k, SHARE if share is None else share, LEAST if least is None else least), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    out = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op4_hash_forest": op4_hash_forest}
ORACLE: dict[str, str] = {}
