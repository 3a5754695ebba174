"""Centroid clustering by sort-means over integer vectors.

Each round sorts, for each centroid, the others by their distance from it. A vector is measured against its previous
centroid first and then against the others in that order, until they are strictly beyond twice the distance to the previous
one: by the triangle inequality none of the rest is nearer, and as strictly farther ones alone are left out no tie is lost.

Vectors are packed into blocks of up to BLOCK; a block is a row with the ids, the packed components and the previous
assignment. A round is one pass over the blocks: it writes them with the new assignment, the sums and counts of each cluster
beside them, and reads back the sums alone. So a lost executor costs its tasks of the round, two copies of the vectors are
on disk at most, and k times dim sums come to the driver. All arithmetic is exact: vectors are integers, sums are decimals.

Edge cases: vectors that are null, of another length, or with null or non-finite components take no part, nor do those with
a component of 2**27 or more in size (a distance might not fit a long); repeated rows are vectors of their own; a null id is
kept and never a first centroid while there are others; fewer vectors than clusters are as many clusters; ties go to the
smaller number; empty clusters keep their centroid; no vectors give no rows; a sum of distances beyond a long is null; other
columns aren't read. Sets the session's bound of Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bound_batches, deleted, scratch, table, written

#: Vectors of a block, and what a component stays under in size.
BLOCK, LARGEST = 4096, 1 << 27
#: Distances are summed in two parts of so many bits.
_LOW = 31

PACKED = "ids array<long>, vectors binary, clusters binary"


def integers(rows: DataFrame, dim: int, scale: int = 1024) -> DataFrame:
    """(vec_id, v): the vectors of `dim` good components of (vec_id, embedding), as floor(scale * x)."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (x > -LARGEST) & (x < LARGEST)
    good = F.coalesce((F.size("embedding") == dim) & F.forall(scaled, fits), F.lit(False))
    return rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest digests of `salt:vec_id`."""
    order = [F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("v")]
    return np.array([r["v"] for r in vectors.orderBy(*order).select("v").limit(k).collect()], np.int64)  # k rows


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                v = part.column("v").flatten().to_numpy().astype("<i4")
                ids = pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes()], pa.binary()), pa.array([bytes(2 * n)], pa.binary())], ["ids", "vectors", "clusters"])

    return run


def assigned(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(clusters, squared distances, how many were measured) of vectors whose clusters were `before`."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    order = np.argsort(between, axis=1, kind="stable")
    label, best = before.copy(), ((x - centroids[before]) ** 2).sum(1)
    known, measured = best.copy(), len(x)
    for own in np.unique(before):
        left = np.flatnonzero(before == own)
        for c in order[own]:
            if c == own:
                continue
            left = left[known[left] > (between[own, c] - 1) // 4]  # not strictly beyond twice the distance: between <= 4 * known
            if not len(left):
                break
            d = ((x[left] - centroids[c]) ** 2).sum(1)
            measured += len(left)
            nearer = (d < best[left]) | ((d == best[left]) & (c < label[left]))
            best[left[nearer]], label[left[nearer]] = d[nearer], c
    return label, best, measured


def _facts(x: np.ndarray, label: np.ndarray, best: np.ndarray, k: int, measured: int) -> list[int]:
    """Counts, sums of distances (high and low bits) and sums of components of each cluster, and the distances measured."""
    add = lambda values: [values[label == c].sum(0) for c in range(k)]
    parts = [np.bincount(label, minlength=k), add(best >> _LOW), add(best & ((1 << _LOW) - 1)), *add(x), [measured]]
    return np.concatenate([np.asarray(p, np.int64).ravel() for p in parts]).tolist()


def _round(centroids: np.ndarray, distances: bool):
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packed = batch.column("vectors")[i]
                x = np.frombuffer(packed.as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
                label, best, measured = assigned(x, np.frombuffer(batch.column("clusters")[i].as_buffer(), "<u2").astype(np.int64), centroids)
                one = [batch.column("ids").slice(i, 1), batch.column("vectors").slice(i, 1), pa.array([label.astype("<u2").tobytes()], pa.binary()), pa.array([_facts(x, label, best, k, measured)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*one, pa.array([best.astype("<i8").tobytes() if distances else b""], pa.binary())], ["ids", "vectors", "clusters", "facts", "distances"])

    return run


def _sums(blocks: DataFrame) -> list[int]:
    """The facts of all blocks together, exactly."""
    found = blocks.select(F.posexplode("facts").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    return [int(n) for _, n in sorted(map(tuple, found.collect()))]  # a row for each cluster and component


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            label, best = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("clusters", "<u2"), ("distances", "<i8")))
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(label.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])


class Clustering:
    """The result of sort_means(): `rows` (vec_id, cluster, distance), and for each cluster its centroid and sum of distances."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, sums: list[int], measured: list[int]):
        self.rows, self.centroids, self.sums, self.measured = rows, centroids, sums, measured


def sort_means(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> Clustering:
    """Clusters (vec_id, v) from the given centroids: `rounds` times vectors are assigned and centroids replaced by the floor of their means, then vectors are assigned once more."""
    spark = vectors.sparkSession
    bound_batches(spark)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, [], [])
    k, dim = centroids.shape
    with scratch(spark) as paths:
        blocks = written(vectors.select("vec_id", "v").mapInArrow(_pack(dim), PACKED), "vectors")
        measured = []
        for left in range(rounds, -1, -1):
            blocks = written(blocks.select("ids", "vectors", "clusters").mapInArrow(_round(centroids, left == 0), f"{PACKED}, facts array<long>, distances binary"), "clusters")
            deleted(spark, paths[:-1])
            del paths[:-1]
            facts = _sums(blocks)
            counts, high, low, sums = facts[:k], facts[k : 2 * k], facts[2 * k : 3 * k], facts[3 * k : -1]
            measured.append(facts[-1])
            if left:
                means = [[s // n for s in sums[c * dim : (c + 1) * dim]] if n else centroids[c].tolist() for c, n in enumerate(counts)]
                centroids = np.array(means, np.int64)
        paths.clear()  # the rows below read the last table
    rows = blocks.select("ids", "clusters", "distances").mapInArrow(_unpack, "vec_id long, cluster int, distance long")
    return Clustering(rows, centroids, [(h << _LOW) + n for h, n in zip(high, low, strict=True)], measured)


def _of_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(integers(table(spark, sf_dir, "embeddings"), 64), "integers")
    found = sort_means(vectors, first_centroids(vectors, 8, "3"), 10)
    if not len(found.centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    fits = lambda n: n if n < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    return found.rows.select("vec_id", "cluster", "distance", _of_cluster([*map(fits, found.sums)], "long").alias("cluster_inertia"), F.lit(fits(sum(found.sums))).cast("long").alias("inertia"), _of_cluster(digests, "string").alias("centroid_sha256"))


QUERIES = {"op12_sort_means": op12_sort_means}

_NEAREST = "a{0} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, c := c)) AS m FROM kept k, c{0} c GROUP BY r)"
_MEANS = "c{1} AS MATERIALIZED (SELECT c, coalesce(m.v, old.v) AS v FROM c{0} old LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY i) AS v FROM (SELECT m.c AS c, i, sum(v[i])::bigint AS s, count(*) AS n FROM a{0} JOIN kept USING (r), range(1, 65) t(i) GROUP BY ALL) GROUP BY c) m USING (c))"
_ROUNDS = ",\n".join([_NEAREST.format(0), *[f"{_MEANS.format(i, i + 1)},\n{_NEAREST.format(i + 1)}" for i in range(10)]])
ORACLE = {
    "op12_sort_means": f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), v) - 1 AS c, v FROM kept QUALIFY c < 8),
{_ROUNDS}
SELECT vec_id, m.c::integer AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::bigint AS cluster_inertia, (sum(m.d) OVER ())::bigint AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a10 a JOIN kept USING (r) JOIN c10 c ON c.c = a.m.c"""
}
