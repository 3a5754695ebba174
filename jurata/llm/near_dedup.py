"""Near-duplicate documents: banded MinHash candidates, pruned by sequential Bayesian verification, confirmed on whole sets.

1. Documents with one word sequence become one class (grouped by a digest, partially aggregated first), so a group of
   copies costs one row from here on.
2. Each class has a MinHash signature; its bands give buckets. Every bucket member is paired with the bucket's smallest
   member only (linear in the bucket).
3. A pair's signatures are compared batch by batch. With a uniform prior the posterior of the similarity after m of n
   matches is Beta(m + 1, n - m + 1); a pair goes as soon as P(similarity >= threshold) falls below `miss`. Pairs left
   are confirmed on the full shingle sets of the texts.
4. Confirmed links are joined into components. Buckets whose other members are still in more than one component are
   dealt in blocks of ids and signatures (no texts); inside a block (or two blocks of one bucket) members of different
   components are compared with the same bound, each pair in the first band it shares, and the members of likely pairs
   are named.
5. Those members, and no others, are dealt again with their texts, in blocks bounded by bytes too; inside a block the
   likely pairs are confirmed on their full sets, the likeliest first, and only links that join components leave the task.
   After that every candidate pair is either linked through its component or was judged.

Edge cases: a null or wordless text has no shingles and is linked with nothing; a null doc_id takes part only as a copy;
rows repeated under one doc_id count as one document, which is linked with whatever one of its texts is linked with, and
all of them are reported; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from ._store import bound_batches, table, written
from .components import components

ROWS, BANDS = 5, 24
PERMS = ROWS * BANDS
STEP = 24
#: Members of a bucket that meet in one block, and bytes of their texts where they are needed.
BLOCK, BLOCK_BYTES = 512, 4 << 20


def _permutations() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = _permutations()
    for batch in batches:
        for part in K.chunks(batch):
            w = K.words(part.column("text"), lower=True)
            h, first = K.shingles(w)
            full = np.flatnonzero(np.diff(first))
            sig = np.zeros((part.num_rows, PERMS), np.uint16)
            n = np.zeros(part.num_rows, np.int64)
            if len(full):
                for i, f in enumerate(factors):
                    sig[full, i] = np.minimum.reduceat(h * f, first[full]) >> np.uint64(40)
                for d in full:
                    own = np.sort(h[first[d] : first[d + 1]])
                    n[d] = 1 + np.count_nonzero(own[1:] != own[:-1])
            tight, begin, end = K.tight(w)
            lo, hi = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            lo[full], hi[full] = begin[w.first[full]], end[w.first[full + 1] - 1]
            digests = [hashlib.sha256(tight[a:b]).digest()[:16] for a, b in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), pa.array(n), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "text_id", "n_shingles", "words_id", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, n_shingles, words_id, sig) of every document; words_id is one value for one word sequence."""
    bound_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(_sign, "doc_id long, text_id long, n_shingles long, words_id binary, sig binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After n compared hashes (n = STEP, 2 STEP, ...): the fewest matches whose posterior still reaches `miss`."""
    out = []
    for n in range(STEP, PERMS + 1, STEP):
        total, m = 0.0, -1  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows a, b of sig survive the sequential comparison, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        step = np.ascontiguousarray(sig[:, i * STEP : (i + 1) * STEP])
        matches = matches + np.count_nonzero(step[a[alive]] == step[b[alive]], axis=1)
        alive, matches = alive[matches >= m], matches[matches >= m]
    return alive, matches


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PERMS)


def _prune(least: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                n = x.num_rows
                left = pa.array(_likely(np.concatenate((_matrix(x.column("sig_a")), _matrix(x.column("sig_b")))), np.arange(n), np.arange(n, 2 * n), least)[0])
                yield pa.RecordBatch.from_arrays([x.column("a").take(left), x.column("b").take(left)], ["a", "b"])

    return run


def _block(x: pa.RecordBatch, row: int, least: tuple[int, ...]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(members, components, a, b, matches): the likely pairs a, b of one block (or of two) between components, the likeliest first."""
    band, i, j, members = (x.column(c)[row].as_py() for c in ("band", "i", "j", "members"))
    sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint16).reshape(-1, PERMS)
    own, comp, block = (np.array([m[k] for m in members]) for k in ("rep", "component", "block"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    apart = np.flatnonzero((comp[a] != comp[b]) & ((i != j) | (own[a] < own[b])))
    a, b = a[apart], b[apart]
    ok, matches = _likely(sig, a, b, least)
    a, b = a[ok], b[ok]
    # A pair is judged in the first band that it shares.
    mine = np.flatnonzero((sig[a].reshape(-1, BANDS, ROWS) == sig[b].reshape(-1, BANDS, ROWS)).all(2).argmax(1) == band)
    mine = mine[np.argsort(-matches[mine], kind="stable")]
    return members, comp, a[mine], b[mine], own


def _block_members(least: tuple[int, ...]):
    """(bucket, rep) of the members of each block that have a likely pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
            for row in range(x.num_rows):
                _, _, a, b, own = _block(x, row, least)
                reps = own[np.unique(np.concatenate((a, b)))]
                found.append(np.stack((np.full(len(reps), x.column("bucket")[row].as_py()), reps)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, 1)], ["bucket", "rep"])

    return run


def _block_links(least: tuple[int, ...], percent: int):
    """Links of each block between its components, as few as join them, confirmed on the members' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
            for row in range(x.num_rows):
                members, comp, a, b, own = _block(x, row, least)
                sets: dict[int, set] = {}

                def linked(k: int, m: int, members=members, sets=sets) -> bool:
                    for e in (k, m):
                        if e not in sets:
                            sets[e] = _set(members[e]["text"])
                    both = len(sets[k] & sets[m])
                    return 100 * both >= percent * (len(sets[k]) + len(sets[m]) - both)

                at = _joining(comp, a, b, linked)
                one, two = own[a[at]], own[b[at]]
                found.append(np.stack((np.minimum(one, two), np.maximum(one, two))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, 1)], ["a", "b"])

    return run


def _joining(comp: np.ndarray, a: np.ndarray, b: np.ndarray, linked: Callable[[int, int], bool]) -> np.ndarray:
    """The linked pairs, in order, that join components not yet joined by the ones before them."""
    top = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while top[c] != c:
            c = top[c] = top[top[c]]
        return c

    out = []
    for p, (k, m, x, y) in enumerate(zip(a.tolist(), b.tolist(), comp[a].tolist(), comp[b].tolist(), strict=True)):
        one, two = root(x), root(y)
        if one != two and linked(k, m):
            top[one] = two
            out.append(p)
    return np.array(out, np.int64)


def _set(text: str) -> set:
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for x in batches:
            keep = []
            for r, (a, ta, tb) in enumerate(zip(x.column("a").to_pylist(), x.column("text_a").to_pylist(), x.column("text_b").to_pylist(), strict=True)):
                if last[0] != a:
                    last = (a, _set(ta))
                one, two = last[1], _set(tb)
                both = len(one & two)
                if 100 * both >= percent * (len(one) + len(two) - both):
                    keep.append(r)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("a").take(at), x.column("b").take(at)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: linked when 100 * |A & B| >= percent * |A | B|.

    component_id is the smallest doc_id reachable over links; kept marks that document.
    """
    least = least_matches(percent / 100, miss)
    signed = written(signatures(docs), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    first = full.groupBy("words_id").agg(F.min(F.struct("doc_id", "text_id", "sig")).alias("r"))
    reps = written(first.select("words_id", F.col("r.doc_id").alias("rep"), "r.text_id", "r.sig"), "reps")
    bands = reps.select("rep", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * 2 * ROWS + 1, 2 * ROWS)) for i in range(BANDS)])).alias("band", "bucket"))
    pivots = bands.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").drop("last")
    pivots = written(pivots, "pivots")  # an exchange on both sides of the join lets adaptive execution split a hot bucket
    hits = written(bands.join(pivots, "bucket").where("rep <> pivot"), "hits")

    taking = hits.select("rep").union(hits.select("pivot")).distinct().join(reps.select("rep", "text_id"), "rep").select(F.col("rep").alias("doc_id"), "text_id")
    texts = _texts(docs).join(taking, ["doc_id", "text_id"], "left_semi").dropDuplicates(["doc_id", "text_id"])
    texts = written(texts.select(F.col("doc_id").alias("id"), "text"), "texts")
    sig_a, sig_b = (reps.select(F.col("rep").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        return written(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long"), "links")

    def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members (bucket, band, rep, ...) of the buckets in which they are in several components, with their components."""
        placed = written(members.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
        open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        return placed.join(written(open_, "open"), "bucket")

    def blocks(members: DataFrame, size: F.Column, *fields: str) -> DataFrame:
        """Every two blocks of a bucket (and each by itself) in one row; size says how many blocks a bucket has."""
        n = written(members.groupBy("bucket").agg(size.cast("long").alias("blocks")), "blocks")
        dealt = members.join(n, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return dealt.groupBy("bucket", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("rep", "component", "block", "sig", *fields)).alias("members"))

    def signed_blocks(labels: DataFrame) -> DataFrame:
        members = open_members(hits, labels).join(reps.select("rep", "sig"), "rep")
        return blocks(members, F.ceil(F.count("*") / BLOCK))

    tested = hits.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    likely = tested.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(least), "a long, b long")
    own = full.groupBy("doc_id").agg(F.min(F.xxhash64("words_id")).alias("lo"), F.max(F.xxhash64("words_id")).alias("hi")).where("lo < hi").select("doc_id")
    same = full.select("doc_id", "words_id").join(written(own, "several"), "doc_id", "left_semi").distinct().join(reps.select("words_id", "rep"), "words_id")
    same = same.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"))
    links = confirmed(written(likely, "likely")).union(same)
    labels = components(links).withColumnRenamed("node", "rep")
    needed = written(signed_blocks(labels).mapInArrow(_block_members(least), "bucket long, rep long").distinct(), "needed")
    members = open_members(hits.join(needed, ["bucket", "rep"], "left_semi"), labels).join(reps.select("rep", "sig"), "rep").join(texts.withColumnRenamed("id", "rep"), "rep")
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES))
    found = written(blocks(members, size, "text").mapInArrow(_block_links(least, percent), "a long, b long"), "links")
    if not found.isEmpty():
        labels = components(links.union(found)).withColumnRenamed("node", "rep")

    classes = reps.select("words_id", "rep").join(labels, "rep", "left").select("words_id", F.coalesce("component", "rep").alias("of"))
    out = signed.select("doc_id", "n_shingles", "words_id").join(written(classes, "classes"), "words_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("of")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLE = {
    "op2_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, CASE WHEN len(ws) >= 5 THEN unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM w WHERE len(ws) >= 5
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
}
