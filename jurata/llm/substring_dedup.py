"""Repeated passages: compaction of the word De Bruijn graph, with spans verified at their source coordinates.

An edge of the graph is a window of `width` consecutive words; a document is a walk over edges.

1. Local paths. Consecutive edges of a walk that share their smallest k-mer (the anchor) form one path, so that equal
   edges always lie in paths of one anchor, and a path stands for about (width - k) / 2 edges. A path that a document
   repeats is one row with all its places.
2. Repeated paths. Anchors are grouped (partially aggregated); those of a single document go. If all paths of an anchor
   are equal the path doesn't branch and stays whole; else the walks part inside it, and each distinct path, whatever
   number of documents follow it, is split once into its edges, which are grouped by themselves.
3. Compaction. Joins attach the source (the smallest document and the place in it); neighbouring edges of a path become
   runs, all runs of a path are one row (a path has at most width - k + 1 edges), and a join gives them to the documents
   of the path. A document's paths meet in one row, where neighbouring runs of one source document at one distance are
   merged into spans.
4. Verification. Each span carries the digest of the words at its source; the words at its own place must have the
   same digest, else the span is left alone. The places of a source document are dealt to parts of bounded size.

Edge cases: null and wordless texts have no words; a text shorter than the window is never trimmed and is no source; a
null doc_id is neither trimmed nor a source; rows of one doc_id aren't sources of each other, and each of their texts is
judged by itself (a text is known by doc_id and its hash); other columns are not read, whatever they are called. No step
gathers an anchor, an edge or a source in one task but through partial aggregates and joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel as K
from ._store import bound_batches, parted, table, unused, written

#: Words of an anchor; the window must be longer.
ANCHOR = 20
#: Places of one source document that are digested in one row.
PLACES = 1000


def _least_index(v: np.ndarray, n: int) -> np.ndarray:
    """Index of the smallest value (the first on ties) in every run of n values."""
    at, size = np.arange(len(v)), 1
    while size < n:
        step = min(size, n - size)
        a, b = at[:-step], at[step:]
        at = np.where(v[b] < v[a], b, a)
        size += step
    return at


def _paths(width: int):
    weight = K._powers(0xD6E8FEB86659FD93, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                w = K.words(part.column("text"))
                data, begin, end = K.tight(w)
                counts = np.zeros(part.num_rows, np.int64)
                anchor = body = np.zeros(0, np.uint64)
                start = size = np.zeros(0, np.int64)
                heads = np.zeros(0, np.int64)
                at, text = K.gram_owner(w, width)
                if len(at):
                    mers = K.ngrams(w.hash, ANCHOR)
                    least = _least_index(mers, width - ANCHOR + 1)[at]
                    fresh = np.ones(len(at), bool)
                    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                    first = np.flatnonzero(fresh)
                    size = np.diff(np.append(first, len(at)))
                    rank = np.arange(len(at)) - np.repeat(first, size)
                    body = K.mix(np.add.reduceat(K.ngrams(w.hash, width)[at] * weight[rank], first) + size.astype(np.uint64))
                    order = np.lexsort((first, body, text[first]))  # equal paths of a text side by side, in their order
                    own, body, first = text[first][order], body[order], first[order]
                    new = np.ones(len(own), bool)
                    new[1:] = (body[1:] != body[:-1]) | (own[1:] != own[:-1])
                    heads, start = np.flatnonzero(new), at[first] - w.first[own]
                    anchor, body, size = mers[least[first[heads]]], body[heads], size[order][heads]
                    counts = np.bincount(own[heads], minlength=part.num_rows)
                full = np.flatnonzero(w.counts)
                whole = [hashlib.sha256().hexdigest()] * part.num_rows
                for d in full:
                    whole[d] = hashlib.sha256(data[begin[w.first[d]] : end[w.first[d + 1] - 1]]).hexdigest()
                places = K.lists(np.diff(np.append(heads, len(start))), start, pa.int32())
                starts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), places)
                columns = [part.column("doc_id"), part.column("text_id"), pa.array(w.counts), pa.array(whole), K.lists(counts, anchor.view(np.int64), pa.int64()), K.lists(counts, body.view(np.int64), pa.int64()), K.lists(counts, size, pa.int32()), starts]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_id", "n_words", "sha256", "anchor", "body", "size", "starts"])

    return run


def _edges(width: int):
    """Hash and place of every edge of the listed paths: a row of a document has parallel lists of body, last, start and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                w = K.words(part.column("text"))
                grams = K.ngrams(w.hash, width)
                owner = np.repeat(np.arange(part.num_rows), part.column("start").value_lengths().to_numpy(zero_copy_only=False))
                body, last, start, size = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("body", "last", "start", "size"))
                path = np.repeat(np.arange(len(size)), size)
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row, place = owner[path], start[path] + inside
                ids, texts = (part.column(c).to_numpy() for c in ("doc_id", "text_id"))
                columns = (grams[w.first[row] + place].view(np.int64), body[path], inside.astype(np.int32), ids[row], texts[row], place.astype(np.int32), last[path])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["edge", "body", "inside", "doc_id", "text_id", "start", "last"])

    return run


def _merged(width: int):
    """Spans of each document from its paths' places and runs: (doc_id, text_id, source, source_text, source_start, length, starts)."""
    names = ["doc_id", "text_id", "source", "source_text", "source_start", "length", "starts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "found")), strict=True):
                met: dict[tuple, list] = {}
                for f in found:
                    for r in f["runs"]:
                        for s in f["starts"]:
                            met.setdefault((r["source"], r["source_text"], s - r["apart"]), []).append((s + r["inside"], s + r["inside"] + r["n"]))
                places: dict[tuple, list] = {}
                for (source, source_text, apart), runs in met.items():
                    runs.sort()
                    begin, end = runs[0]
                    for a, b in [*runs[1:], (None, None)]:
                        if a is not None and a <= end:
                            end = max(end, b)
                        else:
                            places.setdefault((source, source_text, begin - apart, end - begin + width - 1), []).append(begin)
                            begin, end = a, b
                rows += [(doc, text, *k, v) for k, v in places.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the words at the listed places."""
    names, types = ["source", "source_text", "source_start", "length", "digest"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        for part in K.chunks(batch):
            w = K.words(part.column("text"))
            data, begin, end = K.tight(w)
            rows = []
            for d, (doc, text, places) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_id", "places")), strict=True)):
                for p in places:
                    i = w.first[d] + p["start"]
                    rows.append((doc, text, p["start"], p["length"], hashlib.blake2b(data[begin[i] : end[i + p["length"] - 1]], digest_size=16).digest()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.chunks(batch):
            w = K.words(part.column("text"))
            data, begin, end = K.tight(w)
            removed, texts = [], []
            for d, spans in enumerate(part.column("spans").to_pylist()):
                lo, hi = w.first[d], w.first[d + 1]
                gone = np.zeros(hi - lo + 1, np.int64)
                for span in spans:
                    n = span["length"]
                    for at in span["starts"]:
                        if hashlib.blake2b(data[begin[lo + at] : end[lo + at + n - 1]], digest_size=16).digest() == span["digest"]:
                            gone[at] += 1
                            gone[at + n] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                removed.append(int(hi - lo - stays.sum()))
                edge = np.diff(np.concatenate(([0], stays.astype(np.int8), [0])))
                runs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
                texts.append(b" ".join(data[begin[lo + a] : end[lo + b - 1]].tobytes() for a, b in runs).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text_id", "n_removed", "kept_text"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")


def repeated_spans(paths: DataFrame, docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): spans (doc_id, text_id, starts, length, digest) whose words start a window in a smaller document too, and the texts (doc_id, text_id, text) of all documents that share an anchor."""
    rows = paths.where("doc_id is not null").select("doc_id", "text_id", F.explode(F.arrays_zip("anchor", "body", "size", "starts")).alias("p")).select("doc_id", "text_id", "p.*")
    group = rows.groupBy("anchor").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min("body").alias("lo"), F.max("body").alias("hi"))
    group = group.where("source < last").select("anchor", "source", (F.col("lo") != F.col("hi")).alias("branches"))
    # Aggregates are written before they are joined: with an exchange on both sides adaptive execution can split a hot key.
    shared = written(rows.join(written(group, "anchors"), "anchor").withColumn("start", F.element_at("starts", 1)), "paths")
    texts = _texts(docs).where("doc_id is not null").join(shared.select("doc_id", "text_id").distinct(), ["doc_id", "text_id"], "left_semi")
    texts = written(texts.dropDuplicates(["doc_id", "text_id"]), "texts")

    # Paths that don't branch: one source place for each anchor, and one run, the whole path.
    whole = shared.where("not branches")
    place = whole.where("doc_id = source").groupBy("anchor").agg(F.min(F.struct("text_id", "start")).alias("at"))
    run = F.struct(F.lit(0).alias("inside"), F.col("size").alias("n"), "source", F.col("at.text_id").alias("source_text"), F.col("at.start").alias("apart"))
    found = whole.where("doc_id > source").join(written(place, "sources"), "anchor").select("doc_id", "text_id", "starts", F.array(run).alias("runs"))

    # Branching ones: each distinct path once, at its first place, is split into edges; equal edges have one source place.
    bodies = shared.where("branches").groupBy("body").agg(F.min(F.struct("doc_id", "text_id", "start", "size")).alias("at"), F.max("doc_id").alias("last"))
    split = bodies.groupBy("at.doc_id", "at.text_id").agg(*[F.collect_list(c).alias(n) for c, n in (("body", "body"), ("last", "last"), ("at.start", "start"), ("at.size", "size"))])
    edges = written(texts.join(split, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "body", "last", "start", "size").mapInArrow(_edges(width), "edge long, body long, inside int, doc_id long, text_id long, start int, last long"), "edges")
    first = edges.groupBy("edge").agg(F.min(F.struct("doc_id", "text_id", "start")).alias("at"), F.max("last").alias("last")).where("at.doc_id < last")
    first = first.select("edge", F.col("at.doc_id").alias("source"), F.col("at.text_id").alias("source_text"), F.col("at.start").alias("source_start"))
    # Neighbouring edges of a path with one source and distance are one run again, and a path's runs one row, before its documents are joined.
    met = edges.select("edge", "body", "inside").join(written(first, "first"), "edge").withColumn("apart", F.col("source_start") - F.col("inside"))
    rank = F.row_number().over(W.partitionBy("body").orderBy("source", "source_text", "apart", "inside"))
    runs = met.withColumn("run", F.col("inside") - rank).groupBy("body", "source", "source_text", "apart", "run").agg(F.min("inside").alias("inside"), F.count("*").cast("int").alias("n"))
    runs = written(runs.groupBy("body").agg(F.collect_list(F.struct("inside", "n", "source", "source_text", "apart")).alias("runs")), "runs")
    branching = shared.where("branches").select("doc_id", "text_id", "body", "starts").join(runs, "body")
    branching = branching.select("doc_id", "text_id", "starts", F.filter("runs", lambda r: r["source"] < F.col("doc_id")).alias("runs")).where(F.size("runs") > 0)

    # A document's paths in one row; repeated rows of a document are equal elements of the set.
    walks = found.union(branching).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("starts", "runs")).alias("found"))
    spans = written(walks.mapInArrow(_merged(width), "doc_id long, text_id long, source long, source_text long, source_start int, length int, starts array<int>"), "spans")
    places = spans.select("source", "source_text", F.col("source_start").alias("start"), "length").distinct()
    places = parted(places, ["source", "source_text"], PLACES).groupBy("source", "source_text", "part").agg(F.collect_list(F.struct("start", "length")).alias("places"))
    places = places.withColumnsRenamed({"source": "doc_id", "source_text": "text_id"})
    digests = texts.join(places, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "places").mapInArrow(_digests, "source long, source_text long, source_start int, length int, digest binary")
    return spans.join(digests, ["source", "source_text", "source_start", "length"]).select("doc_id", "text_id", "starts", "length", "digest"), texts


def _analysed(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(all rows: doc_id, text_id, n_words, sha256; trimmed texts: doc_id, text_id, n_removed, kept_text)"""
    bound_batches(docs.sparkSession)
    paths = _texts(docs).mapInArrow(_paths(width), "doc_id long, text_id long, n_words long, sha256 string, anchor array<long>, body array<long>, size array<int>, starts array<array<int>>")
    paths = written(paths, "walks")
    spans, texts = repeated_spans(paths, docs, width)
    spans = spans.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("starts", "length", "digest")).alias("spans"))
    trimmed = texts.join(spans, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "spans").mapInArrow(_trimmed, "doc_id long, text_id long, n_removed long, kept_text string")
    return paths.select("doc_id", "text_id", "n_words", "sha256"), trimmed


def repeated_words(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; a word goes if a window of `width` words over it also starts in a document with a smaller doc_id."""
    every, trimmed = _analysed(docs, width)
    trimmed = trimmed.select("doc_id", "text_id", "n_removed", F.sha2("kept_text", 256).alias("kept"))
    return every.join(trimmed, ["doc_id", "text_id"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with the repeated words taken out of `text` (texts that lose words have the rest one space apart; others are unchanged)."""
    _, trimmed = _analysed(docs, width)
    doc, text, kept = (unused(docs, n) for n in ("kept_doc_id", "kept_text_id", "kept_text"))
    trimmed = trimmed.where("n_removed > 0").select(F.col("doc_id").alias(doc), F.col("text_id").alias(text), F.col("kept_text").alias(kept))
    out = docs.join(trimmed, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(text)), "left")
    return out.withColumn("text", F.coalesce(kept, "text")).select(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE = {
    "op6_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i+49], ' ')))) AS h FROM w WHERE len(ws) >= 50
), f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)
), x AS (SELECT DISTINCT g.doc_id, g.i + k.k AS i FROM g JOIN f ON g.h = f.h AND g.doc_id > f.first CROSS JOIN range(0, 50) k(k)
), t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), r AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept, count(*) AS n FROM t LEFT JOIN x ON x.doc_id = t.doc_id AND x.i = t.i WHERE x.i IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)"""
}
