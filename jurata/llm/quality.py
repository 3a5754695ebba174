"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into at most BINS bins; cyclic boosting fits one shallow tree per feature and round and
adds it to that feature's look-up table, then does the same with two-dimensional tables for the PAIRS pairs that lower
the loss most. A score is the logistic function of a sum of table entries, so a batch is scored by index additions.

Features come from whole texts only (bytes, words, lines); no label, language, source or id is an input. The model is
fitted on at most `sample` labelled documents (SAMPLE by default), the first by a hash of doc_id; a bound on the hash
from their number keeps all others from the driver. Scoring computes features and score where the text is, in one pass
without a shuffle.

Edge cases: a null or empty text has all-zero features and is scored like any other; labels that are null or whose
doc_id is null are ignored and several labels of one document count by their mean; without labels of both kinds the
score is the share of label 1 (0.5 without labels); repeated rows are scored row by row; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from ._store import bound_batches, table, written

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1

KINDS = ("other", "upper", "lower", "digit", "blank", "line", "stop", "pause", "mark", "symbol", "wide")
FEATURES = (*(f"share_{k}" for k in KINDS), "log_bytes", "log_words", "word_mean", "word_spread", "word_longest", "short_words", "capital_words", "marked_words", "bare_symbol_words", "distinct_words", "top_word", "log_lines", "line_words", "distinct_lines", "stops_per_word", "repeated_pairs")

_KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((b"", range(65, 91), range(97, 123), range(48, 58), b" \t\x0b\x0c", b"\n\r", b".", b",;:", b"!?", b"#$%&*@^~|<>{}[]\\/_=+", range(128, 256))):
    _KIND[list(_bytes)] = _kind


def _distinct(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest one, per text."""
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(fresh)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, t[at], np.diff(np.append(at, len(v))))
    return np.bincount(t[at], minlength=n), top


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(column)
    w = K.words(column)
    offsets, data = K.string_bytes(column)
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    kind = _KIND[data]
    shares = np.bincount(text * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, -1)
    of = np.repeat(np.arange(n), w.counts)
    length = (w.end - w.start).astype(float)
    words = np.maximum(w.counts, 1)
    mean = np.bincount(of, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / words - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    upper, lower = (np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2))
    capital = (upper[w.end] - upper[w.start] >= 2) & (lower[w.end] == lower[w.start])
    last = kind[w.end - 1] if len(w.end) else np.zeros(0, np.int64)
    head = kind[w.start] if len(w.start) else np.zeros(0, np.int64)
    per_word = lambda mask: np.bincount(of[mask], minlength=n) / words
    distinct, top = _distinct(of, w.hash, n)
    pairs, pair_text = K.gram_owner(w, 2)
    grams = K.ngrams(w.hash, 2)[pairs] if len(pairs) else np.zeros(0, np.uint64)
    pair_kinds, _ = _distinct(pair_text, grams, n)
    pair_n = np.maximum(w.counts - 1, 0)
    # Lines: words on each line by the line breaks before each word; a line is known by the sum of its words.
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line = breaks[w.start]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(fresh)
    line_hash = np.add.reduceat(w.hash, at) if len(at) else np.zeros(0, np.uint64)
    lines = np.bincount(of[at], minlength=n)
    line_kinds, _ = _distinct(of[at], line_hash, n)
    out = [*(shares / np.maximum(size, 1)[:, None]).T, np.log1p(size), np.log1p(w.counts), mean, spread, longest, per_word(length <= 3), per_word(capital), per_word((last == 8) | (last == 9)), per_word((length == 1) & (head == 9)), distinct / words, top / words, np.log1p(lines), w.counts / np.maximum(lines, 1), line_kinds / np.maximum(lines, 1), shares[:, 6] / words, (pair_n - pair_kinds) / np.maximum(pair_n, 1)]
    return np.stack(out, 1).astype(np.float32)


@dataclass
class Model:
    """Look-up tables: base + sum of mains[j][bin] + sum of tables[i, j][bin, bin]."""

    base: float
    cuts: list[np.ndarray]
    mains: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cuts, t) in enumerate(zip(self.cuts, self.mains, strict=True)):
            z += t[np.searchsorted(cuts, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], "right") for j in {k for p in self.pairs for k in p}}
        for (i, j), t in self.pairs.items():
            z += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-z))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)).astype(np.float32)


def _stump(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values by bin of a tree of that depth over ordered bins, from sums of gradients and curvatures."""
    gs, hs = np.cumsum(g), np.cumsum(h)
    total, weight = gs[-1], hs[-1]
    if depth and len(g) > 1:
        left, right = gs[:-1] ** 2 / (hs[:-1] + 1), (total - gs[:-1]) ** 2 / (weight - hs[:-1] + 1)
        gain = left + right
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > total**2 / (weight + 1) + 1e-9:
            return np.concatenate((_stump(g[:at], h[:at], depth - 1), _stump(g[at:], h[at:], depth - 1)))
    return np.full(len(g), total / (weight + 1))


def _patch(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over a grid: the better of a cut by rows then columns and the other way; and its gain."""
    best: tuple[np.ndarray, float] = (np.zeros_like(g), -1.0)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            out, gain = np.empty_like(a), 0.0
            for part in (slice(0, at), slice(at, None)):
                row = _stump(a[part].sum(0), b[part].sum(0), 1)
                out[part] = row
                gain += float((row * a[part].sum(0)).sum())
            if gain > best[1]:
                best = (out.T if turned else out, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of feature tables, then of pair tables."""
    rate = float(y.mean()) if len(y) else 0.5
    n = x.shape[1]
    if not (len(y) and 0 < rate < 1):
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return Model(float(np.log(rate / (1 - rate))), [np.zeros(0, np.float32)] * n, [np.zeros(1)] * n, [np.zeros(0, np.float32)] * n, {})
    base = float(np.log(rate / (1 - rate)))
    cuts, pair_cuts = [_cuts(x[:, j], BINS) for j in range(n)], [_cuts(x[:, j], PAIR_BINS) for j in range(n)]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(pair_cuts)]
    mains, z = [np.zeros(len(c) + 1) for c in cuts], np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(n):
            g, h = slopes()
            step = RATE * _stump(*(np.bincount(bins[j], v, len(mains[j])) for v in (g, h)), 2)
            mains[j] += step
            z += step[bins[j]]
    g, h = slopes()
    shape = [len(c) + 1 for c in pair_cuts]
    grid = {(i, j): coarse[i] * shape[j] + coarse[j] for i in range(n) for j in range(i + 1, n)}
    sums = lambda p, v: np.bincount(grid[p], v, shape[p[0]] * shape[p[1]]).reshape(shape[p[0]], shape[p[1]])
    chosen = sorted(grid, key=lambda p: -_patch(sums(p, g), sums(p, h))[1])[:PAIRS]
    pairs = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            step = RATE * _patch(*(sums(p, v) for v in slopes()))[0]
            pairs[p] += step
            z += step.ravel()[grid[p]]
    return Model(base, cuts, mains, pair_cuts, pairs)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.chunks(batch):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], ["doc_id", "y", "x"])


def held_out() -> F.Column:
    """The third of the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels (doc_id, quality) from at most `sample` documents that aren't held out."""
    y = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    known = written(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(y, "doc_id"), "labelled")
    n, place = known.count(), F.xxhash64("doc_id")
    if n > sample:  # the least hashes that hold `sample` of n: the bound is six deviations above their share
        known = known.where(place <= int(-(1 << 63) + (sample + 6 * sample**0.5) / n * (1 << 64)) if sample + 6 * sample**0.5 < n else F.lit(True))
    chosen = written(known.orderBy(place, "doc_id").limit(sample), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    x = texts.select("doc_id", "y", "text").mapInArrow(_measure, "doc_id long, y double, x array<float>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    rows = x.collect()
    return fit(np.array([r["x"] for r in rows], np.float32).reshape(-1, len(FEATURES)), (np.array([r["y"] for r in rows], float) >= 0.5).astype(float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.value.score(features(part.column("text"))))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """docs whose score is at least `least`; the rows are scored where they are, without a shuffle."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                yield part.filter(pa.array(model.value.score(features(part.column("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality": op5_quality}
ORACLE: dict[str, str] = {}
