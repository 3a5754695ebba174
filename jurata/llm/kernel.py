"""Vectorised words, n-grams and hashes over the bytes of an Arrow string column (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at a time; pieces are cut at white space, so a word is never split.
PIECE = 1 << 18
#: Bytes of text worked on at a time (a longer single text is a chunk by itself).
CHUNK = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_PW, _PW_INV = _powers(_P, PIECE + 1), _powers(_P_INV, PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about `limit` bytes of text."""
    offsets, _ = string_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of several texts one after another; first[d] is the first word of text d."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, lower: bool = False) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ with a 64-bit hash each; lower maps A-Z only."""
    offsets, data = string_bytes(column)
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True
    if len(data):
        before = np.concatenate(([False], solid[:-1]))
        after = np.concatenate((solid[1:], [False]))
        start = np.flatnonzero(solid & (~before | head[:-1]))
        end = np.flatnonzero(solid & (~after | head[1:])) + 1
    else:
        start = end = np.zeros(0, np.int64)
    return Words(start, end, _hash_spans(data, start, end), np.searchsorted(start, offsets), data)


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), U64)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(end, base + PIECE, "right")))
        stop = int(end[to - 1] - base)
        pw, inv = (_PW, _PW_INV) if stop <= PIECE else (_powers(_P, stop + 1), _powers(_P_INV, stop + 1))
        sums = np.zeros(stop + 1, U64)
        piece = data[base : base + stop].astype(U64)
        piece += U64(1)
        piece *= pw[:stop]
        np.cumsum(piece, out=sums[1:])
        s = start[at:to] - base
        out[at:to] = (sums[end[at:to] - base] - sums[s]) * inv[s] + (end[at:to] - start[at:to]).astype(U64) * U64(_Q)
        at = to
    return mix(out)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values (over text borders too: mask them)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, span, power, length = None, h, pow(_Q, 1, 1 << 64), 1
    done = 0
    while True:  # doubling: span holds runs of `length`, whose base to the length is `power`
        if n & length:
            out = span if out is None else out[: len(span) - done] + span[done:] * U64(pow(_Q, done, 1 << 64)) if done else span
            done += length
        if done == n:
            return mix(out[: len(h) - n + 1].copy())
        span = span[:-length] + span[length:] * U64(power)
        power = pow(power, 2, 1 << 64)
        length *= 2


def gram_owner(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, text) of every n-gram that lies within one text."""
    counts = np.maximum(w.counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(w.first[:-1], counts)
    return at, text


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first[d]) of the n-word shingles of each text; a shorter text with words is one shingle as a whole."""
    grams = ngrams(w.hash, n)
    at, _ = gram_owner(w, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    counts = np.maximum(w.counts - n + 1, 0)
    counts[short] = 1
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(first[-1], U64)
    full = np.ones(first[-1], bool)
    full[first[short]] = False
    out[full] = grams[at]
    for d in short:
        run = w.hash[w.first[d] : w.first[d + 1]]
        out[first[d]] = ngrams(np.concatenate((run, [U64(len(run))])), len(run) + 1)[0]
    return out, first


def tight(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, end): the words one space apart, and where each begins and ends in those bytes."""
    solid = ~SPACE[w.data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    border = np.concatenate(([0], np.cumsum(keep)))
    return np.where(solid, w.data, np.uint8(32))[keep], border[w.start], border[w.end]


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from values laid end to end."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))
