"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is tokenised by itself; those that are one pre-token and end as one token are proved
whole. Inside the tasks a text is cut into pre-tokens; whole ones count as one by a table look-up, and only the rest are
merged (each distinct one once while it stays in a bounded table).

Reads a byte-level BPE file of the tokenizers library (no normaliser, the library's standard split pattern).

Edge cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside texts count as one token, as the
library does by default; a null doc_id and repeated rows are reported as they are; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bound_batches, table

#: Pre-tokens whose counts a worker keeps besides the whole ones.
KEPT = 150_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merger:
    """Byte-level BPE by merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.vocab = list(model["vocab"])
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.letters = byte_letters()

    def spelled(self, token: str) -> list[str]:
        letters = self.letters
        return [letters[b] for b in token.encode("utf-8", "surrogatepass")]

    def count(self, token: str) -> int:
        """Tokens that a pre-token becomes."""
        parts, rank = self.spelled(token), self.rank.get
        if len(parts) > 128:
            return self._count_long(parts)
        none = 1 << 60
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:  # the leftmost of the best pairs, then its two neighbours anew
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return len(parts)

    def _count_long(self, parts: list[str]) -> int:
        """The same with a heap over linked parts, n log n."""
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            left -= 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def whole(self, pattern) -> frozenset[str]:
        """The vocabulary strings that alone are one pre-token and one token."""
        byte = {c: b for b, c in enumerate(self.letters)}
        out = set()
        for v in self.vocab:
            try:
                text = bytes(byte[c] for c in v).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if pattern.fullmatch(text) and pattern.findall(text) == [text] and self.count(text) == 1:
                out.add(text)
        return frozenset(out)


class _Counts(dict):
    """Tokens of each pre-token: whole ones for good, others while they fit."""

    def __init__(self, merger: Merger, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.merger, self.whole = merger, whole

    def __missing__(self, token: str) -> int:
        if len(self) >= len(self.whole) + KEPT:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = self.merger.count(token)
        if len(token) <= 64:
            self[token] = n
        return n


_workers: dict[str, _Counts] = {}


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; path is the vocabulary file, on every machine, and pattern its pre-token pattern."""
    import regex

    spark = docs.sparkSession
    bound_batches(spark)
    merger = Merger(path)
    whole = spark.sparkContext.broadcast(merger.whole(regex.compile(pattern)))  # bounded by the vocabulary
    special = merger.special

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = _Counts(Merger(path), whole.value)
        one, find = _workers[path].__getitem__, regex.compile(pattern).findall
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        for batch in batches:
            n = []
            for text in batch.column("text").to_pylist():
                pieces = cut.split(text) if cut and any(s in text for s in special) else (text,)
                n.append(sum(sum(map(one, find(p))) for p in pieces) + len(pieces) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE: dict[str, str] = {}
