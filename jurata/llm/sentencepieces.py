"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no merge can cross: between characters that no piece has side by side. The distinct units are a table of their own: each is exploded into its substrings up to the
longest piece, the substrings are equi-joined to the piece table, the matches grouped by unit are the lattice's edges,
and a fold with the higher-order function aggregate() walks the lattice.

The fold follows the model's kind. A unigram model takes the path of the greatest score (Viterbi). For a BPE model that
path is not what the model means, so there each step of the fold takes the edge of the best score, the leftmost of
equals, whose two ends are borders with one border between them, and removes that border: the model's own merges.
The set of borders is a 64-bit mask; units of more than UNIT characters are merged in a vectorised UDF.

Units repeat, so the lattice is walked once for each distinct unit of all texts. Texts are dealt by a hash to chunks of about
CHUNK bytes; a unit's ids go to the chunks whose texts have it, and meet these there, both as compressed blocks of rows. The ids of every document are decoded
again in the task, from the whole document's ids, and compared with its text; decoded() is the same for ids in a table, by
joins. The piece table is broadcast, as the vocabulary bounds it. A task holds a chunk, its units and their ids.

Models with the identity normaliser, escaped white space and a dummy prefix are meant. Edge cases: a null or empty text
has no pieces; U+2581 in a text reads as a space, as in the library; characters without a piece become byte pieces (or
the unknown piece); a null text counts as an empty one; repeated rows and null doc_ids are encoded row by row; other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from ._store import bound_batches, table, written

MARK = "▁"
_MARK = MARK.encode()
UNIT = 60
#: Characters of a unit from which a heap over linked parts is faster than a list.
LONG = 200
#: Bytes of the texts that meet their units' ids in one task, pairs of unit and chunk that a task gathers before it tells them, and units whose
#: edges one task sorts.
CHUNK, KEPT, DEALT = 32 << 20, 400_000, 20_000


@dataclass(frozen=True)
class Borders:
    """Where texts are cut: codes are the characters of pieces in order, pairs the (number + 1) of characters side by side in one, as first * (size + 1) + second, in order."""

    codes: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def of(pieces: list[str]) -> Borders:
        codes = np.array(sorted({ord(c) for p in pieces for c in p}), np.uint32)
        number = {int(c): i for i, c in enumerate(codes, 1)}
        pairs = {number[ord(a)] * (len(codes) + 1) + number[ord(b)] for p in pieces for a, b in pairwise(p)}
        return Borders(codes, np.array(sorted(pairs), np.int64))

    @cached_property
    def number(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int64)
        out[self.codes] = np.arange(1, len(self.codes) + 1)
        return out

    @cached_property
    def table(self) -> np.ndarray | None:
        size = len(self.codes) + 1
        if size > 4096:  # then the pairs are searched
            return None
        out = np.zeros(size * size, bool)
        out[self.pairs] = True
        return out

    def _joined(self, code: np.ndarray) -> np.ndarray:
        at = self.number[code]
        pair = at[:-1] * (len(self.codes) + 1) + at[1:]
        return self.table[pair] if self.table is not None else np.isin(pair, self.pairs)

    def cut(self, marked: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Units of texts one after another, and how many each text has."""
        text = "".join(marked)
        if not text:
            return pa.array([], pa.large_string()), np.zeros(len(marked), np.int64)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.concatenate(([0], np.cumsum([len(t) for t in marked])))
        start = np.ones(len(code) + 1, bool)
        start[1:-1] = ~self._joined(code)
        start[first] = True
        begin = np.flatnonzero(start[:-1])
        ends = np.concatenate(([0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000))))
        offsets = ends[np.append(begin, len(code))]
        units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(text.encode()))
        return units, np.diff(np.searchsorted(begin, first))

    def findall(self, marked: str) -> list[str]:
        return self.cut([marked])[0].to_pylist()


@dataclass(frozen=True)
class Pieces:
    """A model's piece table: (id, piece, score) and the ids of bytes and of the unknown piece."""

    rows: tuple[tuple[int, str, float], ...]
    bytes_: tuple[int, ...]
    unknown: int
    bpe: bool

    @staticmethod
    def load(path: str, bpe: bool = True) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        byte = sorted((int(m.id_to_piece(i)[3:5], 16), i) for i in every if m.is_byte(i))
        plain = [i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return Pieces(tuple((i, m.id_to_piece(i), m.get_score(i)) for i in plain), tuple(i for _, i in byte), m.unk_id(), bpe)

    @cached_property
    def longest(self) -> int:
        return max(len(p) for _, p, _ in self.rows)

    @cached_property
    def unit(self) -> Borders:
        return Borders.of([p for _, p, _ in self.rows])

    @cached_property
    def score(self) -> dict[str, tuple[float, int]]:
        return {p: (s, i) for i, p, s in self.rows}

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score) of the plain pieces."""
        return spark.createDataFrame([(p, i, float(s)) for i, p, s in self.rows], "piece string, id int, score double")

    @cached_property
    def cost(self) -> dict[str, float]:
        return {p: -s for _, p, s in self.rows}

    def fallback(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def merged(self, unit: str) -> list[int]:
        """Ids of one unit: the same merges (or path) outside the fold, for long units."""
        n, score = len(unit), self.score
        if not self.bpe:
            best: list = [(0.0, ())] + [None] * n
            for e in range(1, n + 1):
                for s in range(max(0, e - self.longest), e):
                    if (hit := score.get(unit[s:e])) and (best[e] is None or best[s][0] + hit[0] > best[e][0]):
                        best[e] = (best[s][0] + hit[0], (s, [hit[1]]))
                if best[e] is None:
                    best[e] = (best[e - 1][0] - 1e6, (e - 1, self.fallback(unit[e - 1])))
            out: list[int] = []
            while n:
                n, ids = best[n][1]
                out[:0] = ids
            return out
        parts = list(unit)
        if n <= LONG:
            cost, none = self.cost.get, float("inf")
            costs = [cost(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while costs and (best := min(costs)) < none:  # the leftmost of the best, then its two neighbours anew
                i = costs.index(best)
                parts[i] += parts.pop(i + 1)
                del costs[i]
                if i:
                    costs[i - 1] = cost(parts[i - 1] + parts[i], none)
                if i < len(costs):
                    costs[i] = cost(parts[i] + parts[i + 1], none)
            return [x for p in parts for x in ([score[p][1]] if p in score else self.fallback(p))]
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (hit := score.get(unit[i : end[j]])):
                heapq.heappush(heap, (-hit[0], i, end[j], j))

        for i in range(n - 1):
            offer(i, i + 1)
        alive = [True] * n
        while heap:
            _, i, e, j = heapq.heappop(heap)
            if alive[i] and j < n and alive[j] and after[i] == j and end[j] == e:
                alive[j], end[i], after[i] = False, e, after[j]
                if after[j] < n:
                    before[after[j]] = i
                offer(before[i], i)
                offer(i, after[i])
        return [x for i in range(n) if alive[i] for x in ([score[unit[i : end[i]]][1]] if unit[i : end[i]] in score else self.fallback(unit[i : end[i]]))]


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, edges) of distinct units of up to UNIT characters; edges are structs (order, start, ends, inner, id, char), best first, one-character edges always among them."""
    spark = units.sparkSession
    size = F.length("unit")
    sub = units.select("unit", F.explode(F.sequence(F.lit(1), size)).alias("start")).select("unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), size - F.col("start") + 1))).alias("n"))
    sub = sub.select("unit", (F.col("start") - 1).alias("start"), "n", F.substring(F.col("unit"), F.col("start"), F.col("n")).alias("piece"))
    known = pieces.table(spark)
    hit = sub.join(F.broadcast(known), "piece", "left").where("id is not null or n = 1")
    bit = lambda at: F.expr(f"shiftleft(1L, {at})")
    edge = F.struct((-F.col("score")).alias("order"), F.col("start"), bit("start").bitwiseOR(bit("start + n")).alias("ends"), (bit("start + n") - bit("start + 1")).alias("inner"), F.col("id"), F.when(F.col("id").isNull(), F.col("piece")).alias("char"))
    return hit.groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def folded(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of a lattice."""
    n = F.length("unit")
    fallback = F.array(*[F.lit(b) for b in pieces.bytes_]) if pieces.bytes_ else None

    def ids(e: F.Column) -> F.Column:
        if fallback is None:
            other = F.array(F.lit(pieces.unknown))
        else:
            raw = e["char"].cast("binary")
            other = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.element_at(fallback, F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int") + 1))
        return F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(other)

    if pieces.bpe:
        start = F.expr("shiftleft(1L, length(unit) + 1) - 1L")
        several = F.filter("edges", lambda e: e["inner"] != 0)

        def step(mask: F.Column, _: F.Column) -> F.Column:
            ready = F.filter("_several", lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1))
            return F.coalesce(mask.bitwiseAND(F.bitwise_not(F.try_element_at(ready, F.lit(1))["inner"])), mask)

        rows = edges.withColumn("_several", several).withColumn("_mask", F.when(F.size("_several") == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step)))
        path = F.filter("edges", lambda e: (F.col("_mask").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("_mask").bitwiseAND(e["inner"]) == 0))
        path = F.array_sort(F.transform(path, lambda e: F.struct(e["start"].alias("start"), ids(e).alias("ids"))))
    else:
        # Best path to each end, ends in order: state[e] = (score, ids).
        step = lambda e: F.struct((e["start"] + F.bit_count(e["inner"]) + 1).alias("end"), e["start"].alias("start"), F.coalesce(-e["order"], F.lit(-1e6)).alias("score"), ids(e).alias("ids"))
        by_end = F.array_sort(F.transform("edges", step))
        first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))

        def extend(state: F.Column, e: F.Column) -> F.Column:
            source = F.element_at(state, e["start"] + 1)
            new = F.struct((source["score"] + e["score"]).alias("score"), F.concat(source["ids"], e["ids"]).alias("ids"))
            last = F.element_at(state, -1)
            return F.when(F.size(state) <= e["end"], F.concat(state, F.array(new))).when(new["score"] > last["score"], F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(new))).otherwise(state)

        return edges.select("unit", F.element_at(F.aggregate(by_end, first, extend), -1)["ids"].alias("ids"))
    return rows.select("unit", F.flatten(F.transform(path, lambda p: p["ids"])).alias("ids"))


def unit_ids(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of distinct non-empty units."""
    short = folded(lattice(units.where(F.length("unit") <= UNIT), pieces), pieces)

    @F.pandas_udf("array<int>")
    def long(unit: pd.Series) -> pd.Series:
        return unit.map(pieces.merged)

    return short.union(units.where(F.length("unit") > UNIT).select("unit", long("unit").alias("ids")))


def _spelled(pieces: Pieces) -> list[bytes]:
    """What each id stands for in a text."""
    out = [b""] * (1 + max([i for i, _, _ in pieces.rows] + list(pieces.bytes_) + [pieces.unknown]))
    for i, p, _ in pieces.rows:
        out[i] = p.replace(MARK, " ").encode()
    for b, i in enumerate(pieces.bytes_):
        out[i] = bytes([b])
    out[pieces.unknown] = " ⁇ ".encode()
    return out


def _read(ids: list[int], spelled: list[bytes]) -> bytes:
    """The text of a document's ids, without the space that the dummy prefix gives."""
    return b"".join(map(spelled.__getitem__, ids)).removeprefix(b" ")


def _marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def units_of(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, chunks) of every unit of docs (chunk, text), and the chunks whose texts have it."""
    borders = pieces.unit

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []

        def told() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(seen).group_by("unit", use_threads=False).aggregate([("chunk", "distinct")])
            seen.clear()
            yield from pa.table([rows["unit"], rows["chunk_distinct"]], ["unit", "chunks"]).to_batches(10_000)

        for batch in batches:
            for part in K.chunks(batch):
                units, words = borders.cut([_marked(t) for t in part.column("text").to_pylist()])
                if not len(units):
                    continue
                units = units.dictionary_encode()
                pair = pd.unique(np.repeat(part.column("chunk").to_numpy(), words).astype(np.int64) << 32 | units.indices.to_numpy())
                unit = units.dictionary.take(pa.array(pair & 0xFFFFFFFF)).cast(pa.string())
                seen.append(pa.table([unit, pa.array((pair >> 32).astype(np.int32))], ["unit", "chunk"]))
                if sum(map(len, seen)) > 2 * KEPT:
                    seen[:] = [pa.concat_tables(seen).group_by(["unit", "chunk"], use_threads=False).aggregate([])]
                    if len(seen[0]) > KEPT:
                        yield from told()
        if seen:
            yield from told()

    rows = docs.mapInArrow(cut, "unit string, chunks array<int>")
    return rows.groupBy("unit").agg(F.array_distinct(F.flatten(F.collect_list("chunks"))).alias("chunks"))


def _packed(rows: DataFrame) -> DataFrame:
    """(chunk, block): a task's rows of a chunk as compressed Arrow, some MB at a time."""
    most = CHUNK // 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(some).sort_by("chunk").combine_chunks()
            some.clear()
            chunk = table.column("chunk").to_numpy()
            at = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in pairwise(at):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([chunk[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "block"])

        for batch in batches:
            if batch.num_rows:
                some.append(batch)
            if sum(b.nbytes for b in some) > most:
                yield from told()
        if some:
            yield from told()

    return rows.mapInArrow(pack, "chunk int, block binary")


def _unpacked(blocks: pa.Table) -> pa.Table | None:
    tables = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blocks.column("block")]
    return pa.concat_tables(tables) if tables else None


def encoded(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip, exact) of every text, whose ids are decoded again: round_trip says that this gives the text as the model reads it (U+2581 is a space), exact that it gives the very text."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    chunks = size // CHUNK + 1
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    units = written(units_of(docs.select("chunk", "text"), pieces), "units", tidy=True)
    # Edges meet where their unit was dealt to, so few units at a time are sorted in memory.
    ids = written(unit_ids(units.select("unit").repartition(units.count() // DEALT + 1, "unit"), pieces), "unit_ids", tidy=True)
    known = units.join(ids, "unit").select(F.explode("chunks").alias("chunk"), "unit", "ids")
    sent = spark.sparkContext.broadcast((pieces.unit, _spelled(pieces)))

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        borders, spelled = sent.value
        texts, known = _unpacked(texts), _unpacked(known)
        number = {u: i for i, u in enumerate(known.column("unit").to_pylist())} if known else {}
        found = known.column("ids").combine_chunks() if known else pa.array([], pa.list_(pa.int32()))
        found = found if isinstance(found, pa.ListArray) else pa.concat_arrays(found.chunks)
        first, flat = found.offsets.to_numpy(), found.values.to_numpy()
        out = []
        for batch in texts.combine_chunks().to_batches():
            for part in K.chunks(batch):
                own, words = borders.cut([_marked(t) for t in part.column("text").to_pylist()])
                own = own.dictionary_encode()
                at = np.array([number[u] for u in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()]
                begin, n = first[at], first[at + 1] - first[at]
                ids = flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                per = np.bincount(np.repeat(np.arange(part.num_rows), words), n, part.num_rows).astype(np.int64)
                ends = np.cumsum(per).tolist()
                back = [_read(ids[a:b].tolist(), spelled) for a, b in zip([0, *ends], ends, strict=False)]
                read = [(t or "").encode() for t in part.column("text").to_pylist()]
                exact = [a == b for a, b in zip(back, read, strict=True)]
                trip = [e or a == b.replace(_MARK, b" ") for e, a, b in zip(exact, back, read, strict=True)]
                out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(per), K.lists(per, ids, pa.int32()), pa.array(trip, pa.bool_()), pa.array(exact, pa.bool_())], _OUT.names))
        return pa.Table.from_batches(out, _OUT)

    texts, known = _packed(docs), _packed(known)
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean, exact boolean")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_()), ("exact", pa.bool_())])


def decoded(rows: DataFrame, pieces: Pieces, ids: str = "ids", into: str = "text") -> DataFrame:
    """rows with the text of their ids: exploded ids, an equi-join to the piece table, and the pieces in order again. Unknown ids and nulls give nothing."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(_spelled(pieces))], "_id int, _piece binary")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "encoded")
    each = rows.select("_row", F.posexplode(ids).alias("_at", "_id")).join(F.broadcast(known), "_id")
    text = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", F.hex("_piece").alias("_hex")))).alias("_p"))
    text = text.select("_row", F.unhex(F.array_join(F.transform("_p", lambda p: p["_hex"]), "")).cast("string").alias("_text"))
    text = text.withColumn("_text", F.regexp_replace("_text", r"^ ", ""))
    return rows.join(text, "_row", "left").withColumn(into, F.coalesce("_text", F.lit(""))).drop("_row", "_text")


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), Pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op8_sentencepieces": op8_sentencepieces}
ORACLE: dict[str, str] = {}
