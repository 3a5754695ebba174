"""Files of token ids, coded by a canonical length-limited Huffman code.

Every text is encoded with the tokenizers library and gets an end id. The ids of all documents are counted, the counts give
code lengths of at most LIMIT bits (package-merge over the vocabulary), and the canonical code follows from the lengths
alone. A document is coded by itself and starts at a byte; every LANE ids a checkpoint keeps the distance in bits to the
next one. Documents are dealt by ascending doc_id to parts and cut into blocks of about BLOCK ids that can be decoded
alone: all checkpoints of a block are followed at once, each step looks one id per checkpoint up in a table of all LIMIT-bit
prefixes.

The format is a folder that Spark writes and reads on any of its file systems:

    codes   (id int, bits int): ids that occur and their code lengths
    blocks  (part int, first long, n_ids long, doc_id array<long>, counts array<int>, gaps binary, payload binary): a part
            holds a range of doc_id and its rows are in ascending order of `first`, the ids of the part before the block;
            counts are ids per document, gaps the bits from each checkpoint to the next (unsigned 16-bit integers), payload
            the codes, highest bit first

Units are encoded once a worker while they stay in a table of bounded size: the library cuts a text before ASCII white space
that follows other characters, and between ASCII letters, digits and other signs (but for the apostrophe), whatever stands
around. Texts with other white space or the string of a special token go to the library whole. Needs a byte-level file
without a normaliser, as the bytes of ids tell where a unit ends.

Tasks hold a batch of texts, a block, and the table of units; no group and no document meets others than its neighbours.
The driver holds the counts (bounded by the vocabulary) and a range bound and a sum for each part.

Edge cases: a null text is an empty one (the end id alone); rows of one doc_id, null included, are kept, ordered by a hash
of their texts, and a null doc_id comes first; one id alone gets a code of one bit; an empty table gives files without rows;
a document longer than a block is a block by itself; other columns are not read. Sets the session's bound of Arrow batches.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import BATCH_BYTES, bound_batches, fresh_path, scratch, table, written
from .kernel import chunks, string_bytes

#: Longest code in bits (more where the vocabulary needs more).
LIMIT = 18
#: Ids between checkpoints, ids of a block.
LANE, BLOCK = 256, 1 << 20
#: Bytes of a part, and the least for which a part of its own is opened.
PART_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: Units and bytes of units that a worker keeps encoded.
KEPT, KEPT_BYTES = 600_000, 12 << 20
#: Characters that the library encodes at a time.
TOGETHER = 1 << 17

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes between which the library always cuts: letters 1, digits 2, other signs but the apostrophe 4; blanks and all else 0.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 4
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0
# White space beyond ASCII, in UTF-8 (with U+180E, which was white space once).
_OTHER_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate((self.room[: self.n], np.zeros(self.n + 2 * len(values), self.room.dtype)))
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """Ids of texts by the library, with a table of encoded units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # of this worker: Spark runs the tasks side by side
        self.library = Tokenizer.from_file(path)
        special = {i: len(t.content.encode()) for i, t in self.library.get_added_tokens_decoder().items()}
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max([*vocab.values(), *special]) + 1, np.int64)  # bytes of each id
        for token, i in vocab.items():
            self.size[i] = len(token)  # a letter stands for a byte
        for i, n in special.items():
            self.size[i] = n
        strings = [re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()]
        self.apart = re.compile(b"|".join([_OTHER_BLANK.pattern, *strings]))
        self._forget()

    def _forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids, self.start, self.length = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int64)
        self.bytes = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, units: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self.code.update(zip(units, range(self.length.n, self.length.n + len(units)), strict=True))
        self.start.extend(self.ids.n + np.cumsum(counts) - counts)
        self.length.extend(counts)
        self.ids.extend(ids)
        self.bytes += sum(map(len, units))

    def _learn(self, units: list[bytes]) -> None:
        """Encodes new units, many in one text: behind one that doesn't end with white space may stand one that starts with it, or a line feed."""
        for led, mark in ((True, b""), (False, b"\n")):
            some, size = [], 0
            for u in units:
                if not _BLANK[u[-1]] and led == bool(_BLANK[u[0]]):
                    some.append(u)
                    size += len(u)
                    if size >= TOGETHER:
                        self._learn_joined(some, mark)
                        some, size = [], 0
            if some:
                self._learn_joined(some, mark)
        for u in units:
            if _BLANK[u[-1]]:
                ids = self.whole(u.decode())
                self._add([u], ids, np.array([len(ids)]))

    def _learn_joined(self, units: list[bytes], mark: bytes) -> None:
        ids = np.array(self.library.encode_batch_fast([mark.join([*units, b""]).decode()], add_special_tokens=False)[0].ids, np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(np.stack((size, np.full(len(units), len(mark))), 1).ravel())  # of each unit and of the mark behind it
        at = np.cumsum(self.size[ids])
        if at[-1] != ends[-1]:
            raise ValueError("the tokenizer isn't a byte-level one without a normaliser")
        span = np.searchsorted(ends, at)
        own = span % 2 == 0
        self._add(units, ids[own], np.bincount(span[own] // 2, minlength=len(units)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of a column of texts."""
        offsets, data = string_bytes(column)
        n = len(column)
        if self.apart.search(data):
            each = [self.whole(t) if self.apart.search((t or "").encode()) else self.encode(pa.array([t], pa.string()))[0] for t in column.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, n)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if len(self.code) >= KEPT or self.bytes >= KEPT_BYTES:
            self._forget()
        blank, kind = _BLANK[data], _KIND[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = (blank[1:] & ~blank[:-1]) | ((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
        starts[offsets] = True
        at = np.flatnonzero(starts)  # the end of all too
        units = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        known = self.code.get
        code = np.fromiter((known(u, -1) for u in distinct), np.int64, len(distinct))
        new = np.flatnonzero(code < 0)
        units_new = [distinct[i] for i in new]
        self._learn(units_new)
        code[new] = [self.code[u] for u in units_new]
        code = code[units.indices.to_numpy()]
        length = self.length.room[code]
        ends = np.cumsum(length)
        ids = self.ids.room[np.repeat(self.start.room[code] - ends + length, length) + np.arange(ends[-1])]
        before = np.concatenate(([0], ends))[np.searchsorted(at, offsets)]
        return ids, np.diff(before)


_encoders: dict[str, Encoder] = {}


def encoded(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """(doc_id, hash, ids): the ids of every text and the end id as little-endian unsigned 32-bit integers."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            for part in chunks(batch, limit=BATCH_BYTES):
                ids, counts = encoder.encode(part.column("text"))
                after = np.cumsum(counts)
                ids = np.insert(ids, after, end).astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), _binaries(ids, np.concatenate(([0], after + np.arange(1, len(after) + 1))))], ["doc_id", "hash", "ids"])

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text).mapInArrow(run, "doc_id long, hash long, ids binary")


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i] : cuts[i + 1]] as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, cuts) of a column of bytes."""
    column = column.cast(pa.binary())
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    return data.view(kind), (cuts - cuts[0]) // np.dtype(kind).itemsize


def id_counts(rows: DataFrame) -> DataFrame:
    """(id, n) of all ids: each task sends a row for each id it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_values(batch.column("ids"), "<u4")[0])
            if len(found) > len(total):
                found, total = total, found.astype(np.int64)
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    return rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a best prefix code of at most `limit` bits for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64) if counts.sum() > 1 << 55 else counts[order]
    merged, of_leaf = leaves, []
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, packages))
        at = np.argsort(both, kind="stable")
        of_leaf.append(at < n)
        merged = both[at]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for chosen in reversed(of_leaf):  # what is taken of a level: its lightest leaves, and packages of two of the level below
        own = int(chosen[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of (id, length) pairs: shorter codes first, equal lengths by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = int(self.lengths.max(initial=1))
        room = np.left_shift(1, self.limit - self.lengths)
        firsts = np.cumsum(room) - room
        self.codes = firsts >> (self.limit - self.lengths)
        self.room = room

    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and lengths by id, for coding."""
        size = int(self.ids.max(initial=0)) + 1
        codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        codes[self.ids], lengths[self.ids] = self.codes, self.lengths
        return codes, lengths

    def prefixes(self) -> np.ndarray:
        """For every prefix of `limit` bits its id and, in the low 6 bits, its length."""
        out = np.zeros(1 << self.limit, np.uint32)
        filled = np.repeat((self.ids << 6 | self.lengths).astype(np.uint32), self.room)
        out[: len(filled)] = filled
        return out


def coded(ids: np.ndarray, cuts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(payload bytes, byte cuts, gaps, gap cuts) of documents ids[cuts[i] : cuts[i + 1]], none empty."""
    bits = lengths[ids]
    ends = np.cumsum(bits)
    starts = ends - bits
    per_doc = ends[cuts[1:] - 1] - starts[cuts[:-1]]
    byte_cuts = np.concatenate(([0], np.cumsum(-(-per_doc // 8))))
    counts = np.diff(cuts)
    at = starts + np.repeat(byte_cuts[:-1] * 8 - starts[cuts[:-1]], counts)
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros(int(byte_cuts[-1]) // 4 + 3, np.uint32)
    out[word[new]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), new)
    out[word[new] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), new)
    lanes = -(-counts // LANE)
    lane_cuts = np.concatenate(([0], np.cumsum(lanes)))
    lane = np.repeat(cuts[:-1] - lane_cuts[:-1] * LANE, lanes) + np.arange(lane_cuts[-1]) * LANE
    gaps = np.diff(np.append(at[lane], byte_cuts[-1] * 8)).astype("<u2")
    return out.astype(">u4").view(np.uint8)[: byte_cuts[-1]], byte_cuts, gaps, lane_cuts


def decoded(payload: np.ndarray, gaps: np.ndarray, counts: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """The ids of a block, all checkpoints at once."""
    limit = len(prefixes).bit_length() - 1
    b = np.concatenate((payload, np.zeros(4, np.uint8))).astype(np.uint32)
    windows = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    lanes = -(-counts // LANE)
    last = np.cumsum(lanes) - 1
    size = np.full(int(lanes.sum()), LANE, np.int64)
    size[last] = counts - (lanes - 1) * LANE
    order = np.argsort(-size, kind="stable")
    bit = (np.cumsum(gaps, dtype=np.int64) - gaps)[order]
    place = (np.cumsum(size) - size)[order]
    active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # lanes of more than so many ids
    out = np.empty(int(counts.sum()), np.uint32)
    for step, n in enumerate(active.tolist()):
        at = bit[:n]
        found = prefixes[windows[at >> 3] << (at & 7).astype(np.uint32) >> np.uint32(32 - limit)]
        out[place[:n] + step] = found >> 6
        at += found & 63
    return out


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = 0) -> None:
    """Encodes docs with the library's file `tokenizer` and writes the files to the folder `path`."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = written(encoded(docs, tokenizer, end), "ids")
        counts = np.array(sorted(map(tuple, id_counts(rows).collect())), np.int64).reshape(-1, 2)  # bounded by the vocabulary
        lengths = code_lengths(counts[:, 1])
        codes = list(zip(counts[:, 0].tolist(), lengths.tolist(), strict=True))
        spark.createDataFrame(codes, "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
        size = int(counts[:, 1] @ lengths) // 8
        least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES)
        parts = max(1, least, size // PART_BYTES)
        _blocks(rows, *Code(counts[:, 0], lengths).by_id(), parts).write.option("compression", "none").parquet(f"{path}/blocks")


_NULL = -(1 << 63)


def _blocks(rows: DataFrame, codes: np.ndarray, lengths: np.ndarray, parts: int) -> DataFrame:
    """The blocks of encoded rows, dealt to parts by ranges of doc_id; a doc_id of very many rows is dealt by hash as well."""
    spark = rows.sparkSession
    key = F.coalesce("doc_id", F.lit(_NULL))
    steps = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(key, steps, max(10_000, 50 * parts))).first()[0] if steps else []
    bounds = np.array(sorted(found or []), np.int64)
    shared = spark.sparkContext.broadcast((codes, lengths, bounds))  # bounded by the vocabulary and the parts

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths, bounds = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cuts = _values(batch.column("ids"), "<u4")
            payload, byte_cuts, gaps, lane_cuts = coded(ids, cuts, codes, lengths)
            doc = batch.column("doc_id").fill_null(_NULL).to_numpy()
            low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
            share = (batch.column("hash").to_numpy().astype(np.float64) / 2.0**64 + 0.5) * (high - low + 1)
            part = np.where(low == high, low, low + np.minimum(share.astype(np.int64), high - low)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("doc_id"), batch.column("hash"), pa.array(np.diff(cuts).astype(np.int32)), _binaries(gaps, lane_cuts), _binaries(payload, byte_cuts)], ["part", "doc_id", "hash", "n", "gaps", "payload"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, part = 0, [], 0, None
        names = ("doc_id", "n", "gaps", "payload")
        for batch in batches:
            cut = batch.column("part").to_numpy()
            for i, row in enumerate(zip(*[batch.column(c) for c in names], strict=True)):
                n = row[1].as_py()
                if held and (size + n > BLOCK or cut[i] != part):
                    yield _block(part, first, size, held)
                    first, held, size = (first + size if cut[i] == part else 0), [], 0
                part = int(cut[i])
                held.append(row)
                size += n
        if held:
            yield _block(part, first, size, held)

    rows = rows.mapInArrow(code, "part int, doc_id long, hash long, n int, gaps binary, payload binary")
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "hash")
    return rows.mapInArrow(gather, "part int, first long, n_ids long, doc_id array<long>, counts array<int>, gaps binary, payload binary")


def _block(part: int, first: int, size: int, held: list[tuple]) -> pa.RecordBatch:
    doc_id, n, gaps, payload = zip(*held, strict=True)
    joined = [pa.array([b"".join(x.as_py() for x in c)], pa.binary()) for c in (gaps, payload)]
    docs, counts = (pa.array([[x.as_py() for x in c]], pa.list_(t)) for c, t in ((doc_id, pa.int64()), (n, pa.int32())))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), docs, counts, *joined], ["part", "first", "n_ids", "doc_id", "counts", "gaps", "payload"])


def _read(spark: SparkSession, path: str, name: str, kind: str, made: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """(doc_id, start, n_tokens) and made(ids, counts) of every document in the files."""
    bound_batches(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    code = np.array([tuple(r) for r in spark.read.parquet(f"{path}/codes").collect()], np.int64).reshape(-1, 2)  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((code[:, 0], code[:, 1]))
    sums = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect()))  # a row for each part
    before = [0, *np.cumsum([n for _, n in sums]).tolist()]
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, before, strict=False)], "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = None
        for batch in batches:
            for i in range(batch.num_rows):
                prefixes = Code(*shared.value).prefixes() if prefixes is None else prefixes
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                counts = row["counts"].values.to_numpy().astype(np.int64)
                ids = decoded(np.frombuffer(row["payload"].as_buffer(), np.uint8), np.frombuffer(row["gaps"].as_buffer(), "<u2"), counts, prefixes)
                start = pa.array(np.cumsum(counts) - counts + row["first"].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), row["part"].as_py(), np.int32)), row["doc_id"].values, start, pa.array(counts), made(ids, counts)], ["part", "doc_id", "first", "n_tokens", name])

    out = blocks.select("part", "first", "doc_id", "counts", "gaps", "payload").mapInArrow(run, f"part int, doc_id long, first long, n_tokens long, {name} {kind}")
    return out.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", name)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids in the files, and how many ids of other documents stand before them."""
    return _read(spark, path, "ids", "array<int>", lambda ids, counts: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids.astype(np.int32))))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the same with a checksum of the ids as little-endian unsigned 32-bit integers."""

    def sums(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        data, cuts = memoryview(ids.astype("<u4").tobytes()), [0, *(4 * np.cumsum(counts)).tolist()]
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64())

    return _read(spark, path, "ids_crc32", "long", sums)


def op11_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "huffman")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_digests(spark, path)


QUERIES = {"op11_huffman_ids": op11_huffman_ids}
ORACLE: dict[str, str] = {}
