"""Token files, sort-means and Merkle proofs against brute force."""

import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jurata.llm import _store, merkle, sort_means, token_files

from . import corpus

P = pytest.importorskip("public_tokenizers")
ODD = ["", "a", "  ", "a  b\n\n c's don't 's' x's--t 12ab3,4 <|endoftext|>y <|endoftext|>", "http://a.b/c?d=1&e=2'll", "a   b", "ä ö,ü.x é1", "中文 字,  符。x　y ", "\x1c a.\x1c b\x0b\x0c c", "a'b 'c d'' e'.f", "_a_b-c 1_2", "   \n x", "a   b", "x" * 2000, "   q", "é" * 50, "1,2.3;4"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_encoder(library, monkeypatch):
    """Units give the library's ids, whatever stands beside them, and also when the table of units is emptied."""
    rng = random.Random(2)
    letters = "ab Z1,.'\n\t-é中 <|>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for kept in (token_files.KEPT, 1):
        monkeypatch.setattr(token_files, "KEPT", kept)
        encoder = token_files.Encoder(P.path("byte_bpe_50k.json"))
        for at in range(0, len(texts), 50):
            ids, counts = encoder.encode(pa.array(texts[at : at + 50]))
            assert counts.tolist() == [*map(len, want[at : at + 50])] and ids.tolist() == sum(want[at : at + 50], [])


def test_code_lengths():
    """Best lengths under a limit, against all lengths that a prefix code may have."""
    rng = random.Random(3)
    for _ in range(60):
        n, limit = rng.randint(2, 6), rng.randint(3, 5)
        counts = np.array([rng.choice([1, 1, 2, 3, 5, 8, 100, 1000]) for _ in range(n)], np.int64)
        got = token_files.code_lengths(counts, limit)
        best = min(int(counts @ np.array(x)) for x in itertools.product(range(1, limit + 1), repeat=n) if sum(2.0**-k for k in x) <= 1)
        assert got.max() <= limit and sum(2.0 ** -got.astype(float)) <= 1 and int(counts @ got) == best
    assert token_files.code_lengths(np.array([7])).tolist() == [1] and len(token_files.code_lengths(np.zeros(0, np.int64))) == 0
    assert token_files.code_lengths(np.arange(1, 300), 4).max() == 9  # as long as the alphabet needs


def test_coding_round_trip():
    rng = np.random.default_rng(4)
    for n_ids in (1, 2, 50, 5000):
        weights = 1 / np.arange(1, n_ids + 1) ** 1.5
        counts = rng.integers(1, 900, 25)
        counts[:3] = 1, token_files.LANE, token_files.LANE + 1
        ids = rng.choice(np.sort(rng.choice(50000, n_ids, replace=False)), counts.sum(), p=weights / weights.sum())
        found = np.bincount(ids)
        code = token_files.Code(np.flatnonzero(found), token_files.code_lengths(found[found > 0]))
        cuts = np.concatenate(([0], np.cumsum(counts)))
        payload, byte_cuts, gaps, lane_cuts = token_files.coded(ids, cuts, *code.by_id())
        assert (token_files.decoded(payload, gaps, counts, code.prefixes()) == ids).all()
        for i in (0, 7, 24):  # each document by itself
            own = token_files.decoded(payload[byte_cuts[i] : byte_cuts[i + 1]], gaps[lane_cuts[i] : lane_cuts[i + 1]], counts[i : i + 1], code.prefixes())
            assert (own == ids[cuts[i] : cuts[i + 1]]).all()
        codes = ["".join(str(c >> (n - 1 - b) & 1) for b in range(n)) for c, n in zip(code.codes.tolist(), code.lengths.tolist(), strict=True)]
        assert not any(b.startswith(a) for a, b in itertools.pairwise(sorted(codes)))  # a prefix code


def test_token_files(spark, library, tmp_path, monkeypatch):
    """Nulls, repeated ids, clashing names, many parts and small blocks: what is read is what the library gives, in order."""
    rows = corpus.documents() + [(500 + i, t, "en", "s", 0, "x") for i, t in enumerate(ODD)] + [(7, "other text of a repeated id", "en", "s", 0, "x")] + [(None, f"many texts {i}", "en", "s", 0, "x") for i in range(200)]
    docs = corpus.frame(spark, rows)
    encode = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    for k, (least, part, block) in enumerate(((token_files.LEAST_BYTES, token_files.PART_BYTES, token_files.BLOCK), (1 << 10, 4 << 10, 300))):
        monkeypatch.setattr(token_files, "LEAST_BYTES", least)
        monkeypatch.setattr(token_files, "PART_BYTES", part)
        monkeypatch.setattr(token_files, "BLOCK", block)
        path = f"{tmp_path}/files{k}"
        token_files.write_ids(docs, P.path("byte_bpe_50k.json"), path)
        got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r.start)
        assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((d is not None, d or 0) for d, *_ in rows)
        assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((str(d), tuple(encode(t))) for d, t, *_ in rows)
        assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
        sums = {(r.start, r.doc_id): r.ids_crc32 for r in token_files.read_digests(spark, path).collect()}
        assert sums == {(r.start, r.doc_id): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
        blocks = spark.read.parquet(f"{path}/blocks")
        assert k == 0 or (blocks.select("part").distinct().count() > 2 and blocks.where("size(doc_id) > 1 and n_ids > 300").isEmpty() and blocks.where("part = 0").count() < blocks.count() / 2)
    token_files.write_ids(docs.where("false"), P.path("byte_bpe_50k.json"), f"{tmp_path}/none")
    assert token_files.read_ids(spark, f"{tmp_path}/none").count() == 0
    token_files.write_ids(docs.where("text is null"), P.path("byte_bpe_50k.json"), f"{tmp_path}/one")
    assert [tuple(r) for r in token_files.read_digests(spark, f"{tmp_path}/one").collect()] == [(0, 0, 1, zlib.crc32(bytes(4)))]


def lloyd(vectors, k, rounds):
    """(clusters, distances, centroids) by plain loops over (id, integers)."""
    order = sorted(range(len(vectors)), key=lambda i: (hashlib.sha256(f"3:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    cents = [vectors[i][1] for i in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in vectors]
    for _ in range(rounds):
        at = assign()
        for n in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(vectors, at, strict=True) if c == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign(), cents


def test_sort_means(spark, monkeypatch):
    """Against plain loops: ties, equal vectors, negative components, small blocks, vectors that take no part."""
    monkeypatch.setattr(sort_means, "BLOCK", 7)
    rng = random.Random(5)
    centres = [[rng.uniform(-3, 3) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in rng.choice(centres)]) for i in range(300)] + [(300 + i, [float(rng.randint(-1, 1)) for _ in range(8)]) for i in range(80)]
    rows += [(3, rows[3][1]), (3, rows[4][1])]
    bad = [(900, None), (901, []), (902, [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [1e300] * 8), (907, [200000.0] * 8)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows + bad)], "vec_id long, embedding array<double>, cluster int").repartition(3)
    vectors = sort_means.integers(df, 8).cache()
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    assert sorted(map(str, vectors.collect())) == sorted(f"Row(vec_id={i}, v={v})" for i, v in kept)
    for k in (8, 1, 30):
        found = sort_means.sort_means(vectors, sort_means.first_centroids(vectors, k, "3"), 4)
        at, cents = lloyd(kept, k, 4)
        assert found.centroids.tolist() == cents
        assert sorted(map(tuple, found.rows.collect())) == sorted((i, c, d) for (i, _), (d, c) in zip(kept, at, strict=True))
        assert found.sums == [sum(d for d, c in at if c == n) for n in range(k)]
        if k == 30:
            assert found.measured[-1] < 0.7 * k * len(kept)  # most centroids are left out
    few = vectors.where("vec_id < 3")
    found = sort_means.sort_means(few, sort_means.first_centroids(few, 8, "3"), 2)
    assert len(found.centroids) == 3 and {r.distance for r in found.rows.collect()} == {0}
    none = vectors.where("false")
    assert sort_means.sort_means(none, sort_means.first_centroids(none, 8, "3"), 2).rows.count() == 0


def test_assigned():
    """No tie is lost where a centroid is exactly twice as far as the previous one."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        x, cents = rng.integers(-3, 4, (40, 2)), rng.integers(-3, 4, (6, 2))
        d = ((x[:, None] - cents[None]) ** 2).sum(2)
        label, best, measured = sort_means.assigned(x, rng.integers(0, 6, 40), cents)
        assert (label == d.argmin(1)).all() and (best == d.min(1)).all() and measured <= d.size
    big = np.full((1, 64), (1 << 27) - 1)
    assert sort_means.assigned(big, np.zeros(1, np.int64), np.stack((-big[0], big[0])))[0].tolist() == [1]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """(root, the siblings of each leaf as (left, right) a level)."""
    level, paths = [(h, [i]) for i, h in enumerate(leaves)], [[] for _ in leaves]
    while len(level) > 1:
        up = []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for j, (_, own) in enumerate(run):
                for i in own:
                    paths[i].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            up.append((sha("".join(h for h, _ in run)), [i for _, own in run for i in own]))
        level = up
    return level[0][0], paths


def test_merkle(spark, tmp_path):
    """Groups of all sizes around the levels, null groups and keys, repeated rows: digests, proofs, and what tampering does."""
    docs = [(d, t, "en", s, n) for d, t, _, s, n, _ in corpus.documents()] + [(None, "x\ny", None, None, None), (None, None, None, None, None)]
    docs += [(1000 * g + i, f"t\n{i}", "de", f"g{g}", i) for g, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 250)) for i in range(n)] + [(2**40, "é\n", "fr", "é", 3), (2**41, "z", "fr", "￿", 3), (2**42, "z", "fr", "\U00010000", 3)]
    rows = [(*r, "clash") for r in docs]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, level string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    leaf = lambda d, t, lang, s, n: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, lang, n, t)))
    groups = {}
    for r in docs:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        built[s] = (own, *tree([leaf(*r) for r in own]))
    root, tops = tree([built[s][1] for s in names])
    want = []
    for s, top in zip(names, tops, strict=True):
        own, subroot, paths = built[s]
        for r, path in zip(own, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r[0], r[1].replace("\n", "") if bad else r[1], *r[2:])
            for left, right in path + top:
                node = sha(left + node + right)
            want.append((r[0], leaf(*r), subroot, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {v for *_, v in got} == {True, False}
    for name, part in (("one", "doc_id = 1"), ("none", "false")):
        spark.read.parquet(f"{folder}/documents.parquet").where(part).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    (one,) = merkle.op13_merkle_manifest(spark, f"{tmp_path}/one").collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")
    assert merkle.op13_merkle_manifest(spark, f"{tmp_path}/none").count() == 0


def test_tables_of_a_call(spark, tmp_path):
    """What one call writes is deleted with it, and nothing that another thread or the caller wrote."""
    import threading

    kept = _store.written(spark.range(5).toDF("id"), "kept")
    other, go, done = [], threading.Event(), threading.Event()

    def beside():
        other.append(_store.written(spark.range(7).toDF("id"), "beside"))
        go.set()
        done.wait(60)

    t = threading.Thread(target=beside)

    def make():
        inner = _store.written(spark.range(3).toDF("id"), "inner")
        t.start()
        go.wait(60)
        return inner.where("id > 0")

    spent = []
    out = _store.settled(make, "out", spent)
    done.set()
    t.join()
    assert (out.count(), kept.count(), other[0].count()) == (2, 5, 7) and len(spent) == 1
    again = _store.settled(lambda: out.where("id > 1"), "again", spent)
    assert again.count() == 1 and not os.path.exists(out.inputFiles()[0].removeprefix("file://"))
    with pytest.raises(ZeroDivisionError):
        _store.settled(lambda: _store.written(spark.range(3), "left") and 1 / 0, "failed")
    assert again.count() == 1 and not [f for f in os.listdir(_store.shared_folder(spark).removeprefix("file://") + "/jurata") if f.startswith("left-")]


def test_stage_tables(spark, tmp_path):
    """After a run of the pipeline the last stage's input is the only stage table there."""
    import corpus_pipeline as C

    folder = _store.shared_folder(spark).removeprefix("file://") + "/jurata"
    before = {f for f in os.listdir(folder) if f.startswith("stage-")} if os.path.isdir(folder) else set()
    out = C.run(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    left = {f for f in os.listdir(folder) if f.startswith("stage-")} - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-decontamination-") and out.where(F.col("doc_id").isNotNull()).count() > 0


def test_common_lines_of_items(spark):
    """A benchmark whose items share a line, and documents that hold it: candidates in proportion to matches, no match lost."""
    from jurata.llm import decontamination

    from .test_documents import shingles

    rng = random.Random(31)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = "answer the next question in one word".split()
    items = [(i, " ".join(line + w((5, 12, 33, 100)[i % 4]))) for i in range(400)]
    docs = [(i, " ".join(w(30) + line + w(60))) for i in range(500)]
    docs += [(1000 + i, " ".join(w(20) + t.split() + w(40))) for i, t in items[::10]] + [(2000 + i, " ".join(t.split()[: -max(1, len(t.split()) // 20)])) for i, t in items[::20]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    sets, asked = [(d, shingles(t)) for d, t in docs], [(i, shingles(t)) for i, t in items]
    want = sorted((d, i, len(q), len(q & s)) for d, s in sets for i, q in asked if 100 * len(q & s) >= 80 * len(q))
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contaminated(df, bench).collect()) == want
    assert {i for d, i, *_ in want if d >= 1000} >= {i for i, _ in items[::10]}
    assert decontamination.candidates(df, decontamination.numbered_items(bench)).count() <= 3 * len(want)


def test_forest_prunes():
    """Clustered vectors: a query measures at most a twentieth of the rows at a recall of 0.9 or more, fewer in a larger segment."""
    from jurata.llm import forest

    shares = []
    for n in (8000, 16000):
        rng = np.random.default_rng(12)
        centres = rng.standard_normal((n // 40, 64))
        x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.standard_normal((n, 64))
        segment = forest.Segment(np.arange(n), x, forest._planes(64), 10)
        asked = np.arange(0, n, n // 100)
        got = {}
        for q, j, _ in segment.search(asked, x[asked], forest._planes(64), 10, max(forest.LEAST, forest.SHARE * n)):
            got.setdefault(q, set()).add(j)
        hit = 0
        for q in asked.tolist():
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
        assert hit >= 0.9 * 10 * len(asked)
        shares.append(segment.measured / (len(asked) * n))
    assert shares[0] <= 0.05 and shares[1] <= 0.6 * shares[0], shares
