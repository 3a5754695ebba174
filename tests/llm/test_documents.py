"""Operators over documents against brute force on a small corpus."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from jurata.llm import decontamination, hilbert, near_dedup, quality, sentencepieces, substring_dedup, token_counts

from . import corpus

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(rows, percent):
    own = {d: shingles(t) for d, t, *_ in rows if d is not None}
    top = {d: d for d in own}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(own[a] & own[b])
            if both and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: root(d) for d in ids}, own


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent):
    rows = corpus.documents()
    want, own = classes(rows, percent)
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(own[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(want) - 20
    assert [r.component_id for r in got if r.doc_id is None] == [5]


def test_blocks_find_links_that_pivots_miss(spark):
    """A chain: neighbours are linked, the pivot of their bucket is linked with few of them."""
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w), "en", "s", 0, ""))
        for _ in range(3):
            w[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
    want, _ = classes(rows, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(corpus.frame(spark, rows), 85).collect()}
    assert got == want and set(want.values()) == {0}


def test_posterior_bound():
    least = near_dedup.least_matches(0.85, 1e-6)
    rng = np.random.default_rng(0)
    hits = rng.random((20000, near_dedup.PERMS)) < 0.85
    totals = np.cumsum(hits, 1)[:, near_dedup.STEP - 1 :: near_dedup.STEP]
    assert (totals >= np.array(least)).all(1).mean() > 0.999 and least[0] > 5


def removed(rows, width=50):
    first = {}
    split = {d: (t or "").encode().split() for d, t, *_ in rows if d is not None}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_repeated_words(docs):
    want = removed(corpus.documents())
    got = substring_dedup.repeated_words(docs).collect()
    assert len(got) == len(corpus.documents())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3]
        else:
            assert r.n_removed == 0
    assert sum(v[1] > 0 for v in want.values()) > 20


def test_without_repeats(docs):
    want = removed(corpus.documents())
    out = substring_dedup.without_repeats(docs)
    assert set(out.columns) == set(docs.columns)
    for r in out.collect():
        if r.doc_id is not None:
            original = dict((d, t) for d, t, *_ in corpus.documents())[r.doc_id]
            assert r.text == (want[r.doc_id][3] if want[r.doc_id][1] else original)


def test_contamination(spark, docs):
    rows = corpus.documents()
    texts = {d: t for d, t, *_ in rows if d is not None}
    long = texts[8].split()
    items = [(1, " ".join(long[4000:4040])), (2, " ".join(long[100:130] + ["q"] + long[131:160])), (3, "one"), (4, "a B c d"), (5, None), (6, ""), (7, "never seen " * 9), (8, " ".join(long[7000:7300])), (9, " ".join(long[50:57])), (1, " ".join(long[4000:4040]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = Counter()
    for d, t, *_ in rows:
        for i, q in {*items}:
            s = shingles(q)
            if s and 100 * len(s & shingles(t)) >= 80 * len(s):
                want[d, i, len(s), len(s & shingles(t))] += 1
    got = Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contaminated(docs, bench).collect())
    assert got == want and {i for _, i, *_ in want} == {1, 2, 3, 4, 8, 9}
    gone = {d for d, *_ in want}
    clean = decontamination.without_items(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, *_ in rows if d not in gone and d is not None)


def test_blocks_of_items(spark, docs, monkeypatch):
    """Bitmaps too small for the items and one item to a row give the same result."""
    items = [(i, " ".join(t.split()[:30])) for i, t, *_ in corpus.documents()[9:40] if t and len(t.split()) > 40]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 1)
    monkeypatch.setattr(decontamination, "MARK_BYTES", 1)
    assert whole and sorted(map(tuple, decontamination.contaminated(docs, bench).collect()), key=str) == whole


def test_scattered_items(spark):
    """Items whose shingles lie one by one all over a long document, and one that is repeated wholly at its end."""
    rng = random.Random(13)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [w(rng.choice([7, 11, 25, 60, 200])) for _ in range(40)]
    rows = []
    for i, item in enumerate(items):
        text = w(2000)
        for k in range(len(item) - 4):
            text += item[k : k + 5] + w(rng.choice([1, 3]) if i % 2 else 20)
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(w(3000) + item)) for i, item in enumerate(items)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, text_id string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    assert {(100 + i, i) for i in range(40)} <= got and len(got & {(i, i) for i in range(40)}) >= 39
    clean = decontamination.without_items(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = [rng.choice(["the", "of", "river", "stone", "walks", "slowly"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w), "en", "s", 0, ""))
        labels.append((i, int(good), 0))
    rows += [(900, None, "en", "s", 0, ""), (901, "", "en", "s", 0, ""), (None, "The river.", "en", "s", 0, "")]
    docs = corpus.frame(spark, rows)
    marks = spark.createDataFrame([*labels, (900, None, 0), (None, 1, 0), (0, labels[0][1], 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.97
    kept = quality.accepted(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id in truth} == {r.doc_id for r in got if r.predicted and r.doc_id in truth}


def test_quality_learns_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert (2, 7) in m.pairs and np.mean((m.score(x[2000:]) >= 0.5) == y[2000:]) > 0.9


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.scored(docs, one).collect())


def test_features_of_nothing():
    import pyarrow as pa

    assert quality.features(pa.array([None, ""])).sum() == 0


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["", "<|endoftext|>a<|endoftext|><|endoftext|>", "a" * 5000, "日本語テキスト👩‍👩‍👧  x", "I'll we've ' 's"] + ["".join(rng.choice("ab éñ日١२'!? \n　\x85") for _ in range(150)) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("n_bytes", corpus_literal())
    got = token_counts.token_counts(df, path, P.PATTERN, limit=50).collect()
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 50)
    assert token_counts.token_counts(docs, path, P.PATTERN).count() == len(corpus.documents())


def corpus_literal():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_pieces(spark, docs):
    import sentencepiece

    rng = random.Random(3)
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    pieces = sentencepieces.Pieces.load(P.path("piece_bpe_32k.model"))
    texts = ["", " ", "a▁b", "\x00a\n\n b", "日本語👩‍👩‍👧  x", "x" * 300, " " * 40 + "y" * 70 + ".,;" * 40, "e²..²a", "<s> don't http://a.b/c?d=e" + " " * 20] + ["".join(rng.choice("ab éñ日१theing.,!'\"-=()🎉\n　") for _ in range(120)) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    got = sentencepieces.encoded(df, pieces)
    for r in got.collect():
        text = texts[r.doc_id] if r.doc_id is not None else ""
        assert list(r.ids) == m.encode(text) and r.n_pieces == len(r.ids) and r.round_trip
    back = sentencepieces.decoded(got, pieces).collect()
    assert {r.doc_id: r.text for r in back} == {i: t.replace("▁", " ") for i, t in enumerate(texts)} | {None: ""}
    units = sorted({u for t in texts for u in pieces.unit.findall("▁" + t.replace(" ", "▁"))})
    table = spark.createDataFrame([(u,) for u in units], "unit string")
    assert all(list(r.ids) == pieces.merged(r.unit) for r in sentencepieces.unit_ids(table, pieces).collect())


def test_pieces_decoded(spark, monkeypatch):
    """Every document's ids are decoded and compared with its text."""
    pieces = sentencepieces.Pieces.load(P.path("piece_bpe_32k.model"))
    texts = ["a▁b", "a b", " a", "▁a", "", None, "日本語👩 x"]
    got = sentencepieces.encoded(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), pieces)
    back = {r.doc_id: r.text for r in sentencepieces.decoded(got, pieces).collect()}
    assert all(r.round_trip and r.exact == (back[r.doc_id] == (texts[r.doc_id] or "")) == (r.doc_id not in (0, 3)) for r in got.collect())
    read = sentencepieces._read
    monkeypatch.setattr(sentencepieces, "_read", lambda ids, spelled: read(ids[:-1], spelled))  # a last piece is lost
    got = sentencepieces.encoded(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), pieces)
    assert [r.doc_id for r in got.collect() if r.round_trip or r.exact] == [4, 5]


def test_every_unit_goes_through_the_lattice(spark, monkeypatch):
    """Ids of rare units come from the lattice too, in whatever chunk their text is."""
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    pieces, model = sentencepieces.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sentencepieces, "CHUNK", 300)
    monkeypatch.setattr(sentencepieces, "KEPT", 5)
    monkeypatch.setattr(sentencepieces.Pieces, "merged", None)  # no way beside the lattice
    texts = [f"rare{i}word common zq{i * i}x, \u4e2d{i}" for i in range(60)] + ["", None, "common", "common"]
    got = sentencepieces.encoded(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), pieces).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: model.encode(t or "") for i, t in enumerate(texts)} and all(r.exact for r in got)

def test_units_end_where_no_piece_goes_on(spark):
    """Characters that no piece has side by side are cut apart (fewer distinct units), and rows travel as compressed blocks."""
    pieces = sentencepieces.Pieces(((3, "▁", -2.0), (4, "a", -3.0), (5, "1", -3.5), (6, "▁a", -4.0), (7, "b", -5.0), (8, "ab", -6.0)), (), 0, bpe=True)
    assert pieces.unit.findall("▁ab1a▁▁ab日本b") == ["▁ab", "1", "a", "▁", "▁ab", "日", "本", "b"]
    units, words = pieces.unit.cut(["▁é1", "", "▁a"])
    assert units.to_pylist() == ["▁", "é", "1", "▁a"] and words.tolist() == [3, 0, 1]
    rows = spark.createDataFrame([(i % 3, i, "same text " * 50) for i in range(3000)], "chunk int, doc_id long, text string").coalesce(2)
    blocks = sentencepieces._packed(rows).collect()
    assert len(blocks) == 6 and sum(len(b.block) for b in blocks) < 3000 * 500 / 10
    import pyarrow as pa

    back = sentencepieces._unpacked(pa.table([[bytes(b.block) for b in blocks]], ["block"]))
    assert sorted(back.column("doc_id").to_pylist()) == [*range(3000)]


def test_viterbi(spark):
    """A unigram model: the best-scored path, against all paths."""
    rows = ((3, "▁", -2.0), (4, "a", -3.0), (5, "b", -3.5), (6, "ab", -4.0), (7, "▁a", -4.5), (8, "ba", -3.9), (9, "aba", -9.0))
    pieces = sentencepieces.Pieces(rows, (), 0, bpe=False)
    score = {p: (s, i) for i, p, s in rows}

    def best(u):
        if not u:
            return (0.0, [])
        return max(((score[u[:k]][0] + best(u[k:])[0], [score[u[:k]][1], *best(u[k:])[1]]) for k in range(1, len(u) + 1) if u[:k] in score), default=(float("-inf"), []))

    units = ["▁abab", "aabba", "ba", "a", "▁", "▁ababab"]
    got = {r.unit: list(r.ids) for r in sentencepieces.unit_ids(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}
    for u in units:
        assert sum(dict((i, s) for i, _, s in rows)[x] for x in got[u]) == pytest.approx(best(u)[0]) and pieces.merged(u) == got[u]


def test_hilbert(spark, docs):
    import itertools

    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = hilbert.curve_index(cells, bits)
        order = cells[np.argsort(index)]
        assert sorted(index) == list(range(len(cells))) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    rows = corpus.documents()
    got = hilbert.sharded(docs, ["lang", "source", "size"], 7).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    texts = {d: t or "" for d, t, *_ in rows if d is not None}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got if r.doc_id is not None)
    spot = {}
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        spot.setdefault(r.text_crc32, []).append(sum(sizes[s] for s in range(r.shard)) + r.slot)
    assert all(v == list(range(v[0], v[0] + len(v))) for v in spot.values())  # copies lie next to each other


def test_write_shards(spark, docs, tmp_path):
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    hilbert.write_shards(own, hilbert.sharded(own, ["source"], 4), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == own.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    pieces = sentencepieces.Pieces.load(P.path("piece_bpe_32k.model"))
    for out in (near_dedup.near_duplicates(empty), substring_dedup.repeated_words(empty), substring_dedup.without_repeats(empty), decontamination.contaminated(empty, none), decontamination.without_items(empty, none), quality.scored(empty, marks), quality.accepted(empty, marks), hilbert.sharded(empty, ["lang", "size"]), sentencepieces.encoded(empty, pieces), token_counts.token_counts(empty, P.path("byte_bpe_50k.json"), P.PATTERN)):
        assert out.count() == 0


def test_rows_of_one_document(spark):
    """Rows of one doc_id with different texts are judged each by itself, and helper names may be taken."""
    rng = random.Random(5)
    w = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = w(60), w(55)
    rows = [(1, passage), (2, f"a b {passage} c"), (2, "short text of its own"), (2, f"{other} {passage}"), (3, f"x {other}"), (3, f"x {other}"), (None, passage)]
    names = ["doc_id", "text", "_id", "_kept", "text_id", "KEPT_TEXT", "kept_doc_id", "anchor"]
    df = spark.createDataFrame([(d, t, i, f"k{i}", i, "x", i, "y") for i, (d, t) in enumerate(rows)], "doc_id long, text string, _id int, _kept string, text_id int, KEPT_TEXT string, kept_doc_id int, anchor string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_words(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter([(1, 60, 0, sha(passage)), (2, 63, 60, sha("a b c")), (2, 5, 0, sha("short text of its own")), (2, 115, 60, sha(other)), (3, 56, 55, sha("x")), (3, 56, 55, sha("x")), (None, 60, 0, sha(passage))])
    out = substring_dedup.without_repeats(df)
    assert out.columns == names
    assert sorted((r["_id"], r.doc_id, r["_kept"], r.text) for r in out.collect()) == [(0, 1, "k0", passage), (1, 2, "k1", "a b c"), (2, 2, "k2", rows[2][1]), (3, 2, "k3", other), (4, 3, "k4", "x"), (5, 3, "k5", "x"), (6, None, "k6", passage)]


def test_places_in_parts(spark, docs, monkeypatch):
    """A source document with more places than one part takes gives the same result."""
    whole = sorted(map(tuple, substring_dedup.repeated_words(docs).collect()), key=str)
    monkeypatch.setattr(substring_dedup, "PLACES", 3)
    assert sorted(map(tuple, substring_dedup.repeated_words(docs).collect()), key=str) == whole


@pytest.mark.parametrize("block", [4, 512])
def test_blocks_in_rounds(spark, monkeypatch, block):
    """Buckets with many pairs just below and just above the threshold: pairs that aren't confirmed don't hide links behind them."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block * 1000)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    edited = lambda w, n: [f"n{rng.randrange(10**6)}" if k in at else x for at in [set(rng.sample(range(200), n))] for k, x in enumerate(w)]
    groups = [edited(base, 3) for _ in range(6)]
    for i in range(60):
        rows.append((i, " ".join(edited(groups[i % 6], rng.choice([1, 2, 2, 3]))), "en", "s", 0, ""))
    want, _ = classes(rows, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(corpus.frame(spark, rows), 85).collect()}
    assert got == want and 6 <= len(set(want.values())) < 50


def test_documents_with_several_texts(spark):
    """A doc_id is one document, linked with what any of its texts is linked with; repeated rows change nothing."""
    rng = random.Random(12)
    w = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two = w(80), w(80)
    rows = [(1, one), (2, one + " x"), *[(2, one + " x")] * 5, (2, two), (3, two + " y"), (None, one)]
    df = spark.createDataFrame([(d, t, i, 0) for i, (d, t) in enumerate(rows)], "doc_id long, text string, text_id int, rep int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 85).collect())
    assert got == Counter([(1, 76, 1, True), *[(2, 77, 1, False)] * 6, (2, 76, 1, False), (3, 77, 1, False), (None, 76, 1, False)])


def plain_fit(x, y):
    """The same boosting, bin by bin in plain loops: every stump by trying all cuts."""

    def stump(g, h, depth):
        total = sum(g) / (sum(h) + 1)
        best = sum(g) ** 2 / (sum(h) + 1) + 1e-9, None
        for at in range(1, len(g)) if depth else ():
            gain = sum(sum(a) ** 2 / (sum(b) + 1) for a, b in ((g[:at], h[:at]), (g[at:], h[at:])))
            if gain > best[0] + 1e-12:
                best = gain, at
        return [total] * len(g) if best[1] is None else stump(g[: best[1]], h[: best[1]], depth - 1) + stump(g[best[1] :], h[best[1] :], depth - 1)

    rate = sum(y) / len(y)
    base = np.log(rate / (1 - rate))
    cuts = [sorted({np.float32(np.quantile(x[:, j], k / quality.BINS)) for k in range(1, quality.BINS)}) for j in range(x.shape[1])]
    bins = [[sum(c <= v for c in cuts[j]) for v in x[:, j]] for j in range(x.shape[1])]
    tables, z = [[0.0] * (len(c) + 1) for c in cuts], [base] * len(y)
    for _ in range(quality.ROUNDS):
        for j, t in enumerate(tables):
            g, h = [0.0] * len(t), [0.0] * len(t)
            for i, v in enumerate(z):
                p = 1 / (1 + np.exp(-v))
                g[bins[j][i]] += y[i] - p
                h[bins[j][i]] += p * (1 - p)
            step = [quality.RATE * s for s in stump(g, h, 2)]
            tables[j] = [a + b for a, b in zip(t, step, strict=True)]
            z = [v + step[bins[j][i]] for i, v in enumerate(z)]
    return base, cuts, tables


def test_quality_against_plain_loops(monkeypatch):
    """fit() and Model.score() without pairs against loops over rows and bins."""
    monkeypatch.setattr(quality, "ROUNDS", 3)
    monkeypatch.setattr(quality, "PAIRS", 0)
    monkeypatch.setattr(quality, "BINS", 6)
    rng = np.random.default_rng(4)
    x = rng.random((150, 5)).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.random(150) > 0.7).astype(float)
    m = quality.fit(x, y)
    base, cuts, tables = plain_fit(x, y)
    assert m.base == pytest.approx(base) and all(np.allclose(a, b) for a, b in zip(m.mains, tables, strict=True))
    want = [1 / (1 + np.exp(-(base + sum(t[sum(c <= v for c in cuts[j])] for j, (t, v) in enumerate(zip(tables, row, strict=True)))))) for row in x]
    assert np.allclose(m.score(x), want)


def test_quality_sample(spark):
    """The documents learnt from are the first by hash, whatever their number."""
    df = spark.createDataFrame([(i, f"text {i} " * (i % 9 + 1)) for i in range(3000)] + [(5, "other text")], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 9 > 4)) for i in range(2, 2900)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda x, y: seen.append(len(y)) or fit(x, y)
    try:
        for n in (10**6, 300):
            quality.fitted(df, marks, n)
    finally:
        quality.fit = fit
    assert seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(2, 2900)), 300]


def test_write_every_row(spark, docs, tmp_path):
    """Rows without doc_id and of one doc_id are written, once each."""
    rows = hilbert.numbered(docs)
    hilbert.write_shards(rows, hilbert.sharded(rows, ["source"], 4, keep=("row",)), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect())) and set(back.columns) == {*docs.columns, "shard"}
    with pytest.raises(ValueError, match="repeated"):
        hilbert.write_shards(docs, hilbert.sharded(docs, ["source"], 4), f"{tmp_path}/no")


def test_shards_follow_the_curve(spark):
    """Places against brute force: cells by the same cuts, texts that share long prefixes in cells of their own, the order of (curve, digest, doc_id) cut in equal runs."""
    rng = random.Random(14)
    hosts = [f"https://www.example.com/a/long/common/prefix/{k:03d}" for k in range(64)]
    rows = [(i, f"text {i}", rng.choice(hosts), rng.randrange(1000)) for i in range(640)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, n int").repartition(3)
    got = hilbert.sharded(df, ["host", "n"], 8).collect()
    cuts_host = hilbert._text_cuts(df, "host")
    assert len(cuts_host) > 24 and cuts_host == sorted(cuts_host)
    cuts_n = sorted(set(df.selectExpr(f"percentile_approx(n, array({', '.join(str(i / 32) for i in range(1, 32))}), 10000) AS p").first().p))
    cell = {i: (sum(c <= h for c in cuts_host), sum(c <= n for c in cuts_n)) for i, _, h, n in rows}
    full = [(x, y) for x in range(32) for y in range(32)]
    index = dict(zip(full, hilbert.curve_index(np.array(full)).tolist(), strict=True))
    assert all(r.curve == index[cell[r.doc_id]] for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert [(r.shard, r.slot) for r in order] == [(k * 8 // 640, k % 80) for k in range(640)]
    spread = Counter(x for x, _ in cell.values())
    assert max(spread.values()) <= 3 * len(rows) / 32
