"""Chat formatting, URL filters, nearest neighbours and the pipeline, against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest

from jurata.llm import chat, forest, near_dedup, quality, url_filter

from . import corpus
from .test_documents import classes, removed, shingles


def test_chat(spark):
    rng = random.Random(4)
    said = [("user", "hi"), ("assistant", "yes"), ("user", None), (None, ""), ("assistant", "yes|user"), ("user", "")]
    convs = {}
    for i in range(80):
        if i > 10 and rng.random() < 0.6:
            old = convs[rng.choice(list(convs))]
            convs[i] = (old + [rng.choice(said)] * rng.randint(0, 2))[: rng.randint(1, 9)]
        else:
            convs[i] = [rng.choice(said) for _ in range(rng.randint(1, 4))]
    rows = [(c, t, r, x, "extra") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame([*rows, *rows[:9], (None, 0, "user", "hi", "")], "conv_id long, turn long, role string, text string, hashes string").repartition(3)
    got = {r.conv_id: r for r in chat.chat_documents(df).collect()}
    want = {}
    for c, turns in convs.items():
        if any(o[: len(turns)] == turns and len(o) > len(turns) for o in convs.values()):
            continue
        same = [k for k, o in convs.items() if o == turns]
        want[min(same)] = (len(turns), len(same), "\n".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>" for r, x in turns))
    assert {k: (r.n_turns, r.n_copies, r.text) for k, r in got.items()} == want
    assert chat.chat_documents(df.where("false")).count() == 0


def test_url_filter(spark):
    rng = random.Random(6)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    domains = ["example.com", "a.example.com", "b.a.example.com", "org", "x.org", "10.0.0.1"]
    entries = [(rng.choice([*domains, "EXAMPLE.com"]), day(rng.randrange(100)), rng.choice(["block", "allow", "drop"])) for _ in range(60)]
    entries += [(None, day(1), "block"), ("x.org", None, "block"), ("x.org", day(2), None)]
    urls = ["http://example.com/x", "https://u:p@B.a.Example.com:80/?q=@", "ftp://z.x.org#f", "no url", None, "http://10.0.0.1", "http://other.net/", "http:///path"]
    hosts = ["example.com", "b.a.example.com", "z.x.org", None, None, "10.0.0.1", "other.net", None]
    captures = [(i, urls[i % 8], None if i % 50 == 7 else day(rng.randrange(110)) + timedelta(hours=i % 24), "clash", "clash") for i in range(160)]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched timestamp, action string, host string").repartition(3)
    table = spark.createDataFrame(entries, "domain string, since timestamp, action string")
    got = {r.page_id: r for r in url_filter.judged(df, table).collect()}
    assert len(got) == 160
    log = {}
    for dom, t, act in entries:
        if dom and t and act:
            key = (dom.lower(), t)
            log[key] = max(log.get(key, ""), act)
    for i, _, t, *_ in captures:
        host, want = hosts[i % 8], (None, None, "allow")
        parts = host.split(".") if host else []
        for k in range(len(parts)):
            dom = ".".join(parts[k:])
            past = [(s, a) for (d, s), a in log.items() if d == dom and t and s <= t]
            if past and max(past)[1] != "drop":
                want = (dom, max(past)[0], max(past)[1])
                break
        assert (got[i].matched_domain, got[i].active_since, got[i].verdict, got[i].host) == (*want, host)
    assert {r.verdict for r in url_filter.judged(df, table.where("false")).collect()} == {"allow"}


def vectors(n=3000, dim=16, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.7) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[200][1]) for i in range(30)]  # copies of a query
    bad = [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [1.0] * (dim - 1), [], [None] + [1.0] * (dim - 1)]
    return rows + [(10 * n + 100 * i, v) for i, v in enumerate(bad)] + [(None, rows[0][1])]


def test_nearest(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(forest, "SEGMENT", 1000)
    monkeypatch.setattr(forest, "LEAST", 200)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int").repartition(2)
    got = {}
    for r in forest.nearest(df, df["vec_id"] % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    full = [(i, np.array(v, np.float32).astype(float)) for i, v in rows[:3030]]
    ids, x = np.array([i for i, _ in full]), np.stack([v for _, v in full])
    hit = 0
    for q in range(0, 3030, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(m[2] == d[list(ids).index(m[1])] for m in mine)
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (m[1], m[0]))
        hit += len({m[1] for m in mine} & set(ids[order].tolist()))
    assert hit / (10 * 31) >= 0.9
    assert [m[1] for m in sorted(got[200])] == list(range(3000, 3010))
    alone = set(got) - set(range(0, 3030, 100))
    assert alone == set()  # unusable vectors ask nothing; the shorter one has no other of its length
    assert forest.nearest(df.where("false"), df["vec_id"] % 100 == 0).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [4.0, 6.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in forest.nearest(df, df["vec_id"] % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 5.0)]


def test_repeated_vectors(spark, monkeypatch):
    """Repeated rows take no neighbour's place: every row twice, one row many times, an id with several vectors."""
    import numpy as np

    monkeypatch.setattr(forest, "SEGMENT", 60)
    rng = random.Random(8)
    once = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    once += [(i, once[7][1]) for i in range(80, 95)] + [(50, [x + 0.01 * n for x in once[0][1]]) for n in range(1, 70)]
    rows = once * 2 + [once[7]] * 40 + [once[0]] * 30
    want = {}
    for q in (0, 7):
        least = {}
        for i, v in once:
            if i != q:
                d = float(np.sqrt(((np.array(v) - np.array(once[q][1])) ** 2).sum()))
                least[i] = min(d, least.get(i, d))
        want[q] = [i for _, i in sorted((d, i) for i, d in least.items())[:10]]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = {}
        for r in forest.nearest(df, df["vec_id"].isin(0, 7)).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as C
    import sentencepiece

    P = pytest.importorskip("public_tokenizers")
    rows = [r for r in corpus.documents(90) if r[0] is not None]
    rows += [(1000 + i, " ".join(w.upper() + "!!" for w in (r[1] or "q").split()[:60]), *r[2:]) for i, r in enumerate(rows[9:60])]
    item = " ".join(rows[8][1].split()[500:540])
    tables = {
        "documents": spark.createDataFrame(rows, corpus.SCHEMA),
        "labels": spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    seen = []
    for name, stage in C.STAGES:
        before = read(docs)
        docs = C.written(stage(spark, docs, str(tmp_path)), name)
        if name != "sentencepieces":
            assert docs.columns == tables["documents"].columns
            after = read(docs)
        if name == "quality":
            score = {r.doc_id: r.score for r in quality.scored(tables["documents"], tables["labels"]).collect()}
            assert set(after) == {d for d in before if score[d] >= 0.5} and sum(d >= 1000 for d in after) <= 3 and sum(d < 1000 for d in after) > 80
        elif name == "near_dedup":
            want, _ = classes(list(before.items()), 80)
            assert set(after) == set(want.values()) and len(after) < len(before)
        elif name == "substring_dedup":
            want = removed(list(before.items()))
            assert set(after) == set(before) and all(after[d] == (want[d][3] if want[d][1] else before[d]) for d in after)
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in docs.collect())
        elif name == "decontamination":
            q = shingles(item)
            assert set(after) == {d for d, t in before.items() if len(q & shingles(t)) < 0.8 * len(q)} and len(after) < len(before)
        else:
            m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
            assert {r.doc_id: list(r.ids) for r in docs.collect()} == {d: m.encode(t or "") for d, t in before.items()}
        seen.append(name)
    assert seen == ["quality", "near_dedup", "substring_dedup", "decontamination", "sentencepieces"]
    assert C.run(spark, str(tmp_path)).count() == docs.count()
    assert near_dedup.least_matches(0.8, 1e-6) and math.isfinite(score[0])


def test_ties(spark):
    """Of equally distant neighbours the smallest ids are answered, however many there are."""
    rng = random.Random(3)
    signs = [[rng.choice((-1.0, 1.0)) / 4 for _ in range(16)] for _ in range(199)]
    rows = [(0, [1.0] + [0.0] * 15), *((200 - i, [abs(v[0]), *v[1:]]) for i, v in enumerate(signs))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in forest.nearest(df, df["vec_id"] == 0).orderBy("rank").collect()]
    assert got == sorted(i for i, _ in rows[1:])[:10]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    """Recall against brute force on the given embeddings, with the parameters of the query."""
    import numpy as np
    from pathlib import Path

    if not Path(f"/root/testdata/{sf}").exists():
        pytest.skip("no test data")
    got = {}
    for r in forest.op4_hash_forest(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where(forest.usable("embedding")).collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hit = n = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [int(j) for j in ids[np.lexsort((ids, d))] if j != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == d[ids == m[1]][0] for m in mine)
        hit, n = hit + len({m[1] for m in mine} & set(best)), n + 10
    assert hit / n >= 0.9


def test_clashing_names_of_captures(spark):
    """Captures may have columns that are called like anything; brackets hold one host; a long URL is no trouble."""
    urls = ["http://[2001:db8::1.2.3.4]:80/x", "http://a.example.com/" + "q" * 2_000_000, "http://b.net"]
    rows = [(u, datetime(2024, 2, 1), "d", "a", 1, 2, "s", "u", "c", "o") for u in urls]
    names = ["url", "fetched", "_domain", "_action", "_row", "row", "since", "until", "capture", "Domain"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, ["string", "timestamp", "string", "string", "int", "int", "string", "string", "string", "string"], strict=True)))
    entries = spark.createDataFrame([("example.com", datetime(2024, 1, 1), "block"), ("[2001:db8::1.2.3.4]", datetime(2024, 1, 1), "block"), ("4]", datetime(2024, 1, 1), "allow")], "domain string, since timestamp, action string")
    out = url_filter.judged(df, entries)
    assert out.columns == [*names, "host", "matched_domain", "active_since", "verdict"]
    got = {r.url[:12]: (r.host, r.matched_domain, r.verdict, r["_domain"], r["row"], r["Domain"]) for r in out.collect()}
    assert got == {urls[0][:12]: ("[2001:db8::1.2.3.4]", "[2001:db8::1.2.3.4]", "block", "d", 2, "o"), urls[1][:12]: ("a.example.com", "example.com", "block", "d", 2, "o"), urls[2][:12]: ("b.net", None, "allow", "d", 2, "o")}


def test_long_conversations(spark):
    """A turn of two million characters and a conversation of 600 turns, with their snapshots."""
    long = "x" * 2_000_000
    turns = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "y")] + [(3, i, "user", f"t{i}") for i in range(600)] + [(4, i, "user", f"t{i}") for i in range(599)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, len(r.text)) for r in chat.chat_documents(df).collect()}
    assert set(got) == {2, 3} and got[2][0] == 2 and got[2][1] > len(long) and got[3][0] == 600


def test_pipeline_cases(spark, tmp_path):
    """Null ids, repeated rows (equal ones and ones that differ), clashing names, and empty tables."""
    import corpus_pipeline as C

    rng = random.Random(21)
    w = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, three = w(90), w(90), w(90)
    rows = [(1, one), (1, one), (2, one), (3, two), (3, three), (None, two + " tail"), (None, two + " tail"), (None, None), (5, None), (6, ""), (7, w(8000))]
    names = "doc_id long, text string, lang string, source string, n_chars long, _id int, _kept string, text_id int, again string, rep int, kept boolean"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), i, "k", i, "a", i, None) for i, (d, t) in enumerate(rows)], names)
    tables = {"labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, three[:300].rsplit(" ", 1)[0])], "item_id long, text string")}
    for suffix, df in (("", docs), ("-empty", docs.where("false"))):
        folder = tmp_path / f"in{suffix}"
        for name, t in tables.items():
            t.write.parquet(f"{folder}/{name}.parquet")
        at = df
        for name, stage in C.STAGES[:-1]:
            at = C.settled(lambda stage=stage, at=at, folder=folder: stage(spark, at, str(folder)), name)
            assert at.columns == docs.columns
            if not suffix and name == "near_dedup":
                assert sorted((str(r.doc_id), r.text or "") for r in at.collect()) == sorted([("1", one), ("3", two), ("3", three), ("None", two + " tail"), ("None", ""), ("5", ""), ("6", ""), ("7", rows[10][1])])
        left = C.STAGES[-1][1](spark, at, str(folder)).collect()
        assert sorted(str(r.doc_id) for r in left) == ([] if suffix else sorted(["1", "3", "None", "None", "5", "6", "7"]))
