"""Places of several runs' rows, and quotes in very long tokens, against plain Python."""

import random

from pyspark.sql import functions as F

from jurata.operators import export as E
from jurata.operators import quotes
from jurata.operators.evidence import quoted_in
from jurata.plans import judging_queries


def test_sheet_rows_of_runs(spark):
    rows = [(run, i * 3, "=x" if i == 2 else "y") for run in ("a", "b", None) for i in range(4)]
    df = spark.createDataFrame(rows, "run_id string, order_index int, q string").repartition(3)
    got = {(r.run_id, r.order_index): r.sheet_row for r in E.sheet_rows(df, "run_id").collect()}
    assert got == {(run, i * 3): i + 2 for run in ("a", "b", None) for i in range(4)}
    hits = E.rewrites(E.sheet_rows(df, "run_id"), "s", "run_id").collect()
    assert sorted((str(r.run_id), r.column_name, r.sheet_row, r.guarded) for r in hits) == [("None", "q", 4, True), ("a", "q", 4, True), ("b", "q", 4, True)]
    one = E.sheet_rows(df.where("run_id = 'a'").select("order_index", "q")).orderBy("order_index").collect()
    assert [r.sheet_row for r in one] == [2, 3, 4, 5] and E.sheet_rows(df.where("false"), "run_id").count() == 0


def test_quotes_in_long_tokens(spark):
    r = random.Random(8)
    junk = "".join(r.choice("abcd") for _ in range(20_000))
    texts = [(0, junk), (1, "x " + junk[:10_000] + " y"), (2, "a" * 5_000), (3, " " * 2_000 + "b"), (4, "one two"), (5, ""), (6, None)]
    quotes = [junk[7_000:8_000], junk[13_000:14_000], "a" * 1_000, "a" * 6_000, "b", "e two", "one t", " " * 1_500, " " * 13, " ", "", "x " + junk[:40], "zzz", junk[5:17], junk[5:16]]
    got = quoted_in(spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string"), spark.createDataFrame(texts, "doc_id int, text string"))
    assert sorted(map(tuple, got.select(F.col("quote_id"), F.col("doc_id")).collect())) == sorted((i, d) for i, q in enumerate(quotes) for d, t in texts if t is not None and q in t)


def test_short_texts_need_no_hashes(spark, monkeypatch):
    """Short pairs are compared without the table of hashes, and a small file's rows go to all tasks."""
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abc") for _ in range(n))
    pairs = [(text(r.randint(1, 25)), text(r.randint(1, 35))) for _ in range(200)]
    hashed = [(quotes.longest_common(a, b), quotes.similarity(a, b)) for a, b in pairs]
    monkeypatch.setattr(quotes, "_SHORT", 0)
    assert [(quotes.longest_common(a, b), quotes.similarity(a, b)) for a, b in pairs] == hashed
    monkeypatch.undo()
    monkeypatch.setattr(quotes, "_Hashes", None)
    assert [quotes.longest_common(a, b) for a, b in pairs] == [h[0] for h in hashed]
    assert judging_queries.QUERIES["quote_common_part"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
