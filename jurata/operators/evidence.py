"""Quotes looked for in many texts by joins: the texts that hold a quote word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _with

# Fixed value: what stands between the tokens of a text.
_GAP = r"[ \t\n\x0b\f\r]+"


def _pieces(c: Column) -> Column:
    return F.split(c, _GAP)


def quoted_in(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, doc_id) of the quotes (quote_id, quote) and texts (doc_id, text) that hold them.

    Wherever a quote of three tokens or more occurs, its inner tokens are whole tokens of the text; the one that the fewest
    texts have is its anchor. The end tokens of shorter quotes may be parts of the text's tokens, so their longest one is
    looked up in the vocabulary by parts of at most 12 characters. Anchors meet the texts' distinct tokens in a join of ids, and
    only the texts and quotes of candidate pairs are compared. A quote without tokens is compared with every text that has
    white space, or with all if it is empty. Null quotes and texts match nothing; ids should be unique.
    """
    quotes = quotes.where("quote is not null").select("quote_id", "quote").withColumn("pieces", _pieces(F.col("quote")))
    tokens = texts.where("text is not null").select("doc_id", F.explode(F.array_distinct(_pieces(F.col("text")))).alias("token"))

    long = quotes.where("size(pieces) >= 3 and exists(slice(pieces, 2, greatest(size(pieces) - 2, 0)), x -> x <> '')")
    inner = long.select("quote_id", F.explode(F.array_distinct(F.expr("slice(pieces, 2, size(pieces) - 2)"))).alias("token"))
    met = tokens.join(inner.select("token").distinct(), "token", "left_semi")  # only tokens that some quote has
    often = met.groupBy("token").agg(F.count("*").alias("n"))
    anchors = inner.join(often, "token", "left").groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("a")).where("a.n > 0").select("quote_id", "a.token")
    pairs = met.join(anchors, "token").select("quote_id", "doc_id")

    short = quotes.where("size(pieces) < 3 and quote rlike '[^ \\\\t\\\\n\\\\x0b\\\\f\\\\r]'").select("quote_id", F.expr("array_max(transform(pieces, x -> struct(length(x) as n, x as part)))").alias("p")).select("quote_id", "p.part")
    inside = _inside(tokens.select("token").distinct(), short)
    some = tokens.join(inside, "token").select("quote_id", "doc_id").distinct()

    full = pairs.union(some).join(texts.select("doc_id", "text"), "doc_id").join(quotes.select("quote_id", "quote"), "quote_id").where(F.contains("text", F.col("quote")))
    blank = quotes.where("not quote rlike '[^ \\\\t\\\\n\\\\x0b\\\\f\\\\r]'").select("quote_id", "quote")
    gaps = texts.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"({_GAP})"))))).alias("gap"))
    return full.select("quote_id", "doc_id").union(_gaps(gaps, blank))


#: Characters of the parts by which longer ones are looked up.
_GRAM = 12


def _inside(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(quote_id, token) of distinct tokens and asked (quote_id, part), parts not empty, where the token holds the part.

    A part is looked up by the one of its parts of 12 characters that the fewest tokens have, or as it is if it's shorter; the
    whole of it is compared with the tokens that have that. So a long token makes as many short texts as it has characters.
    """
    cut = lambda n: lambda letters: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(letters) - n + 1), lambda i: F.array_join(F.slice(letters, i, n), "")))
    grams = lambda c, n: _with(F.filter(F.split(c, ""), lambda x: x != ""), cut(n))  # noqa: E731 - a list of letters, as a place in a text is found from its start
    sized = asked.where("part <> ''").select("quote_id", "part", F.least(F.length("part"), F.lit(_GRAM)).alias("n"))
    wanted = sized.select("quote_id", "part", F.explode(grams(F.col("part"), F.col("n"))).alias("gram"))
    sizes = sized.select("n").distinct().agg(F.array_sort(F.collect_list("n")).alias("sizes"))  # at most 12 numbers
    held = words.join(F.broadcast(sizes)).select("token", F.explode("sizes").alias("n")).where("n <= length(token)").select("token", F.explode(grams(F.col("token"), F.col("n"))).alias("gram"))
    held = held.join(wanted.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "gram", "left").groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("quote_id", "g.gram")
    met = held.join(rarest, "gram").join(sized.select("quote_id", "part"), "quote_id")
    return met.where(F.contains("token", F.col("part"))).select("quote_id", "token").distinct()


def _gaps(gaps: DataFrame, blank: DataFrame) -> DataFrame:
    """Quotes of white space alone, looked up in the texts' distinct gaps; an empty one is in every text."""
    inside = _inside(gaps.select(F.col("gap").alias("token")).distinct(), blank.select("quote_id", F.col("quote").alias("part")))
    empty = blank.where("quote = ''").select("quote_id", F.lit("").alias("token"))
    return gaps.join(inside.union(empty), F.col("gap") == F.col("token")).select("quote_id", "doc_id").distinct()
