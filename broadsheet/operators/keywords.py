"""Keyword tables too big for one pattern, matched through what the texts hold.

A purely alphanumeric keyword has to be a whole run of letters and digits of the text, so it is joined with the distinct
runs of each text. Any other keyword may stand anywhere. Its pieces of three characters (all of it, if it is shorter) are counted
in the texts: a keyword with a piece that no text has is out. Of the others an anchor, as long as the keyword allows (``SIZES``), is
joined with the distinct pieces of that length that texts have; the anchor is the one that starts with the rarest piece, and texts
send only pieces that start as some anchor does. Candidates of longer keywords are compared in full. So candidates grow with the
matches and not with texts times keywords. Sets of pieces and heads are broadcast while they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import text_or_empty
from ..session import broadcast_if_few, cut_lineage

PLAIN = r"\A[a-z0-9]+\z"
PIECE = 3
# Lengths of anchors: the greatest that a keyword's length allows is taken.
SIZES = (1, 2, 3, 4, 5, 6, 8, 12)


def _pieces(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text, in order."""
    # A look-ahead matches at every character, so one scan of the text finds all of them.
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def _text_pieces(texts: DataFrame, size: int) -> DataFrame:
    """``(_row, piece)`` of the distinct pieces of each text."""
    return texts.select("_row", F.explode(F.array_distinct(_pieces(F.col("_text"), size))).alias("piece"))


def keyword_table(keywords: DataFrame) -> DataFrame:
    """``(kind, keyword, plain)`` of ``keywords (kind, keyword)``: trimmed, lower case, distinct, none empty."""
    rows = keywords.select("kind", F.lower(F.trim("keyword")).alias("keyword")).filter("keyword <> ''").distinct()
    return rows.withColumn("plain", F.col("keyword").rlike(PLAIN))


def _sizes(rows: DataFrame) -> list[int]:
    return [r.size for r in rows.select("size").distinct().orderBy("size").collect()]


def keyword_anchors(words: DataFrame, texts: DataFrame) -> DataFrame:
    """``(keyword, size, head, anchor)`` of the keywords of ``words (keyword)`` all of whose pieces some text has."""
    length = F.length("keyword")
    sized = words.withColumn("size", F.least(F.lit(PIECE), length))
    every = F.when(F.lit(False), F.array("keyword"))
    for size in range(1, PIECE + 1):
        every = every.when(F.col("size") == size, _pieces(F.col("keyword"), size))
    each = sized.select("keyword", F.posexplode(every).alias("at", "piece"))
    asked = cut_lineage(each.select("piece").distinct())
    seen = None
    for size in _sizes(asked.select(F.length("piece").alias("size"))):
        own = _text_pieces(texts, size).join(broadcast_if_few(asked), "piece", "left_semi")
        seen = own if seen is None else seen.unionByName(own)
    if seen is None:
        return words.sparkSession.createDataFrame([], "keyword string, size int, head string, anchor string")
    counts = cut_lineage(seen.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    long = F.lit(SIZES[0])
    for size in SIZES[1:]:
        long = F.when(length >= size, size).otherwise(long)
    each = each.withColumn("size", long).join(broadcast_if_few(counts), "piece", "left")
    best = each.groupBy("keyword", "size").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("n"),
        F.min(F.when(F.col("at") <= length - F.col("size"), F.struct("n", "at", "piece"))).alias("best"))
    return best.filter("n > 0").select("keyword", "size", F.col("best.piece").alias("head"), F.substring(
        "keyword", F.col("best.at") + 1, F.col("size")).alias("anchor"))


def keyword_matches(rows: DataFrame, row_id: str, text: Column, keywords: DataFrame) -> DataFrame:
    """Distinct ``(row_id, kind, keyword)`` for all keywords of ``keywords (kind, keyword)`` that a row's text holds.

    ``row_id`` names a unique column of ``rows``. Null texts hold nothing; letters are compared in lower case.
    """
    table = cut_lineage(keyword_table(keywords))
    texts = rows.select(F.col(row_id).alias("_row"), F.lower(text_or_empty(text)).alias("_text"))
    runs = F.array_distinct(F.array_remove(F.split("_text", "[^a-z0-9]+"), ""))
    plain = table.filter("plain").select("keyword").distinct()
    found = texts.select("_row", F.explode(runs).alias("keyword")).join(broadcast_if_few(plain), "keyword").select("_row", "keyword")
    anchors = cut_lineage(keyword_anchors(table.filter(~F.col("plain")).select("keyword").distinct(), texts))
    for size in _sizes(anchors):
        own = anchors.filter(F.col("size") == size)
        asked = _text_pieces(texts, size)
        if size > PIECE:
            heads = own.select("head").distinct()
            asked = asked.withColumn("head", F.substring("piece", 1, PIECE)).join(broadcast_if_few(heads), "head", "left_semi")
        near = asked.join(broadcast_if_few(own.select(F.col("anchor").alias("piece"), "keyword")), "piece").select("_row", "keyword")
        whole = F.length("keyword") == size
        found = found.unionByName(near.filter(whole)).unionByName(near.filter(~whole).join(texts, "_row").filter(
            F.contains("_text", "keyword")).select("_row", "keyword"))
    return found.distinct().join(table.select("kind", "keyword"), "keyword").select(
        F.col("_row").alias(row_id), "kind", "keyword")


def topic_filter_table(df: DataFrame, row_id: str, keywords: DataFrame) -> DataFrame:
    """Rows with an ``ai`` and a ``bio`` keyword, or a ``strong`` one; ``keywords`` has ``kind, keyword``.

    Same rule as ``topic_filter``, for lists of any length. Rows need ``title`` and ``summary``.
    """
    text = F.concat(text_or_empty("title"), F.lit("\n"), text_or_empty("summary"))
    found = keyword_matches(df, row_id, text, keywords).groupBy(row_id).agg(F.collect_set("kind").alias("_kinds"))
    hit = (F.array_contains("_kinds", "ai") & F.array_contains("_kinds", "bio")) | F.array_contains("_kinds", "strong")
    return df.join(found.filter(hit).select(row_id), row_id, "left_semi")
