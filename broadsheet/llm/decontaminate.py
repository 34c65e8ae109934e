"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Benchmark texts become windows of ``WINDOW`` consecutive words (a shorter item is one window). Tokens are ordered by how
often they occur in all documents, and the rarest ``PREFIX`` tokens of a window are its necessary prefix: a document
contains the window only if it has all of them, each at its own distance from the window's start. Positions of prefix
tokens in documents therefore give candidate starts; those that run over the document's end, or that not all prefix
tokens agree on, fall away, and what is left is compared word by word.

The benchmark's token tables are broadcast only up to ``BROADCAST_ROWS`` rows (they are counted first) and joined by
shuffle beyond. Documents that match are read a second time for the comparison; nothing gathers rows of more than one
document. Null texts have no words, items without words no windows; an item without id can hit words but is not listed;
repeated rows give repeated rows; items that repeat count once per id; extra columns are not read by
:func:`contamination`, and :func:`drop_contaminated` keeps them, whatever their names. An empty table of documents gives no
rows, an empty one of items no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, stored, table
from .registry import query

WINDOW = 10
PREFIX = 2
BROADCAST_ROWS = 500_000


def words_of(text: str) -> F.Column:
    """Words of a column: A-Z count as a-z, all ASCII but letters and digits separates."""
    column = F.col(text)
    lower = F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, string.ascii_uppercase, string.ascii_lowercase))
    found = F.array_remove(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``(win, words, item_ids)``: each distinct window once, with the ids that have it."""
    found = items.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    found = found.select("item_id", "words", F.explode(starts).alias("at"))
    return stored(found.groupBy(F.slice("words", F.col("at") + 1, window).alias("words")).agg(
        F.collect_set(F.col("item_id").cast("string")).alias("item_ids")).withColumn(
        "win", F.monotonically_increasing_id()), "windows")


def keyed(docs: DataFrame) -> DataFrame:
    """Text and two hashes that name a row by its content."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"), F.hash("text", "doc_id").alias("g"))


def necessary_tokens(docs: DataFrame, windows: DataFrame, prefix: int) -> DataFrame:
    """``(win, size, n, k, token, offset)``: the ``n`` rarest tokens of each window that all documents have."""
    tokens = windows.select("win", F.size("words").alias("size"), F.posexplode("words").alias("offset", "token"))
    vocabulary = stored(tokens.select("token").distinct(), "vocabulary")
    counts = docs.select(F.explode(words_of("text")).alias("token")).join(small(vocabulary), "token").groupBy(
        "token").agg(F.count("*").alias("c"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "token", "offset")))
    ranked = tokens.join(stored(counts, "counts"), "token", "left").groupBy("win", "size").agg(
        F.slice(order, 1, prefix).alias("rare"))
    return stored(ranked.where("rare[0].c > 0").select(
        "win", "size", F.size("rare").alias("n"), F.posexplode("rare").alias("k", "r")).select(
        "win", "size", "n", "k", F.col("r.token").alias("token"), F.col("r.offset").alias("offset")), "prefixes")


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, prefix: int = PREFIX
                ) -> tuple[DataFrame, DataFrame]:
    """``rows (uid, doc_id, h, g, n_words)``, one per document row, and ``hits (h, g, found)`` of the texts with hits:
    the occurring windows as an array of ``(at, size, item_ids)``."""
    windows = item_windows(items, window)
    necessary = necessary_tokens(docs, windows, prefix)
    texts = keyed(docs).withColumn("uid", F.monotonically_increasing_id())
    places = texts.select("uid", "doc_id", "h", "g", words_of("text").alias("words")).select(
        "uid", "doc_id", "h", "g", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("at", "token"))
    places = stored(places.join(small(necessary), "token", "left").where("win is not null or at is null or at = 0")
                    .select("uid", "doc_id", "h", "g", "n_words", "at", "win", "size", "n", "k",
                            (F.col("at") - F.col("offset")).alias("start")), "places")
    rows = places.where("at is null or at = 0").select("uid", "doc_id", "h", "g", "n_words").distinct()
    candidates = places.where("win is not null and start >= 0 and start + size <= n_words").groupBy(
        "h", "g", "win", "start", "size", "n").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("agreed"))
    candidates = candidates.where("agreed = shiftleft(1, n) - 1").join(
        windows.select("win", "words", "item_ids"), "win").groupBy("h", "g").agg(
        F.collect_list(F.struct("start", "size", "words", "item_ids")).alias("asked")).withColumnsRenamed(
        {"h": "__h", "g": "__g"})
    checked = keyed(docs).select("h", "g", "text").join(
        stored(candidates, "candidates"), (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g"))).select(
        "h", "g", "asked", words_of("text").alias("words"))
    same = F.filter("asked", lambda c: F.slice(F.col("words"), c["start"] + 1, c["size"]) == c["words"])
    hits = checked.select("h", "g", F.transform(same, lambda c: F.struct(
        c["start"].alias("at"), c["size"].alias("size"), c["item_ids"].alias("item_ids"))).alias("found"))
    return rows, hits.where("size(found) > 0").groupBy("h", "g").agg(F.any_value("found").alias("found"))


def covered(found: str) -> F.Column:
    """Number of word places inside any of the windows."""
    ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["at"], (c["at"] + c["size"]).alias("end"))))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("end"))
    return F.aggregate(ordered, start, lambda acc, c: F.struct(
        (acc["sum"] + F.greatest(F.lit(0), c["end"] - F.greatest(acc["end"], c["at"]))).alias("sum"),
        F.greatest(acc["end"], c["end"]).alias("end")), lambda acc: acc["sum"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs (doc_id, text)``."""
    rows, hits = window_hits(docs, items, window, prefix)
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda c: c["item_ids"]))))
    hits = hits.select("h", "g", covered("found").alias("n_hit"), ids.alias("ids"))
    return rows.join(hits, ["h", "g"], "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """``docs`` without the rows in which a window occurs; all columns stay."""
    _, hits = window_hits(docs, items, window, prefix)
    h, g, row, more = free_names(docs.columns, "own_h", "own_g", "row", "more")
    bad = stored(hits.select(F.col("h").alias(h), F.col("g").alias(g)), "contaminated")
    named = docs.withColumns({row: F.xxhash64("doc_id", "text"), more: F.hash("text", "doc_id")})
    kept = named.join(bad, (F.col(row) == F.col(h)) & (F.col(more) == F.col(g)), "left_anti")
    return kept.select(*[docs[c] for c in docs.columns])


_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORDS = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', "
          f"'{string.ascii_lowercase}'), '{_SEPARATORS}'), lambda x: x <> '')")
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, list_slice(w, s + 1, s + {WINDOW}) AS win,
         least(len(w), {WINDOW}) AS size
         FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
runs AS (SELECT doc_id, size, s, list_slice(w, s + 1, s + size) AS win
         FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, s, size, item FROM runs JOIN wins USING (win, size)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM hits))
           GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op10_decontaminate", SQL)
def op10_decontaminate(spark, sf_dir):
    """Words of each whole document inside 10-word windows of benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
