"""Landed JSON entry pages to unified items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import parse_pub_date
from ..functions.html import strip_html
from ..functions.text import filled, literal, text_or_empty, trim_all
from ..schemas import ENTRY_PAGE, as_items

# Sources whose label does not depend on the entry.
CONSTANT_LABELS = {"aibase": "aibase", "jiqizhixin": "机器之心", "qbit": "量子位", "xinzhiyuan": "新智元",
                   "xiaohu": "xiaohu", "huggingface-papers": "huggingface-papers"}
FEED_LABELS = ("papers", "reddit")


def source_label(kind, feed, author) -> Column:
    """Label shown as the source of an entry, by kind of source."""
    kind, feed, author = (F.col(c) if isinstance(c, str) else c for c in (kind, feed, author))
    both = F.concat(text_or_empty(feed), F.lit(" - "), text_or_empty(author))
    label = F.when(kind == "twitter", F.when(feed.startswith("Twitter"), F.concat(
        F.lit("twitter-"), text_or_empty(author))).otherwise(both))
    for name, constant in CONSTANT_LABELS.items():
        label = label.when(kind == name, constant)
    return label.when(kind.isin(*FEED_LABELS), feed).otherwise(
        F.when(filled(author).isNotNull(), trim_all(both)).otherwise(F.coalesce(filled(feed), F.lit("Folo"))))


def read_entry_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed page files, one JSON document per file; malformed ones contribute nothing."""
    pages = spark.read.schema(ENTRY_PAGE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return pages.select(F.lit(kind).alias("kind"), F.col("_metadata.file_name").alias("page"), "data")


def parse_entry_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Page texts in a column to the ``data`` array."""
    return pages.withColumn("data", F.from_json(body, ENTRY_PAGE)["data"]).drop(body)


def scan_entry_json(pages: DataFrame) -> DataFrame:
    """One row per entry. ``pages`` has ``kind``, the ``data`` array and any columns to keep."""
    keep = [c for c in pages.columns if c != "data"]
    rows = pages.select(*keep, F.posexplode("data").alias("_pos", "_e"))
    entry = F.col("_e.entries")
    return rows.select(
        *keep, F.col("_pos").cast("long").alias("item_ord"), entry["id"].alias("id"), entry["url"].alias("url"),
        entry["title"].alias("title"), entry["content"].alias("content"), entry["publishedAt"].alias("published_raw"),
        parse_pub_date(entry["publishedAt"]).alias("published_at"), entry["author"].alias("author"),
        source_label(F.col("kind"), F.col("_e.feeds.title"), entry["author"]).alias("source"))


def auto_feed_then_list(rows: DataFrame, key: Sequence[str] = ("source_id",)) -> DataFrame:
    """Per id the feed rows when there are any, else the list rows. ``fetch`` is ``feed`` or ``list``.

    Ids with feed rows are aggregated first and anti-joined, so one busy id does not fill one task.
    """
    with_feed = rows.filter(F.col("fetch") == "feed").select(*key).distinct()
    return rows.filter(F.col("fetch") == "feed").unionByName(
        rows.filter(F.col("fetch") == "list").join(with_feed, list(key), "left_anti"))


def unify_entry_items(rows: DataFrame, category: str | Column, report_date: Column,
                      source_ord: int | Column = 0) -> DataFrame:
    return as_items(rows.select(
        report_date.alias("report_date"), literal(category).alias("category"), "source", "id", "url", "title",
        strip_html("content").alias("description"), "published_at", "published_raw",
        F.array(F.col("author")).alias("authors"),
        F.struct(text_or_empty("content").alias("content_html")).alias("details"),
        literal(source_ord).alias("source_ord"), "item_ord"))


def unify_paper_items(rows: DataFrame, report_date: Column, source_ord: int | Column = 0) -> DataFrame:
    """Papers: translated title over the original, authors split at commas."""
    authors = F.transform(F.split(F.col("author"), ","), trim_all)
    return as_items(rows.select(
        report_date.alias("report_date"), F.lit("paper").alias("category"),
        F.coalesce(filled("source"), F.lit("Huggingface Papers")).alias("source"), "id", "url",
        F.coalesce(filled("title_zh"), F.col("title")).alias("title"), strip_html("content").alias("description"),
        "published_at", "published_raw", F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
        F.struct(text_or_empty("content").alias("content_html")).alias("details"),
        literal(source_ord).alias("source_ord"), "item_ord"))
