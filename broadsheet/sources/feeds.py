"""RSS/Atom feed bodies to feed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import parse_pub_date
from ..functions.html import image_url, strip_html, build_content_html, xml_all_tags, xml_attr, xml_tag
from ..functions.text import filled, literal, text_or_empty
from ..operators.filters import require_title_link, split_digest_items, topic_filter
from ..schemas import as_items

ENTRY = r"(?is)<entry(?![A-Za-z0-9_])[^>]*>(.*?)</entry>"
ITEM = r"(?is)<item(?![A-Za-z0-9_])[^>]*>(.*?)</item>"


def read_raw_feeds(spark: SparkSession, path: str, feeds: DataFrame) -> DataFrame:
    """Landed feed files, one whole file per row. ``feeds`` maps ``file`` to ``name, url, ord``."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_modification_time").alias("fetched_at"))
    return files.join(feeds, "file").select(
        F.col("name").alias("feed_name"), F.col("url").alias("feed_url"), F.col("ord").alias("feed_ord"),
        "body", "fetched_at")


def scan_feed_xml(raw_feeds: DataFrame) -> DataFrame:
    """One row per ``<entry>`` (Atom) or ``<item>`` (RSS) of each body."""
    atom = F.col("body").rlike(r"(?i)<feed(?![A-Za-z0-9_])")
    entries = F.when(atom, F.regexp_extract_all("body", F.lit(ENTRY), F.lit(1))).otherwise(
        F.regexp_extract_all("body", F.lit(ITEM), F.lit(1)))
    keep = [c for c in raw_feeds.columns if c != "body"]
    blocks = raw_feeds.withColumn("is_atom", atom).select(
        *keep, "is_atom", F.posexplode(entries).alias("_pos", "block"))
    block = F.col("block")
    rows = blocks.select(
        *keep, "is_atom", F.col("_pos").cast("long").alias("item_ord"),
        xml_tag(block, "title").alias("title"),
        xml_tag(block, "summary", "content", "content:encoded", "description").alias("summary"),
        F.when(F.col("is_atom"), F.coalesce(filled(xml_attr(block, "link", "href")), xml_tag(block, "id"))).otherwise(
            F.coalesce(filled(xml_tag(block, "link")), xml_tag(block, "guid"))).alias("link"),
        xml_tag(block, "published", "updated", "pubDate", "dc:date").alias("published_raw"),
        F.when(F.col("is_atom"), xml_all_tags(block, "name")).otherwise(
            xml_all_tags(block, "dc:creator", "author")).alias("authors"),
        image_url(block).alias("_block_image"))
    return rows.withColumn("image_url", F.coalesce(filled("_block_image"), image_url("summary"))).withColumn(
        "published_at", F.when(filled("published_raw").isNull(), F.col("fetched_at")).otherwise(
            parse_pub_date("published_raw"))).drop("_block_image")


def parse_feeds(raw_feeds: DataFrame, kind: str = "rss", topics: dict | None = None) -> DataFrame:
    """Feed rows with title and link; digests are split, paper feeds are filtered by topic."""
    rows = split_digest_items(require_title_link(scan_feed_xml(raw_feeds)), topics=topics)
    if kind == "papers":
        ordinary = topic_filter(rows.filter("story_ord = 0"), **(topics or {}))
        rows = ordinary.unionByName(rows.filter("story_ord > 0"))
    return rows


def unify_feed_items(rows: DataFrame, category: str | Column, report_date: Column, source_ord: int | Column = 0,
                     default_source: str = "rss") -> DataFrame:
    """Feed rows to unified items."""
    ident = F.col("entry_id") if "entry_id" in rows.columns else F.col("link")
    story = F.col("story_ord") if "story_ord" in rows.columns else F.lit(0)
    return as_items(rows.select(
        report_date.alias("report_date"), literal(category).alias("category"),
        F.coalesce(filled("feed_name"), F.lit(default_source)).alias("source"), ident.alias("id"),
        F.col("link").alias("url"), "title", strip_html("summary").alias("description"), "published_at", "published_raw",
        F.coalesce("authors", F.array(F.lit("Unknown"))).alias("authors"),
        F.struct(build_content_html("title", "summary", "image_url", "link").alias("content_html"), "feed_url",
                 text_or_empty("image_url").alias("image_url")).alias("details"),
        literal(source_ord).alias("source_ord"), (F.col("item_ord") * 1000 + story).alias("item_ord")))
