"""Projections, filters and predicates over feed rows and items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (DIGEST_MAX_STORIES, DIGEST_URL, POLICY_HOST, POLICY_MAX_ITEMS, AI_KEYWORDS, BIO_KEYWORDS,
                            STRONG_KEYWORDS)
from ..functions.dates import in_window, shanghai_date
from ..functions.html import decode_entities, first_link, image_url, strip_html, strip_media_tags
from ..functions.text import S, filled, text_or_empty, trim_all, utf16_prefix
from ..functions.topics import on_topic
from ..functions.urls import on_host
from .ordering import first_n


def require_title_link(df: DataFrame) -> DataFrame:
    """Drop feed rows without title or link."""
    return df.filter((text_or_empty("title") != "") & (text_or_empty("link") != ""))


def recency_filter(df: DataFrame, ts: str, report_date, days: int) -> DataFrame:
    """Rows inside the window that ends with ``report_date`` (a date column or literal)."""
    return df.filter(in_window(ts, report_date, days))


def recency_for_dates(df: DataFrame, run_dates: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of many report dates at once; adds ``run_date``.

    A row can only belong to the dates from its own local date to ``days`` later, so it is expanded to
    those and matched by equality instead of by a range.
    """
    local = shanghai_date(ts)
    expanded = df.filter(F.col(ts).isNotNull()).withColumn(
        "run_date", F.explode(F.sequence(local, F.date_add(local, max(days, 1)))))
    dates = run_dates.select(F.col("report_date").alias("run_date")).distinct()
    return expanded.filter(in_window(ts, "run_date", days)).join(dates, "run_date", "left_semi")


def topic_filter(df: DataFrame, ai: Sequence[str] = AI_KEYWORDS, bio: Sequence[str] = BIO_KEYWORDS,
                 strong: Sequence[str] = STRONG_KEYWORDS) -> DataFrame:
    return df.filter(on_topic("title", "summary", ai, bio, strong))


def split_digest_items(df: DataFrame, max_stories: int = DIGEST_MAX_STORIES, topics: dict | None = None) -> DataFrame:
    """Replace digest rows by their numbered, on-topic stories; digests without such a story vanish.

    Rows need ``title, summary, link, image_url, item_ord``; ``story_ord`` is added (0 for ordinary rows).
    """
    pattern = (r"""(?is)<h2(?![A-Za-z0-9_])[^>]*id=["']([^"']+)["'][^>]*>(.*?)</h2>(.*?)"""
               r"""(?=<hr>|<h2(?![A-Za-z0-9_])|\z)""")

    def section(found: Column) -> Column:
        return F.struct(
            decode_entities(F.regexp_extract(found, pattern, 1)).alias("anchor"),
            trim_all(F.regexp_replace(
                strip_html(decode_entities(F.regexp_extract(found, pattern, 2))), rf"{S}*#{S}*\z", "")).alias("heading"),
            decode_entities(F.regexp_extract(found, pattern, 3)).alias("body"))

    def story(part: Column) -> Column:
        return F.struct(
            part["anchor"].alias("anchor"), part["heading"].alias("heading"),
            trim_all(F.regexp_replace(part["heading"], rf"\A\d+\.{S}*", "")).alias("title"),
            utf16_prefix(strip_html(part["body"]), 1500).alias("summary"),
            first_link(part["body"]).alias("link"), image_url(part["body"]).alias("image"))

    def kept(s: Column) -> Column:
        return (s["heading"].rlike(rf"\A\d+\.{S}+") & (s["title"] != "") & (s["summary"] != "")
                & on_topic(s["title"], s["summary"], **(topics or {})))

    found = F.regexp_extract_all(text_or_empty("summary"), F.lit(pattern), F.lit(0))
    stories = F.slice(F.filter(F.transform(F.transform(found, section), story), kept), 1, max_stories)
    digest = text_or_empty("link").rlike(DIGEST_URL)
    none = F.struct(*[F.lit(None).cast("string").alias(n)
                      for n in ("anchor", "heading", "title", "summary", "link", "image")])
    rows = df.withColumn("_digest", digest).select(
        "*", F.posexplode(F.when(F.col("_digest"), stories).otherwise(F.array(none))).alias("_i", "_story"))
    page = F.col("link")

    def pick(name: str, value: Column) -> Column:
        return F.when(F.col("_digest"), value).otherwise(F.col(name)).alias(name)

    changed = {
        "title": pick("title", F.col("_story.title")),
        "summary": pick("summary", F.col("_story.summary")),
        "link": pick("link", F.coalesce(filled(F.col("_story.link")), page)),
        "image_url": pick("image_url", F.col("_story.image")),
    }
    return rows.select(
        *[changed.get(c, F.col(c)) for c in df.columns],
        F.when(F.col("_digest"), F.concat(page, F.lit("#"), F.col("_story.anchor"))).otherwise(page).alias("entry_id"),
        F.when(F.col("_digest"), F.col("_i") + 1).otherwise(0).alias("story_ord"))


def repo_activity_filter(df: DataFrame, report_date, min_stars: int = 1, active_days: int = 240) -> DataFrame:
    """Repositories with enough stars (non-numbers count 0) and activity inside the window."""
    stars = F.coalesce(F.col("total_stars").try_cast("double"), F.lit(0.0))
    return df.filter((stars >= min_stars) & F.col("last_activity_at").isNotNull()
                     & in_window("last_activity_at", report_date, active_days))


def host_policy(df: DataFrame, groups: Sequence[str], order: Sequence[Column], host: str = POLICY_HOST,
                max_items: int = POLICY_MAX_ITEMS, strip_media: bool = True, category: str | None = "news") -> DataFrame:
    """Keep the first items of one host per group and strip their media; other rows pass untouched.

    Only the host's rows are windowed. All other rows skip the shuffle.
    """
    matches = on_host("url", host)
    if category:
        matches = matches & (F.col("category") == category)
    matches = F.coalesce(matches, F.lit(False))
    limited = first_n(df.filter(matches), groups, order, max_items)
    if strip_media:
        limited = limited.withColumn("details", F.col("details").withField(
            "content_html", F.when(F.col("details.content_html").isNotNull(), strip_media_tags("details.content_html"))))
    return df.filter(~matches).unionByName(limited)
