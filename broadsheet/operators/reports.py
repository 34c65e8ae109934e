"""Report rows, indexes and the RSS view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import rfc822
from ..functions.html import minify_html, strip_html
from ..functions.text import filled, utf16_prefix
from ..session import cut_lineage, path_exists
from .aggregates import latest_report_per_date


def reports_upsert(new: DataFrame, path: str) -> DataFrame:
    """Write report files into the table at ``path``; returns ``file, hash, status``.

    ``new`` has ``report_date, file, content``. Only the months that receive rows are rewritten; the merged
    rows are materialised first, because a table cannot be overwritten while it is read.
    """
    spark = new.sparkSession
    rows = new.select(F.date_format("report_date", "yyyy-MM").alias("month"), "report_date", "file", "content",
                      F.sha2("content", 256).alias("hash"))
    if not path_exists(spark, path):
        status = cut_lineage(rows.withColumn("status", F.lit("Create")))
        merged = status.drop("status")
    else:
        old = spark.read.parquet(path)
        old = old.select("month", "report_date", "file", "content", "hash").join(
            rows.select("month").distinct(), "month", "left_semi")
        known = old.select("file", F.lit(True).alias("_known"))
        status = cut_lineage(rows.join(known, "file", "left").withColumn(
            "status", F.when(F.col("_known"), "Update").otherwise("Create")).drop("_known"))
        untouched = old.join(status.select("file"), "file", "left_anti")
        merged = cut_lineage(untouched.unionByName(status.drop("status")))
    (merged.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))
    return status.select("file", "hash", "status")


def rss_view(reports: DataFrame, base_link: str = "") -> DataFrame:
    """Latest report per date as RSS item fields. Rows need ``report_date, title, link, content_html``."""
    latest = latest_report_per_date(reports)
    link = F.concat(F.lit(base_link), F.col("link"))
    return latest.select(
        "report_date", F.coalesce(filled("title"), F.lit("无标题")).alias("title"), link.alias("link"),
        F.coalesce(filled("id"), link).alias("guid"), rfc822("published_at").alias("pub_date"),
        minify_html("content_html").alias("content"),
        utf16_prefix(strip_html("content_html"), 200).alias("description"))


def rss_item(title="title", link="link", guid="guid", pub_date="pub_date", content="content",
             description="description") -> Column:
    """One ``<item>`` element."""
    def cdata(name, value):
        return F.concat(F.lit(f"<{name}><![CDATA["), F.col(value), F.lit(f"]]></{name}>"))

    def plain(name, value):
        return F.concat(F.lit(f"<{name}>"), F.col(value), F.lit(f"</{name}>"))

    return F.concat(F.lit("<item>"), cdata("title", title), plain("link", link), plain("guid", guid),
                    plain("pubDate", pub_date), cdata("content:encoded", content), cdata("description", description),
                    F.lit("</item>"))


def rss_document(view: DataFrame, channel_title: str, link: str, description: str) -> DataFrame:
    """The view as one XML text. It has one item per date of the window, so the list is bounded by days."""
    items = F.array_sort(F.collect_list(F.struct(F.col("report_date").alias("d"), rss_item().alias("x"))))
    body = F.array_join(F.transform(F.reverse(items), lambda s: s["x"]), "")
    head = ('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" '
            'xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
            f"<title>{channel_title}</title><link>{link}</link><description>{description}</description>"
            "<language>zh-cn</language>")
    return view.agg(F.concat(F.lit(head), body, F.lit("</channel></rss>")).alias("xml"))


def report_index(names: DataFrame, folder: str = "daily") -> DataFrame:
    """Daily reports by month, newest first, and weekly reports as a last group.

    ``names`` has ``name`` (``YYYY-MM-DD`` or ``YYYY-week-WW``). A group holds the reports of one month (or
    the weeks of all years), so its list is bounded by the calendar.
    """
    distinct = names.select("name").distinct()
    daily = distinct.filter(F.col("name").rlike(r"\A\d{4}-\d{2}-\d{2}\z"))
    weekly = distinct.filter(F.col("name").rlike(r"\A.{4}-week-.{2}\z"))
    newest = daily.agg(F.max("name").alias("latest"))
    line = F.concat(F.lit("- ["), F.substring("name", 6, 5), F.lit(f"-日刊]({folder}/"), F.col("name"), F.lit(".md)"))

    def lines(text: Column) -> Column:
        entries = F.sort_array(F.collect_list(F.struct(F.col("name").alias("n"), text.alias("t"))), asc=False)
        return F.array_join(F.transform(entries, lambda e: e["t"]), "\n")

    months = daily.groupBy(F.substring("name", 1, 7).alias("section")).agg(
        F.count(F.lit(1)).alias("n_reports"), lines(line).alias("lines"), F.max("name").alias("_top"))
    # One aggregated row on the other side.
    months = months.join(newest, F.col("_top") == F.col("latest"), "left").select(
        "section", "n_reports", "lines", F.col("latest").alias("today"))
    weeks = weekly.groupBy(F.lit("深度周报").alias("section")).agg(
        F.count(F.lit(1)).alias("n_reports"), lines(F.concat(
            F.lit("- ["), F.col("name"), F.lit("](blog/"), F.col("name"), F.lit(".md)"))).alias("lines"),
        F.lit(None).cast("string").alias("today"))
    return months.unionByName(weeks)
