"""Counts, visitor statistics and per-minute decisions.

Every aggregate here has a partial step, so a site, client or visitor that owns a third of all rows is
reduced inside the input tasks before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..fixed_values import CATEGORIES
from ..functions.dates import shanghai_date
from ..functions.text import filled
from .ordering import first_n, keep_first, running_max
from .texts import item_has_media

VISITOR_ID = r"\A[a-zA-Z0-9_-]{8,80}\z"
SITE = r"\A[a-z0-9-]{2,40}\z"
IDLE_DAYS = 365


def source_stats(items: DataFrame) -> DataFrame:
    """Per report date and category: all items and items with media."""
    return items.groupBy("report_date", "category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(item_has_media()).alias("media"))


def selected_stats(selected: DataFrame) -> DataFrame:
    return selected.groupBy("report_date", "category").agg(F.count(F.lit(1)).alias("selected"))


def snapshot_counts(items: DataFrame, run_dates: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Item count per date and category, with zero rows for empty ones."""
    grid = run_dates.select("report_date").distinct().withColumn(
        "category", F.explode(F.array(*[F.lit(c) for c in categories])))
    counts = items.groupBy("report_date", "category").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["report_date", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def latest_report_per_date(reports: DataFrame) -> DataFrame:
    """Per report date the row published last; the first one when several are equal."""
    return keep_first(reports, ["report_date"], [F.col("published_at").desc_nulls_last(), F.col("ord")])


def clean_visits(visits: DataFrame, default_site: str = "home") -> DataFrame:
    """Lower-case valid site names and null for invalid visitor ids."""
    site = F.lower(F.coalesce(filled("site"), F.lit(default_site)))
    return visits.select(
        F.when(site.rlike(SITE), site).otherwise(default_site).alias("site"),
        F.when(F.col("visitor").rlike(VISITOR_ID), F.col("visitor")).alias("visitor"), "ts")


def visitor_days(visits: DataFrame) -> DataFrame:
    """Per site, visitor and local day: views, first and last visit."""
    return visits.groupBy("site", "visitor", shanghai_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("views"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def visitor_stats_total(visits: DataFrame, idle_days: int = IDLE_DAYS) -> DataFrame:
    """Per site: page views and visitors; a visitor idle for longer than ``idle_days`` counts again.

    Gaps that long cannot fall inside a day, so days are compared instead of single visits.
    """
    days = visitor_days(visits)
    previous = F.lag("last_ts").over(W.partitionBy("site", "visitor").orderBy("day"))
    gap = F.unix_micros("first_ts") - F.unix_micros(previous)
    new = F.col("visitor").isNotNull() & (previous.isNull() | (gap > idle_days * 86_400_000_000))
    return days.withColumn("new", new).groupBy("site").agg(
        F.sum("views").alias("pageviews"), F.count_if("new").alias("visitors"))


def visitor_stats_daily(visits: DataFrame) -> DataFrame:
    """Per site and local day: page views and distinct valid visitors."""
    return visitor_days(visits).groupBy("site", "day").agg(
        F.sum("views").alias("pageviews"), F.count("visitor").alias("visitors"))


def visitor_approx(visits: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Per site: page views and approximate distinct visitors, in one pass and one small shuffle."""
    return visits.groupBy("site").agg(
        F.count(F.lit(1)).alias("pageviews"), F.approx_count_distinct("visitor", rsd).alias("visitors"))


def visitor_sketches(visits: DataFrame, precision: int = 14) -> DataFrame:
    """Per site and local day: page views and a sketch of its valid visitors, to be stored and united later."""
    return visits.groupBy("site", shanghai_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("pageviews"), F.hll_sketch_agg("visitor", F.lit(precision)).alias("sketch"))


def visitors_over(sketches: DataFrame, periods: DataFrame) -> DataFrame:
    """Page views and estimated distinct visitors per site of each of ``periods (period, first_day, last_day)``.

    Any period is answered from the stored days, both ends included, without the visits. Days are given to the periods
    that hold them through a list of the days of each period, so no range join is needed.
    """
    days = periods.select("period", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return sketches.join(days, "day").groupBy("period", "site").agg(
        F.sum("pageviews").alias("pageviews"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"))


def run_summary(results: DataFrame, groups: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts per outcome and whether the run counts as a success."""
    failed = F.count_if(F.col("status").isin("failed", "error"))
    success = F.count_if(F.col("status") == "success")
    skipped = F.count_if(F.col("status") == "skipped")
    return results.groupBy(*groups).agg(
        success.alias("success_count"), failed.alias("failed_count"), skipped.alias("skipped_count"),
        ((failed == 0) | (success > 0) | (skipped == F.count(F.lit(1)))).alias("success"))


def home_pointer(runs: DataFrame, groups: Sequence[str] = (), order: str = "run_ord") -> DataFrame:
    """Newest date wins: whether each run moves the pointer, and where it points afterwards."""
    rows = running_max(runs, groups, [F.col(order)], "report_date", "_before")
    return rows.withColumn("moved", F.col("_before").isNull() | (F.col("report_date") >= F.col("_before"))).withColumn(
        "pointer", F.greatest("report_date", "_before")).drop("_before")


def rate_limit_decision(requests: DataFrame, limit: int = 5, order: Sequence[str] = ("ts", "request_id"),
                        period: str = "minute") -> DataFrame:
    """Per client and period: the first ``limit`` requests are allowed, the rest rejected.

    Only the first ``limit`` rows of a group are ordered; the others are compared with the last allowed
    one. ``limit`` outside 1..30 falls back to 5.
    """
    limit = limit if 1 <= limit <= 30 else 5
    rows = requests.withColumn("period", F.date_trunc(period, "ts"))
    place = F.struct(*order)
    first = first_n(rows.select("client", "period", *[c for c in order if c not in ("client", "period")]),
                    ["client", "period"], [F.col(c) for c in order], limit)
    last = first.groupBy("client", "period").agg(F.max(place).alias("_last"))
    return rows.join(last, ["client", "period"]).withColumn("allowed", place <= F.col("_last")).drop("_last")

