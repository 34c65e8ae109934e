"""What goes into the report of each date."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..fixed_values import (BACKFILL_CATEGORIES, BACKFILL_DAYS, CATEGORIES, CATEGORY_CAP, DEDUPE_DAYS, POLICY_HOST,
                            POLICY_MAX_ITEMS, QUOTAS, SNAPSHOT_TTL_DAYS)
from ..functions.html import has_media, strip_media_tags
from ..operators.dedupe import IDENTITY, dedupe_history
from ..operators.filters import on_host
from ..operators.joins import backfill_asof
from ..operators.ordering import first_n, same_row
from ..operators.selection import cap_ranked, quota_select, rank_order
from ..operators.texts import candidates, prompt_bundle
from ..session import broadcast_if_few, cut_lineage
from ..sources.snapshots import snapshot_range, snapshot_write

DAILY_CAP = 18


def ranked_and_capped(items: DataFrame, caps: Mapping[str, int] | None = None, cap: int = CATEGORY_CAP,
                      host: str = POLICY_HOST) -> DataFrame:
    """Host policy and category caps; adds ``has_media`` and ``rank``.

    Same rows as :func:`host_policy` and :func:`cap_per_category` in turn. Both decide on a narrow table, for which the
    contents are read once; they are read again for the rows within the caps.
    """
    html, groups = "details.content_html", ["report_date", "category"]
    hosted = F.coalesce(on_host("url", host) & (F.col("category") == "news"), F.lit(False))
    narrow = cut_lineage(items.select(
        *IDENTITY, "published_at", hosted.alias("_hosted"), has_media(html).alias("has_media"),
        F.when(hosted, has_media(strip_media_tags(html))).alias("_stripped")))
    limited = first_n(narrow.filter("_hosted"), groups, rank_order(), POLICY_MAX_ITEMS).withColumn(
        "has_media", F.col("_stripped"))
    best = cut_lineage(cap_ranked(narrow.filter("not _hosted").unionByName(limited), caps, cap))
    best = broadcast_if_few(best.select("has_media", "rank", "_hosted", *[F.col(c).alias(f"_at_{c}") for c in IDENTITY]))
    stripped = F.when(F.col("_hosted") & F.col(html).isNotNull(), strip_media_tags(html)).otherwise(F.col(html))
    return items.drop("has_media", "rank").join(best, same_row(IDENTITY, "_at_")).withColumn(
        "details", F.when(F.col("details").isNotNull(), F.col("details").withField("content_html", stripped))).drop(
        "_hosted", *[f"_at_{c}" for c in IDENTITY])


def daily_selection(items: DataFrame, history: DataFrame | None = None, dedupe_days: int = DEDUPE_DAYS,
                    quotas: Mapping[str, int] = QUOTAS, cap: int = DAILY_CAP) -> DataFrame:
    """Rank, cap, de-duplicate against earlier days and pick by quota, for many report dates at once."""
    # At most the category caps per date, so the rows are small enough to materialise with their contents.
    best = cut_lineage(ranked_and_capped(items))
    kept = dedupe_history(best, dedupe_days, history)
    return quota_select(candidates(kept), quotas, cap)


def run_daily(spark: SparkSession, items: DataFrame, snapshots: str, report_date, dedupe_days: int = DEDUPE_DAYS,
              lookback: int = BACKFILL_DAYS, cap: int = DAILY_CAP, written_at: Column | None = None,
              as_of: Column | None = None, ttl_days: int = SNAPSHOT_TTL_DAYS) -> DataFrame:
    """One scheduled run: de-duplicate against the stored days, store, fill empty categories, bundle.

    The stored snapshot is the one after de-duplication and before the fill; it replaces that of an earlier run of the
    date, empty categories included.
    """
    date = F.lit(report_date).cast("date")
    span = max(dedupe_days, lookback)
    past = snapshot_range(spark, snapshots, date, span, as_of=as_of, ttl_days=ttl_days).drop("written_at")
    recent = past.filter(F.col("report_date") >= F.date_sub(date, dedupe_days))
    best = cut_lineage(ranked_and_capped(items.filter(F.col("report_date") == date)))
    kept = cut_lineage(dedupe_history(best, dedupe_days, recent))
    run_dates = spark.range(1).select(date.alias("report_date"))
    replaced = run_dates.withColumn("category", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])))
    snapshot_write(kept.drop("has_media", "rank"), snapshots, written_at, replaced)
    order = [F.col("source_ord"), F.col("item_ord")]
    filled = backfill_asof(kept, past, run_dates, order, lookback, dedupe_days, categories=BACKFILL_CATEGORIES)
    # A few rows per date and category.
    filled = filled.withColumn("rank", F.row_number().over(W.partitionBy("report_date", "category").orderBy(*order)))
    everything = kept.drop("has_media").unionByName(filled, allowMissingColumns=True)
    return prompt_bundle(quota_select(candidates(everything), cap=cap))
