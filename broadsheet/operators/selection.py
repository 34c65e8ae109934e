"""Ranking, caps and quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed_values import BRIEF_QUOTAS, CATEGORY_CAP, PROMPT_CAP, QUOTA_ORDER, QUOTAS
from ..functions.html import has_media
from ..functions.text import filled
from ..session import cut_lineage
from .dedupe import IDENTITY
from .ordering import first_n, keep_first, ranked, same_row
from .texts import category_ord


def rank_order() -> list[Column]:
    """Media first, then newest; arrival order decides ties."""
    return [F.col("has_media").desc(), F.col("published_at").desc_nulls_last(), F.col("source_ord").asc(),
            F.col("item_ord").asc()]


def with_media_flag(items: DataFrame) -> DataFrame:
    return items.withColumn("has_media", has_media("details.content_html"))


def rank_category(items: DataFrame, groups: Sequence[str] = ("report_date", "category")) -> DataFrame:
    """Rank of every item in its category; adds ``has_media`` and ``rank``.

    Ranks come from a narrow table of identities, media flags and times; item contents are joined to them by identity.
    """
    ranks = category_ranks(items, groups).select(
        "has_media", "rank", *[F.col(c).alias(f"_at_{c}") for c in IDENTITY])
    return items.drop("has_media", "rank").join(ranks, same_row(IDENTITY, "_at_")).drop(*[f"_at_{c}" for c in IDENTITY])


def category_ranks(items: DataFrame, groups: Sequence[str] = ("report_date", "category")) -> DataFrame:
    """Identity, ``published_at``, ``has_media`` and ``rank`` of every item, without its contents."""
    names = list(dict.fromkeys([*groups, *IDENTITY, "published_at"]))
    return ranked(with_media_flag(items).select(*names, "has_media"), groups, rank_order(), "rank")


def _limits(values: Mapping[str, int], default: int | None) -> Column:
    limit = F.lit(default)
    for name, value in values.items():
        limit = F.when(F.col("category") == name, value).otherwise(limit)
    return limit


def cap_per_category(items: DataFrame, caps: Mapping[str, int] | None = None, default: int = CATEGORY_CAP,
                     groups: Sequence[str] = ("report_date", "category")) -> DataFrame:
    """The best items per category, up to its cap; adds ``has_media`` and ``rank``."""
    return cap_ranked(with_media_flag(items), caps, default, groups)


def cap_ranked(flagged: DataFrame, caps: Mapping[str, int] | None = None, default: int = CATEGORY_CAP,
               groups: Sequence[str] = ("report_date", "category")) -> DataFrame:
    """The best rows per category, up to its cap, of rows that have ``has_media``; adds ``rank``."""
    caps = dict(caps or {})
    best = first_n(flagged, groups, rank_order(), max([default, *caps.values()]), "rank")
    return best.filter(F.col("rank") <= _limits(caps, default))


def media_then_rest(items: DataFrame, cap: int, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Media items, then the others, each in the given order, cut at ``cap``; adds ``pick``."""
    return first_n(items, groups, [F.col("has_media").desc(), *order], cap, "pick")


def quota_select(cands: DataFrame, quotas: Mapping[str, int] = QUOTAS, cap: int = PROMPT_CAP,
                 quota_order: Sequence[str] = QUOTA_ORDER) -> DataFrame:
    """Pick candidates per report date: quotas first, then a fill by rank; adds ``pick``.

    Rows need ``report_date, category, category_ord, rank, key, has_media, published_at``; ``rank`` is unique
    per date and category. Every window is limited, so at most ``cap`` plus the quotas travel per task and
    date. The choice is made on a narrow table; other columns are joined to the picked rows only.
    """
    rows = cut_lineage(cands.select(
        "report_date", "category", "category_ord", "rank", filled("key").alias("key"), "has_media",
        F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("_time")))
    best = [F.col("has_media").desc(), F.col("_time").desc(), F.col("category_ord"), F.col("rank")]

    # Quotas: the first candidates of each category, cut before keys are made unique.
    known = rows.filter(F.col("category").isin(*quotas))
    slices = first_n(known, ["report_date", "category"], best, max(quotas.values()), "_slot").filter(
        F.col("_slot") <= _limits(quotas, 0)).filter(F.col("key").isNotNull())
    pick_order = [category_ord(order=quota_order), F.col("_slot")]
    unique = keep_first(slices, ["report_date", "key"], pick_order)
    chosen = first_n(unique, ["report_date"], pick_order, cap, "pick").drop("_slot")

    # Fill: papers only while the quota phase left room for them.
    counts = chosen.groupBy("report_date").agg(
        F.count(F.lit(1)).alias("_chosen"), F.count_if(F.col("category") == "paper").alias("_papers"))
    rest = (rows.filter(F.col("key").isNotNull()).join(counts, "report_date", "left")
            .withColumn("_chosen", F.coalesce("_chosen", F.lit(0)))
            .filter((F.col("category") != "paper") | (F.coalesce("_papers", F.lit(0)) < quotas.get("paper", 0)))
            .filter(F.col("_chosen") < cap))
    fresh = keep_first(rest, ["report_date", "key"], best).join(
        chosen.select("report_date", "key"), ["report_date", "key"], "left_anti")
    fill = first_n(fresh, ["report_date"], best, cap, "_fill").filter(F.col("_fill") + F.col("_chosen") <= cap)
    fill = fill.withColumn("pick", (F.col("_fill") + F.col("_chosen")).cast("int"))
    picks = ["report_date", "category", "rank", "pick"]
    return cands.join(chosen.select(picks).unionByName(fill.select(picks)), picks[:3])


def brief_select(items: DataFrame, quotas: Mapping[str, int] = BRIEF_QUOTAS, order: Sequence[str] | None = None,
                 groups: Sequence[str] = ("report_date",), item_order: Sequence[Column] | None = None) -> DataFrame:
    """First items per category in the given order, up to their quota; adds ``pick``."""
    order = list(order or quotas)
    item_order = list(item_order or [F.col("rank")])
    slices = first_n(items.filter(F.col("category").isin(*quotas)), [*groups, "category"], item_order,
                     max(quotas.values()), "_slot").filter(F.col("_slot") <= _limits(quotas, 0))
    return slices.withColumn("pick", F.row_number().over(
        W.partitionBy(*groups).orderBy(category_ord(order=order), "_slot"))).drop("_slot")


def month_weight(year_month) -> Column:
    """Weight that falls as months get newer."""
    year, month = F.substring(year_month, 1, 4).cast("int"), F.substring(year_month, 6, 2).cast("int")
    return F.lit(1000000) - (year - 2000) * 12 - month


def month_order(reports: DataFrame, date: str = "report_date") -> DataFrame:
    """Months newest first by weight, days inside a month by ``max(32 - day, 0)``; adds ``position``."""
    rows = reports.withColumn("month", F.date_format(date, "yyyy-MM")).withColumn(
        "month_weight", month_weight(F.col("month"))).withColumn(
        "day_weight", F.greatest(F.lit(32) - F.dayofmonth(date), F.lit(0)))
    return ranked(rows, [], [F.col("month_weight"), F.col("day_weight")], "position")
