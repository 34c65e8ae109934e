"""Joins with earlier days, translations, selections and allow-lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import BACKFILL_CATEGORIES, BACKFILL_DAYS, BACKFILL_ROWS, DEDUPE_DAYS
from ..functions.markdown import md_links
from ..functions.text import filled, text_or_empty
from ..functions.urls import norm_url_link, url_origin
from ..schemas import details_or_empty
from ..session import broadcast_if_few, cut_lineage
from .dedupe import IDENTITY, dedupe_keys, drop_seen
from .ordering import first_n, keep_first, ranked, same_row


def anti_prev_day(repos: DataFrame, snapshots: DataFrame, date: str = "report_date") -> DataFrame:
    """Repositories not in the previous day's snapshot; a date that would become empty keeps all rows."""
    yesterday = snapshots.filter(filled("url").isNotNull()).select(
        F.date_add(date, 1).alias("_d"), F.col("url").alias("_u")).distinct().withColumn("_seen", F.lit(True))
    # Rows without address get distinct values that match nothing, so they do not share one task.
    url = F.coalesce(F.col("url"), F.concat(F.lit("\u0001"), F.xxhash64(*repos.columns).cast("string")))
    flagged = repos.join(yesterday, (F.col(date) == F.col("_d")) & (url == F.col("_u")), "left").drop("_d", "_u")
    fresh = flagged.groupBy(F.col(date).alias("_date")).agg(F.count_if(F.col("_seen").isNull()).alias("_fresh"))
    return flagged.join(fresh, F.col(date) == F.col("_date")).filter(
        F.col("_seen").isNull() | (F.col("_fresh") == 0)).drop("_seen", "_date", "_fresh")


def backfill_asof(today: DataFrame, snapshots: DataFrame, run_dates: DataFrame, order: Sequence[Column],
                  lookback: int = BACKFILL_DAYS, dedupe_days: int = DEDUPE_DAYS, rows: int = BACKFILL_ROWS,
                  categories: Sequence[str] = BACKFILL_CATEGORIES) -> DataFrame:
    """Fill empty (date, category) pairs from the nearest earlier snapshot day with fresh rows.

    ``today`` are the items kept per report date, ``snapshots`` the stored ones. Returns only the added
    rows, dated to the report date and tagged with the day they come from. Which stored days come into question is
    decided on presence per (category, day), and the history test runs once for all categories. Categories are then filled one
    after the other, because rows added to one count as seen for the next. ``order`` are ascending columns.
    """
    keys = ["report_date", "url_key", "title_key"]
    # Keys are normalised once, in narrow tables; contents are joined to the few added rows at the end.
    places = [F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]).alias("_place")]
    stored = cut_lineage(dedupe_keys(snapshots).select(*IDENTITY, "url_key", "title_key", *places))
    current = cut_lineage(dedupe_keys(today).select("category", *keys))
    dates = run_dates.select("report_date").distinct()
    # As-of step on presence alone: the empty (category, run date) pairs and the stored days each may fall back to.
    grid = dates.withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))
    empty = grid.join(current.select("category", "report_date").distinct(), ["category", "report_date"], "left_anti")
    present = stored.select("category", "report_date").distinct()
    days = empty.select("category", F.col("report_date").alias("_run"), F.explode(F.sequence(
        F.lit(1), F.lit(lookback))).alias("_back")).withColumn("report_date", F.date_sub("_run", F.col("_back")))
    days = days.join(present, ["category", "report_date"])
    # One test against history and the day itself for all categories, on the rows of those days only.
    fresh = stored.join(days, ["category", "report_date"])
    for key in ("url_key", "title_key"):
        fresh = drop_seen(fresh, stored, dedupe_days, key, date="_run")
        fresh = drop_seen(fresh, current, 0, key, date="_run", first_day=0)
    fresh = cut_lineage(fresh)
    added = None
    for category in categories:
        pool = fresh.filter(F.col("category") == category)
        if added is not None:
            # A few rows per run date.
            now = added.select(F.col("_run").alias("report_date"), "url_key", "title_key")
            for key in ("url_key", "title_key"):
                pool = drop_seen(pool, now, 0, key, date="_run", first_day=0)
        best = first_n(pool, ["_run"], [F.col("_back"), F.col("_place")], rows)
        nearest = best.groupBy(F.col("_run").alias("_r")).agg(F.min("_back").alias("_b"))
        fill = cut_lineage(best.join(nearest, (F.col("_run") == F.col("_r")) & (F.col("_back") == F.col("_b"))).drop(
            "_r", "_b"))
        added = fill if added is None else added.unionByName(fill)
    wanted = added.select(*IDENTITY, "_run")
    return snapshots.join(broadcast_if_few(cut_lineage(wanted)), IDENTITY).withColumn(
        "details", details_or_empty().withField("backfilled_from", F.col("report_date"))).withColumn(
        "report_date", F.col("_run")).drop("_run")


def translation_by_id(items: DataFrame, translations: DataFrame, id_col: str = "id", text: str = "title",
                      translated: str = "title_zh") -> DataFrame:
    """Overlay translated texts by id; the last translation of an id wins, missing ones keep the original.

    ``translations`` has ``id``, the translated column and ``ord``.
    """
    usable = translations.filter(F.col(translated).isNotNull())
    latest = keep_first(usable, ["id"], [F.col("ord").desc()]).select(
        F.col("id").alias("_tid"), F.col(translated).alias("_text"))
    joined = items.join(latest, F.col(id_col) == F.col("_tid"), "left")
    return joined.withColumn(translated, F.coalesce("_text", text_or_empty(text))).drop("_tid", "_text")


def translation_by_pos(items: DataFrame, translations: DataFrame, groups: Sequence[str], order: Sequence[str],
                       text: str = "description", translated: str = "description_zh") -> DataFrame:
    """Overlay array translations by position; a group whose lengths differ keeps its originals.

    ``translations`` has one row per group with ``texts array<string>``. ``order`` names columns that tell the rows of a
    group apart. Positions and texts meet in a narrow table; items are joined to it once.
    """
    names = list(dict.fromkeys([*groups, *order]))
    placed = ranked(items.select(*names), groups, [F.col(c) for c in order], "_pos")
    sizes = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    fitting = translations.join(sizes, list(groups)).filter(F.size("texts") == F.col("_n"))
    texts = fitting.select(*groups, F.posexplode("texts").alias("_i", "_text")).withColumn(
        "_pos", (F.col("_i") + 1).cast("long")).drop("_i")
    found = placed.join(texts, [*groups, "_pos"]).select("_text", *[F.col(c).alias(f"_at_{c}") for c in names])
    return items.join(found, same_row(names, "_at_"), "left").withColumn(
        translated, F.coalesce("_text", text_or_empty(text))).drop("_text", *[f"_at_{c}" for c in names])


def selection_parse(selection) -> tuple[Column, Column]:
    """``type:id`` split at the first colon; the id may itself contain colons."""
    parts = F.split(selection, ":", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def selection_join(requests: DataFrame, items: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Requested ``type:id`` references to items: first match per reference, in request order.

    ``requests`` has ``report_date, request_ord, selection``; unknown references are dropped.
    """
    kind, ident = selection_parse("selection")
    wanted = requests.select(F.col("report_date").alias("_d"), "request_ord", "selection",
                             kind.alias("_kind"), ident.alias("_id"))
    on = (F.col("report_date") == F.col("_d")) & (F.col("category") == F.col("_kind")) & (F.col("id") == F.col("_id"))
    needed = wanted.select("_d", "_kind", "_id").distinct()
    first = keep_first(items.join(needed, on, "left_semi"), ["report_date", "category", "id"], order)
    return wanted.join(first, on).drop("_d", "_kind", "_id")


def allowed_url_check(docs: DataFrame, allowed: DataFrame, origins: Sequence[str]) -> DataFrame:
    """Links of each document that are neither on its allow-list nor on an allowed origin.

    ``docs`` has ``doc_id, body``; ``allowed`` has ``doc_id, url``.
    """
    links = docs.select("doc_id", F.posexplode(md_links("body")).alias("link_ord", "link")).select(
        "doc_id", "link_ord", F.col("link.url").alias("url"))
    links = links.withColumn("_norm", norm_url_link("url")).filter(
        ~F.coalesce(url_origin("_norm").isin(*origins), F.lit(False)))
    permitted = allowed.select("doc_id", norm_url_link("url").alias("_norm")).distinct()
    return links.join(permitted, ["doc_id", "_norm"], "left_anti").drop("_norm")
