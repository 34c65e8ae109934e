"""Repository search results to unified items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import parse_pub_date
from ..functions.text import filled, first_filled, text_or_empty
from ..operators.ordering import ranked
from ..schemas import REPO_FIELDS, as_items


def scan_repo_search(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per repository of a search result (``{"items": [...]}``) or of a bare array."""
    items = F.get_json_object(body, "$.items")
    is_search = items.isNotNull()
    keep = [c for c in pages.columns if c != body]
    parsed = F.from_json(F.coalesce(items, F.col(body)), T.ArrayType(REPO_FIELDS))
    r = F.col("_r")
    rows = pages.withColumn("_search", is_search).select(*keep, "_search", F.posexplode(parsed).alias("_pos", "_r"))

    def either(search: Column, bare: Column) -> Column:
        return F.when(F.col("_search"), search).otherwise(bare)

    owner = first_filled(F.get_json_object(r["owner"], "$.login"), F.get_json_object(r["owner"], "$.name"))
    return rows.select(
        *keep, F.col("_pos").cast("long").alias("item_ord"),
        either(first_filled(r["full_name"], r["name"]), r["name"]).alias("name"),
        either(first_filled(r["html_url"], r["url"]), r["url"]).alias("url"),
        text_or_empty(r["description"]).alias("description"),
        either(F.coalesce(owner, F.lit("")), text_or_empty(r["owner"])).alias("owner"),
        text_or_empty(r["language"]).alias("language"),
        either(F.coalesce(r["stargazers_count"], r["watchers_count"]), r["totalStars"]).alias("total_stars"),
        either(r["forks_count"], r["forks"]).alias("forks"),
        either(F.lit(None), r["starsToday"]).alias("stars_today"),
        either(F.coalesce(r["updated_at"], r["updatedAt"]), r["updatedAt"]).alias("updated_raw"),
        either(F.coalesce(r["pushed_at"], r["pushedAt"]), r["pushedAt"]).alias("pushed_raw")
    ).withColumn("updated_at", parse_pub_date("updated_raw")).withColumn("pushed_at", parse_pub_date("pushed_raw")).withColumn(
        "last_activity_at", F.greatest("updated_at", "pushed_at")).withColumn(
        "last_activity_raw", F.when(
            F.col("updated_at").isNotNull() & (F.col("pushed_at").isNull() | (F.col("updated_at") >= F.col("pushed_at"))),
            F.col("updated_raw")).when(F.col("pushed_at").isNotNull(), F.col("pushed_raw")))


def unify_repo_items(repos: DataFrame, source_ord: int = 0, date: str = "report_date", order=("item_ord",)) -> DataFrame:
    """Repositories to items: the id is the 1-based position within the report date, in the order of unique ``order``."""
    placed = ranked(repos, [date], [F.col(c) for c in order], "_position", order)
    description = (F.coalesce(filled("description_zh"), F.col("description"))
                   if "description_zh" in repos.columns else F.col("description"))
    raw = first_filled("last_activity_raw", "pushed_raw", "updated_raw")
    return as_items(placed.select(
        date, F.lit("project").alias("category"), F.lit("GitHub Trending").alias("source"),
        F.col("_position").cast("string").alias("id"), "url", F.col("name").alias("title"),
        text_or_empty(description).alias("description"),
        F.coalesce("last_activity_at", F.to_timestamp(F.col(date).cast("string"))).alias("published_at"),
        F.coalesce(raw, F.col(date).cast("string")).alias("published_raw"),
        F.when(filled("owner").isNotNull(), F.array("owner")).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.struct("owner", "language", F.col("total_stars").try_cast("bigint").alias("total_stars"),
                 F.col("forks").try_cast("bigint").alias("forks"),
                 F.col("stars_today").try_cast("bigint").alias("stars_today")).alias("details"),
        F.lit(source_ord).alias("source_ord"), F.col("_position").alias("item_ord")))
