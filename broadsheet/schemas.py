"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

DETAILS = T.StructType([
    T.StructField("content_html", T.StringType()),
    T.StructField("feed_url", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("total_stars", T.LongType()),
    T.StructField("forks", T.LongType()),
    T.StructField("stars_today", T.LongType()),
    T.StructField("backfilled_from", T.DateType()),
])

ITEMS = T.StructType([
    T.StructField("report_date", T.DateType()),
    T.StructField("category", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("published_raw", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("details", DETAILS),
    T.StructField("source_ord", T.IntegerType()),
    T.StructField("item_ord", T.LongType()),
])

RAW_FEEDS = T.StructType([
    T.StructField("feed_name", T.StringType()),
    T.StructField("feed_url", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

ENTRY_PAGE = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("entries", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("publishedAt", T.StringType()),
            T.StructField("author", T.StringType()),
        ])),
        T.StructField("feeds", T.StructType([T.StructField("title", T.StringType())])),
    ]))),
])

REPO_FIELDS = T.StructType([
    T.StructField("full_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("html_url", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("stargazers_count", T.StringType()),
    T.StructField("watchers_count", T.StringType()),
    T.StructField("forks_count", T.StringType()),
    T.StructField("totalStars", T.StringType()),
    T.StructField("forks", T.StringType()),
    T.StructField("starsToday", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("updatedAt", T.StringType()),
    T.StructField("pushed_at", T.StringType()),
    T.StructField("pushedAt", T.StringType()),
])


def details_or_empty(name: str = "details"):
    """The details struct; a missing one becomes a struct of nulls, so that fields can be set."""
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in DETAILS.fields])
    return F.coalesce(F.col(name), empty)


def as_items(df: DataFrame) -> DataFrame:
    """Project ``df`` to the items schema: missing columns and detail fields become null."""
    present = {f.name: f.dataType for f in df.schema.fields}

    def detail(field):
        inner = present.get("details")
        known = isinstance(inner, T.StructType) and field.name in inner.names
        value = F.col(f"details.{field.name}") if known else F.lit(None)
        return value.cast(field.dataType).alias(field.name)

    columns = []
    for field in ITEMS.fields:
        if field.name == "details":
            columns.append(F.struct(*[detail(f) for f in DETAILS.fields]).alias("details"))
        else:
            value = F.col(field.name) if field.name in present else F.lit(None)
            columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def check_items(df: DataFrame, name: str) -> DataFrame:
    """Fail early when a registered transform does not return the items schema."""
    got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in ITEMS.fields}
    wrong = sorted(k for k in want if got.get(k) != want[k])
    if wrong or set(got) - set(want):
        raise ValueError(f"source {name!r} does not return the items schema: {wrong or sorted(set(got) - set(want))}")
    return df
