"""Prompt candidates and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import CATEGORIES, PROMPT_SEPARATOR
from ..functions.dates import published_text
from ..functions.html import has_media, media_hint, strip_html
from ..functions.text import filled, first_filled, shorten, text_or_empty


def category_ord(category="category", order=CATEGORIES) -> Column:
    """Position of the category in a fixed order; unknown categories come last."""
    category = F.col(category) if isinstance(category, str) else category
    position = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(position > 0, position.cast("int")).otherwise(len(order) + 1)


def item_hint() -> Column:
    return media_hint(F.col("title"), F.col("details.image_url"), F.col("details.content_html"))


def item_has_media() -> Column:
    """A candidate has media when it has a hint or its HTML shows an image or video."""
    return (item_hint() != "") | has_media("details.content_html")


def _published() -> Column:
    return text_or_empty(published_text("published_raw", "published_at"))


def item_prompt_text() -> Column:
    """Category-specific text of an item, with its media hint on a last line."""
    body = strip_html(F.col("details.content_html"))
    title, url, published = text_or_empty("title"), text_or_empty("url"), _published()
    missing = F.lit("N/A")

    def lines(*parts) -> Column:
        return F.concat_ws("\n", *parts)

    def labelled(label: str, value) -> Column:
        return F.concat(F.lit(label), value)

    text = (
        F.when(F.col("category") == "news", lines(
            labelled("News Title: ", title), labelled("Published: ", published), labelled("Url: ", url),
            labelled("Content Summary: ", body)))
        .when(F.col("category") == "project", lines(
            labelled("Project Name: ", title), labelled("Published: ", published), labelled("Url: ", url),
            labelled("Description: ", text_or_empty("description")),
            labelled("Stars: ", F.coalesce(F.col("details.total_stars").cast("string"), F.lit("null")))))
        .when(F.col("category") == "paper", lines(
            labelled("Papers Title: ", title), labelled("Published: ", published), labelled("Url: ", url),
            labelled("Abstract/Content Summary: ", body)))
        .when(F.col("category") == "socialMedia", lines(
            F.concat(F.lit("socialMedia Post by "), F.array_join(F.col("authors"), ", "),
                     F.lit("：Published: "), published),
            labelled("Url: ", url), labelled("Content: ", body)))
        .otherwise(lines(
            labelled("Type: ", text_or_empty("category")),
            labelled("Title: ", first_filled("title", missing)),
            labelled("Description: ", first_filled("description", missing)),
            labelled("URL: ", first_filled("url", missing)),
            labelled("Published: ", filled(published)),
            labelled("Source: ", filled("source")),
            F.when(text_or_empty("details.content_html") != "", labelled("Content: ", body)))))
    return F.concat_ws("\n", text, filled(item_hint()))


def item_brief_text() -> Column:
    """Uniform brief with optional lines; long texts are cut."""
    content = shorten(strip_html(F.col("details.content_html")), 700)
    missing = F.lit("N/A")

    def line(label: str, value) -> Column:
        return F.concat(F.lit(label), value)

    return F.concat_ws(
        "\n",
        line("Type: ", F.col("category")),
        line("Title: ", first_filled("title", missing)),
        line("Published: ", first_filled(_published(), missing)),
        line("Source: ", first_filled("source", missing)),
        line("Url: ", first_filled("url", missing)),
        F.when(text_or_empty("description") != "", line("Description: ", shorten("description", 400))),
        line("Stars: ", F.col("details.total_stars").cast("string")),
        line("Language: ", filled("details.language")),
        line("Content: ", filled(content)))


def candidates(items: DataFrame) -> DataFrame:
    """Items with the columns the selection needs: key, media flag and arrival order."""
    return items.withColumns({
        "category_ord": category_ord(), "has_media": item_has_media(),
        "key": F.coalesce(filled("url"), F.concat(F.col("category"), F.lit(":"), text_or_empty("title")))})


def prompt_bundle(selected: DataFrame, groups=("report_date",), order: str = "pick", text: Column | None = None,
                  separator: str = PROMPT_SEPARATOR) -> DataFrame:
    """Texts of the selected items in order, with the separator before, between and after them.

    The selection is capped, so a group is small.
    """
    text = item_prompt_text() if text is None else text
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return selected.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.concat(F.lit(separator), F.array_join(F.transform(ordered, lambda s: s["t"]), separator),
                 F.lit(separator)).alias("prompt"))
