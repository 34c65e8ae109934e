"""HTML and feed-XML text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..fixed_values import (ANY_TAG, DEFAULT_HINT_TITLE, IMAGE_LABEL, IMAGE_WITH_ALT, IMAGE_WITH_SRC, LINK_TAG, MEDIA_TAGS,
                            PAPER_PDF_PREFIX, PAPER_URL, VIDEO_LABEL)
from .text import LINE_CHAR, S, any_match, col, filled, first_filled, first_match, replace_all, squeeze, text_or_empty, trim_all

END_OF_NAME = "(?![A-Za-z0-9_])"


def strip_html(c) -> Column:
    """Plain text: images and videos become placeholders, other tags blanks."""
    c = text_or_empty(c)
    c = F.regexp_replace(c, IMAGE_WITH_ALT, f"[{IMAGE_LABEL}: $2 $1]")
    c = F.regexp_replace(c, IMAGE_WITH_SRC, f"[{IMAGE_LABEL}: $1]")
    c = F.regexp_replace(
        c, rf'(?i)<video[^>]*src="([^"]*)"[^>]*>{LINE_CHAR}*?</video>', f"[{VIDEO_LABEL}: $1]")
    return squeeze(F.regexp_replace(c, ANY_TAG, " "))


def strip_media_tags(c) -> Column:
    c = F.regexp_replace(text_or_empty(c), f"(?i)<img{END_OF_NAME}[^>]*>", "")
    c = F.regexp_replace(c, f"(?is)<video{END_OF_NAME}[^>]*>.*?</video>", "")
    return F.regexp_replace(c, f"(?i)<video{END_OF_NAME}[^>]*/>", "")


def minify_html(c) -> Column:
    return trim_all(F.regexp_replace(text_or_empty(c), f">{S}+<", "><"))


def escape_html(c) -> Column:
    return replace_all(text_or_empty(c), (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")))


def _numeric_entities(c: Column, head: str, digits: str, base: int) -> Column:
    """Decode one notation of numeric entities; code points that do not exist stay as they are."""
    entity = f"(?i)^{head}({digits}+);"

    def piece(p: Column) -> Column:
        code = F.conv(F.regexp_extract(p, entity, 1), base, 10).try_cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(p.rlike(entity) & valid, F.concat(char, F.regexp_replace(p, entity, ""))).otherwise(p)

    return F.array_join(F.transform(F.split(c, f"(?i)(?={head}{digits}+;)"), piece), "")


def decode_entities(c) -> Column:
    """Unwrap CDATA, then numeric (hex, decimal) and named entities."""
    c = F.regexp_replace(text_or_empty(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    c = _numeric_entities(c, "&#x", "[0-9a-f]", 16)
    c = _numeric_entities(c, "&#", "[0-9]", 10)
    return replace_all(c, (
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#039;", "'")))


def _tag(name: str) -> str:
    name = re.escape(name)
    return rf"(?is)<{name}(?![A-Za-z0-9_])[^>]*>(.*?)</{name}>"


def xml_tag(block, *names: str) -> Column:
    """Decoded content of the first tag found, in order of preference; empty when there is none."""
    found = F.coalesce(*[first_match(block, _tag(n), 1) for n in names], F.lit(""))
    return decode_entities(trim_all(found))


def xml_all_tags(block, *names: str) -> Column:
    values = F.flatten(F.array(*[
        F.regexp_extract_all(col(block), F.lit(_tag(n)), F.lit(1)) for n in names]))
    return F.transform(values, lambda v: decode_entities(trim_all(v)))


def _attr(tag: str, attr: str) -> str:
    return rf"""(?i)<{tag}(?![A-Za-z0-9_])[^>]*{S}{attr}=["']([^"']+)["'][^>]*>"""


def xml_attr(block, tag: str, attr: str) -> Column:
    return decode_entities(trim_all(F.regexp_extract(col(block), _attr(re.escape(tag), re.escape(attr)), 1)))


def image_url(c) -> Column:
    """First media:content, enclosure or img address; empty when there is none."""
    c = text_or_empty(c)
    return decode_entities(F.coalesce(*[
        filled(F.regexp_extract(c, _attr(tag, attr), 1))
        for tag, attr in (("media:content", "url"), ("enclosure", "url"), ("img", "src"))], F.lit("")))


def first_link(c) -> Column:
    return decode_entities(F.regexp_extract(text_or_empty(c), LINK_TAG, 1))


def has_media(c) -> Column:
    return any_match(text_or_empty(c), MEDIA_TAGS)


def media_url(explicit, html) -> Column:
    """Explicit image address, else the first image, else the first video of the HTML."""
    html = text_or_empty(html)
    return F.coalesce(filled(explicit), filled(F.regexp_extract(html, _attr("img", "src"), 1)),
                      filled(F.regexp_extract(html, _attr("video", "src"), 1)), F.lit(""))


def media_hint(title, explicit, html) -> Column:
    """``[image: title address]`` for an http(s) medium, else the empty string."""
    url = media_url(explicit, html)
    label = squeeze(first_filled(title, F.lit(DEFAULT_HINT_TITLE)))
    return F.when(url.rlike("(?i)^https?://"),
                  F.concat(F.lit(f"[{IMAGE_LABEL}: "), label, F.lit(" "), url, F.lit("]"))).otherwise("")


def build_content_html(title, summary, image, url) -> Column:
    """Image paragraph, summary paragraph and, for paper pages, a PDF link."""
    paper = F.regexp_extract(text_or_empty(url), PAPER_URL, 1)
    image_part = F.when(text_or_empty(image) != "", F.concat(
        F.lit('<p><img src="'), escape_html(image), F.lit('" alt="'), escape_html(title), F.lit('"></p>')))
    pdf_part = F.when(paper != "", F.concat(
        F.lit(f'<p><a href="{PAPER_PDF_PREFIX}'), paper,
        F.lit('" target="_blank" rel="noopener noreferrer">PDF</a></p>')))
    return F.concat(text_or_empty(image_part), F.lit("<p>"), text_or_empty(summary), F.lit("</p>"),
                    text_or_empty(pdf_part))
