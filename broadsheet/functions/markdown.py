"""Markdown text functions. Lines and sections are arrays inside one row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import (BODY_FALLBACK_MARKER, BODY_MARKERS, DEFAULT_IMAGE_ALT, DEFAULT_PICTURE_ALT, IMAGE_LABEL,
                            VIDEO_EXTENSION, VIDEO_LABEL)
from .text import (LINE_CHAR, NOT_SPACE, S, S_IN_LINE, filled, let, replace_each, squeeze, text_or_empty,
                   trim_all, utf16_length, utf16_prefix)
from .urls import clean_url, is_image_url, norm_url_link, url_origin

_TARGET = rf"""\((https?://(?:(?!\)){NOT_SPACE})+)(?:{S}+["'][^"']+["'])?\)"""
_LINK = rf"(?i)\[([^\]]+)\]{_TARGET}"
_LINK_OR_IMAGE = rf"(?i)!?\[([^\]]+)\]{_TARGET}"
_IMAGE = rf"(?i)!\[([^\]]*)\]{_TARGET}"
_URL = rf"""(?i)https?://(?:(?![)<>"']){NOT_SPACE})+"""


def strip_markdown(c) -> Column:
    c = F.regexp_replace(text_or_empty(c), r"!\[[^\]]*\]\([^)]+\)", "")
    c = F.regexp_replace(c, r"\[[^\]]+\]\(([^)]+)\)", "")
    return squeeze(F.regexp_replace(c, "[`*_>#-]", ""))


def extract_urls(c) -> Column:
    """Distinct cleaned web addresses in order of first appearance."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(_URL), F.lit(0))
    return F.array_distinct(F.transform(found, clean_url))


def md_links(c) -> Column:
    """``array<struct<text, url>>`` of the links that are not images."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(_LINK_OR_IMAGE), F.lit(0))
    links = F.filter(found, lambda m: ~m.startswith("!"))
    return F.transform(links, lambda m: F.struct(
        trim_all(F.regexp_extract(m, _LINK, 1)).alias("text"),
        clean_url(F.regexp_extract(m, _LINK, 2)).alias("url")))


def md_images(c) -> Column:
    found = F.regexp_extract_all(text_or_empty(c), F.lit(_IMAGE), F.lit(0))
    return F.transform(found, lambda m: F.struct(
        trim_all(F.regexp_extract(m, _IMAGE, 1)).alias("alt"),
        clean_url(F.regexp_extract(m, _IMAGE, 2)).alias("url")))


def _placeholder(c, label: str, as_link, default: str) -> Column:
    pattern = rf"\[{label}:{S}*[^\]]+?\]"

    def build(found: Column) -> Column:
        inner = F.regexp_extract(found, rf"\A\[{label}:{S}*([^\]]+?)\]", 1)

        def render(parts: Column) -> Column:
            url = F.element_at(parts, -1)
            rest = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")
            video = F.concat(
                F.lit('<video controls preload="metadata" playsinline style="max-width:100%; height:auto;" src="'),
                url, F.lit('"></video>'))
            shown = as_link(F.coalesce(filled(rest), F.lit(default)), url)
            return F.when(~url.rlike("(?i)^https?://"), found).when(url.rlike(VIDEO_EXTENSION), video).otherwise(shown)

        return let(F.split(trim_all(inner), f"{S}+"), render)

    return replace_each(c, pattern, build)


def placeholders_to_md(c) -> Column:
    """Media placeholders to Markdown images, links or video tags; non-web ones stay."""
    c = _placeholder(text_or_empty(c), VIDEO_LABEL, lambda t, u: F.concat(
        F.lit("["), t, F.lit("]("), u, F.lit(")")), VIDEO_LABEL)
    return _placeholder(c, IMAGE_LABEL, lambda t, u: F.concat(
        F.lit("!["), t, F.lit("]("), u, F.lit(")")), DEFAULT_IMAGE_ALT)


def _single_blank_lines(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, "\n{3,}", "\n\n"))


def drop_toc(c) -> Column:
    """Remove tables of contents: the heading and the blank or anchor-link lines after it."""
    heading = rf"(?i)\A{S}*#{{2,3}}{S}*(Table of contents|目录){S}*\z"
    start = rf"(?imd)^(?={S_IN_LINE}*#{{2,3}}{S_IN_LINE}*(?:Table of contents|目录){S_IN_LINE}*$)"
    anchor = rf"\A{S}*([-*+]|\d+\.){S}+\[[^\]]+\]\(#[^)]+\)"

    def chunk(part: Column) -> Column:
        def cut(lines: Column) -> Column:
            keep = F.transform(lines, lambda line, i: (i > 0) & (trim_all(line) != "") & ~line.rlike(anchor))
            first = F.array_position(keep, True)
            return F.when(~F.get(lines, F.lit(0)).rlike(heading), part).when(first > 0, F.array_join(
                F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise("")

        return let(F.split(part, "\n"), cut)

    return _single_blank_lines(F.array_join(F.transform(F.split(text_or_empty(c), start), chunk), ""))


def top_numbering(c) -> Column:
    """Number the ``###`` headings of each ``## **… TOP n`` section; numbered ones keep their number."""
    top = rf"##{S_IN_LINE}*\*\*{LINE_CHAR}*TOP{S_IN_LINE}+\d+"
    boundary = rf"(?imd)^(?=##{S_IN_LINE}+|{top})"
    heading = rf"(?md)^(?=###{S_IN_LINE}+{LINE_CHAR})"
    text = F.regexp_replace(text_or_empty(c), "\r\n", "\n")

    def number(part: Column, i: Column) -> Column:
        plain = part.rlike(rf"\A###{S_IN_LINE}+{LINE_CHAR}") & ~part.rlike(rf"\A###{S_IN_LINE}+\d+\.{S}")
        prefix = F.regexp_extract(part, rf"\A(###{S_IN_LINE}+(?={LINE_CHAR}))", 1)
        rest = F.substring(part, F.length(prefix) + 1, F.length(part))
        return F.when((i > 0) & plain, F.concat(prefix, i.cast("string"), F.lit(". "), rest)).otherwise(part)

    def section(part: Column) -> Column:
        parts = F.split(part, heading)
        return F.when(part.rlike(rf"(?i)\A{top}"), F.array_join(F.transform(parts, number), "")).otherwise(part)

    return F.array_join(F.transform(F.split(text, boundary), section), "")


def normalize_body(c) -> Column:
    """Number the TOP sections and drop everything before the report body."""
    text = top_numbering(c)

    def cut(t: Column) -> Column:
        starts = [F.nullif(F.instr(t, marker), F.lit(0)) for marker in (*BODY_MARKERS, BODY_FALLBACK_MARKER)]
        return trim_all(F.substring(t, F.coalesce(*starts, F.lit(1)), F.length(t)))

    return let(text, cut)


def is_allowed_url(url, allowed_normal: Column, origins) -> Column:
    """On the normalised allow-list or on an always allowed origin."""
    return let(norm_url_link(url), lambda u: F.array_contains(allowed_normal, u) | F.coalesce(
        url_origin(u).isin(*origins), F.lit(False)))


def normalize_markdown(c, allowed_urls, origins) -> Column:
    """Drop tables of contents and foreign images; media that are no images become links."""
    def render(found: Column, allowed: Column) -> Column:
        alt = F.coalesce(filled(trim_all(F.regexp_extract(found, _IMAGE, 1))), F.lit(DEFAULT_PICTURE_ALT))

        def shown(url: Column) -> Column:
            link = F.concat(F.lit("["), alt, F.lit("]("), url, F.lit(")"))
            return F.when(~is_allowed_url(url, allowed, origins), "").when(
                is_image_url(url), F.concat(F.lit("!"), link)).otherwise(link)

        return let(clean_url(F.regexp_extract(found, _IMAGE, 2)), shown)

    # The normalised list is bound once per row; inside the replacement it would be rebuilt per image.
    return _single_blank_lines(let(F.transform(allowed_urls, norm_url_link), lambda allowed: replace_each(
        drop_toc(c), _IMAGE, lambda found: render(found, allowed))))


def derive_description(c, fallback_title) -> Column:
    """First plain paragraph of at least 20 characters, cut at 120; else the title."""
    parts = F.transform(F.split(text_or_empty(c), "\n{2,}"), trim_all)
    skip = (rf"\A#{{1,6}}{S}", r"\A[-*_]{3,}\z", rf"\A>{S}", r"\A!\[[^\]]*\]\([^)]+\)\z",
            r"(?i)\ATable of contents\z")

    def wanted(p: Column) -> Column:
        ok = p != ""
        for pattern in skip:
            ok = ok & ~p.rlike(pattern)
        return ok & (utf16_length(strip_markdown(p)) >= 20)

    source = F.coalesce(F.get(F.filter(parts, wanted), F.lit(0)), text_or_empty(fallback_title))
    return let(strip_markdown(source), lambda d: F.when(
        utf16_length(d) > 120, F.concat(utf16_prefix(d, 117), F.lit("..."))).otherwise(d))
