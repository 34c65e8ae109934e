"""Rule-based quality gates: one projection per document, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (AI_SIGNALS, ALWAYS_ALLOWED_ORIGINS, BLACKHAT, BODY_MIN, DAILY_MIN, DAILY_TITLE_PREFIXES,
                            DIRECTIVES, FABRICATED_TODAY, MATERIAL_GROUPS, SENTENCE_SEVERE, SENTENCE_WARN,
                            SENTENCE_WARN_COUNT, SIGNAL_LIMIT, TITLE_MAX, TITLE_MIN)
from ..functions.markdown import extract_urls, is_allowed_url, md_images, md_links, strip_markdown
from ..functions.text import S, any_word, let, text_or_empty, trim_all, utf16_length
from ..functions.urls import is_image_url, norm_url_link, url_origin


@dataclass(frozen=True)
class GatePolicy:
    """Names of one deployment: its own sites, its shop and field terms, its daily title prefixes."""

    main_origins: tuple[str, ...] = ()
    own_origins: tuple[str, ...] = ()
    shop_terms: tuple[str, ...] = ()
    field_terms: tuple[str, ...] = ()
    title_prefixes: tuple[str, ...] = DAILY_TITLE_PREFIXES
    #: Document kinds with signal words of their own, as (kind, words); other kinds use the AI words.
    kind_signals: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def allowed_origins(self) -> tuple[str, ...]:
        return (*self.main_origins, *self.own_origins, *ALWAYS_ALLOWED_ORIGINS)

    @property
    def material_words(self) -> tuple[tuple[str, ...], ...]:
        own, trade, field = MATERIAL_GROUPS
        return (*own, *self.shop_terms), trade, (*field, *self.field_terms)


def _spaced(pattern: str) -> str:
    """The pattern with white space of any kind, the no-break and ideographic blanks included."""
    return pattern.replace(r"\s", S)


def _any_rule(c, rules) -> Column:
    """One of the (words, pattern) rules applies; a pattern only runs on texts with one of its words."""
    text = text_or_empty(c)
    result = F.lit(False)
    for words, pattern in rules:
        result = result | (any_word(F.lower(text), words) & text.rlike(_spaced(pattern)))
    return result


def directive_codes(c) -> Column:
    """Codes of the violated directive rules, in fixed order."""
    text = text_or_empty(c)
    return F.array_compact(F.array(*[
        F.when(any_word(text, words) & text.rlike(_spaced(pattern)), F.lit(code)) for code, words, pattern in DIRECTIVES]))


def gate_directives(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("codes", directive_codes(text))


def quarantine(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Split into publishable documents and quarantined ones with their codes."""
    checked = gate_directives(docs, text)
    return checked.filter(F.size("codes") == 0).drop("codes"), checked.filter(F.size("codes") > 0)


def fail_on_directives(docs: DataFrame, text: str = "text", section: str = "report") -> DataFrame:
    """Pass documents through; the job fails at the first one that violates a rule."""
    codes = directive_codes(text)
    message = F.concat(F.lit(f"[{section}] blocked directive: "), F.array_join(codes, ", "))
    return docs.filter(F.when(F.size(codes) > 0, F.raise_error(message).cast("boolean")).otherwise(True))


def has_blackhat(c) -> Column:
    return _any_rule(c, BLACKHAT)


def has_fabricated_claim(c) -> Column:
    return _any_rule(c, FABRICATED_TODAY)


def material_count(c, policy: GatePolicy = GatePolicy()) -> Column:
    """How many of the three material groups the plain text shows."""
    total = F.lit(0)
    for words in policy.material_words:
        total = total + any_word(F.lower(c), words).cast("int")
    return total


def long_sentences(c) -> Column:
    """``warn`` and ``severe`` sentence counts of a plain text; many warnings add a severe one."""
    units = F.transform(F.split(c, "(?<=[。！？!?])"), lambda s: utf16_length(trim_all(s)))
    counts = let(units, lambda u: F.struct(
        F.size(F.filter(u, lambda n: (n >= SENTENCE_WARN) & (n < SENTENCE_SEVERE))).alias("warn"),
        F.size(F.filter(u, lambda n: n >= SENTENCE_SEVERE)).alias("severe")))
    return let(counts, lambda n: F.struct(
        n["warn"].alias("warn"),
        (n["severe"] + (n["warn"] >= SENTENCE_WARN_COUNT).cast("int")).alias("severe")))


def line_signals(text, kind, policy: GatePolicy = GatePolicy(), limit: int = SIGNAL_LIMIT) -> Column:
    """First usable lines of a daily text, unique without regard to case; the document's kind names the words."""
    lines = F.transform(F.split(text_or_empty(text), "\n+"), lambda x: trim_all(F.regexp_replace(
        x, r"\A#+[\s\x{A0}\x{3000}]*", "")))

    def usable(words):
        return F.filter(lines, lambda x: let(F.lower(x), lambda low: any_word(low, words)) & let(
            utf16_length(x), lambda n: n.between(12, 420)))

    found = usable(AI_SIGNALS)
    for name, words in policy.kind_signals:
        found = F.when(kind == name, usable(words)).otherwise(found)

    def first_of_each(rows: Column) -> Column:
        folded = F.transform(rows, F.lower)
        return let(folded, lambda low: F.transform(
            F.slice(F.array_distinct(low), 1, limit),
            lambda key: F.element_at(rows, F.array_position(low, key).cast("int"))))

    return let(found, first_of_each)


def main_site_links(body, policy: GatePolicy) -> Column:
    """Number of links to the deployment's main site."""
    if not policy.main_origins:
        return F.lit(0)
    return F.size(F.filter(md_links(body), lambda link: F.coalesce(
        url_origin(link["url"]).isin(*policy.main_origins), F.lit(False))))


def qualification(text, signals) -> Column:
    """Reason why a daily text cannot be used; null when it can."""
    short = utf16_length(trim_all(text_or_empty(text))) < DAILY_MIN
    return F.when(short, "daily content missing or too short").when(
        F.size(signals) == 0, "no usable trigger tied to known materials")


def qualify_document(docs: DataFrame, policy: GatePolicy = GatePolicy(), text: str = "daily_content",
                     kind: str = "blog_type") -> DataFrame:
    short = utf16_length(trim_all(text_or_empty(text))) < DAILY_MIN
    signals = F.when(short, F.array().cast("array<string>")).otherwise(line_signals(text, F.col(kind), policy))
    rows = docs.withColumn("signals", signals)
    return rows.withColumn("reason", qualification(text, F.col("signals"))).withColumn(
        "eligible", F.col("reason").isNull())


def validate_document(docs: DataFrame, policy: GatePolicy = GatePolicy()) -> DataFrame:
    """All checks of a draft; adds ``gate`` (``ok, severe, warnings, signals``), codes in fixed order.

    Rows need ``title, body, daily_content, blog_type, allowed_urls array<string>``.
    """
    rows = qualify_document(docs, policy).withColumn("_plain", strip_markdown("body")).withColumn(
        "_long", long_sentences(F.col("_plain")))
    allowed = F.transform(F.array_distinct(F.concat(
        F.coalesce("allowed_urls", F.array().cast("array<string>")), extract_urls("daily_content"))), norm_url_link)
    origins = policy.allowed_origins
    # The normalised allow-list is bound once per document; inside the filters it would be rebuilt per link.
    rows = rows.withColumn("_bad", let(allowed, lambda ok: F.struct(
        F.filter(F.transform(md_links("body"), lambda x: x["url"]),
                 lambda u: ~is_allowed_url(u, ok, origins)).alias("links"),
        F.filter(F.transform(md_images("body"), lambda x: x["url"]),
                 lambda u: ~is_allowed_url(u, ok, origins) | ~is_image_url(u)).alias("images"))))
    title, body = text_or_empty("title"), text_or_empty("body")
    prefixes = "|".join(policy.title_prefixes)

    def first_three(name: str, label: str) -> Column:
        return F.when(F.size(name) > 0, F.concat(F.lit(label), F.array_join(F.slice(name, 1, 3), ",")))

    severe = F.array_compact(F.array(
        F.when((utf16_length(trim_all(title)) < TITLE_MIN) | (utf16_length(title) > TITLE_MAX), "bad_title_length"),
        F.when(title.rlike(rf"(?i)\A({prefixes})"), "fallback_or_daily_title"),
        F.when((body == "") | (utf16_length("_plain") < BODY_MIN), "body_too_short"),
        F.when(body.rlike("(?i)Table of contents"), "toc_visible"),
        F.when(material_count(F.col("_plain"), policy) < 2, "missing_personal_material"),
        F.when(has_fabricated_claim(F.col("_plain")), "possible_fabricated_today_experience"),
        F.when(has_blackhat(body), "black_hat_llm_instruction"),
        first_three("_bad.links", "unapproved_links:"),
        first_three("_bad.images", "invalid_images:"),
        F.when(main_site_links(body, policy) > 1, "too_many_shop_links"),
        F.when(F.col("_long.severe") > 0, F.concat(
            F.lit("severe_long_sentences:"), F.col("_long.severe").cast("string"))),
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("source_not_eligible:"), F.col("reason")))))
    warnings = F.array_compact(F.array(
        F.when(F.col("_long.warn") > 0, F.concat(F.lit("long_sentences:"), F.col("_long.warn").cast("string")))))
    gate = F.struct((F.size(severe) == 0).alias("ok"), severe.alias("severe"), warnings.alias("warnings"),
                    F.col("signals"))
    return rows.withColumn("gate", gate).drop(
        "_plain", "_long", "_bad", "signals", "reason", "eligible")


def url_set_union(docs: DataFrame) -> DataFrame:
    """Distinct union of the allowed addresses and those inside the daily text, per document."""
    return docs.withColumn("urls", F.array_distinct(F.concat(
        F.coalesce("allowed_urls", F.array().cast("array<string>")), extract_urls("daily_content"))))


