"""Instants, local dates and date texts. Local time is Asia/Shanghai."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, filled, trim_all

ZONE = "Asia/Shanghai"
DAY_MICROS = 86_400_000_000
OFFSET_MICROS = 8 * 3_600_000_000


def local_time(c, zone: str = ZONE) -> Column:
    """Wall-clock time (timestamp without zone) of an instant."""
    return F.convert_timezone(None, F.lit(zone), col(c))


def shanghai_date(c) -> Column:
    return F.to_date(local_time(c))


def shift_date(c, days) -> Column:
    return F.date_add(col(c), days)


def day_end(report_date) -> Column:
    """Last millisecond of a local date as an instant."""
    days = F.unix_date(col(report_date)).cast("long")
    return F.timestamp_micros((days + 1) * DAY_MICROS - OFFSET_MICROS - 1000)


def in_window(ts, report_date, days) -> Column:
    """True inside ``[end of report date − max(days, 1)·24 h, end of report date]``."""
    end = F.unix_micros(day_end(report_date))
    span = F.greatest(F.lit(days).cast("long") if isinstance(days, int) else days.cast("long"),
                      F.lit(1).cast("long")) * DAY_MICROS
    at = F.unix_micros(col(ts))
    return F.coalesce((at >= end - span) & (at <= end), F.lit(False))


def parse_pub_date(c) -> Column:
    """ISO-8601 or RFC-822 text to an instant; anything else is null."""
    raw = trim_all(col(c))
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), raw.try_cast("timestamp"))
    plain = F.regexp_replace(F.regexp_replace(raw, r"(?i)^[a-z]{3,9},?\s+(?=\d)", ""), r"\bUTC?$", "GMT")
    numeric = F.when(plain.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} .*[+-]\d{4}$"),
                     F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm[:ss] Z")))
    named = F.when(plain.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} .*[A-Z]{1,4}$"),
                   F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm[:ss] z")))
    return F.coalesce(iso, numeric, named)


def iso_text(c) -> Column:
    """Instant as ISO-8601 text in UTC with milliseconds."""
    return F.date_format(local_time(c, "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def published_text(raw, ts) -> Column:
    """The published date as it is shown: the source's own text, else the instant."""
    return F.coalesce(filled(raw), iso_text(ts))


def zh_date(c) -> Column:
    return F.date_format(local_time(c), "yyyy/M/d")


def zh_date_time(c) -> Column:
    return F.date_format(local_time(c), "yyyy/M/d HH:mm:ss")


def gmt_date_time(c) -> Column:
    return F.date_format(local_time(c, "UTC"), "yyyy/M/d HH:mm:ss")


def rfc822(c) -> Column:
    return F.date_format(local_time(c, "UTC"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
