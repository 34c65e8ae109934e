"""Keyed state: visitors with idle time-outs and per-minute admission."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import shanghai_date

# Python workers need not have this package installed: the processors travel with the query.
register_pickle_by_value(sys.modules[__name__])

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
EPOCH = date(1970, 1, 1)
# State keys per site: their calls and values grow with the visitors of a bucket, not their number.
VISITOR_BUCKETS = 256
DAYS_SCHEMA = "site string, visitor string, day date, views long, first_ms long, last_ms long, event_ts timestamp"
VISITS_SCHEMA = "site string, day date, pageviews long, new_total long, new_daily long"


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts per site, visitor and day inside each Arrow batch, before anything is shuffled."""
    for pdf in batches:
        grouped = pdf.groupby(["site", "visitor", "day"], dropna=False, sort=False)
        out = grouped.agg(views=("ms", "size"), first_ms=("ms", "min"), last_ms=("ms", "max"),
                          event_ts=("ts", "max")).reset_index()
        yield out[["site", "visitor", "day", "views", "first_ms", "last_ms", "event_ts"]]


class VisitorState(StatefulProcessor):
    """Last visits and recent days of the visitors of one site that fall into one bucket.

    A call of its own costs more than a visitor's few rows, so a key holds many visitors and the whole state is one
    value, read and written once per batch. Days are kept for three days after the last visit of a visitor, who expires
    ``idle_days`` after it. The one timer of a key is for the visitor who may expire first; where it finds others left,
    it is set again.
    """

    def __init__(self, idle_days: int):
        self._idle = idle_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "visitors array<string>, lasts array<long>, days array<array<int>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["first_ms", "last_ms"])
        known = self._seen.get()
        seen = {v: (last, days) for v, last, days in zip(*known)} if known else {}
        new_total, new_daily = [], []
        for visitor, day, first, final in zip(
                pdf["visitor"].tolist(), pdf["day"].tolist(), pdf["first_ms"].tolist(), pdf["last_ms"].tolist()):
            last, days = seen.get(visitor, (None, []))
            number = (day - EPOCH).days
            new_total.append(int(last is None or first - last > self._idle))
            new_daily.append(int(number not in days))
            seen[visitor] = (final if last is None else max(last, final), days if number in days else [*days, number])
        self._store(seen)
        if not known:
            self._handle.registerTimer(min(last for last, _ in seen.values()) + self._idle)
        sums = pdf.assign(new_total=new_total, new_daily=new_daily).groupby("day", sort=False)[
            ["views", "new_total", "new_daily"]].sum().reset_index()
        yield sums.rename(columns={"views": "pageviews"}).assign(site=key[0])[
            ["site", "day", "pageviews", "new_total", "new_daily"]]

    def _store(self, seen: dict[str, tuple[int, list[int]]]) -> None:
        self._seen.update((
            list(seen), [last for last, _ in seen.values()],
            [sorted(d for d in days if d * DAY_MS >= last - 4 * DAY_MS) for last, days in seen.values()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left = {v: (last, days) for v, last, days in zip(*self._seen.get()) if last + self._idle > passed}
        if left:
            self._store(left)
            self._handle.registerTimer(min(last for last, _ in left.values()) + self._idle)
        else:
            self._seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_visitors(visits: DataFrame, idle_days: int = 365, delay: str = "1 day") -> DataFrame:
    """Increments per site and local day: page views, new visitors in total and on that day.

    Visits without a valid visitor id only count as page views and never reach the state. A visitor with a
    great share of all visits sends one row per day and Arrow batch. State is kept by buckets of visitors. Visits
    behind the watermark do not reach the state either; ``visitor_totals`` takes page views from
    ``views.run_daily_views`` and counts those.
    """
    rows = visits.select(
        "site", "visitor", shanghai_date("ts").alias("day"), F.unix_millis("ts").alias("ms"), "ts")
    combined = rows.filter("visitor is not null").mapInPandas(_combine, DAYS_SCHEMA).withWatermark("event_ts", delay)
    combined = combined.withColumn("bucket", F.pmod(F.xxhash64("visitor"), F.lit(VISITOR_BUCKETS)))
    return combined.groupBy("site", "bucket").transformWithStateInPandas(
        statefulProcessor=VisitorState(idle_days), outputStructType=VISITS_SCHEMA, outputMode="Append",
        timeMode="EventTime")


def visitor_totals(increments: DataFrame, views: DataFrame) -> DataFrame:
    """Totals per site and day: ``views (site, day, pageviews, anonymous)`` are exact over all visits.

    ``late_views`` are the visits with a visitor id that came behind the watermark: they are page views, but
    could not be tried for new visitors.
    """
    known = increments.groupBy("site", "day").agg(
        F.sum("pageviews").alias("known"), F.sum("new_total").alias("new_total"), F.sum("new_daily").alias("new_daily"))
    zero = F.lit(0).cast("long")
    return views.join(known, ["site", "day"], "left").select(
        "site", "day", "pageviews", F.coalesce("new_total", zero).alias("new_total"),
        F.coalesce("new_daily", zero).alias("new_daily"),
        (F.col("pageviews") - F.col("anonymous") - F.coalesce("known", zero)).alias("late_views"))


class Admission(StatefulProcessor):
    """Admit the first requests of one client in each minute of one hour.

    An hour is one key, so the counts of its minutes are read and written once per batch. They live until
    the hour has passed.
    """

    def __init__(self, limit: int):
        self._limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._used = handle.getValueState("used", "minutes array<long>, counts array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "request_id"])
        known = self._used.exists()
        used = dict(zip(*self._used.get())) if known else {}
        place = pdf.groupby("period_ms").cumcount() + pdf["period_ms"].map(used).fillna(0)
        taken = pdf[place < self._limit]
        for minute, n in taken.groupby("period_ms").size().items():
            used[int(minute)] = int(used.get(int(minute), 0) + n)
        self._used.update((list(used), list(used.values())))
        if not known:
            self._handle.registerTimer(int(pdf["hour_ms"].iloc[0]) + HOUR_MS + 120_000)
        yield taken[["client", "period", "request_id", "ts"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._used.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(requests: DataFrame, limit: int = 5, delay: str = "2 minutes") -> DataFrame:
    """Admitted requests, at most ``limit`` per client and minute; all others are rejected.

    Only the earliest ``limit`` rows of a client and minute in an Arrow batch can be admitted, so the rest is
    dropped before the shuffle and a busy client cannot fill one task.
    """
    limit = limit if 1 <= limit <= 30 else 5

    def earliest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(["ts", "request_id"]).groupby(["client", "period"], sort=False).head(limit)

    rows = requests.select("client", F.date_trunc("minute", "ts").alias("period"), "request_id", "ts").withColumns({
        "period_ms": F.unix_millis("period"), "hour_ms": F.unix_millis(F.date_trunc("hour", "ts"))})
    trimmed = rows.mapInPandas(
        earliest, "client string, period timestamp, request_id long, ts timestamp, period_ms long, hour_ms long"
    ).withWatermark("ts", delay)
    return trimmed.groupBy("client", "hour_ms").transformWithStateInPandas(
        statefulProcessor=Admission(limit),
        outputStructType="client string, period timestamp, request_id long, ts timestamp",
        outputMode="Append", timeMode="EventTime")
