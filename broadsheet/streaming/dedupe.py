"""URL de-duplication by event time: which row is kept does not depend on how the rows fall into batches.

Rows wait in a buffer per address until the watermark has passed their time; by then everything before them has come.
A timer then takes them in the order of (time, row id): a row is kept if the last kept row of its address is more than
``days`` days older. Only address, time and row id are buffered; callers join contents to the kept ids. Rows behind the
watermark are late and dropped by the engine. A heartbeat row moves the watermark on when a source falls silent.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..fixed_values import DEDUPE_DAYS
from ..functions.urls import norm_url_dedupe

# Python workers need not have this package installed: the processor travels with the query.
register_pickle_by_value(sys.modules[__name__])

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000
NO_ID = 2 ** 63 - 1
HEARTBEAT = "\u0001heartbeat"


class KeepFirst(StatefulProcessor):
    """Buffered rows of one address, by hours, and the time of the row kept last.

    Only the first row of each time can be kept, and none within the days after the last kept one, so others are not
    buffered. An address has one timer, for the first buffered row that can be kept. What it takes then jumps from one
    kept row to the next: hours in between are dropped unread, and each of the others is read once.
    """

    def __init__(self, days: int, most: int = 500_000):
        self._gap, self._most = days * DAY_MICROS, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._head = handle.getValueState("head", "last long, timer long, hours array<int>")
        self._rows = handle.getMapState("rows", "hour int", "times binary, ids binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, timer, hours = self._head.get() or (None, None, [])
        hours, times, ids = set(hours), array("q"), array("q")
        first = None
        for row in rows:
            if row.micros is None or last is not None and row.micros - last <= self._gap:
                continue
            first = row.micros if first is None else min(first, row.micros)
            times.append(row.micros)
            ids.append(NO_ID if row.row_id is None else row.row_id)
            if len(times) >= self._most:
                self._buffer(times, ids, hours)
                times, ids = array("q"), array("q")
        if times:
            self._buffer(times, ids, hours)
        if first is not None:
            self._head.update((last, self._set_timer(first, timer), sorted(hours)))
        return iter(())

    def _buffer(self, times: array, ids: array, hours: set[int]) -> None:
        """Add rows to their hours, the one with the smallest id of each time."""
        times, ids = np.frombuffer(times, "q"), np.frombuffer(ids, "q")
        numbers = times // HOUR_MICROS
        order = np.argsort(numbers, kind="stable")
        found, starts = np.unique(numbers[order], return_index=True)
        for hour, places in zip(found.tolist(), np.split(order, starts[1:])):
            near_times, near_ids = times[places], ids[places]
            if hour in hours:
                old_times, old_ids = self._hour(hour)
                near_times, near_ids = np.concatenate((old_times, near_times)), np.concatenate((old_ids, near_ids))
            by_time = np.lexsort((near_ids, near_times))
            near_times, near_ids = near_times[by_time], near_ids[by_time]
            new = np.append(True, near_times[1:] != near_times[:-1])
            self._rows.updateValue((hour,), (near_times[new].tobytes(), near_ids[new].tobytes()))
            hours.add(hour)

    def _hour(self, hour: int) -> tuple[np.ndarray, np.ndarray]:
        times, ids = self._rows.getValue((hour,))
        return np.frombuffer(times, "q"), np.frombuffer(ids, "q")

    def _set_timer(self, micros: int, timer: int | None) -> int:
        """One timer, a millisecond after the given row: it fires once the watermark is past it."""
        moment = micros // 1000 + 1
        if timer is not None and timer <= moment:
            return timer
        if timer is not None:
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(moment)
        return moment

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All rows before the watermark have come; later ones among them are late and dropped by the engine.
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        last, _, hours = self._head.get()
        kept, rest, following = [], [], None
        for place, hour in enumerate(hours):
            if last is not None and (hour + 1) * HOUR_MICROS - 1 - last <= self._gap:
                self._rows.removeKey((hour,))
                continue
            times, ids = self._hour(hour)
            while True:
                first = 0 if last is None else int(np.searchsorted(times, last + self._gap, "right"))
                if first == len(times) or times[first] >= passed:
                    break
                last = int(times[first])
                kept.append(Row(norm_url=key[0], row_id=None if ids[first] == NO_ID else int(ids[first])))
            if first == len(times):
                self._rows.removeKey((hour,))
                continue
            following, rest = int(times[first]), hours[place:]
            break
        self._head.update((last, None if following is None else self._set_timer(following, None), rest))
        return iter(kept)

    def close(self) -> None:
        pass


def stream_dedupe_ordered(items: DataFrame, row_id: str, ts: str = "ts", days: int = DEDUPE_DAYS,
                          delay: str = "1 day") -> DataFrame:
    """``(norm_url, row_id)`` of the kept rows of ``items (url, ts, row id)``; ``row_id`` is a unique long."""
    normed = F.when(F.col("url") == HEARTBEAT, F.col("url")).otherwise(norm_url_dedupe("url"))
    rows = items.select(normed.alias("norm_url"), F.unix_micros(ts).alias("micros"),
                        F.col(row_id).alias("row_id"), F.col(ts).alias("event_ts")).withWatermark("event_ts", delay)
    return rows.groupBy("norm_url").transformWithState(
        statefulProcessor=KeepFirst(days), outputStructType="norm_url string, row_id long", outputMode="Append",
        timeMode="EventTime").filter(F.col("norm_url") != HEARTBEAT)


def heartbeat(spark: SparkSession, last: datetime, days: int) -> DataFrame:
    """A row ``days`` days after the last one; it is never kept itself."""
    return spark.createDataFrame([(HEARTBEAT, last + timedelta(days=days), -1)], "url string, ts timestamp, row_id long")
