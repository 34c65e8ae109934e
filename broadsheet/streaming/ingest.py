"""Landed feeds to snapshots as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import in_window, shanghai_date
from ..schemas import RAW_FEEDS
from ..sources.feeds import parse_feeds, unify_feed_items
from ..sources.snapshots import snapshot_append


def read_feed_stream(spark, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed feed bodies (Parquet rows of the raw feed schema) as a stream."""
    reader = spark.readStream.schema(RAW_FEEDS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_ingest(raw: DataFrame, snapshots: str, checkpoint: str, category: Column, report_date: Column, days: int,
                  written_at: Column | None = None, run_dates: DataFrame | None = None):
    """Parse, filter by recency and append each batch to its (date, category) snapshots.

    A batch becomes a version that is added to its partitions; readers take the newest row of each item identity, and a
    replayed batch is not added again, so nothing stored is rewritten, lost or repeated. With ``run_dates (report_date)`` an item goes
    to every one of these dates whose window holds it, instead of ``report_date``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        items = unify_feed_items(parse_feeds(batch), category, report_date)
        if run_dates is not None:
            own = shanghai_date("published_at")
            near = F.explode(F.sequence(own, F.date_add(own, max(days, 1))))
            items = items.withColumn("report_date", near).join(run_dates, "report_date", "left_semi").select(*items.columns)
        recent = items.filter(in_window("published_at", "report_date", days))
        snapshot_append(recent, snapshots, written_at, f"{checkpoint}#{batch_id}")

    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
