"""Page views per local day, late rows and URL de-duplication on streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import DEDUPE_DAYS
from ..functions.dates import in_window, shanghai_date
from ..functions.urls import norm_url_dedupe


def batch_writer(path: str):
    """``foreachBatch`` sink that writes each batch into its own folder, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write


def page_views(visits: DataFrame) -> DataFrame:
    """Page views per site and local day (days start at 16:00 UTC), and those without a valid visitor id."""
    return visits.groupBy("site", shanghai_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("pageviews"), F.count_if(F.col("visitor").isNull()).alias("anonymous"))


def run_daily_views(visits: DataFrame, out: str, checkpoint: str):
    """Write the page views of each batch; ``daily_views`` adds them up.

    Counts add up over any batches, so no state and no watermark is needed and late visits count in full.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        page_views(batch).write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    return (visits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_views(spark: SparkSession, out: str) -> DataFrame:
    """Page views per site and day over all written batches."""
    return spark.read.parquet(out).groupBy("site", "day").agg(
        F.sum("pageviews").alias("pageviews"), F.sum("anonymous").alias("anonymous"))


def stream_dedupe(items: DataFrame, ts: str = "published_at", days: int = DEDUPE_DAYS) -> DataFrame:
    """Keep the first row per normalised URL for ``days`` days of event time."""
    keyed = items.withColumn("norm_url", norm_url_dedupe("url")).withWatermark(ts, f"{days} days")
    return keyed.dropDuplicatesWithinWatermark(["norm_url"])


def run_late_rows(items: DataFrame, ts: str, report_date, days: int, out: str, checkpoint: str):
    """Write rows inside the report window; count all and excluded rows per batch in ``<out>-counts``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        inside = in_window(ts, report_date, days)
        counts = batch.agg(F.count(F.lit(1)).alias("seen"), F.count_if(~inside).alias("excluded"))
        counts.write.mode("overwrite").parquet(os.path.join(out + "-counts", f"batch_id={batch_id}"))
        batch.filter(inside).write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    observed = items.observe("report_window", F.count(F.lit(1)).alias("rows"),
                             F.count_if(~in_window(ts, report_date, days)).alias("late"))
    return (observed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
