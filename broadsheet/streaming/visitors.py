"""Visitors of sites from a log of visitor days: any order of arrival gives the same counts.

A batch is reduced to one row per site, visitor and local day, natively and with a partial step, and lands in a folder of
its own, so a repeated batch replaces itself. Counts are read from the days of all batches: a visit that comes late widens
its day or adds one, which corrects the days around it. No watermark and no state store is needed.

Every ``FOLD`` batches the log before the current batch is folded into one base with one row per site, visitor and day.
A base counts from the moment its folder is complete; readers take the newest complete one and the batches behind it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.aggregates import IDLE_DAYS, visitor_days
from ..session import path_exists

FOLD = 50
DAYS = "site string, visitor string, day date, views long, first_ts timestamp, last_ts timestamp"


def _bases(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the complete bases: each holds all batches before its number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/base")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("before=") and path_exists(
        spark, f"{out}/base/{n}/_SUCCESS"))


def visitor_log(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """One row per site, visitor and day over the base and all batches (those numbered below ``before``)."""
    bases = [n for n in _bases(spark, out) if before is None or n <= before]
    base = bases[-1] if bases else 0
    parts = []
    if path_exists(spark, f"{out}/batches"):
        rows = spark.read.schema(DAYS + ", batch_id long").parquet(f"{out}/batches").filter(F.col("batch_id") >= base)
        parts.append((rows if before is None else rows.filter(F.col("batch_id") < before)).drop("batch_id"))
    if bases:
        parts.append(spark.read.schema(DAYS).parquet(f"{out}/base/before={base}"))
    if not parts:
        return spark.createDataFrame([], DAYS)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("site", "visitor", "day").agg(
        F.sum("views").alias("views"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def fold(spark: SparkSession, out: str, before: int) -> None:
    """Write the days of all batches below ``before`` as one base."""
    visitor_log(spark, out, before).write.mode("overwrite").parquet(f"{out}/base/before={before}")


def run_visitor_log(visits: DataFrame, out: str, checkpoint: str, every: int = FOLD):
    """Append each batch's visitor days to the log; ``visits`` has ``site, visitor, ts``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % every == 0:
            fold(batch.sparkSession, out, batch_id)
        visitor_days(batch).write.mode("overwrite").parquet(os.path.join(out, "batches", f"batch_id={batch_id}"))

    return (visits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def visitor_counts(days: DataFrame, idle_days: int = IDLE_DAYS) -> DataFrame:
    """Per site and day: page views, visitors new in total (or back after ``idle_days``) and visitors of the day."""
    previous = F.lag("last_ts").over(W.partitionBy("site", "visitor").orderBy("day"))
    gap = F.unix_micros("first_ts") - F.unix_micros(previous)
    known = days.filter("visitor is not null").withColumn(
        "new", previous.isNull() | (gap > idle_days * 86_400_000_000))
    rows = known.unionByName(days.filter("visitor is null").withColumn("new", F.lit(False)))
    return rows.groupBy("site", "day").agg(
        F.sum("views").alias("pageviews"), F.count_if("new").alias("new_total"), F.count("visitor").alias("new_daily"))
