"""Daily snapshots: versions of (report_date, category) partitions, appended as Parquet and named in a manifest.

A write adds one folder ``versions/version=<name>`` and then one manifest file, which lists the partitions that the version
replaces or adds to. The manifest file appears by one rename, and readers only see versions that it names, so they see
either the store before a write or the one after it; a write that breaks off leaves rows nobody reads. Stored rows are
never rewritten by a write. Of an item that several visible versions of a partition hold, the newest one counts.

Names sort by their number. One writer appends at a time; compaction may run beside it, as its version sorts
before all that are written after it has begun.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixed_values import SNAPSHOT_TTL_DAYS
from ..operators.ordering import keep_first
from ..schemas import ITEMS
from ..session import path_exists

KEYS = ["report_date", "category"]
IDENTITY = ["report_date", "category", "source", "id"]
MANIFEST = "report_date date, category string, version string, replaces boolean, batch string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All committed versions of all partitions."""
    where = f"{path}/manifest"
    return spark.read.schema(MANIFEST).parquet(where) if path_exists(spark, where) else spark.createDataFrame([], MANIFEST)


def _number(spark: SparkSession, path: str) -> int:
    last = manifest(spark, path).agg(F.max("version")).first()[0]
    return int(last[1:13]) if last else 0


def _commit(rows: DataFrame, path: str) -> None:
    """Make a version visible: one file with all its partitions."""
    rows.select("report_date", "category", "version", "replaces", "batch").coalesce(1).write.mode("append").parquet(
        f"{path}/manifest")


def _add(rows: DataFrame, path: str, version: str, replaced: DataFrame | None, replaces: bool, batch: str | None) -> None:
    """Write the rows of a version, then name its partitions; ``replaced`` are partitions it stands for without rows.

    The rebalance hint merges small and splits large partitions, so a dominant day is written by many tasks.
    """
    folder = f"{path}/versions/version={version}"
    rows.hint("rebalance", *KEYS).write.partitionBy(*KEYS).parquet(folder)
    pairs = rows.sparkSession.read.schema(rows.schema).parquet(folder).select(*KEYS).distinct()
    if replaced is not None:
        pairs = pairs.union(replaced.select(*KEYS)).distinct()
    _commit(pairs.select(*KEYS, F.lit(version).alias("version"), F.lit(replaces).alias("replaces"),
                         F.lit(batch).cast("string").alias("batch")), path)


def _stamped(items: DataFrame, written_at: Column | None) -> DataFrame:
    return items.withColumn("written_at", F.current_timestamp() if written_at is None else written_at)


def snapshot_write(items: DataFrame, path: str, written_at: Column | None = None,
                   replaced: DataFrame | None = None) -> None:
    """Replace the (date, category) partitions that receive rows.

    ``replaced (report_date, category)`` names all partitions the items stand for: those that receive no row come out
    empty.
    """
    version = f"v{_number(items.sparkSession, path) + 1:012d}-{uuid.uuid4().hex[:8]}"
    _add(_stamped(items, written_at), path, version, replaced, True, None)


def snapshot_append(items: DataFrame, path: str, written_at: Column | None = None, batch: str | None = None) -> None:
    """Add items to their partitions; a stored item of the same identity gives way to the new one.

    A missing source or id counts as a value. Of several items of one identity the newest stays. A ``batch`` that is
    committed already is not added again.
    """
    spark = items.sparkSession
    if batch is not None and not manifest(spark, path).filter(F.col("batch") == batch).isEmpty():
        return
    fresh = keep_first(items, IDENTITY, [F.col("published_at").desc_nulls_last(), F.col("source_ord"), F.col("item_ord")])
    version = f"v{_number(spark, path) + 1:012d}-{uuid.uuid4().hex[:8]}"
    _add(_stamped(fresh, written_at), path, version, None, False, batch)


def _visible(spark: SparkSession, path: str) -> DataFrame:
    """``(report_date, category, version, several)``: a partition's last replacing version and all that were added since."""
    rows = manifest(spark, path)
    base = rows.groupBy(*KEYS).agg(F.max(F.when(F.col("replaces"), F.col("version"))).alias("_base"))
    shown = rows.join(base, KEYS).filter(F.col("_base").isNull() | (F.col("version") >= F.col("_base")))
    number = shown.groupBy(*KEYS).agg((F.count_distinct("version") > 1).alias("several"))
    return shown.select(*KEYS, "version").distinct().join(number, KEYS)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The visible rows of all partitions, without those that a newer version of the same partition has anew."""
    if not path_exists(spark, f"{path}/versions"):
        return spark.createDataFrame([], ITEMS).withColumn("written_at", F.lit(None).cast("timestamp"))
    rows = spark.read.parquet(f"{path}/versions").join(_visible(spark, path), ["version", *KEYS])
    names = [c for c in rows.columns if c not in ("version", "several")]
    # Identities alone decide which rows are out of date; contents meet only the few identities that occur again.
    newest = rows.filter("several").groupBy(*IDENTITY).agg(
        F.max("version").alias("_newest"), F.min("version").alias("_oldest")).filter("_newest <> _oldest")
    newest = newest.select("_newest", *[F.col(c).alias(f"_{c}") for c in IDENTITY])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY])
    return rows.join(newest, same, "left").filter(
        F.col("_newest").isNull() | (F.col("version") == F.col("_newest"))).select(*names)


def snapshot_compact(spark: SparkSession, path: str) -> None:
    """Write every partition that has several visible versions as one; later versions stay on top of it."""
    last = manifest(spark, path).agg(F.max("version")).first()[0]
    many = _visible(spark, path).filter("several").select(*KEYS).distinct()
    if last is None or many.isEmpty():
        return
    rows = snapshots(spark, path).join(many, KEYS, "left_semi")
    _add(rows, path, f"{last[:13]}~{uuid.uuid4().hex[:8]}", None, True, None)


def snapshot_vacuum(spark: SparkSession, path: str) -> int:
    """Delete version folders that no reader can see; versions above the last committed number may be under way and stay."""
    last = _number(spark, path)
    shown = {r.version for r in _visible(spark, path).select("version").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for entry in files.listStatus(folder):
        version = entry.getPath().getName().partition("=")[2]
        if version and version not in shown and int(version[1:13]) <= last:
            files.delete(entry.getPath(), True)
            gone += 1
    return gone


def snapshot_read(spark: SparkSession, path: str, report_date, as_of: Column | None = None,
                  ttl_days: int = SNAPSHOT_TTL_DAYS) -> DataFrame:
    """All categories of one date; rows written longer ago than the time to live are hidden."""
    return _alive(snapshots(spark, path).filter(F.col("report_date") == report_date), as_of, ttl_days)


def snapshot_range(spark: SparkSession, path: str, report_date, days: int, including_today: bool = False,
                   as_of: Column | None = None, ttl_days: int = SNAPSHOT_TTL_DAYS) -> DataFrame:
    """The previous ``days`` days, or the ``days`` days that end with the report date."""
    last = 0 if including_today else 1
    first = days - 1 if including_today else days
    rows = snapshots(spark, path).filter(
        F.col("report_date").between(F.date_sub(report_date, first), F.date_sub(report_date, last)))
    return _alive(rows, as_of, ttl_days)


def _alive(rows: DataFrame, as_of: Column | None, ttl_days: int) -> DataFrame:
    now = F.current_timestamp() if as_of is None else as_of
    return rows.filter(F.col("written_at") + F.make_interval(days=F.lit(ttl_days)) > now)
