"""First rows per group, keep-first and full ranks that hold up when one group dominates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def first_n(df: DataFrame, groups: Sequence, order: Sequence[Column], n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows per group.

    ``row_number <= n`` is planned with a group limit below the exchange, so every input task sends at
    most ``n`` rows per group and a dominant group does not end up in one task.
    """
    name = out or "_first_n"
    numbered = df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    kept = numbered.filter(F.col(name) <= n)
    return kept if out else kept.drop(name)


def keep_first(df: DataFrame, keys: Sequence, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return first_n(df, keys, order, 1)


def _by_ranges(df: DataFrame, groups: Sequence[str], order: Sequence[Column], total: Column, combine, local) -> DataFrame:
    """Running values over whole groups: a range partitioning plus the totals of the earlier ranges.

    Rows are range-partitioned by group and order, so a dominant group spreads over many tasks. The ranges
    are materialised first: both uses then see the same partition numbers, also after a lost executor.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *[F.col(g) for g in groups], *order)
        .withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(*groups, "_range").agg(total.alias("_total"))
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_range").alias("_r"),
                            combine("_total").over(earlier).alias("_offset"))
    on = F.col("_range") == F.col("_r")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = W.partitionBy(*groups, "_range").orderBy(*order)
    return placed.withColumn("_local", local(inside)).join(offsets, on).drop(
        "_range", "_r", *[f"_g_{g}" for g in groups])


def same_row(names: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of each column with the one named ``prefix`` and its name."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in names])


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str,
           by: Sequence[str] | None = None) -> DataFrame:
    """1-based rank of every row in its group; ``order`` must be total within the group.

    With ``by``, the columns the order reads, only groups and these columns are ranged and materialised. The ranks are
    joined to the rows by them, and a caller that wants no other columns moves no others.
    """
    if by is not None:
        names = list(dict.fromkeys([*groups, *by]))
        ranks = ranked(df.select(*names), groups, order, out)
        ranks = ranks.select(out, *[F.col(c).alias(f"_at_{c}") for c in names])
        return df.join(ranks, same_row(names, "_at_")).drop(*[f"_at_{c}" for c in names])
    rows = _by_ranges(df, groups, order, F.count(F.lit(1)), F.sum, lambda w: F.row_number().over(w))
    return rows.withColumn(out, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long")).drop(
        "_local", "_offset")


def running_max(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Largest value among the rows before this one; null for the first row of a group."""
    rows = _by_ranges(df, groups, order, F.max(value), F.max, lambda w: F.max(value).over(
        w.rowsBetween(W.unboundedPreceding, -1)))
    return rows.withColumn(out, F.greatest("_local", "_offset")).drop("_local", "_offset")
