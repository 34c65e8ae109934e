"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by (doc_id, row number), so that also a doc_id with a third of all rows can be cut; ids that are no whole
numbers are ordered by a hash of theirs. Candidate key boundaries ("probes") are sent to all partitions, each partition counts rows and exact bytes below them, and the
counts of all partitions are added up. Every boundary keeps a bracket of keys around its target; probes refine the
brackets until the bytes below are within the tolerance or the two sides are neighbouring keys. Only then the rows are
exchanged, once, to pieces of a shard; the number within a shard follows from the piece's first number.

Rows without doc_id come first. Null texts have no bytes. An empty table has no shards. Ties are ordered by the row number
of the stored key table; equal texts are rows like any others and may come into several shards. Extra columns are carried by
:func:`sharded`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import free_names, stored, table
from .registry import query

SHARDS = 16
PROBES = 8
PIECES_PER_SHARD = 4
LOWEST = -2**63


def keyed(docs: DataFrame, carried: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """Key table: the ``carried`` columns and ``(size, text_crc32, k, uid)``; stored, as row numbers must not change."""
    text = F.coalesce("text", F.lit(""))
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return stored(docs.select(
        *carried, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(key, F.lit(LOWEST)).alias("k"),
        F.monotonically_increasing_id().alias("uid")), "keys")


def below(keys: DataFrame, probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows strictly below each of the sorted ``probes``; one small row per probe and partition."""
    k = np.array([p[0] for p in probes], np.int64)
    u = np.array([p[1] for p in probes], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(k) + 1, np.int64), np.zeros(len(k) + 1, np.int64)
        for batch in batches:
            slot = places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), k, u)
            size += np.bincount(slot, batch.column(2).to_numpy(), len(size)).astype(np.int64)
            rows += np.bincount(slot, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])],
                                         names=["slot", "size", "rows"])

    got = keys.select("k", "uid", "size").mapInArrow(count, "slot bigint, size bigint, rows bigint").groupBy("slot").agg(
        F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(k) + 1, np.int64), np.zeros(len(k) + 1, np.int64)
    for g in got:
        size[g.slot], rows[g.slot] = g.size, g.rows
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def places(k: np.ndarray, u: np.ndarray, probe_k: np.ndarray, probe_u: np.ndarray) -> np.ndarray:
    """How many probes are at or below each key."""
    low, high = np.searchsorted(probe_k, k, "left"), np.searchsorted(probe_k, k, "right")
    out = low.copy()
    for i in np.flatnonzero(low < high):
        out[i] += np.searchsorted(probe_u[low[i]:high[i]], u[i], "right")
    return out


def _wide(k: int, u: int) -> int:
    return ((k - LOWEST) << 64) + (u - LOWEST)


def _pair(x: int) -> tuple[int, int]:
    return (x >> 64) + LOWEST, (x & (2**64 - 1)) + LOWEST


def splitters(keys: DataFrame, pieces: int, tolerance: float = 0.0) -> tuple[list[tuple[int, int]], list[int]]:
    """The ``pieces - 1`` inner boundaries (lowest keys of the pieces after the first) and the rows below each.

    Boundary i is the smallest key with at least i/pieces of all bytes below it; with a tolerance (a share of a piece)
    any key that comes as near. Every round sends at most ``PROBES`` probes per open boundary and brings back as many
    sums, whatever the number of rows.
    """
    total, low_k, high_k, low_u, high_u = keys.agg(F.sum("size"), F.min("k"), F.max("k"), F.min("uid"), F.max("uid")).first()
    if total is None:
        return [], []
    target = [-(-total * i // pieces) for i in range(1, pieces)]
    slack = tolerance * total / pieces
    low = [_wide(low_k, low_u)] * len(target)
    high = [_wide(high_k, high_u) + 1] * len(target)
    rows_at: dict[int, int] = {}
    done: dict[int, int] = {}
    while len(done) < len(target):
        probes = set()
        for i in range(len(target)):
            if i not in done:
                gap = high[i] - low[i]
                # First within the ids, as long as they differ; row numbers only tell equal ids apart.
                unit = 1 << 64 if gap > 1 << 65 else 1
                marks = {low[i] + gap * j // (PROBES + 1) for j in range(1, PROBES + 1)}
                probes |= {max(low[i], m // unit * unit) for m in marks} | {low[i]}
        ordered = sorted(probes)
        size, rows = below(keys, [_pair(p) for p in ordered])
        rows_at.update(zip(ordered, rows.tolist(), strict=True))
        for i in range(len(target)):
            if i in done:
                continue
            for probe, have in zip(ordered, size.tolist(), strict=True):
                if low[i] <= probe < high[i]:
                    if abs(have - target[i]) <= slack and have >= target[i]:
                        done[i] = probe
                        break
                    if have >= target[i]:
                        high[i] = probe
                        break
                    low[i] = probe + 1 if probe + 1 <= high[i] else high[i]
            if i not in done and low[i] >= high[i]:
                done[i] = high[i]
    missing = sorted({done[i] for i in range(len(target))} - set(rows_at))
    if missing:
        _, rows = below(keys, [_pair(p) for p in missing])
        rows_at.update(zip(missing, rows.tolist(), strict=True))
    chosen = [done[i] for i in range(len(target))]
    return [_pair(p) for p in chosen], [rows_at[p] for p in chosen]


def placed(keys: DataFrame, shards: int = SHARDS, per_shard: int = PIECES_PER_SHARD, tolerance: float = 0.0) -> DataFrame:
    """``keys`` with ``shard`` and ``slot``: one exchange by piece, numbered inside each piece."""
    pieces = shards * per_shard
    bounds, rows_below = splitters(keys, pieces, tolerance)
    k, u = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)
    first = np.array([0, *rows_below], np.int64)
    names = keys.columns

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(names.index("k")).to_numpy(), batch.column(names.index("uid")).to_numpy(), k, u)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*names, "piece"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            at = batch.column(len(names)).to_numpy()
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            slot = np.arange(len(at))
            for s, e in zip(starts, [*starts[1:], len(at)], strict=True):
                p = int(at[s])
                slot[s:e] += seen.get(p, 0) - s + first[p] - first[p // per_shard * per_shard]
                seen[p] = seen.get(p, 0) + int(e - s)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array((at // per_shard).astype(np.int32)), pa.array(slot)],
                names=[*names, "shard", "slot"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    dealt = keys.mapInArrow(piece, schema + ", piece int").repartition(pieces, "piece").sortWithinPartitions("piece", "k", "uid")
    return dealt.mapInArrow(number, schema + ", shard int, slot bigint")


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``, for ``write.partitionBy("shard")``: whole rows move once.

    Where ``docs`` has columns of these names, the new ones have underscores behind theirs.
    """
    shard, slot = free_names(docs.columns, "shard", "slot")
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select("doc_id", "text", F.struct(*numbered).alias("row"))
    spots = placed(keyed(rows, ["row"]), shards, tolerance=tolerance)
    back = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return spots.select(*back, F.col("shard").alias(shard), F.col("slot").alias(slot))


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    """Shard and number of every document; sizes of shards differ by less than one document."""
    spots = placed(keyed(table(spark, sf_dir, "documents")))
    return spots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
