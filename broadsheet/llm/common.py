"""Helpers the operators of this folder share: stored steps, fixed-size bit filters, components of links."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import work_path


BATCH_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """Rows per Arrow batch for whole texts; bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores behind those that are taken (without regard to case)."""
    used, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, and later reads prune columns."""
    short_batches(df.sparkSession)
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def summed(parts: DataFrame, dtype: str, length: int, how: str = "sum") -> np.ndarray:
    """One vector from rows ``(chunk int, data binary)``: zlib-packed pieces of equal chunks are summed or or-ed.

    ``length`` is fixed by a parameter of the caller and not by the data, so the collected vector is bounded.
    """
    def fold(pieces: pa.Table) -> pa.Table:
        total = None
        for packed in pieces.column("data").to_pylist():
            piece = np.frombuffer(zlib.decompress(packed), dtype)
            if total is None:
                total = piece.copy()
            elif how == "sum":
                total += piece
            else:
                total |= piece
        return pa.table({"chunk": pieces.column("chunk").slice(0, 1), "data": [zlib.compress(total.tobytes(), 1)]},
                        schema=pa.schema([("chunk", pa.int32()), ("data", pa.binary())]))

    out = np.zeros(length, dtype)
    folded = parts.groupBy("chunk").applyInArrow(lambda t: fold(t), "chunk int, data binary")
    for chunk, packed in folded.collect():
        piece = np.frombuffer(zlib.decompress(bytes(packed)), dtype)
        out[chunk * CHUNK:chunk * CHUNK + len(piece)] = piece
    return out


CHUNK = 1 << 16


def pieces(vector: np.ndarray) -> pa.RecordBatch:
    """Rows for :func:`summed`; pieces of zeros are left out."""
    rows = [(i // CHUNK, zlib.compress(vector[i:i + CHUNK].tobytes(), 1))
            for i in range(0, len(vector), CHUNK) if vector[i:i + CHUNK].any()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                       pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "data"])


PIECES = "chunk int, data binary"


class BitFilter:
    """A fixed-size filter of 64-bit keys: says no only to keys that are not in it.

    The size is a parameter. With more keys than it was sized for it lets more through, which costs time, never rows:
    whatever passes is joined or grouped exactly afterwards.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
        mask = np.uint64(size - 1)
        return keys & mask, ((keys * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)) & mask

    @classmethod
    def build(cls, keys: DataFrame, log2_bits: int = 23) -> BitFilter:
        """``keys`` has one long column; each task packs its own filter, and equal pieces are or-ed."""
        size = 1 << log2_bits
        name = keys.columns[0]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size // 8, np.uint8)
            for batch in batches:
                values = batch.column(name).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                for place in cls._places(values.view(np.uint64), size):
                    np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64),
                                     np.left_shift(1, (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            yield pieces(bits)

        return cls(summed(keys.mapInArrow(pack, PIECES), "uint8", size // 8, "or"))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        size = len(self.bits) * 8
        found = np.ones(len(keys), bool)
        for place in self._places(keys.view(np.uint64), size):
            found &= (self.bits[(place >> np.uint64(3)).astype(np.int64)]
                      >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges (u, v)`` with ``u > v`` is either a centre or tied to one centre only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        "up > 1 or up = 1 and down = 1").count()


FEW_LINKS = 1 << 18


def _joined(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of a bounded number of edges ``(u, v)``, by one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, int] = {}

        def top(x: int) -> int:
            while own.setdefault(x, x) != x:
                own[x] = own[own[x]]
                x = own[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((top(a), top(b)))
                own[high] = low
        nodes = list(own)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())],
                                         names=["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node bigint, root bigint")


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """``(node, root)`` of all nodes in ``links (a, b)``; root is the smallest node reachable.

    Up to ``few`` different links are joined by one task. More go through alternating star rounds: every node's larger neighbours, then its smaller ones, are tied to the smallest node it
    knows, until the links are stars around their smallest nodes. Links stay distributed, rounds grow with the logarithm
    of the longest path, each round is stored. Links are never broadcast: packed in files they look smaller than they are.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "links")
    if edges.limit(few + 1).count() <= few:
        return _joined(edges)
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = (edges.select(F.col("v").alias("u"), F.col("u").alias("w")).hint("merge").join(lows, "u")
                 .select(F.col("w").alias("u"), F.col("low").alias("v"))
                 .union(edges.hint("merge").join(lows, "u").select("u", F.col("low").alias("v")))).where("u <> v").distinct()
        large = stored(large, "links")
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.hint("merge").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .union(lows.select("u", F.col("low").alias("v")))).where("u <> v").distinct()
        edges = stored(small, "links")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
