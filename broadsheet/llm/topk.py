"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers and are packed into blocks of about ``BLOCK`` vectors; near vectors are put into the same block
(by the nearest of a bounded number of pivots), which makes the bounds tight. A block keeps, for every component, the
largest and the smallest value. A query's bound for a block is the sum, over components, of the larger product with the
two: no vector of the block scores higher.

1. Every query is scored against the block with its highest bound, which gives a k-th score.
2. Blocks whose bound reaches that score are opened, and nothing below it is returned from them. The best k over both
   rounds are the result. All other blocks are skipped without loss.

Queries and blocks meet as packed chunks, in pieces of bounded size, and only queries that need a block are sent to it.
Vectors that are null or hold null or non-finite components take no part, nor do rows without id. Rows with equal id are
rows of their own: each is searched and asked, no row is a partner of its own id, and an asked id has one ranking over
all its rows. Vectors of different length are compared with zeros in place of what is missing. Components may have any
length: sums that could pass 2^62 are whole Python numbers, their bounds are rounded up. A score in the result that does
not fit a bigint is an error. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table
from .registry import query

BLOCK = 1024
QUERY_CHUNK = 256
BOUND_CHUNK = 1024
PIVOTS = 64
K = 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, x array<double>)``: floor of the scaled components, whole numbers of any length."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # From 2^53 on doubles are whole; floor() would cut them to a bigint.
    numbers = F.transform(parts, lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).when(
        F.abs(x * scale) < float("inf"), x * scale).otherwise(
        F.raise_error(F.lit("a scaled component exceeds the doubles")).cast("double")))
    return rows.where("vec_id is not null and embedding is not null").where(fine).select("vec_id", numbers.alias("x"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as float64, padded or cut to a width."""
    out = np.zeros((len(column), width))
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for i, row in enumerate(lists):
        values = np.asarray(row.values)
        out[i, :len(values)] = values[:width]
    return out


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as int32, or as doubles where one is longer."""
    return x.astype(np.int32 if np.abs(x).max(initial=0) < 2**31 else np.float64).tobytes()


def _unpack(data: bytes, width: int, rows: int) -> np.ndarray:
    kind = np.int32 if len(data) == 4 * rows * width else np.float64
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.float64)


def _largest(a: np.ndarray, b: np.ndarray) -> float:
    """No inner product of rows of the two, nor a part of its sum, is farther from zero."""
    return float(max(1, np.abs(a).max(initial=0))) * float(max(1, np.abs(b).max(initial=0))) * max(1, a.shape[1])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: float64 where all sums stay below 2^53, int64 below 2^62, Python numbers beyond."""
    if _largest(a, b) < 2**53:
        return (a @ b.T).astype(np.int64)
    if _largest(a, b) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.empty((len(a), len(b)), object)
    reach = np.maximum(1, np.abs(b).max(1, initial=0)) * max(1, a.shape[1])
    for i, row in enumerate(a):
        near = max(1, np.abs(row).max(initial=0)) * reach < 2**62
        if near.any():
            out[i, near] = b[near].astype(np.int64) @ row.astype(np.int64)
        own = [(at, int(row[at])) for at in np.flatnonzero(row).tolist()]
        for j in np.flatnonzero(~near).tolist():
            out[i, j] = sum(x * int(b[j, at]) for at, x in own)
    return out


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Highest score any vector between ``low`` and ``high`` can have; rounded up and cut to a bigint for long sums."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    if max(_largest(up, high), _largest(down, low)) < 2**61:
        return products(up, high) + products(down, low)
    with np.errstate(all="ignore"):
        size = np.abs(up) @ np.abs(high).T + np.abs(down) @ np.abs(low).T
        limit = np.ceil(up @ high.T + down @ low.T + size * (queries.shape[1] + 4) * 2.0**-50)
        # Scores above HIGHEST end the run, so a bound cut to it still reaches every k-th score.
        past, below = ~(limit < 2.0**63), limit < -2.0**63
        out = np.where(past | below, 0, limit).astype(np.int64)
    out[past], out[below] = HIGHEST, LOWEST
    return out


def packed_blocks(vectors: DataFrame, width: int, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``(block, n, ids, data, high, low)``: vectors by block, packed, with the component bounds."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(pivots).collect()
    centres = np.zeros((max(1, len(sample)), width))
    for i, row in enumerate(sample):
        centres[i, :len(row.x)] = row.x
    norms = (centres**2).sum(1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argmax(_matrix(batch.column(1), width) @ centres.T - norms, 1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["vec_id", "x", "near"])

    placed = stored(vectors.mapInArrow(nearest, "vec_id bigint, x array<double>, near int").withColumn(
        "row", F.monotonically_increasing_id()), "vectors")
    parts = placed.groupBy("near").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = placed.join(parts, "near").select(
        "vec_id", "x", (F.col("near") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("block"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        x = _matrix(rows.column("x"), width)
        return pa.table({"block": rows.column("block").slice(0, 1), "n": pa.array([len(x)], pa.int32()),
                         "ids": [rows.column("vec_id").to_numpy().tobytes()], "data": [_pack(x)],
                         "high": [_pack(x.max(0))], "low": [_pack(x.min(0))]})

    return stored(placed.groupBy("block").applyInArrow(
        lambda t: pack(t), "block bigint, n int, ids binary, data binary, high binary, low binary"), "blocks")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of ``vectors (vec_id, x)`` for each row of ``queries (vec_id, x)``."""
    width = max(1, vectors.agg(F.max(F.size("x"))).first()[0] or 1)
    blocks = packed_blocks(vectors, width, block)
    asked = queries.select(F.col("vec_id").alias("query_id"), "x").withColumn("query", F.monotonically_increasing_id())
    parts = max(1, -(-asked.count() // QUERY_CHUNK))
    asked = stored(asked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")), "queries")
    groups = max(1, -(-blocks.count() // BOUND_CHUNK))
    limits = blocks.select("block", "high", "low", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"))

    def pairs(rows: DataFrame, choose, schema: str) -> DataFrame:
        """Query chunks against chunks of block bounds, each pair of chunks in a task of its own."""
        left = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = limits.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"query": pa.array([], pa.int64()), "block": pa.array([], pa.int64()),
                                 "bound": pa.array([], pa.int64())})
            high = np.vstack([_unpack(x, width, 1) for x in b.column("high").to_pylist()])
            low = np.vstack([_unpack(x, width, 1) for x in b.column("low").to_pylist()])
            limit = bounds(_matrix(a.column("x"), width), high, low)
            i, j = choose(limit, a, b.column("block").to_numpy())
            return pa.table({"query": a.column("query").take(pa.array(i)), "block": b.column("block").take(pa.array(j)),
                             "bound": pa.array(limit[i, j])})

        return left.groupBy("chunk", "group").cogroup(right.groupBy("to", "group")).applyInArrow(
            lambda key, a, b: run(key, a, b), schema)

    def scored(wanted: DataFrame) -> DataFrame:
        """Best k of each wanted (query, block); queries of one block in parts of bounded size."""
        count = wanted.groupBy("block").agg(F.ceil(F.count("*") / QUERY_CHUNK).alias("parts"))
        rows = stored(wanted.join(count, "block").select(
            "block", "query", "least", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part")).join(
            asked.select("query", "query_id", "x"), "query"), "wanted")
        data = rows.select(F.col("block").alias("to"), F.col("part").alias("at")).distinct().join(
            blocks.select(F.col("block").alias("to"), "n", "ids", "data"), "to")

        def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
            out = [[], [], [], []]
            if a.num_rows and b.num_rows:
                ids = np.frombuffer(b.column("ids")[0].as_py(), np.int64)
                score = products(_matrix(a.column("x"), width),
                                 _unpack(b.column("data")[0].as_py(), width, b.column("n")[0].as_py()))
                own, least = a.column("query_id").to_pylist(), a.column("least").to_pylist()
                for i, (key, q) in enumerate(zip(a.column("query").to_pylist(), own, strict=True)):
                    fit = np.flatnonzero((ids != q) & (True if least[i] is None else score[i] >= least[i]))
                    if score.dtype == object:
                        best = np.array(sorted(fit.tolist(), key=lambda j: (-score[i][j], ids[j]))[:k], int)
                    else:
                        best = fit[np.lexsort((ids[fit], -score[i][fit]))[:k]]
                    found = score[i][best].tolist()
                    if found and found[0] > HIGHEST:
                        raise ValueError(f"the best score of {q} exceeds a bigint")
                    out[0] += [key] * len(best)
                    out[1] += [q] * len(best)
                    out[2] += ids[best].tolist()
                    # Scores too low for a bigint are null: they sort last and are an error in the result.
                    out[3] += [x if x >= LOWEST else None for x in found]
            return pa.table(dict(zip(("query", "query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in out),
                                     strict=True)))

        return rows.groupBy("block", "part").cogroup(data.groupBy("to", "at")).applyInArrow(
            lambda key, a, b: run(key, a, b), "query bigint, query_id bigint, vec_id bigint, score bigint")

    def best(limit, a, ids):
        return np.arange(len(limit)), limit.argmax(1)

    first = pairs(asked, best, "query bigint, block bigint, bound bigint").groupBy("query").agg(
        F.max(F.struct("bound", "block")).alias("top")).select("query", F.col("top.block").alias("block"))
    first = stored(first, "first")
    start = stored(scored(first.withColumn("least", F.lit(None).cast("bigint"))), "scores")
    kth = start.groupBy("query").agg(F.count("score").alias("c"), F.min("score").alias("low")).select(
        "query", F.when(F.col("c") >= k, F.col("low")).alias("least"))
    known = stored(asked.join(kth, "query", "left").join(first.withColumnRenamed("block", "done"), "query", "left"),
                   "known")

    def reaching(limit, a, ids):
        least = np.array([LOWEST if x is None else x for x in a.column("least").to_pylist()], np.int64)
        done = np.array(a.column("done").to_pylist(), np.int64)
        return np.nonzero((limit >= least[:, None]) & (ids[None, :] != done[:, None]))

    more = stored(pairs(known, reaching, "query bigint, block bigint, bound bigint"), "pairs")
    rest = scored(more.join(known.select("query", "least"), "query").select("query", "block", "least"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    ranked = start.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.coalesce(
        "score", F.raise_error(F.lit("a score is too low for a bigint")).cast("bigint")).alias("score"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query("op9_topk", SQL)
def op9_topk(spark, sf_dir):
    """The 20 best partners of every vector whose id is divisible by 20, among all others."""
    vectors = stored(integer_vectors(table(spark, sf_dir, "embeddings")), "integers")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))
