"""SimHash near-duplicates by anchor-point covering.

1. A text becomes a 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes of its word shingles, repeats
   included. Texts with equal fingerprints are one row from here on.
2. The anchors are the words of a covering code over 46 bits of the fingerprint: two binary Golay codes of 23 bits, each
   perfect with covering radius 3, so every half has exactly one anchor within 3 bits. That pair is the *home* of a
   fingerprint. With the threshold ``bits`` added to the radius, a fingerprint also *visits* every anchor pair that it
   reaches by at most ``bits`` bits beyond the radius, both halves taken together (61 of 2^24 on average for two bits).
   Of two fingerprints within ``bits`` bits, the larger visits the home of the smaller one: nothing is missed.
3. Homes and visitors meet per anchor and are compared in full. An anchor that is home to more than ``crowd`` fingerprints
   leaves this step: its fingerprints are taken by the code of radius 0, in which each fingerprint is an anchor of its
   own and visits are all words within ``bits`` bits. Either way the rows made grow with the fingerprints, not with pairs.
4. Links are tied to components; ``component_id`` is the smallest doc_id in them.

Spark sizes a table that Python or ``explode`` has made by the table it is made from, so visits look as small as their
fingerprints, and rows that repeat look as small as their packed files. Such sides are joined by merge, for any size of
the input; they would go through the driver if Spark took them for small. Only tables that keep one row per anchor,
fingerprint or component on disk are left to its size check.

Null texts, empty ones and those without words have the fingerprint zero, which links like any other. A text with fewer
words than ``width`` is one shingle. Rows without doc_id take part; they name a component only if it has no other rows,
and then with null. Repeated rows give repeated rows, an empty table gives none, long texts are read whole in pieces,
ids may have any type that has an order, and extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored, table, texts_of
from .registry import query

WIDTH, BITS = 5, 3
SEED = 42
CROWD = 4096
HALF, RADIUS = 23, 3
GENERATOR = 0b101011100011
_PIECE = 1 << 16


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the shingles of ``width`` words; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[min(width, len(words)) - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for low in range(0, len(ends), _PIECE):
        spans = zip(starts[low:low + _PIECE], ends[low:low + _PIECE], strict=False)
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, print bigint)`` of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, width) for x in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print bigint")


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits of a half, modulo the generator."""
    power, powers = 1, []
    for _ in range(HALF):
        powers.append(power)
        power <<= 1
        if power >> 11:
            power ^= GENERATOR

    def spread(own: list[int]) -> np.ndarray:
        out = np.zeros(1, np.uint16)
        for p in own:
            out = np.concatenate([out, out ^ np.uint16(p)])
        return out

    return spread(powers[:12]), spread(powers[12:])


def syndrome(half: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[half & 0xFFF] ^ high[half >> 12]


@cache
def _patterns(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Error words of one weight, ordered by their syndrome, and where each syndrome begins."""
    words = np.array([sum(1 << i for i in places) for places in combinations(range(HALF), weight)], np.int64)
    own = syndrome(words)
    order = np.argsort(own, kind="stable")
    return words[order], np.searchsorted(own[order], np.arange((1 << 11) + 1))


def _within(half: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, anchor)`` for every anchor exactly ``excess`` bits beyond the radius, or within the radius for zero."""
    rows, found = [], []
    for weight in range(RADIUS + 1) if excess == 0 else [RADIUS + excess]:
        words, begin = _patterns(weight)
        own = syndrome(half).astype(np.int64)
        count = begin[own + 1] - begin[own]
        row = np.repeat(np.arange(len(half)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[own][row]
        rows.append(row)
        found.append((half[row] ^ words[place]) >> 11)
    return np.concatenate(rows), np.concatenate(found)


def anchors(prints: np.ndarray, reach: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(row, anchor)``: the anchor pairs that fingerprints reach with ``first`` to ``reach`` bits beyond the radius."""
    mask = np.uint64((1 << HALF) - 1)
    left, right = (prints & mask).astype(np.int64), (prints >> np.uint64(HALF) & mask).astype(np.int64)
    rows, found = [], []
    for a in range(reach + 1):
        row, one = _within(left, a)
        for b in range(max(0, first - a), reach + 1 - a):
            at, two = _within(right[row], b)
            rows.append(row[at])
            found.append(one[at] << 12 | two)
    return np.concatenate(rows), np.concatenate(found)


def placed(prints: DataFrame, reach: int) -> DataFrame:
    """``(anchor, print)`` of ``prints (print)``: one row for each anchor within the radius plus ``reach``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(own), 1024):
                part = own[low:low + 1024]
                row, anchor = anchors(part, reach)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row].view(np.int64))],
                                                 names=["anchor", "print"])

    return prints.select("print").mapInArrow(run, "anchor bigint, print bigint")


def _neighbours(bits: int) -> F.Column:
    masks = [sum(1 << i for i in places) for n in range(1, bits + 1) for places in combinations(range(64), n)]
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])


def links(prints: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """``(a, b)`` for all pairs of distinct fingerprints in ``prints (print)`` that differ in ``bits`` bits or fewer."""
    if not bits:
        return prints.sparkSession.createDataFrame([], "a bigint, b bigint")
    homes = stored(placed(prints, 0), "homes")
    crowded = homes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor")
    visitors = placed(prints, bits)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    if crowded.limit(1).count():
        crowded = stored(crowded, "crowded")
        full = homes.join(crowded, "anchor", "left_semi").select(F.col("print").alias("a"))
        homes = homes.join(crowded, "anchor", "left_anti")
        asking = stored(visitors.join(crowded, "anchor", "left_semi").select("print").distinct(), "asking")
        every = asking.select(F.col("print").alias("b"), F.explode(_neighbours(bits)).alias("mask")).select(
            "b", F.col("b").bitwiseXOR(F.col("mask")).alias("a")).where("a < b")
        exact = every.hint("merge").join(full, "a").select("a", "b")
    else:
        exact = prints.sparkSession.createDataFrame([], "a bigint, b bigint")
    met = visitors.select("anchor", F.col("print").alias("b")).hint("merge").join(
        homes.select("anchor", F.col("print").alias("a")), "anchor").where(F.col("a") < F.col("b")).where(near)
    return met.select("a", "b").union(exact)


def simhash_components(docs: DataFrame, width: int = WIDTH, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, print, component_id)`` for each row of ``docs (doc_id, text)``."""
    rows = stored(fingerprints(docs, width), "prints")
    classes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("lowest")), "classes")
    found = stored(links(classes, bits, crowd), "links")
    roots = stored(components(found).toDF("print", "root"), "roots")
    lowest = stored(classes.join(roots, "print").groupBy("root").agg(F.min("lowest").alias("least")), "lowest")
    named = classes.join(roots.join(lowest, "root").select("print", "root", "least"), "print", "left").select(
        "print", F.when(F.col("root").isNull(), F.col("lowest")).otherwise(F.col("least")).alias("component_id"))
    return rows.hint("merge").join(named, "print").select("doc_id", "print", "component_id")


@query("op13_simhash")
def op13_simhash(spark, sf_dir):
    """Fingerprints of 3-word shingles of all whole documents, and their components at two differing bits or fewer."""
    found = simhash_components(table(spark, sf_dir, "documents"), 3, 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
