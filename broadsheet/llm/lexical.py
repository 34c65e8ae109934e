"""Ranked lexical search (BM25 in whole numbers) by a dual-tree search over items and documents.

1. Terms of the items are numbered. One pass over the documents takes term counts and lengths; document frequencies and
   the corpus totals are counted over all documents.
2. A document becomes the vector of its terms' saturated counts, an item the vector of its terms' weights times their
   repeats. A score is their inner product, so for a node of documents and a node of items the inner product of their
   coordinate maxima is a bound: no item of the one scores a document of the other higher.
3. Every task builds a tree over its documents (``DOCS`` in a root, then ``FAN`` times fewer, then leaves of ``LEAF``;
   documents with the same weightiest term stand together) and goes down both trees at once. A pair of nodes whose bound
   is below the weakest k-th score of its items is cut with all that is under it. Leaves are opened in the order of their
   bounds, so the k-th scores rise early; they rise on over all trees of a task. Equal bounds are opened, as ties go to
   the smaller doc_id.
4. The best k of every task are merged to the best k of all. Pruning loses nothing, so the result is exact.

Items are a query set: they are searched in blocks of bounded size (``ITEMS`` items and about ``TERMS`` terms), each
against all documents. A task holds the vectors of one tree of documents and of one block of items.

Null texts, empty ones and those without terms hold no term: they count in no statistic and score for no item. Items
without terms have no rows. Each item row is ranked by itself, also where item_id repeats; each document row is ranked,
also where doc_id repeats. Missing doc_ids stand last among equal scores. Ids may have any type that has an order. Empty
tables give no rows, long texts are read whole and extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, texts_of
from .registry import query
from .words import NOT_ALNUM

K = 20
ITEMS, TERMS = 512, 1 << 13
DOCS, FAN, LEAF = 512, 8, 8
CELLS = 1 << 22
SATURATION, LENGTH_SHARE, LEVEL = 12, 25, 100
_BLANKS = bytes(32 if i in NOT_ALNUM else (i + 32 if 65 <= i <= 90 else i) for i in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BLANKS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, terms array<binary>)``: one row per item row, terms with repeats; ``item`` numbers the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(x) for x in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))],
                                             names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return stored(found.withColumn("item", F.monotonically_increasing_id()), "items")


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(doc_id, n, ids array<int>, tf array<bigint>)``: all terms of a document counted, those of the vocabulary kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            lengths, ids, counts = [], [], []
            for text in texts_of(batch.column(1)):
                terms = terms_of(text)
                lengths.append(len(terms))
                own, tf = np.unique(np.array([known[t] for t in terms if t in known], np.int32), return_counts=True)
                ids.append(own)
                counts.append(tf)
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            flat = [np.concatenate(x) if x else np.empty(0) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(flat[0].astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.int64)))], names=["doc_id", "n", "ids", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n bigint, ids array<int>, tf array<bigint>"), "counts")


def weights(counts: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of every vocabulary term, and the numbers of documents and of terms; counted over all documents."""
    docs, terms = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = np.zeros(size, np.int64)
    for term, df in counts.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
        out[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
    return out, docs, terms


def saturated(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    m = LEVEL - LENGTH_SHARE + (LENGTH_SHARE * n * docs) // max(1, terms)
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


class ItemBlock:
    """Vectors of some items over their own terms, and the coordinate maxima of groups of them."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray):
        """``items``: number, distinct term ids and repeats of each."""
        self.items = np.array([x[0] for x in items], np.int64)
        self.terms = np.unique(np.concatenate([x[1] for x in items]))
        exact = max(float((weight[ids] * repeats).sum()) for _, ids, repeats in items) * 1e6 < 2**53
        self.vectors = np.zeros((len(items), len(self.terms)), np.float64 if exact else np.int64)
        for row, (_, ids, repeats) in enumerate(items):
            self.vectors[row, np.searchsorted(self.terms, ids)] = weight[ids] * repeats
        self.begin = np.arange(0, len(items), FAN)
        self.maxima = np.maximum.reduceat(self.vectors, self.begin, axis=0)


def item_blocks(found: list[tuple[int, list[bytes]]], known: dict[bytes, int], weight: np.ndarray, most: int = ITEMS,
                terms: int = TERMS) -> list[ItemBlock]:
    """Blocks of bounded size; items whose weightiest terms agree stand together. Items that no term can score are out."""
    vectors = []
    for number, own in found:
        ids, repeats = np.unique(np.array([known[t] for t in own], np.int64), return_counts=True)
        ids, repeats = ids[weight[ids] > 0], repeats[weight[ids] > 0]
        if len(ids):
            vectors.append((number, ids, repeats))
    vectors.sort(key=lambda x: (int(x[1][np.argmax(weight[x[1]] * x[2])]), x[0]))
    out: list[ItemBlock] = []
    block: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    for vector in vectors:
        if block and (len(block) == most or size + len(vector[1]) > terms):
            out.append(ItemBlock(block, weight))
            block, size = [], 0
        block.append(vector)
        size += len(vector[1])
    return [*out, ItemBlock(block, weight)] if block else out


class DocTree:
    """Vectors of some documents over given terms, with the coordinate maxima of leaves, nodes and the root."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray):
        order = np.argsort((vectors * weight).argmax(1), kind="stable")
        self.rows, self.vectors = order, vectors[order]
        self.leaves = np.maximum.reduceat(self.vectors, np.arange(0, len(order), LEAF), axis=0)
        self.nodes = np.maximum.reduceat(self.leaves, np.arange(0, len(self.leaves), FAN), axis=0)
        self.root = self.nodes.max(0, keepdims=True)


class Best:
    """The k best ``(score, doc_id)`` of each item of a block so far."""

    def __init__(self, size: int, k: int):
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in range(size)]
        self.kth = np.ones(size, np.int64)

    def offer(self, item: int, scores: np.ndarray, ids: list) -> None:
        fit = np.flatnonzero(scores >= self.kth[item])
        if not len(fit):
            return
        if len(fit) > self.k:
            low = np.partition(scores[fit], len(fit) - self.k)[len(fit) - self.k]
            fit = fit[scores[fit] >= low]
        own = self.held[item] + [(-int(scores[i]), ids[i] is None, ids[i]) for i in fit.tolist()]
        own.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
        self.held[item] = own[:self.k]
        if len(own) >= self.k:
            self.kth[item] = -own[self.k - 1][0]


def search_tree(block: ItemBlock, tree: DocTree, ids: list, best: Best) -> int:
    """Offers all documents of the tree that may be among the best of an item; returns the number of scores taken."""
    weakest = np.minimum.reduceat(best.kth, block.begin)
    groups = np.flatnonzero((block.maxima @ tree.root.T)[:, 0] >= weakest)
    if not len(groups):
        return 0
    taken = 0
    bound = block.maxima[groups] @ tree.nodes.T
    pairs = np.argwhere(bound >= weakest[groups][:, None])
    for g, node in pairs[np.argsort(-bound[tuple(pairs.T)], kind="stable")].tolist():
        begin = block.begin[groups[g]]
        items = np.arange(begin, min(begin + FAN, len(block.items)))
        if bound[g, node] < best.kth[items].min():
            continue
        first = node * FAN
        leaf_bound = block.vectors[items] @ tree.leaves[first:first + FAN].T
        order = np.argsort(-leaf_bound.max(0), kind="stable").tolist()
        for leaf in order:
            open_for = items[leaf_bound[:, leaf] >= best.kth[items]]
            if not len(open_for):
                continue
            low = (first + leaf) * LEAF
            vectors = tree.vectors[low:low + LEAF]
            scores = (block.vectors[open_for] @ vectors.T).astype(np.int64)
            taken += scores.size
            own = [ids[i] for i in tree.rows[low:low + LEAF].tolist()]
            for at, item in enumerate(open_for.tolist()):
                best.offer(item, scores[at], own)
    return taken


def search_batch(blocks: list[ItemBlock], bests: list[Best], weight: np.ndarray, ids: list, offsets: np.ndarray,
                 terms: np.ndarray, values: np.ndarray) -> None:
    """All blocks of items against the documents of one batch, given as lists of terms and values."""
    for block, best in zip(blocks, bests, strict=True):
        place = np.searchsorted(block.terms, terms)
        place[place == len(block.terms)] = 0
        hit = np.flatnonzero(block.terms[place] == terms)
        row = np.searchsorted(offsets, hit, "right") - 1
        used, row = np.unique(row, return_inverse=True)
        step = max(LEAF, min(DOCS, CELLS // len(block.terms)))
        edges = np.searchsorted(row, np.arange(0, len(used) + step, step))
        for number, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if low == high:
                continue
            own = used[number * step:(number + 1) * step]
            vectors = np.zeros((len(own), len(block.terms)), block.vectors.dtype)
            at = hit[low:high]
            vectors[row[low:high] - number * step, place[at]] = values[at]
            search_tree(block, DocTree(vectors, weight[block.terms]), [ids[i] for i in own.tolist()], best)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score above zero for each row of ``items``."""
    numbered = item_terms(items)
    parts = max(1, -(-(numbered.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS))
    out = None
    for part in range(parts):
        some = numbered.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        found = _searched(docs, [(r.item, [bytes(t) for t in r.terms]) for r in some.select("item", "terms").collect()], k)
        out = found if out is None else out.union(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = stored(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: Terms of all items, repeats included, that one pass over the documents serves; more items take more passes.
QUERY_TERMS = 1 << 20


def _searched(docs: DataFrame, found: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """``(item, doc_id, score)``: for each of some items, the best k of every task."""
    vocabulary = sorted({t for _, own in found for t in own})
    counts = term_counts(docs, vocabulary)
    weight, total, terms = weights(counts, len(vocabulary))
    blocks = item_blocks(found, {t: i for i, t in enumerate(vocabulary)}, weight)
    kind = counts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(len(block.items), k) for block in blocks]
        kept = pa.null()
        for batch in batches:
            kept = batch.schema.field("doc_id").type
            sizes = batch.column("n").to_numpy()
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            n = np.repeat(sizes, np.diff(offsets))
            first, last = offsets[0], offsets[-1]
            ids = lists.values.to_numpy()[first:last].astype(np.int64)
            tf = batch.column("tf").values.to_numpy()[first:last]
            search_batch(blocks, bests, weight, batch.column("doc_id").to_pylist(), offsets - first, ids,
                         saturated(tf, n, total, terms))
        rows = [(int(block.items[i]), doc, -score) for block, best in zip(blocks, bests, strict=True)
                for i, held in enumerate(best.held) for score, _, doc in held]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kept),
                 pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return counts.where(F.size("ids") > 0).mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, total GROUP BY term),
s AS (SELECT i.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) //
             (1000 * tf.tf + 12 * (100 - 25 + ((25 * len.n * total.docs) // total.terms))))) AS BIGINT) AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN len ON len.doc_id = tf.doc_id, total GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""


@query("op11_lexical", SQL)
def op11_lexical(spark, sf_dir):
    """The 20 best documents of all for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
