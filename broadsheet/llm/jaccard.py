"""Exact n-gram Jaccard links by a token-group matrix, and the connected components they make.

1. A text becomes its set of hashed shingles. Texts with equal sets are one *node*.
2. Nodes are partitioned into groups of similar nodes: those with the same two lowest shingles, in parts of bounded size.
   Inside each part nodes are linked, then the leaders of the parts of one key again, until that no longer merges them;
   what is alone yet is tried once more by any two of its three lowest shingles. This gives local components.
3. The token-group matrix holds, for each group, the union of its members' prefixes, in one order of all shingles
   (rare ones first, by a fixed-size count sketch; every order gives the same result). A node whose set reaches the
   threshold with some member shares at least a twentieth of its tokens with that union, so the number of shared matrix
   tokens bounds the overlap of query and group; lengths bound it too. Tokens that only one local component has are left
   out, and of two components the smaller one asks: nothing is compared again inside a component. While many nodes would
   ask many groups, as near copies that are still apart do, each asks only the group of the largest components that shares
   most tokens with it; what links there is one component from then on, so the rows stay linear in the nodes.
4. Only qualifying groups are opened. Opening first counts the query's tokens in the group's full token union, then takes
   the exact overlaps with the members and returns one link for each other component.

Nothing is emitted per pair inside a group. Null texts and texts without words have the empty set and no links. Rows
with equal ids are rows of their own; a null id never becomes a component id unless all ids of the component are null.
An empty table gives no rows. Extra columns, whatever their names, are not read by :func:`components_of`;
:func:`one_per_component` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECES, BitFilter, components, free_names, pieces, stored, summed, table, texts_of
from .registry import query
from .words import SPACES, Splitter, shingles

SKETCH_BITS = 21
GROUP = 128
LOWS = 3
FULL = 8
TOKENS_PER_TASK = 1 << 20
_SPLIT = Splitter(SPACES)


def _sets(batch: pa.RecordBatch, at: int, width: int) -> Iterator[np.ndarray]:
    for words in _SPLIT.each(texts_of(batch.column(at))):
        yield shingles(words, width)


def _key(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def count_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Document counts of hashed shingles over all documents, 2^SKETCH_BITS counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                places = [(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)
                          for x in _sets(whole.slice(low, 1024), 0, width)]
                counts += np.bincount(np.concatenate(places), minlength=len(counts))
        yield pieces(counts)

    return summed(docs.select("text").mapInArrow(run, PIECES), "int64", 1 << SKETCH_BITS)


def needed(size: np.ndarray | int, num: int, den: int):
    """Least overlap of a set of this size with any set it links with."""
    return -(-num * size // den)


def shared_least(size):
    """Matrix tokens that a linked pair shares at least: a twentieth of the set, one at least."""
    return np.maximum(1, size // 20)


def signatures(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``(doc_id, h, n, k1, k2, lows, prefix)``: hash of the row, set size, set digest, lowest shingles, and the prefix in
    the order of rarity."""
    counts = np.minimum(count_sketch(docs, width), 2**31 - 1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                sizes, keys, lows, prefixes = [], [], [], []
                for tokens in _sets(batch, 2, width):
                    n = len(tokens)
                    sizes.append(n)
                    keys.append(_key(tokens))
                    lows.append(tokens[:LOWS])
                    take = min(n, n - int(needed(n, num, den)) + int(shared_least(n))) if n else 0
                    rarity = counts[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    prefixes.append(tokens[np.argsort(rarity, kind="stable")[:take]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                     pa.array([k[1] for k in keys], pa.int64()), _lists(lows), _lists(prefixes)],
                    names=["doc_id", "h", "n", "k1", "k2", "lows", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "xxhash64(doc_id, text) as h", "text").mapInArrow(
        run, f"doc_id {kind}, h bigint, n bigint, k1 bigint, k2 bigint, lows array<bigint>, prefix array<bigint>")


def token_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``(node, tokens)`` of the wanted ``nodes (node, h, k1, k2)``: a pass over all texts that takes the sets of those
    rows that may be wanted, then an exact join."""
    wanted = BitFilter.build(nodes.select("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = np.flatnonzero(wanted.may_hold(whole.column(0).to_numpy(zero_copy_only=False)))
            for low in range(0, len(rows), 512):
                batch = whole.take(pa.array(rows[low:low + 512]))
                found = list(_sets(batch, 1, width))
                keys = [_key(tokens) for tokens in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([k[0] for k in keys], pa.int64()),
                     pa.array([k[1] for k in keys], pa.int64()), _lists(found)], names=["h", "k1", "k2", "tokens"])

    passed = docs.selectExpr("xxhash64(doc_id, text) as h", "text").mapInArrow(run, "h bigint, k1 bigint, k2 bigint, tokens array<bigint>")
    return passed.dropDuplicates(["h", "k1", "k2"]).join(nodes, ["h", "k1", "k2"]).select("node", "tokens")


def parts_of(count, tokens):
    """Into how many parts a group is cut, so that each has a bounded number of rows and of tokens."""
    return F.ceil(F.greatest(count / GROUP, tokens / TOKENS_PER_TASK))


def _unpacked(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [np.asarray(x.values).view(np.uint64) if x.is_valid else np.empty(0, np.uint64) for x in column]


def _overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two bounded lists of sets, by products of 0/1 blocks of their tokens."""
    names = np.unique(np.concatenate(columns)) if columns else np.empty(0, np.uint64)
    out = np.zeros((len(rows), len(columns)))

    def placed(sets):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        place = np.searchsorted(names, flat)
        known = place < len(names)
        known[known] = names[place[known]] == flat[known]
        order = np.argsort(place[known], kind="stable")
        return owner[known][order], place[known][order]

    (row_owner, row_place), (col_owner, col_place) = placed(rows), placed(columns)
    step = 1 << 14
    for low in range(0, len(names), step):
        a, b = np.searchsorted(row_place, [low, low + step]), np.searchsorted(col_place, [low, low + step])
        if a[0] == a[1]:
            continue
        used, at = np.unique(row_place[a[0]:a[1]], return_inverse=True)
        left = np.zeros((len(rows), len(used)), np.float32)
        left[row_owner[a[0]:a[1]], at] = 1
        own, to = col_owner[b[0]:b[1]], np.searchsorted(used, col_place[b[0]:b[1]])
        hit = to < len(used)
        hit[hit] = used[to[hit]] == col_place[b[0]:b[1]][hit]
        right = np.zeros((len(used), len(columns)), np.float32)
        right[to[hit], own[hit]] = 1
        out += left @ right
    return out


def _linked(overlap, a, b, num: int, den: int):
    return den * overlap >= num * (a + b - overlap)


def _local_roots(nodes: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Smallest linked node of each node of one chunk."""
    sizes = np.array([len(s) for s in sets], float)
    link = _linked(_overlaps(sets, sets), sizes[:, None], sizes[None, :], num, den)
    root = nodes.copy()
    while True:
        low = np.where(link, root[None, :], np.iinfo(np.int64).max).min(1)
        if (low == root).all():
            return root
        root = low


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Rows ``(node, n, low)`` whose key ``low`` other nodes have too."""
    return keyed.join(keyed.groupBy("low").agg(F.count("*").alias("c")).where("c > 1").select("low"), "low")


def _group_rounds(keyed: DataFrame, sets: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Links ``(node, root)`` of nodes that share a key with others, found in chunks of about GROUP nodes; the roots of the
    chunks of one key are chunked again as long as that halves them."""
    current, links = keyed, []
    while True:
        count = current.groupBy("low").agg(F.count("*").alias("c"), parts_of(F.count("*"), F.sum("n")).alias("parts"))
        chunked = stored(current.join(count.where("c > 1"), "low").select(
            "node", "n", "low", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("chunk")),
            "chunks")
        size = chunked.agg(F.count("*"), F.count_if(F.col("parts") > 1)).first()
        if not size[0]:
            return links

        def link(rows: pa.Table) -> pa.Table:
            nodes = rows.column("node").to_numpy().copy()
            root = _local_roots(nodes, _unpacked(rows.column("tokens")), num, den)
            return pa.table({"node": nodes, "low": rows.column("low"), "root": root, "n": rows.column("n"),
                             "parts": rows.column("parts")})

        linked = stored(chunked.join(sets, "node").groupBy("low", "chunk").applyInArrow(
            lambda t: link(t), "node bigint, low bigint, root bigint, n bigint, parts bigint"), "linked")
        links.append(linked.select("node", "root"))
        leaders = linked.where("parts > 1 and node = root")
        left = leaders.count()
        if not left or 2 * left > size[1]:
            return links
        current = leaders.select("node", "n", "low")


def _tied(spark, links: list[DataFrame]) -> DataFrame:
    """``(node, root)`` of all nodes in the links."""
    every = spark.createDataFrame([], "node bigint, root bigint")
    for link in links:
        every = every.union(link)
    return components(every.toDF("a", "b"))


def node_components(docs: DataFrame, base: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``nodes (k1, k2, node, n)`` and links ``(node, root)`` that tie the nodes of each component."""
    nodes = stored(base.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("uid", "h", "n", "lows")).alias("x")).select(
        "k1", "k2", F.col("x.uid").alias("node"), "x.h", "x.n", "x.lows"), "nodes")
    spark = docs.sparkSession
    # Keys are pairs of the lowest shingles, which unrelated texts seldom share. First by one pair; then what is still
    # alone, and one node of each component, by any pair.
    pair = F.xxhash64(F.col("lows")[0], F.get("lows", F.lit(1)))
    every = F.array(*[F.xxhash64(F.get("lows", F.lit(i)), F.get("lows", F.lit(j))) for i, j in ((0, 1), (0, 2), (1, 2))])
    keys = stored(shared_keys(nodes.select("node", "n", F.explode(F.array_distinct(every)).alias("low"))), "keys")
    sets = stored(token_sets(docs, stored(nodes.select("node", "h", "k1", "k2").join(
        keys.select("node").distinct(), "node", "left_semi"), "keyed"), width), "sets")
    links = _group_rounds(nodes.select("node", "n", pair.alias("low")), sets, num, den)
    local = stored(_tied(spark, links), "local")
    alone = keys.join(local.where("node <> root").select("node"), "node", "left_anti")
    local = stored(_tied(spark, [local, *_group_rounds(alone, sets, num, den)]), "local")
    placed = placed_nodes(nodes, local)
    rows = matrix_rows(base, placed)
    # While the full join would make many times its rows, nodes only ask the largest component of each of their tokens.
    asking = _asking(rows)
    while asking:
        found = stored(_opened(docs, stored(top_pairs(rows), "pairs"), placed, width, num, den), "found")
        local = stored(_tied(spark, [local, found]), "local")
        placed = placed_nodes(nodes, local)
        rows = stored(apart(rows.select("token", "node").join(
            placed.select("node", "n", "comp", "size", "near", "part"), "node")), "matrix")
        asking = _asking(rows) if 4 * found.count() >= asking else 0
    top = rows.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("top"))
    rows = stored(rows.join(top, "token"), "matrix")
    # Queries of a token come from the components that are not the largest one with that token.
    asking = rows.where("struct(size, comp) < top").select("token", "node", "n", F.col("size").alias("q_size"),
                                                           F.col("comp").alias("q_comp"))
    groups = rows.groupBy("token", "near", "part").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.struct("size", "comp")).alias("last"))
    pairs = (asking.join(groups, "token")
             .where("q_size < last.size or q_size = last.size and q_comp < last.comp")
             .where((den * F.col("n") >= num * F.col("least")) & (den * F.col("most") >= num * F.col("n")))
             .groupBy("node", "n", "near", "part").agg(F.count("*").alias("shared"), F.min("least").alias("least")))
    least = F.greatest(F.lit(1), F.floor(F.least("n", "least") / 20))
    pairs = stored(pairs.where(F.col("shared") >= least).select("node", "near", "part"), "pairs")
    return placed, local.union(_opened(docs, pairs, placed, width, num, den).select(
        F.col("node"), F.col("comp").alias("root")))


def placed_nodes(nodes: DataFrame, local: DataFrame) -> DataFrame:
    """``(node, n, h, k1, k2, comp, size, near, part)``: nodes with their local component and their group.

    Groups are bounded parts of one local component, or of the unlinked nodes with one pair of lowest shingles.
    """
    sizes = local.groupBy("root").agg(F.count("*").alias("size"))
    member = local.join(sizes, "root").select("node", F.col("root").alias("comp"), "size")
    alone = F.xxhash64(F.col("lows")[0], F.get("lows", F.lit(1)))
    near = nodes.join(member, "node", "left").select(
        "node", "n", "h", "k1", "k2",
        F.when(F.col("comp").isNull(), alone).otherwise(F.xxhash64("comp", F.lit("component"))).alias("near"),
        F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1).cast("bigint")).alias("size"))
    parts = near.groupBy("near").agg(parts_of(F.count("*"), F.sum("n")).alias("parts"))
    return stored(near.join(parts, "near").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"), "placed")


def apart(rows: DataFrame) -> DataFrame:
    """Matrix rows of tokens that more than one component has."""
    common = rows.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token")
    return rows.join(common, "token", "left_semi")


def _asking(rows: DataFrame) -> int:
    """How many nodes ask, if the full join of queries and groups would make over ``FULL`` times the rows it reads; else 0."""
    per = rows.groupBy("token", "near", "part").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.count("*").alias("groups"), F.sum("c").alias("c"))
    made, read = per.agg(F.sum(F.col("groups") * F.col("c")), F.sum("c")).first()
    return rows.select("node").distinct().count() if (made or 0) > FULL * (read or 0) else 0


def top_pairs(rows: DataFrame) -> DataFrame:
    """``(node, near, part)``: each node outside the largest component of a token asks one group of such a component, the
    one with which it shares most tokens. At most one row per node."""
    best = rows.groupBy("token").agg(F.max(F.struct("size", "comp", "near", "part")).alias("top"))
    asked = rows.join(best, "token").where("struct(size, comp) < struct(top.size, top.comp)").groupBy(
        "node", "top.near", "top.part").agg(F.count("*").alias("shared"))
    return asked.groupBy("node").agg(F.max(F.struct("shared", "near", "part")).alias("x")).select("node", "x.near", "x.part")


def matrix_rows(base: DataFrame, placed: DataFrame) -> DataFrame:
    """``(token, node, n, comp, size, near, part)``: prefix tokens that nodes of more than one local component have."""
    prefix = stored(base.select(F.col("uid").alias("node"), "prefix").join(placed.select("node", "comp"), "node"), "prefix")
    common = stored(prefix.select("comp", F.explode("prefix").alias("token")).groupBy("token").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token"), "tokens")
    known = BitFilter.build(common, 25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            pick = known.may_hold(flat)
            yield pa.RecordBatch.from_arrays([pa.array(flat[pick]), pa.array(own[pick])], names=["token", "node"])

    rows = prefix.select("node", "prefix").mapInArrow(run, "token bigint, node bigint")
    return stored(rows.join(common, "token").join(placed.select("node", "n", "comp", "size", "near", "part"), "node"), "matrix")


def _opened(docs: DataFrame, pairs: DataFrame, placed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``(node, comp)`` links of the qualifying pairs of query node and group: at most one per query and component."""
    members = placed.join(pairs.select("near", "part").distinct(), ["near", "part"], "left_semi")
    wanted = placed.select("node", "h", "k1", "k2").join(
        members.select("node").union(pairs.select("node")).distinct(), "node", "left_semi")
    sets = stored(token_sets(docs, stored(wanted, "wanted"), width), "sets")
    sized = pairs.join(placed.select("node", "n", F.col("comp").alias("q_comp")), "node")
    count = sized.groupBy("near", "part").agg(parts_of(F.count("*"), F.sum("n")).alias("parts"))
    asked = sized.join(count, ["near", "part"]).select(
        "node", "near", "part", "q_comp", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"))
    asked = stored(asked.join(sets, "node"), "asked")
    opened = (asked.select("near", "part", "salt").distinct().join(
        members.select("node", "comp", "near", "part"), ["near", "part"]).join(sets, "node").select(
        F.col("near").alias("g_near"), F.col("part").alias("g_part"), F.col("salt").alias("g_salt"), "comp", "tokens"))

    def check(key, ask: pa.Table, group: pa.Table) -> pa.Table:
        out = set()
        if ask.num_rows and group.num_rows:
            members, comp = _unpacked(group.column("tokens")), group.column("comp").to_numpy()
            union = np.unique(np.concatenate(members))
            sizes = np.array([len(m) for m in members], float)
            nodes, own_comp = ask.column("node").to_pylist(), ask.column("q_comp").to_pylist()
            sets = _unpacked(ask.column("tokens"))
            kept = [i for i, own in enumerate(sets)
                    if np.isin(own, union, assume_unique=True).sum() >= needed(len(own), num, den)]
            if kept:
                overlap = _overlaps([sets[i] for i in kept], members)
                own = np.array([len(sets[i]) for i in kept], float)
                for i, row in zip(kept, _linked(overlap, own[:, None], sizes[None, :], num, den), strict=True):
                    out.update((nodes[i], c) for c in set(comp[row].tolist()) - {own_comp[i]})
        return pa.table({"node": pa.array([x[0] for x in out], pa.int64()),
                         "comp": pa.array([x[1] for x in out], pa.int64())})

    return asked.groupBy("near", "part", "salt").cogroup(opened.groupBy("g_near", "g_part", "g_salt")).applyInArrow(
        lambda k, a, b: check(k, a, b), "node bigint, comp bigint")


def components_of(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(uid, doc_id, h, n, component, first)`` for each row of ``docs (doc_id, text)``.

    Rows link when ``den * |intersection| >= num * |union|`` of their sets of ``width``-word shingles. ``component`` is
    the smallest doc_id reachable, ``first`` the row number of one row of the component. ``uid`` numbers the rows.
    """
    docs = docs.select("doc_id", "text")
    base = stored(signatures(docs, width, num, den).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    placed, links = node_components(docs, base, width, num, den)
    roots = components(stored(links.toDF("a", "b"), "links"))
    node_root = stored(placed.select("k1", "k2", "node").join(roots, "node", "left").select(
        "k1", "k2", F.coalesce("root", "node").alias("root")), "roots")
    rows = stored(base.select("uid", "doc_id", "h", "n", "k1", "k2").join(node_root, ["k1", "k2"], "left").select(
        "uid", "doc_id", "h", "n", F.when(F.col("n") > 0, F.col("root")).alias("root")), "rows")
    lowest = rows.where("root is not null").groupBy("root").agg(
        F.min("doc_id").alias("lowest"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("first"))
    return rows.join(lowest, "root", "left").select(
        "uid", "doc_id", "h", "n", F.coalesce("lowest", F.when(F.col("root").isNull(), F.col("doc_id"))).alias("component"),
        F.coalesce("first", "uid").alias("first"))


def one_per_component(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id. All columns stay.

    Rows without words all stay. Of rows with equal doc_id and text one stays; a null id counts as the largest.
    """
    found = components_of(docs, width, num, den)
    own_id, own_h, n, row, at = free_names(docs.columns, "own_id", "own_h", "own_n", "row", "at")
    kept = stored(found.where("first = uid").groupBy("doc_id", "h").agg(F.max("n").alias("n")).toDF(own_id, own_h, n), "kept")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_h)))
    number = F.row_number().over(Window.partitionBy("doc_id", row).orderBy("doc_id"))
    return rows.withColumn(at, number).where((F.col(at) == 1) | (F.col(n) == 0)).select(*[docs[c] for c in docs.columns])


@query("op5_jaccard")
def op5_jaccard(spark, sf_dir):
    """Components of whole documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    found = components_of(table(spark, sf_dir, "documents"), 3, 90, 100)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
