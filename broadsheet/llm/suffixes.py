"""Repeated passages by sparse suffix arrays.

A document is its sequence of words (cut at ASCII white space, A-Z as a-z). A run of ``LEAST`` words is *repeated* when an
equal run starts at a smaller (doc_id, row hash, word) place; rows without doc_id come last. All words inside repeated runs form the repeated spans; the first
occurrence stays.

1. Suffixes are retained only at minimiser positions: the places whose ``HEAD``-word hash is the lowest of some ``LEAST``-
   word run. Equal runs retain the same suffix, so no repeat is missed.
2. The retained suffixes are range-sorted by the hash of their head, and neighbours in that order are compared. A head
   with a third of all suffixes is spread over many ranges; what meets only at a range's edge is settled by a small join
   of the edges.
3. Matches are extended left and right of the retained suffixes whose head has a neighbour: every run around such a
   place is compared, by its hash, with all others of that hash (smallest place per hash, then a join), and overlapping
   repeated runs grow together to maximal spans. Comparing neighbours alone would miss a partner that is not adjacent.

Null texts have no words. Rows that repeat both doc_id and text count once, and all get the same spans; a missing doc_id
is a value like others here. Rows without doc_id are searched with ``unnamed`` only, as the query and :func:`cut_repeats`
do; they follow all others, so the spans of rows with doc_id are the same either way. Documents shorter than ``LEAST`` words have no repeated run. Extra columns are not read by
:func:`repeated_spans`; :func:`cut_repeats` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, free_names, stored, table, texts_of
from .registry import query
from .words import SPACES, Splitter, window_hashes

LEAST = 50
HEAD = 20
_SPLIT = Splitter(SPACES)


def _runs(words: np.ndarray, least: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Head hashes of all suffixes, and for each run its minimiser: where the lowest head hash in it starts."""
    heads = window_hashes(words, head, 0xD1342543DE82EF95)
    width = least - head + 1
    if len(heads) < width:
        return heads, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(heads, width)
    lowest = np.concatenate([view[i:i + 65536].argmin(1) for i in range(0, len(view), 65536)])
    return heads, np.arange(len(view)) + lowest


def _searched(docs: DataFrame, unnamed: bool) -> DataFrame:
    return docs if unnamed else docs.where("doc_id is not null")


def retained_suffixes(docs: DataFrame, least: int = LEAST, head: int = HEAD, unnamed: bool = False) -> DataFrame:
    """``(head, h, at)``: hash of the first words, hash of the row, word position of every retained suffix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                values, places = [], []
                for words in _SPLIT.each(texts_of(batch.column(1))):
                    heads, lowest = _runs(words, least, head)
                    at = np.unique(lowest)
                    values.append(heads[at])
                    places.append(at)
                rows = np.repeat(batch.column(0).to_numpy(), [len(x) for x in places])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(values).view(np.int64)), pa.array(rows),
                     pa.array(np.concatenate(places).astype(np.int32))], names=["head", "h", "at"])

    return _searched(docs, unnamed).selectExpr("xxhash64(doc_id, text) as h", "text").mapInArrow(
        run, "head bigint, h bigint, at int")


def repeated_heads(suffixes: DataFrame) -> DataFrame:
    """``(head)`` of the retained suffixes that have an equal neighbour in sorted order; each once or a few times."""
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        repeated = False

        def rows(values, edge):
            return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([edge] * len(values), pa.bool_())],
                                              names=["head", "edge"])

        for batch in batches:
            values = batch.column(0).to_numpy()
            if not len(values):
                continue
            if last is not None and values[0] == last:
                repeated = True
                yield rows([last], False)
            first = values[0] if first is None else first
            same = values[1:] == values[:-1]
            yield rows(np.unique(values[1:][same]), False)
            last = values[-1]
        if first is not None:
            yield rows([first] if first == last and not repeated else [first, last], True)

    ordered = suffixes.repartitionByRange("head", "h", "at").sortWithinPartitions("head", "h", "at").select("head")
    found = stored(ordered.mapInArrow(neighbours, "head bigint, edge boolean"), "neighbours")
    edges = found.where("edge").groupBy("head").agg(F.count("*").alias("c")).where("c > 1").select("head")
    return found.where("not edge").select("head").union(edges)


def repeated_runs(docs: DataFrame, least: int = LEAST, head: int = HEAD, unnamed: bool = False) -> DataFrame:
    """``(doc_id, h, start)`` of every repeated run."""
    suffixes = stored(retained_suffixes(docs, least, head, unnamed), "suffixes")
    known = BitFilter.build(repeated_heads(suffixes), 25)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                values, places = [], []
                for words in _SPLIT.each(texts_of(batch.column(2))):
                    heads, lowest = _runs(words, least, head)
                    at = np.unique(lowest)
                    wanted = np.zeros(len(heads), bool)
                    wanted[at[known.may_hold(heads[at])]] = True
                    start = np.flatnonzero(wanted[lowest]) if len(lowest) else lowest
                    values.append(window_hashes(words, least)[start])
                    places.append(start)
                own = np.repeat(np.arange(batch.num_rows), [len(x) for x in places])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(values).view(np.int64)), batch.column(0).take(pa.array(own)),
                     batch.column(1).take(pa.array(own)), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["run", "doc_id", "h", "start"])

    runs = stored(_searched(docs, unnamed).selectExpr("doc_id", "xxhash64(doc_id, text) as h", "text").mapInArrow(
        run, f"run bigint, doc_id {kind}, h bigint, start int"), "runs")
    place = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "h", "start")
    firsts = runs.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        "first <> last").select("run", "first")
    return runs.join(firsts, "run").where(place != F.col("first")).select(
        "doc_id", "h", "start")


def repeated_spans(docs: DataFrame, least: int = LEAST, head: int = HEAD, unnamed: bool = False) -> DataFrame:
    """``(doc_id, h, spans)``: maximal repeated spans of each document that has any, as ``[first word, end word)``."""
    starts = repeated_runs(docs, least, head, unnamed).groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set("start")).alias("starts"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = []
            for row in batch.column(2):
                at = np.asarray(row.values)
                new = np.flatnonzero(np.diff(at) > least) + 1
                spans.append([{"first": a[0], "end": a[-1] + least} for a in np.split(at, new)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)],
                                             names=["doc_id", "h", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return starts.mapInArrow(grow, f"doc_id {kind}, h bigint, spans array<struct<first:int,end:int>>")


def without(text: str, spans: list[dict]) -> str:
    """A text without the words of the spans; what stands between kept words stays, joined by a line end at each cut."""
    raw = text.encode()
    starts = np.flatnonzero(np.diff(_SPLIT.apart[np.frombuffer(raw + b" ", np.uint8)].view(np.int8),
                                    prepend=np.int8(1)) == -1).tolist() + [len(raw)]
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at:starts[span["first"]]])
        at = starts[span["end"]]
    kept.append(raw[at:])
    return b"\n".join(x for x in (k.strip(SPACES) for k in kept) if x).decode()


def cut_repeats(docs: DataFrame, least: int = LEAST, head: int = HEAD) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text`` (``n_chars`` follows where it exists). All columns stay.

    A row nothing is left of is dropped: its whole text stands elsewhere. Rows without repeats stay as they are.
    """
    own_id, own_h, own_spans = free_names(docs.columns, "own_id", "own_h", "own_spans")
    spans = stored(repeated_spans(docs, least, head, unnamed=True).toDF(own_id, own_h, own_spans), "spans")
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("doc_id", "text") == F.col(own_h)), "left")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                spans = batch.column(len(names)).to_pylist()
                columns = [batch.column(i) for i in range(len(names))]
                if any(spans):
                    texts = columns[names.index("text")].to_pylist()
                    texts = [without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                    keep = pa.array([not s or bool(t) for t, s in zip(texts, spans, strict=True)])
                    columns[names.index("text")] = pa.array(texts, pa.string())
                    if "n_chars" in names:
                        i = names.index("n_chars")
                        columns[i] = pa.array([len(t) if s else n for t, s, n in zip(
                            texts, spans, columns[i].to_pylist(), strict=True)], columns[i].type)
                    yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)
                else:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*[docs[c] for c in names], own_spans).mapInArrow(cut, docs.schema)


@query("op3_suffixes")
def op3_suffixes(spark, sf_dir):
    """Maximal spans of 50 or more words that stand earlier in ``documents`` too: one row per document that has any."""
    return repeated_spans(table(spark, sf_dir, "documents"), unnamed=True).select("doc_id", "spans")
