"""Quality classifier over document statistics.

Random Fourier features of standardised statistics stand for a Gaussian kernel. Every task sums its own part of the
normal equations, the parts are added up block by block, and the ridge solution is taken on the driver (its size is the
number of features, not of rows). Raw scores of a separate fold of the labelled rows are then calibrated by isotonic
regression over a fixed grid.

Inputs of a score are statistics of the text alone. Null texts count as empty; empty texts get a score like all others.
Labels that are null, or whose document is missing, are not used; without any usable label every score is the prior.
Repeated rows give repeated rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, texts_of
from .registry import query
from .words import BLOCK, SPACES, Splitter, mixed

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "symbol", "stop_mark", "high", "entropy",
    "distinct_words", "top_word", "next_same", "no_letter_words", "symbol_tails", "upper_words", "long_words",
    "log_lines", "repeated_lines", "symbol_lines", "upper_lines", "worst_line")
N_FEATURES = 256
WIDTH = 10.0
RIDGE = 1e-3
MAX_LABELLED = 200_000
THRESHOLD = 0.3
GRID = 400
_CLASSES = ("upper", "lower", "digit", "space", "symbol", "stop", "high")
_CLASS = np.full(256, 7, np.uint8)
for _number, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, *range(9, 14)),
                                    b"!#$%&*+/<=>?@\\^_`{|}~[]()", b".,", range(128, 256))):
    _CLASS[list(_members)] = _number
_SPLIT = Splitter(SPACES)


def statistics(texts: list[bytes]) -> np.ndarray:
    """The statistics of each text, all of them bounded; texts are taken in blocks, a long one by itself."""
    rows, block, size = [], [], 0
    for text in texts:
        if block and size + len(text) > BLOCK:
            rows.append(_statistics(block))
            block, size = [], 0
        block.append(text)
        size += len(text)
    return np.vstack([*rows, _statistics(block)]) if block else np.zeros((0, len(STATISTICS)))


def _repeats(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest count of one value, for each of ``n`` groups."""
    key = mixed(value ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, group[first], count)
    return np.bincount(group[first], minlength=n), most


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1)
    sizes = np.diff(stops, prepend=0)
    doc = np.repeat(np.arange(n), sizes)
    kind = _CLASS[buffer]
    table256 = np.bincount(doc * 256 + buffer, minlength=n * 256).reshape(n, 256).astype(float)
    table256[:, 10] -= 1
    total = np.maximum(table256.sum(1), 1)
    share = table256 / total[:, None]
    classes = {name: share[:, _CLASS == i].sum(1) for i, name in enumerate(_CLASSES)}
    part = np.where(share > 0, share, 1)
    hashes, starts, ends = _SPLIT.places(buffer)
    word_doc, m = doc[starts], len(starts)
    words = np.bincount(word_doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    sums = {name: np.concatenate([[0], np.cumsum(kind == _CLASSES.index(name))]) for name in ("upper", "lower", "symbol",
                                                                                            "high")}
    upper, lower, symbol, high = (sums[k][ends] - sums[k][starts] for k in ("upper", "lower", "symbol", "high"))
    length = ends - starts
    shouted = (upper > 0) & (lower == 0) & (length > 1)
    same = np.zeros(m, bool)
    if m:
        same[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    distinct, top = _repeats(word_doc, hashes, n)

    def per_doc(mask):
        return np.bincount(word_doc[mask], minlength=n) / some

    line_ends = np.flatnonzero(buffer == 10)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    full = line_ends > line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc, line_size = doc[line_starts], (line_ends - line_starts).astype(float)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    marks = (sums["symbol"][line_ends] - sums["symbol"][line_starts]) / line_size
    at = np.searchsorted(line_starts, starts, "right") - 1
    line_words = np.maximum(np.bincount(at, minlength=len(line_starts)), 1)
    capital = np.bincount(at[shouted], minlength=len(line_starts)) / line_words
    again = np.bincount(at[same], minlength=len(line_starts)) / line_words
    line_kinds, _ = _repeats(line_doc, _SPLIT.span_hashes(buffer, line_starts, line_ends), n)
    sized = np.maximum(np.bincount(line_doc, line_size, n), 1)
    worst = np.zeros(n)
    np.maximum.at(worst, line_doc, np.maximum(np.minimum(4 * marks, 1), np.maximum(capital, again)))
    out = np.column_stack([
        np.log1p(total), np.log1p(words), np.minimum(total / some, 60), classes["upper"], classes["digit"],
        classes["space"], classes["symbol"], classes["stop"], classes["high"], -(part * np.log(part)).sum(1),
        distinct / some, top / some, per_doc(same), per_doc(upper + lower + high == 0), per_doc(kind[ends - 1] == 4),
        per_doc(shouted), per_doc(length > 25), np.log1p(lines), 1 - line_kinds / np.maximum(lines, 1),
        np.bincount(line_doc, line_size * (marks > 0.08), n) / sized,
        np.bincount(line_doc, line_size * (capital > 0.6), n) / sized, worst])
    out[words == 0] = 0
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, stats array<double>)``, one row per row of ``docs (doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                flat = statistics(texts_of(batch.column("text"))).ravel()
                stats = pa.ListArray.from_arrays(
                    pa.array(np.arange(batch.num_rows + 1) * len(STATISTICS), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], names=["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(STATISTICS))


@dataclass
class Model:
    """Means, spreads, random projection, weights and the calibration steps; a few hundred kilobytes."""

    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.turn + self.phase)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats)) if self.weights is None else self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated score in 0 to 1; a thousandth of the raw score keeps the order within one calibration step."""
        raw = self.raw(stats)
        return 0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-4 * (raw - 0.5)))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the non-decreasing step function nearest to ``y`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for at, value, w in zip(x, y, weight, strict=True):
        blocks.append([value * w, w, at * w])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, n_features: int = N_FEATURES,
        width: float = WIDTH, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Model from ``stats (doc_id, stats)`` and ``labels (doc_id, quality)``; rows of fold 0 are never read.

    Folds 1 to 3 fit the ridge weights, fold 4 the calibration. Beyond ``max_labelled`` labelled ids, those with the
    lowest hashes are used (expected number: ``max_labelled``).
    """
    usable = labels.where("quality is not null and doc_id is not null").where(fold_of("doc_id") > 0)
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("__label"))
    known = usable.count()
    if known > max_labelled:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / known))
    rows = stored(stats.where(fold_of("doc_id") > 0).join(usable, "doc_id")
                  .select("stats", F.col("__label").cast("double").alias("label"), fold_of("doc_id").alias("fold")),
                  "labelled")
    n = len(STATISTICS)
    sums = [F.sum(F.col("stats")[i]) for i in range(n)] + [F.sum(F.col("stats")[i] ** 2) for i in range(n)]
    count, positive, *moments = rows.agg(F.count("*"), F.sum("label"), *sums).first()
    if not count:
        empty = Model(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), None, np.array([0.0]), np.array([0.5]))
        return empty
    mean = np.array(moments[:n]) / count
    spread = np.sqrt(np.maximum(np.array(moments[n:]) / count - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    model = Model(mean, spread, rng.normal(size=(n, n_features)) / width, rng.uniform(0, 2 * np.pi, n_features), None,
                  np.array([0.0]), np.array([positive / count]))
    size, block = n_features + 1, 32

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x, y = model.features(_matrix(batch.column("stats"))), batch.column("label").to_numpy()
                total += x.T @ np.column_stack([x, y])
        if total.any():
            low = list(range(0, size, block))
            yield pa.RecordBatch.from_arrays(
                [pa.array(low, pa.int32()), pa.array([total[i:i + block].tobytes() for i in low], pa.binary())],
                names=["block", "part"])

    def added(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in parts.column("part").to_pylist())
        return pa.table({"block": parts.column("block").slice(0, 1), "part": [total.tobytes()]},
                        schema=pa.schema([("block", pa.int32()), ("part", pa.binary())]))

    schema = "block int, part binary"
    train = rows.where("fold < 4")
    parts = train.mapInArrow(equations, schema).groupBy("block").applyInArrow(lambda t: added(t), schema).collect()
    if not parts:
        return model
    total = np.vstack([np.frombuffer(bytes(p)).reshape(-1, size + 1) for _, p in sorted(parts)])
    lift = ridge * count * np.eye(size)
    lift[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :size] + lift, total[:, size])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.clip(np.round(model.raw(_matrix(batch.column("stats"))) * GRID), -GRID, 2 * GRID)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), batch.column("label")],
                                             names=["place", "label"])

    steps = (rows.where("fold = 4").mapInArrow(raw, "place int, label double").groupBy("place")
             .agg(F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("place").collect())
    if steps:
        model.knots, model.levels = isotonic(np.array([s.place for s in steps]) / GRID, np.array([s.y for s in steps]),
                                             np.array([s.w for s in steps], float))
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)``, one row per row of ``stats``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(_matrix(batch.column("stats"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())],
                                             names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of ``docs (doc_id, text)``, one row per row."""
    stats = stored(with_statistics(docs), "statistics")
    return (scored(stats, fit(stats, labels, **options))
            .select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows whose score is below the threshold; all columns stay.

    The statistics are taken twice, once to fit and once next to the row, so that no text is exchanged.
    """
    fields, names = docs.schema, docs.columns
    model = fit(stored(with_statistics(docs), "statistics"), labels, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                texts = texts_of(batch.column(names.index("text")))
                score = model.score(statistics(texts))
                yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(keep, fields)


@query("op4_quality")
def op4_quality(spark, sf_dir):
    """Quality score of every whole document; labels of the held-out fifth are never read."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
