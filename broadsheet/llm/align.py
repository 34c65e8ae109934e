"""Alignment of two tokenizers over whole texts by lockstep vectorised merging.

1. Each text is encoded by both (tokenizer A reads a space and the text, B adds that space itself) and its tokens become
   byte ranges of the same string. Tokens of all documents of a batch lie behind one another, so byte ends grow through
   the batch and every document's end is an end of both sides.
2. Documents are cut into *lanes* at places where a sample of A's ends is also an end of B. One state vector holds the
   two pointers of all lanes. Every step compares the byte ends under both pointers of every lane at once, moves the side
   that is behind, or both where they are equal; equal ends are a cut, which closes the lane's open group and emits the
   group and its links. Finished lanes are compacted away, so a step costs what is still open, and long documents do not
   hold up short ones.
3. A pair of ids is counted once for each document that links it, over all documents. Pairs are looked up in two ways:
   those of the highest counts, at most ``FREQUENT`` of them, in a table that every task gets, all others by a join.

Null and empty texts have no tokens, nor do texts whose tokens, joined, do not give the space and the text again (such as
those with U+2581, which B turns into a space): their numbers are zero and their digest is empty. Repeated rows count as
documents of their own. Rows without doc_id count too. Empty tables give no rows, ids may have any type, extra columns
are not read. A text and its tokens are held by one task; groups with very many links are counted by distinct ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import stored, table, texts_of
from .registry import query

FREQUENT = 1 << 20
LANE = 256
PORTION = 1 << 21
LARGE = 1 << 12


class Tokenizers:
    """The two encoders and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers as public
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): number for token, number in vocab.items() if token not in special}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            raise ValueError(f"{path_a}: ids do not follow the merges")
        self.encode_a = tiktoken.Encoding("a", pat_str=public.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={}).encode_ordinary
        self.a = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.a[number] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b = [self._piece(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.a], np.int64)
        self.length_b = np.array([len(x) for x in self.b], np.int64)

    @staticmethod
    def _piece(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both for each text; none where the joined tokens are not the space and the text."""
        strings = [x.decode() for x in texts]
        for text, string, own_b in zip(texts, strings, self.pieces.encode(strings, num_threads=1), strict=True):
            own_a = self.encode_a(" " + string) if text else []
            whole = b" " + text
            fits = text and all(b"".join([names[i] for i in ids]) == whole
                                for names, ids in ((self.a, own_a), (self.b, own_b)))
            yield (own_a, own_b) if fits else ([], [])


@cache
def tokenizers(path_a: str | None, path_b: str | None) -> Tokenizers:
    import public_tokenizers as public
    return Tokenizers(path_a or public.path("byte_bpe_50k.json"), path_b or public.path("piece_bpe_32k.model"))


def lanes(end_a: np.ndarray, end_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray,
          lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first A token, A token behind the last, first B token)`` of each lane.

    ``docs_a`` and ``docs_b`` hold where each document begins, with the total at the end.
    """
    tried = np.arange(lane - 1, len(end_a), lane)
    place = np.searchsorted(end_b, end_a[tried])
    good = end_b[np.minimum(place, len(end_b) - 1)] == end_a[tried]
    start_a = np.concatenate([docs_a[:-1], tried[good] + 1])
    start_b = np.concatenate([docs_b[:-1], place[good] + 1])
    start_a, first = np.unique(start_a[start_a < len(end_a)], return_index=True)
    start_b = start_b[np.concatenate([docs_a[:-1], tried[good] + 1]) < len(end_a)][first]
    return start_a, np.append(start_a[1:], len(end_a)), start_b


def products(open_a, count_a, open_b, count_b) -> tuple[np.ndarray, np.ndarray]:
    """All A and B tokens of the given groups, paired within each."""
    total = count_a * count_b
    row = np.repeat(np.arange(len(total)), total)
    at = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    return open_a[row] + at // count_b[row], open_b[row] + at % count_b[row]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, starts: tuple[np.ndarray, np.ndarray, np.ndarray],
             large: int = LARGE) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """``(groups, links, large)``: rows ``first A, behind A, first B, behind B`` of all groups, linked token pairs of those
    with up to ``large`` links, and the rows of the others."""
    a, stop, b = (x.astype(np.int64) for x in starts)
    open_a, open_b = a.copy(), b.copy()
    cuts, left, right, rest = [], [], [], []
    while len(a):
        x, y = end_a[a], end_b[b]
        a += x <= y
        b += y <= x
        at = np.flatnonzero(x == y)
        if len(at):
            cut = np.stack([open_a[at], a[at], open_b[at], b[at]])
            open_a[at], open_b[at] = cut[1], cut[3]
            cuts.append(cut)
            count_a, count_b = cut[1] - cut[0], cut[3] - cut[2]
            few = count_a * count_b <= large
            if not few.all():
                rest.append(cut[:, ~few])
                cut, count_a, count_b = cut[:, few], count_a[few], count_b[few]
            one, two = products(cut[0], count_a, cut[2], count_b)
            left.append(one)
            right.append(two)
            going = a < stop
            if not going.all():
                a, b, stop, open_a, open_b = a[going], b[going], stop[going], open_a[going], open_b[going]

    def joined(parts, axis=0, shape=(0,)):
        return np.concatenate(parts, axis) if parts else np.empty(shape, np.int64)

    return joined(cuts, 1, (4, 0)), (joined(left), joined(right)), joined(rest, 1, (4, 0))


def _digits(size: int) -> np.ndarray:
    """Decimal digits of all ids as zero-padded bytes, with a free byte behind."""
    width = len(str(max(1, size - 1)))
    out = np.zeros((size, width + 1), np.uint8)
    numbers = np.arange(size)
    for place in range(width):
        out[:, width - 1 - place] = np.where((numbers >= 10**place) | (place == 0), numbers // 10**place % 10 + 48, 0)
    return out


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray,
                digits: np.ndarray) -> Iterator[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``; ``groups`` in order."""
    number = np.arange(groups.shape[1])
    place_a = np.arange(len(ids_a)) + groups[2][np.repeat(number, groups[1] - groups[0])]
    place_b = np.arange(len(ids_b)) + groups[1][np.repeat(number, groups[3] - groups[2])]
    own = np.empty(len(ids_a) + len(ids_b), np.int64)
    own[place_a], own[place_b] = ids_a, ids_b
    text = digits[own]
    text[:, -1] = 44
    text[place_a[groups[1] - 1], -1] = 124
    text[place_b[groups[3] - 1], -1] = 59
    sizes = np.concatenate([[0], np.cumsum((text != 0).sum(1))])
    flat = text.ravel()
    flat = flat[flat != 0].tobytes()
    for low, high in zip(*(sizes[docs_a + docs_b][s].tolist() for s in (slice(None, -1), slice(1, None))), strict=True):
        yield flat[low:high - 1] if high > low else b""


def aligned_batch(own: Tokenizers, texts: list[bytes], lane: int = LANE, large: int = LARGE) -> list[tuple]:
    """``(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)`` of each text; pairs are ``A id << 32 | B id``."""
    encoded = list(own.encode(texts))
    docs_a, docs_b = (np.cumsum([0, *(len(x[side]) for x in encoded)]) for side in (0, 1))
    ids_a, ids_b = (np.fromiter((i for x in encoded for i in x[side]), np.int64) for side in (0, 1))
    if not len(ids_a):
        return [(0, 0, 0, 0, "", [], [])] * len(texts)
    end_a, end_b = np.cumsum(own.length_a[ids_a]), np.cumsum(own.length_b[ids_b])
    groups, (left, right), rest = lockstep(end_a, end_b, lanes(end_a, end_b, docs_a, docs_b, lane), large)
    groups = groups[:, np.argsort(groups[0])]
    doc_of = np.repeat(np.arange(len(texts)), np.diff(docs_a))
    group_doc = doc_of[groups[0]]
    n_groups = np.bincount(group_doc, minlength=len(texts))
    upto = np.concatenate([[0], np.cumsum((groups[1] - groups[0]) * (groups[3] - groups[2]))])
    edges = np.searchsorted(group_doc, np.arange(len(texts) + 1))
    n_links = np.diff(upto[edges])
    width = len(own.b)
    code, times = np.unique((doc_of[left] * len(own.a) + ids_a[left]) * width + ids_b[right], return_counts=True)
    if rest.shape[1]:
        more, counts = [code], [times]
        for first_a, last_a, first_b, last_b in rest.T.tolist():
            one, n_one = np.unique(ids_a[first_a:last_a], return_counts=True)
            two, n_two = np.unique(ids_b[first_b:last_b], return_counts=True)
            more.append(((doc_of[first_a] * len(own.a) + one)[:, None] * width + two[None, :]).ravel())
            counts.append((n_one[:, None] * n_two[None, :]).ravel())
        code, at = np.unique(np.concatenate(more), return_inverse=True)
        times = np.zeros(len(code), np.int64)
        np.add.at(times, at, np.concatenate(counts))
    a, b = code // width, code % width
    begin = np.searchsorted(a // len(own.a), np.arange(len(texts) + 1)).tolist()
    pair = (a % len(own.a)) << 32 | b
    digits = _digits(max(len(own.a), width))
    out = []
    for i, text in enumerate(group_texts(ids_a, ids_b, groups, docs_a, docs_b, digits)):
        span = slice(begin[i], begin[i + 1])
        out.append((int(docs_a[i + 1] - docs_a[i]), int(docs_b[i + 1] - docs_b[i]), int(n_groups[i]), int(n_links[i]),
                    hashlib.sha256(text).hexdigest() if text else "", pair[span], times[span]))
    return out


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, lane: int = LANE,
            large: int = LARGE) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``: linked id pairs and how often, per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(path_a, path_b)
        for batch in batches:
            texts = texts_of(batch.column(1))
            edges = np.cumsum([0, *map(len, texts)])
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(edges, edges[low] + PORTION, "right")) - 1)
                rows = aligned_batch(own, texts[low:high], lane, large)
                numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                offsets = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.asarray(r[i], np.int64) for r in rows])))
                         for i in (5, 6)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *numbers, pa.array([r[4] for r in rows]), *lists],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                low = high

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
             "pairs array<bigint>, times array<bigint>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, count, best)``: documents that link the pair, and whether no other pair of its A id is in more."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").count(), "pairs")
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return stored(counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def frequent_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Sorted pairs of the highest counts with count and best, ``most`` of them or fewer; and whether these are all."""
    sizes = counts.groupBy(F.length(F.bin("count")).alias("bits")).agg(F.count("*").alias("n")).collect()
    least, total = None, 0
    for bits, n in sorted(((r.bits, r.n) for r in sizes), reverse=True):
        if total + n > most:
            break
        least, total = bits, total + n
    if least is None:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, not sizes
    rows = counts.where(F.length(F.bin("count")) >= least).toArrow()
    pair = rows.column("pair").to_numpy()
    order = np.argsort(pair)
    best = rows.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    return pair[order], rows.column("count").to_numpy()[order], best[order], total == sum(r.n for r in sizes)


NUMBERS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT,
              lane: int = LANE, large: int = LARGE) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row of ``docs (doc_id, text)``."""
    rows = stored(aligned(docs, path_a, path_b, lane, large).withColumn("uid", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    pair, count, best, complete = frequent_pairs(counts, frequent)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[offsets[0]:offsets[-1]]
            times = batch.column("times").flatten().to_numpy()
            offsets = offsets - offsets[0]
            place = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            hit = pair[place] == flat if len(pair) else np.zeros(len(flat), bool)
            factor = np.where(hit, times, 0)
            sums = []
            for values in (best, count):
                upto = np.concatenate([[0], np.cumsum(factor * values[place] if len(pair) else factor)])
                sums.append(pa.array(upto[offsets[1:]] - upto[offsets[:-1]]))
            left = np.concatenate([[0], np.cumsum(~hit)])[offsets]
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~hit])) for x in (flat, times)]
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "uid")]
            yield pa.RecordBatch.from_arrays([*kept, *sums, *rest], names=[
                "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "uid", "n_best", "count_sum", "rest",
                "rest_times"])

    found = rows.mapInArrow(run, f"doc_id {kind}, {NUMBERS}, uid bigint, n_best bigint, count_sum bigint, "
                                 "rest array<bigint>, rest_times array<bigint>")
    if not complete:
        found = stored(found, "looked-up")
        each = found.select("uid", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select(
            "uid", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
        more = each.join(counts, "pair").groupBy("uid").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("count")).alias("more_sum"))
        found = found.join(more, "uid", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
        found = found.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_align")
def op12_align(spark, sf_dir):
    """Alignment of the byte-level and the piece vocabulary over every whole document."""
    return alignment(table(spark, sf_dir, "documents"))
