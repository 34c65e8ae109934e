"""Byte-pair encoding and decoding of whole texts.

Encoding gives exactly what repeated lowest-rank merging gives, in linear time. An Aho-Corasick automaton over all
token strings finds the tokens that start at a place; the encoder takes the longest one that may follow the token
before it, and goes back one token when none may. Whether two tokens may stand side by side is looked up in a
compatibility table, filled from the merge ranks on first use. Decoding gathers token bytes from one blob with an
offset table.

Null and empty texts have no tokens and decode to the empty text. Repeated rows give repeated rows; extra columns of
the input are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import table
from .registry import query

#: Fixed value: how the byte-level vocabulary cuts text before merging, with white space spelled out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKENS = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
              rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
MEMO = 1 << 18
SPAN = 4096


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, number in vocab.items():
            self.tokens[number] = bytes(letters[c] for c in token)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            self.parts[whole] = (a, b, rank)
        self.automaton = ahocorasick.Automaton()
        for number in vocab.values():
            self.automaton.add_word(self.tokens[number].decode("latin-1"), number)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.tokens))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)
        for text, number in self.special.items():
            self.tokens[number] = text.encode()
        lengths = np.fromiter(map(len, self.tokens), np.int64, size)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.find = regex.compile(PRE_TOKENS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                 ) if self.special else None

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge of ``token`` while it forms, each with the rank that takes it up."""
        edge, taken = [], float("inf")
        while True:
            edge.append((token, taken))
            if token not in self.parts:
                return edge[::-1]
            taken = self.parts[token][2]
            token = self.parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` followed by those of ``b`` ends as these two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            left, right = self._edge(a, 1), self._edge(b, 0)
            i = j = 0
            known = True
            while True:
                (x, x_taken), (y, y_taken) = left[i], right[j]
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_taken and rank <= y_taken:
                    known = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= 4 * MEMO:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of one piece."""
        text, n, tokens = piece.decode("latin-1"), len(piece), self.tokens
        spans: dict[int, list[list[int]]] = {}

        def starting(at: int) -> list[int]:
            """Tokens that start at a place, short to long; found for a span of places at a time."""
            span = at // SPAN
            if span not in spans:
                if len(spans) >= 4:
                    del spans[min(spans) if min(spans) != span else max(spans)]
                low = span * SPAN
                here: list[list[int]] = [[] for _ in range(min(SPAN, n - low))]
                for end, token in self.automaton.iter(text, low, min(n, low + SPAN + self.longest)):
                    start = end + 1 - len(tokens[token]) - low
                    if start < len(here):
                        here[start].append(token)
                spans[span] = here
            return spans[span][at - span * SPAN]

        if n == 0:
            return []
        dead = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = []
        at, k = 0, len(starting(0)) - 1
        while at < n:
            choice = starting(at)
            while k >= 0:
                token = choice[k]
                if not dead[at + len(tokens[token])] and (not out or self.compatible(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                at += len(tokens[token])
                if at < n:
                    k = len(starting(at)) - 1
            else:
                dead[at] = 1
                at -= len(tokens[out.pop()])
                k = tried.pop() - 1
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        pick, find = self.memo.__getitem__, self.find
        if self.cut is None:
            return b"".join(map(pick, find(text)))
        parts = self.cut.split(text) if any(s in text for s in self.special) else [text]
        return b"".join(packed([self.special[part]]) if i % 2 else b"".join(map(pick, find(part)))
                        for i, part in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; bytes that are no UTF-8 become the replacement character."""
        numbers, out = np.frombuffer(ids, "<u4").astype(np.int64), []
        for low in range(0, len(numbers), 1 << 16):
            part = numbers[low:low + (1 << 16)]
            starts = self.offsets[part]
            lengths = self.offsets[part + 1] - starts
            shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            out.append(self.blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(out).decode("utf-8", "replace").encode()


def packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class _Memo(dict):
    """Packed ids by piece; emptied when full, so its memory is bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = packed(self.codec.merge(piece.encode()))
        if len(piece) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


_CODECS: dict[str | None, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """The codec of a file, held once per Python worker; None is the public byte-level vocabulary."""
    if path not in _CODECS:
        import public_tokenizers
        _CODECS[path] = Codec(path or public_tokenizers.path("byte_bpe_50k.json"))
    return _CODECS[path]


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)``, one row per row of ``docs (doc_id, text)``.

    ``ids`` is the token sequence. The digests are taken from the packed ids and from the text decoded out of them.
    One narrow pass without any exchange; a task holds one batch of texts and bounded memos.
    """
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                ids = [own.encode(text or "") for text in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                           pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``rows (doc_id, ids)``; null ids give the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(packed(ids or [])).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    """Token counts and digests of every whole document, encoded and decoded again."""
    return encoded(table(spark, sf_dir, "documents"), with_ids=False)
