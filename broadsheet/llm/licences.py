"""Licence scan with a positional index of rare words.

Words of the licence templates are weighted by IDF over all documents. Each template is indexed at its highest-IDF words
with their positions. A file looks up its licence words, rarest first; the postings of a template are intersected by
relative position: words that agree on where the template would start make a candidate. A candidate counts when its
mandatory key phrases stand where the template has them (give or take ``SLACK`` words) and enough of its words are aligned.
Phrases of the base list are templates of their own whose one key phrase must match word by word; every place is found.

Null and empty texts have no words and score 0. The score is the best share of aligned template words, at least 0.5 with a
base phrase. Repeated rows give repeated rows; extra columns are not read. Without documents all weights are equal.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts_of
from .registry import query

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence notices (label, words of the notice, key phrases that must stand in it).
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ("permission to use copy modify",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license v 2 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)
RARE = 4
SLACK = 3
COVER = 0.5
_KEPT = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z count as a-z, all ASCII but letters and digits separates."""
    return text.translate(_KEPT).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]
    base: bool


@dataclass
class Index:
    """Postings of the rare words of all templates: word -> [(template, position)]."""

    templates: list[Template]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    votes: list[int] = field(default_factory=list)
    idf: dict[bytes, float] = field(default_factory=dict)


def templates() -> list[Template]:
    out = []
    for label, text, phrases in [*((b, a, (a,)) for a, b in BASE.items()), *NOTICES]:
        words = text.encode().split()
        keys = []
        for phrase in phrases:
            key = phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            keys.append((at, key))
        out.append(Template(label, words, keys, text in BASE))
    return out


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of documents with each licence word; one small row per word and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            seen[b""] += batch.num_rows
            for text in texts_of(batch.column(0)):
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         names=["word", "c"])

    rows = docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).collect()
    counts = {bytes(r.word): r.c for r in rows}
    return counts.pop(b"", 0), counts


def index_of(docs: DataFrame, rare: int = RARE) -> Index:
    """The index; which words of a template are rare is settled by their document counts over all of ``docs``."""
    index = Index(templates())
    n, counts = document_counts(docs, frozenset(w for t in index.templates for w in t.words))
    idf = {w: log((n + 1) / (counts.get(w, 0) + 0.5)) for t in index.templates for w in t.words}
    index.idf = idf
    for number, template in enumerate(index.templates):
        order = sorted(range(len(template.words)), key=lambda i: (-idf[template.words[i]], i))
        chosen = order[:1] if template.base else order[:rare]
        for at in chosen:
            index.postings[template.words[at]].append((number, at))
        index.votes.append(1 if template.base else min(2, len(chosen)))
    return index


def scan(words: list[bytes], index: Index) -> tuple[int, int | None, int | None, list[str], list[str], float]:
    """Places, first and last start, base labels, all labels and score of one file."""
    if index.postings.keys().isdisjoint(words):
        return 0, None, None, [], [], 0.0
    places = defaultdict(list)
    for at, word in enumerate(words):
        if word in index.postings:
            places[word].append(at)
    votes: Counter[tuple[int, int]] = Counter()
    for word in sorted(places, key=lambda w: (-index.idf[w], w)):
        for number, offset in index.postings[word]:
            votes.update((number, at - offset) for at in places[word])
    starts, base, labels, score = [], set(), set(), 0.0
    for (number, start), count in votes.items():
        if count < index.votes[number]:
            continue
        template = index.templates[number]
        if template.base:
            if start >= 0 and words[start:start + len(template.words)] == template.words:
                starts.append(start)
                base.add(template.label)
        elif all(any(words[p:p + len(key)] == key for p in range(max(0, start + at - SLACK), start + at + SLACK + 1))
                 for at, key in template.keys):
            hit = sum(w == words[start + i] for i, w in enumerate(template.words) if 0 <= start + i < len(words))
            cover = hit / len(template.words)
            if cover >= COVER:
                labels.add(template.label)
                score = max(score, cover)
    if starts:
        score = max(score, 0.5)
    return (len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels | base), score)


def licences(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    index = index_of(docs, rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                rows = []
                for text in texts_of(batch.column(1)):
                    words = words_of(text)
                    rows.append((len(words), *scan(words, index)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]),
                     *(pa.array([",".join(x) for x in c], pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.float64())],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                                "base_labels string, labels string, score double")


@query("op6_licences")
def op6_licences(spark, sf_dir):
    """Licence phrases and notices of every whole document."""
    return licences(table(spark, sf_dir, "documents"))
