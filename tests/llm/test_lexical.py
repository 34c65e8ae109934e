"""Ranked lexical search against a plain scorer over all pairs, and the pruning of its trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from broadsheet.llm import lexical

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    """``(item_id, rank, doc_id, score)`` by the definition."""
    def terms(text):
        return TERM.findall((text or "").translate(LOWER))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        own, scores = terms(text), []
        for doc, tf, n in counted:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(weight[t] * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in own if t in tf)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    def text(n, size=300):
        return " ".join(f"t{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(900)]
    docs += [(900, None), (901, ""), (902, "-- !"), (903, "ÉCOLE École T1"), (904, text(20000)), (None, docs[5][1]),
             (None, docs[5][1]), (5, docs[5][1]), (906, docs[5][1]), (907, "x" * 5000 + " t3")]
    items = [(i, text(rng.randrange(1, 25))) for i in range(40)]
    items += [(40, docs[5][1]), (41, "École t1 t1 T1"), (42, None), (43, "nowhere"), (44, ""), (45, docs[904][1]), (3, "t7"),
              (None, "t9")]
    return docs, items


@pytest.mark.parametrize("k", [1, 20])
def test_equals_all_pairs(spark, corpus, k):
    docs, items = corpus
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n long, score string")
    asked = spark.createDataFrame([(i, t, 2, "y") for i, t in items], "item_id long, text string, item long, doc_id string")
    got = [tuple(r) for r in lexical.ranked(frame.repartition(3), asked, k).collect()]
    assert sorted(got, key=repr) == plain(docs, items, k)


def test_several_passes_and_text_ids(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "QUERY_TERMS", 300)
    frame = spark.createDataFrame([(f"{d:05}", t) for d, t in docs if d is not None], "doc_id string, text string")
    asked = spark.createDataFrame([(str(i), t) for i, t in items[:45]], "item_id string, text string")
    got = [(int(r.item_id), r.rank, int(r.doc_id), r.score) for r in lexical.ranked(frame, asked, 5).collect()]
    assert sorted(got, key=repr) == plain([d for d in docs if d[0] is not None], items[:45], 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.where("false"), items).count() == 0
    assert lexical.ranked(docs, items.where("false")).count() == 0
    assert lexical.ranked(docs.where("false"), items.where("false")).count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_trees_prune_and_lose_nothing(exact):
    rng = np.random.default_rng(4)
    weight = rng.integers(1, 9000, 120)
    items = [(i, np.sort(rng.choice(120, 6, replace=False)), np.ones(6, np.int64)) for i in range(30)]
    block = lexical.ItemBlock(items, weight)
    if not exact:
        block.vectors, block.maxima = block.vectors.astype(np.int64), block.maxima.astype(np.int64)
    vectors = np.zeros((512, len(block.terms)), block.vectors.dtype)
    for row in vectors:
        row[rng.choice(len(block.terms), 5, replace=False)] = rng.integers(1, 10**6, 5)
    best = lexical.Best(30, 3)
    ids = list(range(1000, 1512))
    taken = lexical.search_tree(block, lexical.DocTree(vectors, weight[block.terms]), ids, best)
    assert 0 < taken < 30 * 512 / 2
    scores = (block.vectors @ vectors.T).astype(np.int64)
    for i in range(30):
        want = sorted((-int(s), False, ids[j]) for j, s in enumerate(scores[i]) if s > 0)[:3]
        assert best.held[i] == want
