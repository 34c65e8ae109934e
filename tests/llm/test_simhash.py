"""SimHash components against all pairs, and the covering code against its definition."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from broadsheet.llm import common, simhash

DOCS = "doc_id long, text string, print long, a string, anchor string"


def plain_print(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    spans = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, width, bits):
    prints = [plain_print(t, width) for _, t in rows]
    own = list(range(len(rows)))

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            own[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if top(j) == top(i) and d is not None]
        out.append((doc, prints[i], min(ids, default=None)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "é É x y z", " ".join(base), " ".join(base).upper()]
    for i in range(60):
        near = list(base)
        near[rng.randrange(len(near))] = f"c{i}"
        texts.append(" ".join(near))
    texts += [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    out = [(i + 3, t) for i, t in enumerate(texts)]
    return out + [out[7], out[7], (None, texts[7]), (None, "lonely one row"), (None, None), (1, texts[20])]


@pytest.mark.parametrize("crowd", [4096, 1])
@pytest.mark.parametrize("bits", [0, 2, 4])
def test_components_equal_all_pairs(spark, rows, bits, crowd):
    if bits == 4 and crowd == 1:
        pytest.skip("the finest code has 680 000 words at four bits")
    docs = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], DOCS).repartition(3)
    got = [(r.doc_id, r.print % 2**64, r.component_id) for r in simhash.simhash_components(docs, 3, bits, crowd).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(plain_components(rows, 3, bits), key=key)


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(none).count() == 0
    named = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(named).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_long_text_is_read_in_pieces(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = simhash.fingerprint(text.encode(), 3)
    monkeypatch.setattr(simhash, "_PIECE", 64)
    assert simhash.fingerprint(text.encode(), 3) == whole == plain_print(text, 3)


def test_every_fingerprint_has_one_home_and_near_ones_visit_it():
    rng = np.random.default_rng(2)
    own = rng.integers(0, 2**64, 300, dtype=np.uint64)
    row, home = simhash.anchors(own, 0)
    assert sorted(row.tolist()) == list(range(300))
    home = dict(zip(row.tolist(), home.tolist(), strict=True))
    for places in [[5], [22, 23], [0, 45], [63, 46], [3, 9]]:
        near = own ^ np.uint64(sum(1 << p for p in places))
        row, anchor = simhash.anchors(near, 2)
        pairs = list(zip(row.tolist(), anchor.tolist(), strict=True))
        assert len(pairs) == len(set(pairs)) and all((i, home[i]) in set(pairs) for i in range(300))


def broadcast_sides(plan):
    """The plans below the broadcasts of a plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return broadcast_sides(plan.executedPlan())
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan.toString()] * (plan.nodeName() == "BroadcastExchange") + [x for p in below for x in broadcast_sides(p)]


@pytest.mark.parametrize("crowd", [4096, 0])
def test_nothing_that_spark_sizes_too_low_is_broadcast(spark, rows, monkeypatch, crowd):
    seen, stored = [], common.stored

    def kept(df, name):
        seen.append(df)
        return stored(df, name)

    monkeypatch.setattr(common, "stored", kept)
    monkeypatch.setattr(simhash, "stored", kept)
    monkeypatch.setattr(simhash, "components", lambda found: common.components(found, 0))
    docs = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], DOCS)
    seen.append(simhash.simhash_components(docs, 3, 2, crowd))
    made = [x for df in seen for x in broadcast_sides(df._jdf.queryExecution().executedPlan())]
    got = [(r.doc_id, r.print % 2**64, r.component_id) for r in seen[-1].collect()]
    assert sorted(got, key=repr) == sorted(plain_components(rows, 3, 2), key=repr)
    assert sum(df.columns == ["u", "v"] for df in seen) > 2
    assert not [x for x in made if re.search(r"MapInArrow|Generate|FileScan parquet \[(u|doc_id)#", x)]
