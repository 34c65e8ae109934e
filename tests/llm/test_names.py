"""Columns of the input that are named like those the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import common, decontaminate, jaccard, quality, sharding, suffixes

NAMES = ["size", "k", "uid", "piece", "shard", "slot", "text_crc32", "row", "at", "own_h", "own_id", "own_n", "own_g", "more",
         "own_spans", "__row", "__h", "__g", "__spans", "__id", "__at", "n", "h", "component", "first", "score", "Row", "c0"]


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(0, long, 0), (1, long + " tail", 1), (2, "a b c d e f g h i j k l", 2), (3, None, 3), (None, "", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mark long")
    for name in NAMES:
        if name.lower() not in [c.lower() for c in frame.columns]:
            frame = frame.withColumn(name, F.col("mark") * 10)
    return frame


@pytest.mark.parametrize("stage", ["jaccard", "suffixes", "decontaminate", "sharding", "quality"])
def test_clashing_names_are_kept(spark, docs, stage):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0), (1, 1)], "doc_id long, quality int")
    out = {"jaccard": lambda: jaccard.one_per_component(docs), "suffixes": lambda: suffixes.cut_repeats(docs),
           "decontaminate": lambda: decontaminate.drop_contaminated(docs, items),
           "sharding": lambda: sharding.sharded(docs, 2), "quality": lambda: quality.drop_rejected(docs, labels)}[stage]()
    extra = ["shard_", "slot_"] if stage == "sharding" else []
    assert out.columns == [*docs.columns, *extra]
    rows = out.collect()
    assert rows and all(r["uid"] == r["__row"] == r["mark"] * 10 for r in rows)
    assert stage != "sharding" or len(rows) == 5


def test_text_ids_are_sharded(spark):
    docs = spark.createDataFrame([(f"id-{i}" if i else None, "x" * i) for i in range(50)], "doc_id string, text string")
    rows = sharding.sharded(docs, 4).collect()
    sizes = [sum(len(r.text) + 1 for r in rows if r.shard == s) for s in range(4)]
    assert len(rows) == 50 and max(sizes) - min(sizes) <= 100


@pytest.mark.parametrize("few", [common.FEW_LINKS, 0])
def test_components_of_a_chain_and_a_star(spark, few):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long"), few).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
