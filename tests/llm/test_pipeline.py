"""The stages over a small table: each one's decisions take effect, clean rows stay."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**5)}" for _ in range(120))) for i in range(300)]
    rows += [(300 + i, "!! ".join(f"W{rng.randrange(10**5)}" for _ in range(120))) for i in range(100)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(400, rows[0][1]), (401, rows[1][1] + " tail"), (402, rows[2][1][:300] + " " + passage),
             (403, rows[3][1][:300] + " " + passage), (404, "start " + " ".join(f"b{i}" for i in range(12)) + " " + rows[4][1][:300])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(300)) <= set(out)
    assert not set(range(300, 400)) & set(out)
    assert 400 not in out and 401 not in out and 404 not in out
    assert out[402].n_tokens > out[403].n_tokens > 0
