"""Landed files, keyword tables, sketches, visitor logs, ordered streams and repeated JSON keys."""

import json
import os
import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.topics import _pattern
from broadsheet.operators import aggregates as A, keywords as K, requests as RQ
from broadsheet.sources import feeds, landed
from broadsheet.streaming import dedupe, views as SV, visitors

RSS = '<rss><channel><item><title>{}</title><link>https://x/{}</link></item></channel></rss>'


def test_landed_feeds_have_a_status(spark, tmp_path):
    files = {
        "utf8.xml": ('<?xml version="1.0" encoding="utf-8"?>' + RSS.format("né", 1)).encode(),
        "latin.xml": ('<?xml version="1.0" encoding="ISO-8859-1"?>' + RSS.format("né", 2)).encode("latin-1"),
        "bom.xml": b"\xef\xbb\xbf" + RSS.format("né", 3).encode(),
        "utf16.xml": RSS.format("né", 4).encode("utf-16"),
        "odd.xml": RSS.format("n", 5).encode("utf-16") + b"x",
        "wrong.xml": RSS.format("né", 6).encode("latin-1"),
        "ascii.xml": b'<?xml version="1.0" encoding="US-ASCII"?>' + RSS.format("né", 7).encode(),
        "other.xml": b'<?xml version="1.0" encoding="KOI7"?>' + RSS.format("n", 8).encode(),
        "cut.xml": RSS.format("n", 9).encode()[:60], "empty.xml": b"", "blank.xml": b" \n\x00", "page.html": b"<html>x</html>"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    scan = landed.landed_feeds(spark, str(tmp_path))
    got = {r.file: (r.status, r.body is not None) for r in scan.collect()}
    want = {n: "ok" for n in ("utf8.xml", "latin.xml", "bom.xml", "utf16.xml")} | {
        n: "bytes" for n in ("odd.xml", "wrong.xml", "ascii.xml")} | {
        "other.xml": "charset", "cut.xml": "truncated", "empty.xml": "empty", "blank.xml": "empty", "page.html": "format"}
    assert got == {n: (s, s == "ok") for n, s in want.items()}
    dim = spark.createDataFrame([(n, n, "u", 0) for n in files], "file string, name string, url string, ord int")
    rows = feeds.scan_feed_xml(landed.feeds_of(scan, dim)).collect()
    assert sorted((r.title, r.link) for r in rows) == [("né", f"https://x/{i}") for i in (1, 2, 3, 4)]


def test_landed_pages_have_a_status(spark, tmp_path):
    good = json.dumps({"data": [{"entries": {"id": "1", "title": "t"}, "feeds": {"title": "f"}}]})
    for name, text in (("good.json", good), ("cut.json", good[:30]), ("list.json", "[1]"), ("none.json", '{"x": 1}'), ("empty.json", "")):
        (tmp_path / name).write_text(text)
    scan = landed.landed_pages(spark, str(tmp_path), "twitter")
    assert {r.file: r.status for r in landed.file_status(scan).collect()} == {
        "good.json": "ok", "cut.json": "truncated", "list.json": "format", "none.json": "format", "empty.json": "empty"}
    assert [r.data[0].entries.id for r in scan.filter("data is not null").collect()] == ["1"]


def test_keyword_table_equals_the_pattern(spark):
    rng = random.Random(4)
    words = ["ai", "gpu", "c++", "长寿", "寿", "-omics", "cell atlas", "x", "é", "a.b", "AI ", "  ", "ai-driven"]
    pieces = ["ai", "maid", "gpu2", "c++", "c+", "长寿", "寿", "multi-omics", "cell", "atlas", " ", ".", "é", "a.b", "axb", "AI", "🙂", "ai-driven"]
    texts = [None, "", *["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(150)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([("k", w) for w in words], "kind string, keyword string")
    got = {(r.id, r.keyword) for r in K.keyword_matches(rows, "id", F.col("text"), table).collect()}
    want = {(i, w.strip().lower()) for i, t in enumerate(texts) for w in words
            if w.strip() and re.search(_pattern([w]), (t or "").lower())}
    assert got == want and len({k for _, k in got}) > 6


def test_fifty_thousand_keywords(spark):
    table = spark.range(50_000).select(F.lit("strong").alias("kind"), F.when(
        F.col("id") % 2 == 0, F.concat(F.lit("word"), "id")).otherwise(F.concat(F.lit("two words "), "id")).alias("keyword"))
    rows = spark.createDataFrame([(1, "a", "word12 x"), (2, "a", "word12x"), (3, "Two Words 77", ""), (4, "", "two words"), (5, None, None)],
                                 "id long, title string, summary string")
    assert sorted(r.id for r in K.topic_filter_table(rows, "id", table).collect()) == [1, 3]


def test_sketches_answer_periods(spark):
    start = datetime(2024, 1, 1, 4)
    visits = spark.range(20_000).select(
        F.lit("home").alias("site"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), F.col("id") % 3000)).alias("visitor"),
        (F.lit(start) + F.make_interval(days=(F.col("id") % 20).cast("int"))).alias("ts"))
    periods = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 1, 20)), ("b", date(2024, 1, 3), date(2024, 1, 3)),
                                     ("c", date(2025, 1, 1), date(2025, 1, 2))], "period string, first_day date, last_day date")
    got = {r.period: (r.pageviews, r.visitors) for r in A.visitors_over(A.visitor_sketches(visits), periods).collect()}
    exact = {"a": visits, "b": visits.filter("date(ts) = '2024-01-03'")}
    assert set(got) == {"a", "b"}
    for name, rows in exact.items():
        n = rows.select("visitor").distinct().filter("visitor is not null").count()
        assert got[name][0] == rows.count() and abs(got[name][1] - n) * 20 <= n


def _events(seed, n=400):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    return [(f"s{rng.randrange(2)}", rng.choice([None, *[f"visitor-{i}" for i in range(9)]]),
             start + timedelta(minutes=rng.randrange(40 * 1440))) for _ in range(n)]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_visitor_log_does_not_depend_on_the_order(spark, tmp_path, order):
    schema = "site string, visitor string, ts timestamp"
    rows = sorted(_events(7), key=lambda r: r[2])
    out, path = str(tmp_path / "log"), str(tmp_path / "in")
    for place in order:
        spark.createDataFrame(rows[place * 100:place * 100 + 100], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        visitors.run_visitor_log(stream, out, out + "-c", every=2).awaitTermination()
    got = visitors.visitor_counts(visitors.visitor_log(spark, out), idle_days=5)
    want = visitors.visitor_counts(A.visitor_days(spark.createDataFrame(rows, schema)), idle_days=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert visitors._bases(spark, out) == [2]


def test_a_broken_fold_is_not_read(spark, tmp_path):
    out = str(tmp_path / "log")
    rows = spark.createDataFrame(_events(3, 50), "site string, visitor string, ts timestamp")
    A.visitor_days(rows).write.parquet(f"{out}/batches/batch_id=0")
    before = visitors.visitor_log(spark, out).count()
    os.makedirs(f"{out}/base/before=1")
    assert visitors.visitor_log(spark, out).count() == before > 0


def test_ordered_dedupe_keeps_the_same_rows_in_any_batches(spark, tmp_path):
    rng, start = random.Random(9), datetime(2024, 1, 1)
    rows = [(f"https://x/{rng.randrange(4)}#{i}", start + timedelta(hours=rng.randrange(24 * 30)), i) for i in range(80)]
    keep, last = [], {}
    for url, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        key = url.split("#")[0]
        if key not in last or ts - last[key] > timedelta(days=7):
            last[key] = ts
            keep.append(i)
    schema = "url string, ts timestamp, row_id long"
    ordered = sorted(rows, key=lambda r: r[1])
    for name, portions in (("one", [rows]), ("three", [ordered[:30], ordered[30:55], ordered[55:]])):
        path, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        ends = dedupe.heartbeat(spark, start + timedelta(days=31), 3)
        for frame in [*[spark.createDataFrame(p, schema) for p in portions], ends]:
            frame.coalesce(1).write.mode("append").parquet(path)
            stream = dedupe.stream_dedupe_ordered(spark.readStream.schema(schema).parquet(path), "row_id", delay="1 hour")
            (stream.writeStream.outputMode("append").foreachBatch(SV.batch_writer(out)).option("checkpointLocation", out + "-c")
             .trigger(availableNow=True).start()).awaitTermination()
        assert sorted(r.row_id for r in spark.read.parquet(out).collect()) == sorted(keep)


def test_the_last_of_repeated_keys_holds(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind < 4:
            return [str(rng.randrange(99)), '"t%d"' % rng.randrange(9), "null", "true"][kind]
        if kind == 4:
            return "[" + ",".join(value(depth - 1) for _ in range(rng.randrange(3))) + "]"
        return "{" + ",".join(f'"{rng.choice("abc")}":{value(depth - 1)}' for _ in range(rng.randrange(5))) + "}"
    texts = [value(3) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, j string")
    got = RQ.with_variant(rows, "j", "v").select("i", F.to_json("v").alias("v")).collect()
    for row in got:
        assert json.loads(row.v if row.v is not None else "null") == json.loads(texts[row.i])
    assert sum(len(re.findall('"a"', t)) > 1 for t in texts) > 10
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
