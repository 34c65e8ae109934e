"""Tables as folders of files, ordered de-duplication of busy addresses, keyword tables that grow and landed files."""

import collections
import random
import time
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from broadsheet.operators import keywords
from broadsheet.queries import scans, streams
from broadsheet.sources import landed
from broadsheet.streaming import dedupe, state, views as SV

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("files", [None, 3])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, files):
    pages = spark.range(30).selectExpr("id AS page_id", "concat('https://x.example/', id % 7, '?ref=', id) AS url", "'' AS html")
    if files:
        pages.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    else:
        pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    got = streams.stream_dedupe(spark, str(tmp_path)).collect()
    assert sorted(r.norm_url for r in got) == [f"https://x.example/{i}" for i in range(7)]
    counts = {r.kind: r.n for r in streams.stream_late_rows(spark, str(tmp_path)).collect()}
    assert counts["seen"] == 30 and counts["kept"] + counts["excluded"] == 30


def keep(rows, days=7):
    """Ids of the rows that the rule keeps, by a plain loop."""
    out, last = [], {}
    for url, ts, number in sorted(rows, key=lambda r: (r[1], r[2])):
        if url not in last or ts - last[url] > timedelta(days=days):
            last[url] = ts
            out.append(number)
    return sorted(out)


def run_ordered(spark, tmp_path, portions, last):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "url string, ts timestamp, row_id long"
    for frame in [*[spark.createDataFrame(p, schema) for p in portions], dedupe.heartbeat(spark, last, 30)]:
        frame.coalesce(1).write.mode("append").parquet(path)
        stream = dedupe.stream_dedupe_ordered(spark.readStream.schema(schema).parquet(path), "row_id", delay="3 days")
        (stream.writeStream.outputMode("append").foreachBatch(SV.batch_writer(out)).option("checkpointLocation", out + "-c")
         .trigger(availableNow=True).start()).awaitTermination()
    return sorted(r.row_id for r in spark.read.parquet(out).collect())


def test_a_busy_address_is_deduplicated_in_time(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"https://x/{rng.randrange(2)}", START + timedelta(seconds=rng.randrange(30 * 86400)), i) for i in range(40_000)]
    begun = time.monotonic()
    assert run_ordered(spark, tmp_path, [rows], START + timedelta(days=31)) == keep(rows)
    assert time.monotonic() - begun < 90


def test_ordered_dedupe_of_many_batches_with_equal_times(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"https://x/{rng.randrange(3)}", START + timedelta(minutes=rng.randrange(45 * 24) * 60), i) for i in range(3000)]
    rng.shuffle(rows)
    # A row may land up to three days after its time.
    landed = [(r, r[1] + timedelta(hours=rng.randrange(71))) for r in rows]
    portions = [[r for r, at in landed if (at - START).days // 8 == k] for k in range(6)]
    got = run_ordered(spark, tmp_path, [p for p in portions if p], START + timedelta(days=60))
    assert got == keep(rows) and len(got) > 12


def test_visitors_share_state_keys_and_expire_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "VISITOR_BUCKETS", 1)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "site string, visitor string, ts timestamp"
    days = {"a": (0, 20, 29), "b": (5, 9, 21), "c": (9, 10, 40), "d": (30, 39, 41)}
    visits = sorted((START + timedelta(days=d), v) for v, some in days.items() for d in some)
    for ts, visitor in visits:
        spark.createDataFrame([("home", visitor, ts)] * 2, schema).coalesce(1).write.mode("append").parquet(path)
        stream = state.stream_visitors(spark.readStream.schema(schema).parquet(path), idle_days=10)
        (stream.writeStream.outputMode("append").foreachBatch(SV.batch_writer(out)).option("checkpointLocation", out + "-c")
         .trigger(availableNow=True).start()).awaitTermination()
    got = spark.read.parquet(out).selectExpr("sum(pageviews)", "sum(new_total)", "sum(new_daily)", "count(*)").first()
    # New in total: a twice, b twice, c twice, d once.
    assert tuple(got) == (24, 7, 12, 12)


def test_keywords_that_share_pieces_make_few_candidates(spark):
    table = spark.range(60_000).selectExpr("'strong' AS kind", "concat('q', id, '-q z') AS keyword").unionByName(
        spark.createDataFrame([("ai", "c++"), ("ai", "de la"), ("bio", "of the"), ("bio", "🙂?"), ("ai", "x?"), ("bio", "stem-cell atlas")],
                              "kind string, keyword string"))
    texts = [f"report {i} q {i + 7} -q z {i * 31} 12345678" for i in range(3000)] + [
        "Q77-q z", "q77 -q z", "c++ of the", "hôtel de la mer", "🙂🙂?", "x🙂", "the stem-cell atlas", "stem-cell atlasses", "stem-cell", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = ["q77-q z", "c++", "de la", "of the", "🙂?", "x?", "stem-cell atlas"]
    want = {(i, w) for i, t in enumerate(texts) for w in words if w in (t or "").lower()}
    begun = time.monotonic()
    got = [(r.id, r.keyword) for r in keywords.keyword_matches(rows, "id", F.col("text"), table).collect()]
    assert set(got) == want and len(got) == len(want) == 7
    assert time.monotonic() - begun < 60
    anchors = keywords.keyword_anchors(table.select("keyword").distinct(), rows.selectExpr("id AS _row", "lower(coalesce(text, '')) AS _text"))
    assert anchors.filter("keyword LIKE 'q%-q z'").groupBy("anchor").count().agg({"count": "max"}).first()[0] <= 1200


def landed_pages(spark, path, n):
    """Pages of which every tenth comes twice; odd ones have a title that Latin-1 does not have."""
    rows = spark.range(n).selectExpr(
        "id AS page_id", "concat('https://x.example/', id) AS url",
        "concat('<title>', if(id % 2 = 1, '\u957f\u5bff', 'caf\u00e9'), ' ', id, '</title>\n<p>x</p>') AS html")
    rows.unionByName(rows.filter("page_id % 10 = 0")).write.parquet(str(path / "pages.parquet"))
    return str(path)


def test_landed_files_share_folders_and_are_written_by_all_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "work_path", lambda spark, name: str(tmp_path / name))
    got = collections.Counter(r.status for r in scans._landed(spark, landed_pages(spark, tmp_path, 700)).collect())
    files = [p.relative_to(tmp_path / "landed-feeds") for p in (tmp_path / "landed-feeds").rglob("part-*")]
    assert len(files) == 700 and got == {"ok": 400, "truncated": 100, "empty": 100, "charset": 100}
    cores = spark.sparkContext.defaultParallelism
    for kind, n in (("utf8", 650), ("latin", 50)):
        mine = [p for p in files if p.parts[0] == kind]
        # One task per folder: a folder moves as a whole.
        writers = {p.parent.name: {q.name.split("-")[1] for q in mine if q.parent == p.parent} for p in mine}
        assert len(mine) == n and len(writers) == cores and all(len(w) == 1 for w in writers.values())
        assert len(set.union(*writers.values())) == cores


def test_landed_files_of_repeated_pages_are_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "work_path", lambda spark, name: str(tmp_path / name))
    rows = scans.scan_landed_feeds(spark, landed_pages(spark, tmp_path, 70)).collect()
    got = collections.Counter(r.link for r in rows if "Archive" not in r.title)
    assert got == {f"https://x.example/{i}": 1 + (i % 10 == 0) for i in range(70) if i % 7 not in (1, 2, 3)}
    repeated = [p.parts[-3] for p in (tmp_path / "landed-feeds").rglob("part-*") if p.read_bytes().count(b"<?xml") == 2]
    assert sorted(repeated) == ["latin"] + ["utf8"] * 5


def test_names_of_landed_files_are_not_asked_for_one_by_one(spark, tmp_path, monkeypatch):
    def asked(frame):
        raise AssertionError("one call per name")
    names = ["a,b.xml", "c d+e.xml", "100%.xml", "f\ng.xml", "\u957f.xml"]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(b"" if k % 2 else b"<rss></rss>")
    (tmp_path / "none").mkdir()
    monkeypatch.setattr(type(spark.range(0)), "inputFiles", asked)
    got = {r.file: r.status for r in landed.landed_feeds(spark, str(tmp_path)).collect()}
    assert {n: s for n, s in got.items() if s == "empty"} == {n: "empty" for n in names[1::2]} and len(got) == 5
    assert landed.landed_feeds(spark, str(tmp_path / "none")).collect() == []
