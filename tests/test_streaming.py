import os
import subprocess
import sys
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from broadsheet.operators.aggregates import clean_visits, rate_limit_decision, visitor_stats_daily, visitor_stats_total
from broadsheet.schemas import RAW_FEEDS
from broadsheet.sources.snapshots import snapshots
from broadsheet.streaming import ingest, state, views as SV

START = datetime(2024, 1, 1, 12)


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def run(spark, make, schema, path, out):
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = (stream.writeStream.outputMode("append").foreachBatch(SV.batch_writer(out)).option("checkpointLocation", out + "-c")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@pytest.fixture
def visits(spark):
    def make(rows):
        return clean_visits(spark.createDataFrame(rows, "site string, visitor string, ts timestamp"))
    return make


def test_visitors_over_batches_equal_batch_job(spark, visits, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    portions = [[("home", f"visitor-{i % 3}", START + timedelta(hours=h + i)) for i in range(9)] for h in (0, 6, 40)]
    for portion in portions:
        land(visits(portion), path)
    everything = visits([r for p in portions for r in p])
    increments = run(spark, state.stream_visitors, everything.schema, path, out)
    got = state.visitor_totals(increments, SV.page_views(everything)).collect()
    assert sum(r.late_views for r in got) == 0
    daily = {(r.site, r.day): (r.pageviews, r.visitors) for r in visitor_stats_daily(everything).collect()}
    assert {(r.site, r.day): (r.pageviews, r.new_daily) for r in got} == daily
    assert sum(r.new_total for r in got) == visitor_stats_total(everything).first().visitors == 3


def test_idle_visitors_count_again_and_timers_fire(spark, visits, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [[("home", "visitor-a", START)], [("home", "visitor-b", START + timedelta(days=5))],
            [("home", "visitor-b", START + timedelta(days=9))], [("home", "visitor-a", START + timedelta(days=20))]]
    for portion in rows:
        land(visits(portion), path)
    schema = visits(rows[0]).schema
    got = run(spark, lambda s: state.stream_visitors(s, idle_days=10), schema, path, out)
    assert got.agg(F.sum("new_total")).first()[0] == 3  # a twice, b once


def test_rate_limit_over_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, "c" if i % 4 else "d", START + timedelta(seconds=i)) for i in range(80)]
    schema = "request_id long, client string, ts timestamp"
    for part in (rows[:30], rows[30:]):
        land(spark.createDataFrame(part, schema), path)
    everything = spark.createDataFrame(rows, schema)
    got = run(spark, lambda s: state.stream_rate_limit(s, 5), everything.schema, path, out)
    want = rate_limit_decision(everything, 5).filter("allowed")
    assert sorted(r.request_id for r in got.collect()) == sorted(r.request_id for r in want.collect())


def test_stream_dedupe_forgets_after_its_days(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "url string, published_at timestamp"
    # Expired keys leave the state at the end of a batch, hence one more batch before the last repeat.
    for day, url in ((0, "https://x/1?ref=a"), (3, "https://x/1"), (30, "https://y/1"), (30, "https://z/1"), (31, "https://x/1")):
        land(spark.createDataFrame([(url, START + timedelta(days=day))], schema), path)
    got = run(spark, SV.stream_dedupe, spark.createDataFrame([], schema).schema, path, out)
    assert sorted(r.norm_url for r in got.collect()) == ["https://x/1", "https://x/1", "https://y/1", "https://z/1"]


def test_daily_views_update_over_batches(spark, visits, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    # 16:00 UTC is local midnight.
    rows = [[("home", "visitor-a", datetime(2024, 1, 1, 15, 59)), ("home", None, datetime(2024, 1, 1, 16, 0))],
            [("home", "visitor-a", datetime(2024, 1, 1, 17, 0))]]
    for portion in rows:
        land(visits(portion), path)
    stream = spark.readStream.schema(visits(rows[0]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    SV.run_daily_views(stream, out, out + "-c").awaitTermination()
    got = {r.day: (r.pageviews, r.anonymous) for r in SV.daily_views(spark, out).collect()}
    assert got == {date(2024, 1, 1): (1, 0), date(2024, 1, 2): (2, 1)}


def test_late_visits_stay_page_views_and_are_counted(spark, visits, tmp_path):
    path, out, views = (str(tmp_path / x) for x in ("in", "out", "views"))
    portions = [[("home", "visitor-a", START + timedelta(days=20))], [("home", "visitor-b", START + timedelta(days=21))],
                [("home", "visitor-c", START), ("home", "visitor-d", START), ("home", None, START)]]
    for portion in portions:
        land(visits(portion), path)
    schema = visits(portions[0]).schema
    increments = run(spark, state.stream_visitors, schema, path, out)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    SV.run_daily_views(stream, views, views + "-c").awaitTermination()
    got = {r.day: (r.pageviews, r.new_total, r.late_views)
           for r in state.visitor_totals(increments, SV.daily_views(spark, views)).collect()}
    assert got == {date(2024, 1, 1): (3, 0, 2), date(2024, 1, 21): (1, 1, 0), date(2024, 1, 22): (1, 1, 0)}


def test_ingest_merges_later_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    body = "<rss><item><title>{0}</title><link>https://x/{0}</link><pubDate>Thu, 01 Jan 2026 00:00:00 GMT</pubDate></item></rss>"
    for name in ("a", "b", "b"):
        land(spark.createDataFrame([(name, "https://f", body.format(name), START)], RAW_FEEDS), path)
    raw = spark.readStream.schema(RAW_FEEDS).option("maxFilesPerTrigger", 1).parquet(path)
    ingest.stream_ingest(raw, out, out + "-c", F.lit("news"), F.lit("2026-01-01").cast("date"), 3).awaitTermination()
    assert sorted(r.id for r in snapshots(spark, out).collect()) == ["https://x/a", "https://x/b"]
    assert os.path.isdir(out)


def test_state_processors_need_no_installed_package(tmp_path):
    from pyspark import cloudpickle
    (tmp_path / "p.bin").write_bytes(cloudpickle.dumps((state.VisitorState(1), state.Admission(2), state._combine)))
    code = "from pyspark import cloudpickle; print(len(cloudpickle.loads(open('p.bin', 'rb').read())))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "3", done.stderr
