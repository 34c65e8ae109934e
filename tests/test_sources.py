import json
import os
from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from broadsheet.operators import filters, reports as R
from broadsheet.plans.daily import run_daily
from broadsheet.schemas import ITEMS, RAW_FEEDS, as_items
from broadsheet.sources import entries, feeds, repos, snapshots
from broadsheet.sources.registry import SourceRegistry

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>https://papers.cool/arxiv/2601.00017</id><title>An AI model finds longevity genes in killifish</title>
<updated>2026-02-01T08:00:00+00:00</updated><author><name>Mira</name></author><link href="https://papers.cool/arxiv/2601.00017"/>
<summary>Deep learning over gene maps of ageing fish.</summary></entry>
<entry><id>https://papers.cool/arxiv/2601.00018</id><title>Waiting times in tram networks</title>
<updated>2026-02-01T09:00:00+00:00</updated><author><name>Jonas</name></author><link href="https://papers.cool/arxiv/2601.00018"/>
<summary>Queues of passengers.</summary></entry></feed>"""
RSS = """<rss><channel><item><title>Atlas of AI for longevity drugs</title><link>https://site.example/atlas</link>
<pubDate>Mon, 02 Feb 2026 00:00:00 GMT</pubDate><description><![CDATA[<p>All trials on one page.</p>]]></description>
<media:content url="https://site.example/cover.png" medium="image"/></item><item><title>Entry without address</title></item></channel></rss>"""
DIGEST = """<rss><channel><item><title>2026 02 03 HackerNews</title><link>https://supertechfans.com/cn/post/2026-02-03-HackerNews/</link>
<pubDate>Tue, 03 Feb 2026 06:30:00 +0800</pubDate><description><![CDATA[
<h2 id="1-station">1. 屋顶气象站</h2><p><a href="https://site.example/station">x</a></p><p>传感器与太阳能。</p><hr>
<h2 id="2-clock">2. AI model estimates biological age from blood proteins</h2>
<p><a href="https://site.example/clock">x</a></p><p>A neural network trained on old samples.</p>]]></description></item></channel></rss>"""


def raw(spark, body, name="Feed"):
    return spark.createDataFrame([(name, "https://f", body, datetime(2026, 2, 2))], RAW_FEEDS)


def test_papers_feed_keeps_the_topic(spark):
    rows = feeds.parse_feeds(raw(spark, ATOM, "Papers"), kind="papers")
    item = feeds.unify_feed_items(rows, "paper", F.lit("2026-02-02").cast("date")).collect()
    assert len(item) == 1 and item[0].source == "Papers" and item[0].authors == ["Mira"]
    assert "arxiv.org/pdf/2601.00017" in item[0].details.content_html


def test_rss_media_and_missing_links(spark):
    item = feeds.unify_feed_items(feeds.parse_feeds(raw(spark, RSS)), "news", F.lit("2026-02-02").cast("date")).collect()
    assert len(item) == 1 and item[0].details.image_url == "https://site.example/cover.png"
    assert '<img src="https://site.example/cover.png"' in item[0].details.content_html
    assert item[0].published_at == datetime(2026, 2, 2)


def test_digest_becomes_stories(spark):
    rows = feeds.parse_feeds(raw(spark, DIGEST, "Digest")).collect()
    assert [(r.title, r.link, r.feed_name) for r in rows] == [
        ("AI model estimates biological age from blood proteins", "https://site.example/clock", "Digest")]
    assert rows[0].entry_id.endswith("#2-clock")


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS, encoding="utf8")
    dim = spark.createDataFrame([("a.xml", "A", "https://a", 1)], "file string, name string, url string, ord int")
    rows = feeds.scan_feed_xml(feeds.read_raw_feeds(spark, str(tmp_path), dim)).collect()
    assert [r.feed_name for r in rows] == ["A", "A"] and rows[0].title == "Atlas of AI for longevity drugs"


def test_entry_pages(spark, tmp_path):
    entry = {"entries": {"id": "1", "url": "u", "title": "t", "content": "<p>c</p>", "publishedAt": "2026-01-01T00:00:00Z", "author": "a"},
             "feeds": {"title": "Twitter x"}}
    (tmp_path / "good.json").write_text(json.dumps({"data": [entry]}))
    (tmp_path / "bad.json").write_text("{broken")
    rows = entries.scan_entry_json(entries.read_entry_pages(spark, str(tmp_path), "twitter")).collect()
    assert [(r.id, r.source) for r in rows] == [("1", "twitter-a")]


def test_repositories(spark):
    body = json.dumps({"items": [{"full_name": "lab/aging-clock", "html_url": "https://github.com/lab/aging-clock",
                                  "description": "Small but active", "owner": {"login": "lab"}, "language": "Python", "stargazers_count": 1,
                                  "forks_count": 0, "updated_at": "2026-03-16T00:00:00Z", "pushed_at": "2026-03-16T00:00:00Z"},
                                 {"full_name": "lab/none", "html_url": "https://x", "stargazers_count": "many", "pushed_at": "2026-03-16T00:00:00Z"},
                                 {"full_name": "lab/old", "html_url": "https://y", "stargazers_count": 9, "pushed_at": "2020-03-16T00:00:00Z"}]})
    pages = spark.createDataFrame([(date(2026, 3, 17), body), (date(2026, 3, 17), "{}")], "report_date date, body string")
    rows = filters.repo_activity_filter(repos.scan_repo_search(pages), F.col("report_date"), 1, 240)
    items = repos.unify_repo_items(rows).collect()
    assert [(i.id, i.title, i.description, i.authors) for i in items] == [("1", "lab/aging-clock", "Small but active", ["lab"])]


def item_rows(spark, rows):
    return spark.createDataFrame([(date(2026, 1, d), c, "s", i, f"https://x/{i}", f"title {i}", "", datetime(2026, 1, d), None, [], None, 0, n)
                                  for n, (d, c, i) in enumerate(rows)], ITEMS)


def test_snapshots_replace_and_expire(spark, tmp_path):
    path = str(tmp_path / "snap")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    snapshots.snapshot_write(item_rows(spark, [(1, "news", "a"), (1, "paper", "b"), (2, "news", "c")]), path, at)
    snapshots.snapshot_write(item_rows(spark, [(1, "news", "d")]), path, at)
    day = F.lit("2026-01-01").cast("date")

    def ids(as_of):
        return sorted(r.id for r in snapshots.snapshot_read(spark, path, day, F.lit(as_of).cast("timestamp")).collect())
    assert ids("2026-01-07 23:59:59") == ["b", "d"]
    assert ids("2026-01-08 00:00:00") == []
    plan = snapshots.snapshot_read(spark, path, day, at)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_date" in plan


def test_snapshots_replace_with_nothing(spark, tmp_path):
    path = str(tmp_path / "snap")
    snapshots.snapshot_write(item_rows(spark, [(1, "news", "a"), (1, "paper", "b"), (2, "paper", "c")]), path)
    both = item_rows(spark, [(1, "news", "x"), (1, "paper", "x")])
    snapshots.snapshot_write(item_rows(spark, [(1, "news", "d")]), path, replaced=both)
    assert sorted(r.id for r in snapshots.snapshots(spark, path).collect()) == ["c", "d"]
    snapshots.snapshot_write(both.limit(0), path, replaced=both)
    assert [r.id for r in snapshots.snapshots(spark, path).collect()] == ["c"]


def test_batches_merge_by_identity(spark, tmp_path):
    path = str(tmp_path / "snap")
    for ids in (["a", "a", None], ["b", None], ["b", None]):
        snapshots.snapshot_append(item_rows(spark, [(1, "news", i) for i in ids]), path)
    assert sorted(str(r.id) for r in snapshots.snapshots(spark, path).collect()) == ["None", "a", "b"]


def shown(spark, path):
    return sorted((r.category, r.id, r.title) for r in snapshots.snapshots(spark, path).collect())


def test_a_broken_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    snapshots.snapshot_write(item_rows(spark, [(1, "news", "a"), (1, "paper", "b")]), path)
    before = shown(spark, path)
    commit = snapshots._commit

    def broken(rows, path):
        raise RuntimeError("lost the driver")
    for write in (snapshots.snapshot_write, snapshots.snapshot_append):
        monkeypatch.setattr(snapshots, "_commit", broken)
        with pytest.raises(RuntimeError, match="lost the driver"):
            write(item_rows(spark, [(1, "news", "z")]), path)
        assert shown(spark, path) == before
    monkeypatch.setattr(snapshots, "_commit", commit)
    snapshots.snapshot_append(item_rows(spark, [(1, "news", "c")]), path)
    assert [x[1] for x in shown(spark, path)] == ["a", "c", "b"]


def test_replays_add_nothing_and_stored_files_stay(spark, tmp_path):
    path = str(tmp_path / "snap")

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "snap" / "versions").rglob("*.parquet")}
    for batch, ids in (("0", ["a", "b"]), ("1", ["b", "c"]), ("1", ["b", "c"])):
        old = files()
        snapshots.snapshot_append(item_rows(spark, [(1, "news", i) for i in ids]).withColumn(
            "title", F.concat("title", F.lit(f" of {batch}"))), path, batch=batch)
        assert old.items() <= files().items()
    assert snapshots.manifest(spark, path).count() == 2
    rows = shown(spark, path)
    assert rows == [("news", "a", "title a of 0"), ("news", "b", "title b of 1"), ("news", "c", "title c of 1")]


def test_compaction_keeps_the_rows_and_later_versions_stay_on_top(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    for word in ("x", "y"):
        snapshots.snapshot_append(item_rows(spark, [(1, "news", "a"), (1, "paper", word)]).withColumn(
            "title", F.lit(word)), path)
    add, beside = snapshots._add, []

    def late(*args):
        if not beside:
            beside.append(1)
            snapshots.snapshot_append(item_rows(spark, [(1, "news", "a")]).withColumn("title", F.lit("late")), path)
        add(*args)
    monkeypatch.setattr(snapshots, "_add", late)
    snapshots.snapshot_compact(spark, path)
    want = [("news", "a", "late"), ("paper", "x", "x"), ("paper", "y", "y")]
    assert shown(spark, path) == want
    assert snapshots.snapshot_vacuum(spark, path) == 2
    assert shown(spark, path) == want and snapshots.snapshot_vacuum(spark, path) == 0


def test_registry_checks_the_schema(spark):
    reg = SourceRegistry()
    reg.register("good", "mine", lambda s, p: item_rows(s, [(1, "mine", "a")]), as_items)
    reg.register("gone", "mine", lambda s, p: s.read.parquet(p), as_items)
    assert reg.load(spark, "mine", {"good": "", "gone": "/nowhere"}).count() == 1
    assert reg.load(spark, "news", {}).count() == 0 and reg.categories()[-1] == "mine"
    reg.register("wrong", "mine", lambda s, p: s.range(1), lambda d: d)
    with pytest.raises(ValueError, match="items schema"):
        reg.load(spark, "mine", {"wrong": ""})
    reg.register("typo", "other", lambda s, p: s.range(1).select("no_such_column"), as_items)
    with pytest.raises(AnalysisException):
        reg.load(spark, "other", {"typo": ""})


def test_reports_upsert_is_idempotent(spark, tmp_path):
    path = os.path.join(str(tmp_path), "reports")
    new = spark.createDataFrame([(date(2026, 1, 1), "a", "x"), (date(2026, 2, 1), "b", "y")], "report_date date, file string, content string")
    assert {r.status for r in R.reports_upsert(new, path).collect()} == {"Create"}
    assert {r.status for r in R.reports_upsert(new, path).collect()} == {"Update"}
    more = spark.createDataFrame([(date(2026, 1, 2), "c", "z")], new.schema)
    assert R.reports_upsert(more, path).first().status == "Create"
    assert sorted(r.file for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_rss_document(spark):
    rows = spark.createDataFrame([(date(2026, 1, d), f"t{d}", "/l", "", "<p>x</p> <p>y</p>", datetime(2026, 1, d), 1) for d in (1, 2)],
                                 "report_date date, title string, link string, id string, content_html string, published_at timestamp, ord int")
    xml = R.rss_document(R.rss_view(rows, "https://n"), "Feed", "https://n", "d").first().xml
    assert xml.index("t2") < xml.index("t1") and "<p>x</p><p>y</p>" in xml and "<guid>https://n/l</guid>" in xml


def test_daily_run_stores_fills_and_bundles(spark, tmp_path):
    path = str(tmp_path / "snap")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    snapshots.snapshot_write(item_rows(spark, [(1, "paper", "old"), (9, "news", "n9")]), path, at)
    today = item_rows(spark, [(10, "news", "n9"), (10, "news", "n10")])
    out = run_daily(spark, today, path, "2026-01-10", dedupe_days=3, lookback=9, written_at=at, as_of=at).collect()
    assert len(out) == 1 and out[0].n_items == 2
    assert "title n10" in out[0].prompt and "title old" in out[0].prompt and "title n9" not in out[0].prompt
    stored = snapshots.snapshots(spark, path).filter("report_date = '2026-01-10'").collect()
    assert [r.id for r in stored] == ["n10"]
