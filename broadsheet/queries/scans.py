"""Sources, sinks and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import shanghai_date
from ..functions.html import build_content_html, has_media
from ..operators import filters, reports as R, texts
from ..operators.aggregates import latest_report_per_date
from ..operators.joins import selection_parse
from ..operators.ordering import first_n
from ..session import work_path
from ..operators import keywords
from ..sources import entries, feeds, landed, repos, snapshots
from ..sources.registry import SourceRegistry, union_sources
from . import sqltext as Q, views as V
from .registry import query

ISO = "yyyy-MM-dd HH:mm:ss"


def day(c="report_date"):
    return F.date_format(c, "yyyy-MM-dd")


def stamp(c="published_at"):
    return F.date_format(c, ISO)


@query("scan_feed_xml", f"""WITH {V.FEED_ROWS_SQL}
SELECT feed_name, feed_url, is_atom, item_ord, title, summary, link, authors, image_url,
  strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM feed_rows""")
def scan_feed_xml(spark, sf):
    rows = feeds.scan_feed_xml(V.raw_feeds(spark, sf))
    return rows.select("feed_name", "feed_url", "is_atom", F.col("item_ord").cast("int").alias("item_ord"), "title", "summary", "link",
                       F.array_join("authors", "|").alias("authors"), "image_url", stamp().alias("published_at"))


@query("scan_entry_json", f"""WITH {V.ENTRY_ROWS_SQL}
SELECT page_id, kind, item_ord, id, url, title, content, published_raw, author, source,
  strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM entry_rows""")
def scan_entry_json(spark, sf):
    rows = entries.scan_entry_json(entries.parse_entry_pages(V.entry_pages(spark, sf)))
    return rows.select("page_id", "kind", F.col("item_ord").cast("int").alias("item_ord"), "id", "url", "title", "content", "published_raw",
                       "author", "source", stamp().alias("published_at"))


@query("scan_repo_search", f"""WITH {V.REPO_ROWS_SQL}
SELECT page_id, item_ord, name, url, description, owner, language, total_stars, forks, stars_today,
  strftime(last_activity_at, '%Y-%m-%d %H:%M:%S') AS last_activity_at FROM repo_rows""")
def scan_repo_search(spark, sf):
    rows = repos.scan_repo_search(V.repo_pages(spark, sf))
    return rows.select("page_id", F.col("item_ord").cast("int").alias("item_ord"), "name", "url", "description", "owner", "language",
                       "total_stars", "forks", "stars_today", stamp("last_activity_at").alias("last_activity_at"))


def _stored(spark, sf, name):
    path = work_path(spark, name)
    snapshots.snapshot_write(V.items(spark, sf), path, V.published_stamp())
    return path


@query("snapshot_write", f"""WITH {V.ITEMS_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, category, id,
  CASE WHEN category = 'news' THEN 'again ' || title ELSE title END AS title FROM items
WHERE category <> 'paper' OR day(report_date) % 2 = 0""")
def snapshot_write(spark, sf):
    """All items, then the news partitions once more: only those are replaced. Papers come out empty on odd days."""
    path = _stored(spark, sf, "snapshots")
    again = V.items(spark, sf).filter("category = 'news'").withColumn("title", V.text("again ", F.col("title")))
    snapshots.snapshot_write(again, path, V.published_stamp())
    papers = V.items(spark, sf).filter("category = 'paper'")
    snapshots.snapshot_write(papers.filter(F.dayofmonth("report_date") % 2 == 0), path, V.published_stamp(), papers)
    return snapshots.snapshots(spark, path).select(day().alias("report_date"), "category", "id", "title")


@query("snapshot_compact", f"""WITH {V.ITEMS_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, category, id,
  CASE WHEN item_ord % 6 = 0 THEN 'third ' WHEN item_ord % 2 = 0 THEN 'second ' ELSE '' END || title AS title FROM items""")
def snapshot_compact(spark, sf):
    """All items, then every second and every sixth one delivered anew; versions are merged between and after."""
    path, items = _stored(spark, sf, "snapshots"), V.items(spark, sf)
    for word, step in (("second ", 2), ("third ", 6)):
        again = items.filter(F.col("item_ord") % step == 0).withColumn("title", V.text(word, F.col("title")))
        snapshots.snapshot_append(again, path, V.published_stamp(), batch=word)
        snapshots.snapshot_compact(spark, path)
    snapshots.snapshot_vacuum(spark, path)
    return snapshots.snapshots(spark, path).select(day().alias("report_date"), "category", "id", "title")


@query("snapshot_read", f"""WITH {V.ITEMS_SQL}
SELECT category, id, title FROM items
WHERE report_date = DATE '2024-01-05' AND published_at + INTERVAL 7 DAY > TIMESTAMP '2024-01-12 00:00:00'""")
def snapshot_read(spark, sf):
    path = _stored(spark, sf, "snapshots")
    rows = snapshots.snapshot_read(spark, path, F.lit("2024-01-05").cast("date"),
                                   as_of=F.lit("2024-01-12 00:00:00").cast("timestamp"))
    return rows.select("category", "id", "title")


@query("snapshot_range", f"""WITH {V.ITEMS_SQL}
SELECT 'previous' AS kind, strftime(report_date, '%Y-%m-%d') AS report_date, category, id FROM items
WHERE report_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-08'
UNION ALL SELECT 'ending', strftime(report_date, '%Y-%m-%d'), category, id FROM items
WHERE report_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'""")
def snapshot_range(spark, sf):
    path = _stored(spark, sf, "snapshots")
    date, now = F.lit("2024-01-09").cast("date"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    parts = [snapshots.snapshot_range(spark, path, date, 7, today, as_of=now).select(
        F.lit(kind).alias("kind"), day().alias("report_date"), "category", "id")
        for kind, today in (("previous", False), ("ending", True))]
    return parts[0].unionByName(parts[1])


@query("reports_upsert", f"""WITH {V.REPORTS_SQL},
files AS (SELECT report_date, strftime(report_date, 'daily/%Y-%m-%d.md') AS file, count(*) AS n FROM reports GROUP BY ALL)
SELECT file, 'Create' AS status, sha256('first ' || n) AS hash, 1 AS run FROM files WHERE month(report_date) <= 6
UNION ALL SELECT file, CASE WHEN month(report_date) <= 6 THEN 'Update' ELSE 'Create' END, sha256('second ' || n), 2
FROM files WHERE month(report_date) >= 6
UNION ALL SELECT file, 'Stored', sha256(CASE WHEN month(report_date) >= 6 THEN 'second ' ELSE 'first ' END || n), 3 FROM files""")
def reports_upsert(spark, sf):
    """First half of each year, then its second half with June again; statuses and the stored table."""
    path = work_path(spark, "reports")
    files = V.reports(spark, sf).groupBy("report_date").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "file", F.concat(F.lit("daily/"), day(), F.lit(".md")))

    def run(word, keep):
        return R.reports_upsert(files.filter(keep).select(
            "report_date", "file", F.concat(F.lit(word), F.col("n").cast("string")).alias("content")), path)

    first = run("first ", F.month("report_date") <= 6).select("file", "status", "hash", F.lit(1).alias("run"))
    second = run("second ", F.month("report_date") >= 6).select("file", "status", "hash", F.lit(2).alias("run"))
    stored = spark.read.parquet(path).select("file", F.lit("Stored").alias("status"), "hash", F.lit(3).alias("run"))
    return first.unionByName(second).unionByName(stored)


LATEST_SQL = """latest AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY report_date
  ORDER BY published_at DESC, ord) = 1)"""


@query("rss_view", f"""WITH {V.REPORTS_SQL}, {LATEST_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, coalesce(nullif(title, ''), '无标题') AS title,
  'https://news.example.org' || link AS link, coalesce(nullif(id, ''), 'https://news.example.org' || link) AS guid,
  strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') AS pub_date,
  {Q.trim(Q.sub('content_html', '>' + Q.SPACE + '+<', '><'))} AS content,
  substr({Q.strip_html('content_html')}, 1, 200) AS description FROM latest""")
def rss_view(spark, sf):
    view = R.rss_view(V.reports(spark, sf), "https://news.example.org")
    return view.withColumn("report_date", day())


@query("report_index", f"""WITH {V.REPORTS_SQL},
names AS (SELECT DISTINCT strftime(report_date, '%Y-%m-%d') AS name FROM reports),
weeks AS (SELECT DISTINCT isoyear(report_date) || '-week-' || lpad(CAST(week(report_date) AS VARCHAR), 2, '0') AS name FROM reports)
SELECT substr(name, 1, 7) AS section, count(*) AS n_reports,
  string_agg('- [' || substr(name, 6, 5) || '-日刊](daily/' || name || '.md)', chr(10) ORDER BY name DESC) AS lines,
  CASE WHEN max(name) = (SELECT max(name) FROM names) THEN max(name) END AS today FROM names GROUP BY 1
UNION ALL SELECT '深度周报', count(*), string_agg('- [' || name || '](blog/' || name || ')' , chr(10) ORDER BY name DESC), NULL
FROM (SELECT name || '.md' AS file, name FROM weeks) HAVING count(*) > 0""".replace(
    "'](blog/' || name || ')'", "'](blog/' || file || ')'"))
def report_index(spark, sf):
    dates = V.reports(spark, sf).select("report_date").distinct()
    iso_year = F.expr("extract(YEAROFWEEK FROM report_date)")
    weeks = dates.select(F.concat(iso_year.cast("string"), F.lit("-week-"),
                                  F.lpad(F.weekofyear("report_date").cast("string"), 2, "0")).alias("name"))
    return R.report_index(dates.select(day().alias("name")).unionByName(weeks))


@query("unify_feed_items", f"""WITH {V.FEED_ROWS_SQL}
SELECT strftime(CAST(published_at + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d') AS report_date, category, feed_name AS source, link AS id, link AS url, title,
  {Q.strip_html('summary')} AS description, authors,
  CASE WHEN image_url <> '' THEN '<p><img src="' || image_url || '" alt="' || replace(replace(replace(replace(replace(title,
    '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') || '"></p>' ELSE '' END || '<p>' || summary || '</p>' AS content_html,
  feed_url, image_url, item_ord * 1000 AS item_ord
FROM feed_rows JOIN (SELECT page_id, category FROM pages_v) USING (page_id)""")
def unify_feed_items(spark, sf):
    kinds = V.pages(spark, sf).select(V.text("https://feeds.example.org/", F.col("page_id")).alias("feed_url"), "category")
    rows = feeds.parse_feeds(V.raw_feeds(spark, sf)).join(kinds, "feed_url")
    items = feeds.unify_feed_items(rows, F.col("category"), shanghai_date("published_at"))
    return items.select(day().alias("report_date"), "category", "source", "id", "url", "title", "description",
                        F.array_join("authors", "|").alias("authors"), "details.content_html", "details.feed_url",
                        "details.image_url", F.col("item_ord").cast("int").alias("item_ord"))


@query("unify_entry_items", f"""WITH {V.ENTRY_ROWS_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, source, id, url, title, {Q.strip_html('content')} AS description,
  coalesce(author, '') AS authors, content AS content_html, published_raw FROM entry_rows""")
def unify_entry_items(spark, sf):
    rows = entries.scan_entry_json(entries.parse_entry_pages(V.entry_pages(spark, sf)))
    items = entries.unify_entry_items(rows, "news", F.col("report_date"))
    return items.select(day().alias("report_date"), "source", "id", "url", "title", "description",
                        F.array_join("authors", "|").alias("authors"), "details.content_html", "published_raw")


@query("unify_repo_items", f"""WITH {V.REPO_ROWS_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, CAST(row_number() OVER (PARTITION BY report_date ORDER BY page_id, item_ord) AS VARCHAR) AS id,
  url, name AS title, description, owner AS authors, language, CAST(total_stars AS BIGINT) AS total_stars,
  strftime(last_activity_at, '%Y-%m-%d %H:%M:%S') AS published_at, 'GitHub Trending' AS source FROM repo_rows""")
def unify_repo_items(spark, sf):
    rows = repos.scan_repo_search(V.repo_pages(spark, sf))
    items = repos.unify_repo_items(rows, order=("page_id", "item_ord"))
    return items.select(day().alias("report_date"), "id", "url", "title", "description",
                        F.array_join("authors", "|").alias("authors"), "details.language", "details.total_stars",
                        stamp().alias("published_at"), "source")


@query("unify_paper_items", f"""WITH {V.ENTRY_ROWS_SQL}
SELECT id, url, CASE WHEN page_id % 3 = 0 THEN '译 ' || title ELSE title END AS title, {Q.strip_html('content')} AS description,
  coalesce(replace(author, ', ', '|'), '') AS authors, source, 'paper' AS category FROM entry_rows""")
def unify_paper_items(spark, sf):
    rows = entries.scan_entry_json(entries.parse_entry_pages(V.entry_pages(spark, sf))).withColumn(
        "title_zh", F.when(F.col("page_id") % 3 == 0, V.text("译 ", F.col("title"))).otherwise(""))
    items = entries.unify_paper_items(rows, F.col("report_date"))
    return items.select("id", "url", "title", "description", F.array_join("authors", "|").alias("authors"), "source",
                        "category")


@query("require_title_link", f"""WITH {V.PAGES_SQL},
cut AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE title END AS title, CASE WHEN page_id % 5 = 0 THEN NULL ELSE url END AS link FROM pages_v)
SELECT * FROM cut WHERE title <> '' AND link IS NOT NULL AND link <> ''""")
def require_title_link(spark, sf):
    return filters.require_title_link(V.pages(spark, sf).select(
        "page_id", F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(F.col("page_id") % 5 > 0, F.col("url")).alias("link")))


@query("recency_filter", f"""WITH {V.ITEMS_SQL}, dates AS (SELECT DISTINCT report_date AS run_date FROM items)
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at
FROM dates JOIN items ON published_at >= CAST(run_date AS TIMESTAMP) + INTERVAL 16 HOUR - INTERVAL 1 MILLISECOND - INTERVAL 3 DAY
  AND published_at <= CAST(run_date AS TIMESTAMP) + INTERVAL 16 HOUR - INTERVAL 1 MILLISECOND""")
def recency_filter(spark, sf):
    rows = filters.recency_for_dates(V.items(spark, sf), V.run_dates(spark, sf), "published_at", 3)
    return rows.select(day("run_date").alias("run_date"), "id", stamp().alias("published_at"))


# Keywords that occur in the tables' invented prose.
TOPICS = {"ai": ("the", "et", "und"), "bio": ("en", "on", "of the"), "strong": ("with", "de la")}


def _keyword_sql(words):
    parts = [rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)" if w.isalnum() else w for w in words]
    return Q.has("t", "|".join(parts))


@query("topic_filter", f"""SELECT doc_id FROM (SELECT doc_id, lower(source || chr(10) || text) AS t FROM documents)
WHERE ({_keyword_sql(TOPICS['ai'])} AND {_keyword_sql(TOPICS['bio'])}) OR {_keyword_sql(TOPICS['strong'])}""")
def topic_filter(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("summary"))
    return filters.topic_filter(docs, **TOPICS).select("doc_id")


@query("topic_filter_table", f"""SELECT doc_id FROM (SELECT doc_id, lower(source || chr(10) || text) AS t FROM documents)
WHERE ({_keyword_sql(TOPICS['ai'])} AND {_keyword_sql(TOPICS['bio'])}) OR {_keyword_sql(TOPICS['strong'])}""")
def topic_filter_table(spark, sf):
    """The same lists as a table among three keywords per part that no text has."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("summary"))
    lists = spark.createDataFrame([(k, w) for k, words in TOPICS.items() for w in words], "kind string, keyword string")
    unused = V.table(spark, sf, "part").select(F.explode(F.array(*[F.lit(k) for k in TOPICS])).alias("kind"), F.concat(
        F.lit("zq"), F.col("p_partkey").cast("string"), F.lit("-q z")).alias("keyword"))
    return keywords.topic_filter_table(docs, "doc_id", lists.unionByName(unused)).select("doc_id")


LANDED_SQL = V.FEED_ROWS_SQL + """,
landed AS (SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'truncated' WHEN 2 THEN 'empty' WHEN 3 THEN 'charset' ELSE 'ok' END AS status,
  strip_accents(title) = title AND NOT regexp_matches(title, '[^\\x00-\\x{FF}]') AS plain FROM pages_v)"""


# Fixed value: how many landed files a folder holds on average; of fewer files, every core writes a folder.
FILES_PER_FOLDER = 500
# Hadoop's settings for writing to local disks without a checksum file beside every file; other stores have their own.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _landed(spark, sf):
    """Feed files as they land: Latin-1 or UTF-8 with a declaration, broken off, empty, or with an unknown character set."""
    path = work_path(spark, "landed-feeds")
    rows = V.raw_feeds(spark, sf).withColumn("page_id", F.regexp_extract("feed_url", r"(\d+)$", 1).cast("long"))
    k, body = F.col("page_id") % 7, F.col("body")
    latin = (k == 4) & ~body.rlike("[^\\x00-\u00FF]")
    declared = F.concat(F.lit('<?xml version="1.0" encoding="'), F.when(k == 3, "KOI7").when(latin, "ISO-8859-1").otherwise(
        "UTF-8"), F.lit('"?>'), body)
    content = F.when(k == 1, F.substring(declared, 1, 200)).when(k == 2, "").otherwise(declared)
    rows = rows.select("page_id", latin.alias("latin"), content.alias("value"))
    # A folder holds some hundred files and is written by one task, so that it is moved and listed as a whole.
    folders = max(spark.sparkContext.defaultParallelism, -(-V.table(spark, sf, "pages").count() // FILES_PER_FOLDER))

    def one_file_each(part, between):
        """One row per page and so one file; what repeats a page stands in the same file."""
        joined = F.array_join(F.array_sort(F.collect_list("value")), between)
        return part.repartition(folders, "page_id").groupBy("page_id").agg(joined.alias("value")).select(
            F.pmod(F.hash("page_id"), F.lit(folders)).alias("folder"), "value").write.partitionBy("folder").options(
                maxRecordsPerFile=1, **PLAIN_LOCAL)

    one_file_each(rows.filter(~F.col("latin")), "\n").text(f"{path}/utf8")
    # Only the CSV writer has other character sets; one column without line ends and quotes is plain text.
    one_file_each(rows.filter("latin").withColumn("value", F.regexp_replace("value", "[\\r\\n]", " ")), " ").options(
        encoding="ISO-8859-1", quote="", sep="\u0001").csv(f"{path}/latin")
    return landed.landed_feeds(spark, path)


@query("scan_landed_status", f"""WITH {LANDED_SQL} SELECT status, count(*) AS n FROM landed GROUP BY 1""")
def scan_landed_status(spark, sf):
    """How many landed files are good, and what is wrong with the others."""
    return landed.file_status(_landed(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("scan_landed_feeds", f"""WITH {LANDED_SQL}
SELECT is_atom, item_ord, title, link FROM feed_rows JOIN landed USING (page_id) WHERE status = 'ok'""")
def scan_landed_feeds(spark, sf):
    """The entries of the good files."""
    good = _landed(spark, sf).filter("status = 'ok'").select(
        F.col("file").alias("feed_name"), F.lit("").alias("feed_url"), "body", "fetched_at")
    return feeds.scan_feed_xml(good).select("is_atom", F.col("item_ord").cast("int").alias("item_ord"), "title", "link")


def digests(spark, sf):
    """Pages as digest entries with four sections each."""
    p = V.pages(spark, sf)
    page = V.text("https://supertechfans.com/cn/post/", day("report_date"), "-HackerNews/", F.col("page_id"))
    summary = V.text(
        '<h2 id="one">1. ', F.col("title"), ' #</h2><p><a href="', F.col("url"), '">x</a> about biological age</p><hr>',
        '<h2 id="two">2. Router</h2><p>No link on ageing, only a transformer</p>',
        '<h2 id="note">Note</h2><p>biological age</p><h2 id="three">3. Cooking ', F.col("page_id"), "</h2><p>soup</p>",
        F.when(F.col("page_id") % 3 == 0, '<h2 id="four">4. Dementia</h2><img src="http://img.example.com/four.jpg">').otherwise(""))
    return p.select(
        "page_id", F.lit(0).cast("long").alias("item_ord"), V.text("Digest ", F.col("page_id")).alias("title"),
        F.when(F.col("page_id") % 4 > 0, summary).otherwise(F.col("title")).alias("summary"),
        F.when(F.col("page_id") % 8 != 0, page).otherwise(F.col("url")).alias("link"), F.lit("").alias("image_url"))


@query("split_digest_items", f"""WITH {V.PAGES_SQL},
p AS (SELECT *, 'https://supertechfans.com/cn/post/' || strftime(report_date, '%Y-%m-%d') || '-HackerNews/' || page_id AS page FROM pages_v),
s AS (
  SELECT page_id, page || '#one' AS entry_id, {Q.sub(Q.squeeze(V.DECODED.format('title')), '^ ', '')} AS title, replace(replace('x about biological age', '', ''), '', '') AS summary, replace(url, '&amp;', '&') AS link, '' AS image_url, 1 AS k FROM p WHERE page_id % 4 > 0
  UNION ALL SELECT page_id, page || '#two', 'Router', 'No link on ageing, only a transformer', page, '', 2 FROM p WHERE page_id % 4 > 0
  UNION ALL SELECT page_id, page || '#four', 'Dementia', '[图片: http://img.example.com/four.jpg]', page, 'http://img.example.com/four.jpg', 4 FROM p WHERE page_id % 4 > 0 AND page_id % 3 = 0)
SELECT page_id, entry_id, title, summary, link, image_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS story_ord FROM s WHERE title <> ''
UNION ALL SELECT page_id, url, 'Digest ' || page_id, title, url, '', 0 FROM p WHERE page_id % 8 = 0""")
def split_digest_items(spark, sf):
    return filters.split_digest_items(digests(spark, sf)).select(
        "page_id", "entry_id", "title", "summary", "link", "image_url", "story_ord")


@query("build_content_html", """SELECT page_id,
  CASE WHEN page_id % 2 = 0 THEN '<p><img src="http://img.example.com/' || page_id || '.jpg" alt="a &lt;b&gt; &quot;' || page_id || '&quot;"></p>' ELSE '' END
  || '<p>' || html || '</p>' || CASE WHEN page_id % 3 = 0 THEN '<p><a href="https://arxiv.org/pdf/2401.' || (10000 + page_id) || '" target="_blank" rel="noopener noreferrer">PDF</a></p>' ELSE '' END AS content_html
FROM pages""")
def build_content(spark, sf):
    p = V.table(spark, sf, "pages")
    image = F.when(F.col("page_id") % 2 == 0, V.text("http://img.example.com/", F.col("page_id"), ".jpg"))
    url = F.when(F.col("page_id") % 3 == 0, V.text("https://papers.cool/arxiv/2401.", F.col("page_id") + 10000)).otherwise(F.col("url"))
    name = V.text('a <b> "', F.col("page_id"), '"')
    return p.select("page_id", build_content_html(name, F.col("html"), image, url).alias("content_html"))


@query("repo_activity_filter", f"""WITH {V.REPO_ROWS_SQL}
SELECT page_id, item_ord, url FROM repo_rows WHERE CAST(total_stars AS INT) >= 20
  AND last_activity_at >= TIMESTAMP '2024-01-08 16:00:00' - INTERVAL 1 MILLISECOND - INTERVAL 5 DAY
  AND last_activity_at <= TIMESTAMP '2024-01-08 16:00:00' - INTERVAL 1 MILLISECOND""")
def repo_activity_filter(spark, sf):
    rows = repos.scan_repo_search(V.repo_pages(spark, sf))
    return filters.repo_activity_filter(rows, F.lit("2024-01-08").cast("date"), 20, 5).select(
        "page_id", F.col("item_ord").cast("int").alias("item_ord"), "url")


@query("host_policy", f"""WITH {V.ITEMS_SQL},
flagged AS (SELECT *, coalesce(regexp_matches(source, '(^|\\.)example\\.com$'), false) AS matches FROM items),
numbered AS (SELECT *, row_number() OVER (PARTITION BY report_date, matches ORDER BY has_media DESC, published_at DESC, item_ord) AS n FROM flagged)
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, id, CASE WHEN matches THEN {Q.sub("content_html", '(?i)<img[^>]*>', '')}
  ELSE content_html END AS content_html FROM numbered WHERE NOT matches OR n <= 2""")
def host_policy(spark, sf):
    rows = filters.host_policy(
        V.items(spark, sf), ["report_date"], [F.col("has_media").desc(), F.col("published_at").desc(), F.col("item_ord")],
        host="example.com", category=None)
    return rows.select(day().alias("report_date"), "id", "details.content_html")


@query("has_media_flag", f"""WITH {V.ITEMS_SQL} SELECT id, has_media, has_media AS candidate_media FROM items""")
def has_media_flag(spark, sf):
    return V.items(spark, sf).select("id", has_media("details.content_html").alias("has_media"),
                                     texts.item_has_media().alias("candidate_media"))


_HINT = """CASE WHEN item_ord % 5 = 0 THEN '[图片: ' || coalesce(nullif({title}, ''), '相关图片') || ' http://img.example.com/' || id || '.jpg]' END"""
HINT_SQL = _HINT.format(title=Q.squeeze("title"))
_ISO_SQL = "strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z')"
PROMPT_TEXT_SQL = f"""concat_ws(chr(10), CASE category
  WHEN 'news' THEN 'News Title: ' || title || chr(10) || 'Published: ' || {_ISO_SQL} || chr(10) || 'Url: ' || url || chr(10) || 'Content Summary: ' || {Q.strip_html('content_html')}
  WHEN 'project' THEN 'Project Name: ' || title || chr(10) || 'Published: ' || {_ISO_SQL} || chr(10) || 'Url: ' || url || chr(10) || 'Description: ' || description || chr(10) || 'Stars: ' || coalesce(CAST(total_stars AS VARCHAR), 'null')
  WHEN 'paper' THEN 'Papers Title: ' || title || chr(10) || 'Published: ' || {_ISO_SQL} || chr(10) || 'Url: ' || url || chr(10) || 'Abstract/Content Summary: ' || {Q.strip_html('content_html')}
  ELSE 'socialMedia Post by ' || source || '：Published: ' || {_ISO_SQL} || chr(10) || 'Url: ' || url || chr(10) || 'Content: ' || {Q.strip_html('content_html')} END, {HINT_SQL})"""


@query("item_prompt_text", f"WITH {V.ITEMS_SQL} SELECT id, {PROMPT_TEXT_SQL} AS prompt FROM items")
def item_prompt_text(spark, sf):
    return V.items(spark, sf).select("id", texts.item_prompt_text().alias("prompt"))


def _cut(x, n):
    return f"CASE WHEN {Q.units(x)} <= {n} THEN {x} ELSE substr({x}, 1, {n}) || '...' END"


BRIEF_SQL = f"""concat_ws(chr(10), 'Type: ' || category, 'Title: ' || coalesce(nullif(title, ''), 'N/A'), 'Published: ' || {_ISO_SQL},
  'Source: ' || source, 'Url: ' || url, CASE WHEN description <> '' THEN 'Description: ' || {_cut(Q.squeeze('description'), 400)} END,
  'Stars: ' || total_stars, 'Language: ' || language, 'Content: ' || nullif({_cut(Q.strip_html('content_html'), 700)}, ''))"""


@query("item_brief_text", f"WITH {V.ITEMS_SQL} SELECT id, {BRIEF_SQL} AS brief FROM items")
def item_brief_text(spark, sf):
    return V.items(spark, sf).select("id", texts.item_brief_text().alias("brief"))


@query("media_hint", f"WITH {V.ITEMS_SQL} SELECT id, coalesce({HINT_SQL}, '') AS hint FROM items")
def media_hint(spark, sf):
    return V.items(spark, sf).select("id", texts.item_hint().alias("hint"))


@query("selection_parse", f"WITH {V.ITEMS_SQL} SELECT id, category AS kind, url AS ref FROM items")
def parse_selection(spark, sf):
    rows = V.items(spark, sf).select("id", V.text(F.col("category"), ":", F.col("url")).alias("s"))
    kind, ref = selection_parse("s")
    return rows.select("id", kind.alias("kind"), ref.alias("ref"))


@query("union_sources", f"""WITH {V.ENTRY_ROWS_SQL}
SELECT 'entry' AS origin, id, title FROM entry_rows UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), title FROM pages_v""")
def unite(spark, sf):
    a = entries.unify_entry_items(entries.scan_entry_json(entries.parse_entry_pages(V.entry_pages(spark, sf))), "news",
                                  F.col("report_date")).withColumn("origin", F.lit("entry"))
    b = V.items(spark, sf).drop("has_media").withColumn("origin", F.lit("page"))
    return union_sources(spark, [a, b]).select("origin", "id", "title")


@query("source_registry", f"""WITH {V.PAGES_SQL}
SELECT 'repos' AS source, 'lab/' || n % 37 AS title FROM (SELECT page_id AS n FROM pages UNION ALL SELECT page_id + 11 FROM pages)
UNION ALL SELECT host, title FROM pages_v""")
def registry(spark, sf):
    """Two sources of one category are read and united; a third whose path is missing contributes nothing."""
    reg = SourceRegistry()
    reg.register("pages", "project", V.items, lambda rows: rows.drop("has_media"))
    reg.register("repos", "project", V.repo_pages, lambda rows: repos.unify_repo_items(
        repos.scan_repo_search(rows), order=("page_id", "item_ord")).withColumn("source", F.lit("repos")))
    reg.register("missing", "project", lambda s, path: s.read.parquet(path), lambda rows: rows)
    found = reg.load(spark, "project", {"pages": sf, "repos": sf, "missing": f"{sf}/missing.parquet"})
    return found.select("source", "title")


@query("latest_report_per_date", f"""WITH {V.REPORTS_SQL}, {LATEST_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, ord, title FROM latest""")
def latest(spark, sf):
    return latest_report_per_date(V.reports(spark, sf)).select(day().alias("report_date"), "ord", "title")


@query("cap_per_feed", f"""WITH {V.ITEMS_SQL}
SELECT source, id FROM items QUALIFY row_number() OVER (PARTITION BY source ORDER BY item_ord) <= 8""")
def cap_per_feed(spark, sf):
    return first_n(V.items(spark, sf), ["source"], [F.col("item_ord")], 8).select("source", "id")


@query("auto_feed_then_list", f"""WITH {V.PAGES_SQL},
r AS (SELECT page_id, page_id % 20 AS source_id, CASE WHEN page_id % 20 < 10 AND page_id % 40 < 20 THEN 'feed' ELSE 'list' END AS "fetch" FROM pages_v),
f AS (SELECT source_id, count_if("fetch" = 'feed') AS n FROM r GROUP BY 1)
SELECT page_id, source_id, "fetch" FROM r JOIN f USING (source_id) WHERE (n > 0) = ("fetch" = 'feed')""")
def auto_feed(spark, sf):
    n = F.col("page_id")
    rows = V.table(spark, sf, "pages").select(
        n, (n % 20).alias("source_id"),
        F.when((n % 20 < 10) & (n % 40 < 20), "feed").otherwise("list").alias("fetch"))
    return entries.auto_feed_then_list(rows)


