"""Structured Streaming jobs over the given tables, run until the landed data is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregates import clean_visits
from ..session import is_folder, work_path
from ..sources.snapshots import snapshots
from ..streaming import dedupe, ingest, state, views as SV, visitors
from . import sqltext as Q, views as V
from .registry import query
from .scans import day

CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark, sf, name):
    """The table's Parquet file, or folder of files, as a stream."""
    reader, path = spark.readStream.schema(V.table(spark, sf, name).schema), f"{sf}/{name}.parquet"
    if is_folder(spark, path):
        return reader.parquet(path)
    # A stream cannot start from one file: it is picked by name from its folder.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _run(stream, out, mode="append"):
    query_ = (stream.writeStream.outputMode(mode).foreachBatch(SV.batch_writer(out))
              .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start())
    query_.awaitTermination()


def _item_stream(spark, sf):
    p = _stream(spark, sf, "pages")
    return p.select("page_id", "url", V.published().alias("published_at"))


@query("stream_ingest", f"""WITH {V.FEED_ROWS_SQL}
SELECT '2024-01-03' AS report_date, category, feed_name AS source, link AS id, title, {Q.strip_html('summary')} AS description
FROM feed_rows JOIN (SELECT page_id, category FROM pages_v) USING (page_id)
WHERE published_at BETWEEN TIMESTAMP '2024-01-03 16:00:00' - INTERVAL 1 MILLISECOND - INTERVAL 2 DAY
  AND TIMESTAMP '2024-01-03 16:00:00' - INTERVAL 1 MILLISECOND""")
def stream_ingest(spark, sf):
    """Feed bodies land in several files, those of even pages twice; the run of one date keeps what its window holds."""
    return _ingest(spark, sf)


@query("stream_ingest_dates", f"""WITH {V.FEED_ROWS_SQL}, run_dates AS (SELECT DISTINCT report_date FROM pages_v)
SELECT strftime(d.report_date, '%Y-%m-%d') AS report_date, category, feed_name AS source, link AS id, title, {Q.strip_html('summary')} AS description
FROM feed_rows JOIN (SELECT page_id, category FROM pages_v) USING (page_id)
JOIN run_dates d ON published_at BETWEEN CAST(d.report_date AS TIMESTAMP) + INTERVAL 16 HOUR - INTERVAL 1 MILLISECOND - INTERVAL 2 DAY
  AND CAST(d.report_date AS TIMESTAMP) + INTERVAL 16 HOUR - INTERVAL 1 MILLISECOND""")
def stream_ingest_dates(spark, sf):
    """The same landed files for all run dates: every row goes to each date whose window holds it, and merges there."""
    return _ingest(spark, sf, V.run_dates(spark, sf))


def _ingest(spark, sf, run_dates=None):
    landed, out = work_path(spark, "landed"), work_path(spark, "snapshots")
    feeds, number = V.raw_feeds(spark, sf), F.regexp_extract("feed_url", r"(\d+)$", 1).cast("long")
    feeds.repartition(2).write.parquet(landed)
    feeds.filter(number % 2 == 0).repartition(2).write.mode("append").parquet(landed)
    kinds = F.array(*[F.lit(c) for c in ("news", "paper", "project", "socialMedia")])
    query_ = ingest.stream_ingest(
        ingest.read_feed_stream(spark, landed, 2), out, out + "-checkpoint",
        F.element_at(kinds, (number % 4 + 1).cast("int")), F.lit("2024-01-03").cast("date"), 2, F.col("published_at"),
        run_dates)
    query_.awaitTermination()
    return snapshots(spark, out).select(day().alias("report_date"), "category", "source", "id", "title", "description")


@query("stream_visitors", f"""WITH {V.VISITS_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY site, visitor ORDER BY ts) AS n FROM visits)
SELECT site, strftime(day, '%Y-%m-%d') AS day, count(*) AS pageviews, count(DISTINCT visitor) AS new_daily,
  CAST(count_if(visitor IS NOT NULL AND n = 1) AS BIGINT) AS new_total, CAST(0 AS BIGINT) AS late_views FROM f GROUP BY ALL""")
def stream_visitors(spark, sf):
    """The events land in three portions by time, each run from the checkpoint of the one before: none is late."""
    return _visitor_log(spark, sf, (0, 1, 2)).withColumn("late_views", F.lit(0).cast("long"))


@query("stream_visitors_corrected", f"""WITH {V.VISITS_SQL},
f AS (SELECT *, ts - lag(ts) OVER (PARTITION BY site, visitor ORDER BY ts) AS gap FROM visits)
SELECT site, strftime(day, '%Y-%m-%d') AS day, count(*) AS pageviews, count(DISTINCT visitor) AS new_daily,
  CAST(count_if(visitor IS NOT NULL AND (gap IS NULL OR gap > INTERVAL 2 DAY)) AS BIGINT) AS new_total FROM f GROUP BY ALL""")
def stream_visitors_corrected(spark, sf):
    """The last portion lands first and the first one last; idle for two days. Late visits correct the days."""
    return _visitor_log(spark, sf, (2, 1, 0), idle_days=2)


def _visitor_log(spark, sf, order, idle_days=365):
    out, landed = work_path(spark, "visitor-log"), work_path(spark, "landed")
    events = V.table(spark, sf, "events")
    first, second = (F.col("ts").cast("timestamp") >= F.lit(x).cast("timestamp") for x in CUTS)
    for place in order:
        events.filter((~first, first & ~second, second)[place]).write.mode("append").parquet(landed)
        visits = clean_visits(V.visits(spark.readStream.schema(events.schema).parquet(landed)))
        visitors.run_visitor_log(visits, out, out + "-checkpoint", every=2).awaitTermination()
    return visitors.visitor_counts(visitors.visitor_log(spark, out), idle_days).withColumn("day", day("day"))


@query("stream_visitors_late", f"""WITH {V.VISITS_SQL},
m AS (SELECT *, visitor IS NOT NULL AND ts >= TIMESTAMP '{CUTS[0]}' AND ts < TIMESTAMP '{CUTS[1]}' AS late FROM visits),
f AS (SELECT *, row_number() OVER (PARTITION BY site, visitor, late ORDER BY ts) AS n FROM m)
SELECT site, strftime(day, '%Y-%m-%d') AS day, count(*) AS pageviews, count(DISTINCT CASE WHEN NOT late THEN visitor END) AS new_daily,
  CAST(count_if(visitor IS NOT NULL AND NOT late AND n = 1) AS BIGINT) AS new_total, CAST(count_if(late) AS BIGINT) AS late_views
FROM f GROUP BY ALL""")
def stream_visitors_late(spark, sf):
    """The middle portion lands last and lies behind the watermark of the one after it."""
    return _visitors(spark, sf, (0, 2, 1))


def _visitors(spark, sf, order):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out, landed, views = (work_path(spark, x) for x in ("visitors", "landed", "daily-views"))
    events = V.table(spark, sf, "events")
    first, second = (F.col("ts").cast("timestamp") >= F.lit(x).cast("timestamp") for x in CUTS)
    for place in order:
        events.filter((~first, first & ~second, second)[place]).write.mode("append").parquet(landed)
        visits = clean_visits(V.visits(spark.readStream.schema(events.schema).parquet(landed)))
        _run(state.stream_visitors(visits), out)
        SV.run_daily_views(visits, views, views + "-checkpoint").awaitTermination()
    totals = state.visitor_totals(spark.read.parquet(out), SV.daily_views(spark, views))
    return totals.withColumn("day", day("day"))


@query("stream_daily_views", f"""WITH {V.VISITS_SQL} SELECT site, strftime(day, '%Y-%m-%d') AS day, count(*) AS pageviews FROM visits GROUP BY ALL""")
def stream_daily_views(spark, sf):
    """The events land in four files, each with visits of all days, and are read one file per batch."""
    landed, out = work_path(spark, "landed"), work_path(spark, "daily-views")
    events = V.table(spark, sf, "events")
    events.repartition(4).write.parquet(landed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    SV.run_daily_views(clean_visits(V.visits(stream)), out, out + "-checkpoint").awaitTermination()
    return SV.daily_views(spark, out).select("site", day("day").alias("day"), "pageviews")


@query("stream_rate_limit", """SELECT event_id AS request_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id % 3, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1""")
def stream_rate_limit(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = work_path(spark, "admitted")
    _run(state.stream_rate_limit(V.requests(_stream(spark, sf, "events")), 1), out)
    return spark.read.parquet(out).select("request_id")


@query("stream_dedupe", f"SELECT DISTINCT {Q.norm_url('url')} AS norm_url FROM pages")
def stream_dedupe(spark, sf):
    out = work_path(spark, "deduped")
    _run(SV.stream_dedupe(_item_stream(spark, sf)), out)
    return spark.read.parquet(out).select("norm_url")


RULE_SQL = """WITH RECURSIVE e AS (SELECT 'https://x.example/' || (user_id % 40) AS url, ts, event_id FROM events),
kept AS (SELECT url, min(ts) AS ts FROM e GROUP BY 1
  UNION ALL SELECT e.url, min(e.ts) FROM kept k JOIN e ON e.url = k.url AND e.ts > k.ts + INTERVAL 7 DAY GROUP BY 1)
SELECT kept.url AS norm_url, min(event_id) AS row_id FROM kept JOIN e ON e.url = kept.url AND e.ts = kept.ts GROUP BY kept.url, kept.ts"""


@query("stream_dedupe_one_batch", RULE_SQL)
def stream_dedupe_one_batch(spark, sf):
    """Keep the first event per address for 7 days after it; everything lands at once."""
    return _deduped(spark, sf, 1)


@query("stream_dedupe_batches", RULE_SQL)
def stream_dedupe_batches(spark, sf):
    """The same rows from five files, one per batch, each with two days that overlap the file before."""
    return _deduped(spark, sf, 5)


def _deduped(spark, sf, files):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out, landed = work_path(spark, "deduped"), work_path(spark, "landed")
    ts = F.col("ts").cast("timestamp")
    rows = V.table(spark, sf, "events").select(
        V.text("https://x.example/", F.col("user_id") % 40).alias("url"), ts.alias("ts"), F.col("event_id").alias("row_id"))
    # Files follow one another in time, but a row may come up to two days after its place.
    delay = F.make_interval(days=F.pmod(F.col("row_id"), F.lit(3)).cast("int"))
    start, last = rows.agg(F.min("ts"), F.max("ts")).first()
    step = max(1, -(-(last - start).days // files))
    place = F.least(F.lit(files - 1), F.datediff(F.col("ts") + delay, F.lit(start)) / step).cast("int")
    portions = [rows.filter(place == number) for number in range(files)]
    for portion in [*portions, dedupe.heartbeat(spark, last, days=30).select(*rows.columns)]:
        portion.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows.schema).parquet(landed)
        _run(dedupe.stream_dedupe_ordered(stream, "row_id", delay="3 days"), out)
    return spark.read.parquet(out).select("norm_url", "row_id")


@query("stream_late_rows", f"""WITH {V.PAGES_SQL}, w AS (SELECT *, published_at BETWEEN TIMESTAMP '2024-01-06 16:00:00' - INTERVAL 1 MILLISECOND - INTERVAL 5 DAY
    AND TIMESTAMP '2024-01-06 16:00:00' - INTERVAL 1 MILLISECOND AS inside FROM pages_v)
SELECT 'kept' AS kind, CAST(count_if(inside) AS BIGINT) AS n FROM w UNION ALL SELECT 'excluded', CAST(count_if(NOT inside) AS BIGINT) FROM w UNION ALL SELECT 'seen', count(*) FROM w""")
def stream_late_rows(spark, sf):
    out = work_path(spark, "window")
    SV.run_late_rows(_item_stream(spark, sf), "published_at", F.lit("2024-01-06").cast("date"), 5, out,
                     out + "-checkpoint").awaitTermination()
    kept = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("kind"), "n")
    counts = spark.read.parquet(out + "-counts").agg(F.sum("seen").alias("seen"), F.sum("excluded").alias("excluded"))
    return kept.unionByName(counts.selectExpr("stack(2, 'seen', seen, 'excluded', excluded) AS (kind, n)"))


