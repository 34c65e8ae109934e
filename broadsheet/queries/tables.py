"""Joins, aggregations, windows, selections and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import PROJECT_BRIEF_ORDER, PROJECT_BRIEF_QUOTAS
from ..operators import aggregates as A, dedupe as D, joins as J, requests as RQ, selection as S, texts as T
from ..operators.gates import url_set_union
from ..plans.daily import daily_selection
from ..session import work_path
from ..sources import repos
from . import sqltext as Q, views as V
from .registry import query
from .scalars import _URLS, links_sql, _LINK
from .scans import BRIEF_SQL, PROMPT_TEXT_SQL, day


@query("rank_category", f"""WITH {V.ITEMS_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, category, id, rank FROM ranked""")
def rank_category(spark, sf):
    return S.rank_category(V.items(spark, sf)).select(day().alias("report_date"), "category", "id", "rank")


@query("cap_per_category", f"""WITH {V.ITEMS_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, category, id, rank FROM ranked
WHERE rank <= CASE category WHEN 'news' THEN 3 WHEN 'paper' THEN 5 ELSE 4 END""")
def cap_per_category(spark, sf):
    capped = S.cap_per_category(V.items(spark, sf), {"news": 3, "paper": 5}, 4)
    return capped.select(day().alias("report_date"), "category", "id", F.col("rank").cast("long").alias("rank"))


CANDIDATES_SQL = V.ITEMS_SQL + """,
cands AS (SELECT report_date, category, category_ord, rank, coalesce(nullif(url, ''), category || ':' || title) AS key,
  has_media, published_at, id FROM ranked WHERE rank <= 30)"""


def selection_sql(cands: str, cap: int = 8) -> str:
    """Quota selection over a candidate table; defines ``picked``."""
    return f"""
slots AS (SELECT *, row_number() OVER (PARTITION BY report_date, category ORDER BY has_media DESC, published_at DESC, category_ord, rank) AS slot FROM {cands}),
sliced AS (SELECT *, CASE category WHEN 'news' THEN 1 WHEN 'paper' THEN 2 WHEN 'project' THEN 3 ELSE 4 END AS quota_ord FROM slots
  WHERE slot <= CASE category WHEN 'news' THEN 8 WHEN 'paper' THEN 8 WHEN 'project' THEN 4 WHEN 'socialMedia' THEN 2 END),
uniq AS (SELECT * FROM sliced QUALIFY row_number() OVER (PARTITION BY report_date, key ORDER BY quota_ord, slot) = 1),
phase1 AS (SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY quota_ord, slot) AS pick FROM uniq QUALIFY pick <= {cap}),
counts AS (SELECT report_date, count(*) AS n, count_if(category = 'paper') AS papers FROM phase1 GROUP BY 1),
rest AS (SELECT s.*, n FROM slots s JOIN counts USING (report_date)
  WHERE (category <> 'paper' OR papers < 8) AND (report_date, key) NOT IN (SELECT (report_date, key) FROM phase1)
  QUALIFY row_number() OVER (PARTITION BY report_date, key ORDER BY has_media DESC, published_at DESC, category_ord, rank) = 1),
phase2 AS (SELECT *, n + row_number() OVER (PARTITION BY report_date ORDER BY has_media DESC, published_at DESC, category_ord, rank) AS pick FROM rest),
picked AS (SELECT report_date, category, key, id, pick FROM phase1 UNION ALL SELECT report_date, category, key, id, pick FROM phase2 WHERE pick <= {cap})"""


def _picked(spark, sf, cap=8):
    return S.quota_select(T.candidates(V.capped(spark, sf)), cap=cap)


@query("quota_select", f"""WITH {CANDIDATES_SQL}, {selection_sql('cands', 18)}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, category, key, pick FROM picked""")
def quota_select(spark, sf):
    return _picked(spark, sf, 18).select(day().alias("report_date"), "category", "key", F.col("pick").cast("long").alias("pick"))


@query("selected_stats", f"""WITH {CANDIDATES_SQL}, {selection_sql('cands')}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, category, count(*) AS selected FROM picked GROUP BY ALL""")
def selected_stats(spark, sf):
    return A.selected_stats(_picked(spark, sf)).withColumn("report_date", day())


_SEPARATOR = "chr(10) || chr(10) || '------' || chr(10) || chr(10)"


@query("prompt_bundle", f"""WITH {CANDIDATES_SQL}, {selection_sql('cands')},
texts AS (SELECT id, {PROMPT_TEXT_SQL} AS prompt FROM items)
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, count(*) AS n_items,
  {_SEPARATOR} || string_agg(prompt, {_SEPARATOR} ORDER BY pick) || {_SEPARATOR} AS prompt FROM picked JOIN texts USING (id) GROUP BY 1""")
def prompt_bundle(spark, sf):
    return T.prompt_bundle(_picked(spark, sf)).withColumn("report_date", day())


@query("media_then_rest", f"""WITH {V.ITEMS_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, id, row_number() OVER (PARTITION BY report_date ORDER BY has_media DESC, item_ord) AS pick
FROM items QUALIFY pick <= 8""")
def media_then_rest(spark, sf):
    rows = S.media_then_rest(V.items(spark, sf), 8, ["report_date"], [F.col("item_ord")])
    return rows.select(day().alias("report_date"), "id", F.col("pick").cast("long").alias("pick"))


def _brief_sql(quotas):
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(quotas))
    limit = " ".join(f"WHEN '{c}' THEN {n}" for c, n in quotas.items())
    return f"""SELECT report_date, category, id, row_number() OVER (PARTITION BY report_date
      ORDER BY CASE category {order} END, rank) AS pick FROM ranked WHERE rank <= CASE category {limit} END"""


@query("brief_select", f"""WITH {V.ITEMS_SQL}, general AS ({_brief_sql(S.BRIEF_QUOTAS)}),
project AS ({_brief_sql({c: PROJECT_BRIEF_QUOTAS[c] for c in PROJECT_BRIEF_ORDER})}),
briefs AS (SELECT id, {BRIEF_SQL} AS brief FROM items)
SELECT 'general' AS kind, strftime(report_date, '%Y-%m-%d') AS report_date, pick, brief FROM general JOIN briefs USING (id)
UNION ALL SELECT 'project', strftime(report_date, '%Y-%m-%d'), pick, brief FROM project JOIN briefs USING (id)""")
def brief_select(spark, sf):
    rows = V.capped(spark, sf)
    parts = [S.brief_select(rows, quotas, order).select(
        F.lit(kind).alias("kind"), day().alias("report_date"), F.col("pick").cast("long").alias("pick"),
        T.item_brief_text().alias("brief"))
        for kind, quotas, order in (("general", S.BRIEF_QUOTAS, None),
                                    ("project", PROJECT_BRIEF_QUOTAS, PROJECT_BRIEF_ORDER))]
    return parts[0].unionByName(parts[1])


@query("month_order", f"""WITH {V.REPORTS_SQL}, d AS (SELECT DISTINCT report_date FROM reports)
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, 1000000 - (year(report_date) - 2000) * 12 - month(report_date) AS month_weight,
  32 - day(report_date) AS day_weight, row_number() OVER (ORDER BY strftime(report_date, '%Y-%m') DESC, report_date DESC) AS position FROM d""")
def month_order(spark, sf):
    return S.month_order(V.reports(spark, sf).select("report_date").distinct()).select(
        day().alias("report_date"), F.col("month_weight").cast("long").alias("month_weight"),
        F.col("day_weight").cast("long").alias("day_weight"), "position")


# De-duplication.

def _partly_keyed(spark, sf):
    n = F.col("item_ord")
    return V.items(spark, sf).withColumn("url", F.when(n % 3 > 0, F.col("url"))).withColumn(
        "id", F.when(n % 2 == 0, (n % 100).cast("string")).otherwise(""))


@query("dedupe_first_url", f"""WITH {V.ITEMS_SQL},
k AS (SELECT item_ord, coalesce(CASE WHEN item_ord % 3 > 0 THEN nullif(url, '') END, CASE WHEN item_ord % 2 = 0 THEN CAST(item_ord % 100 AS VARCHAR) END, nullif(title, '')) AS key FROM items)
SELECT min(item_ord) AS item_ord FROM k WHERE key IS NOT NULL GROUP BY key""")
def dedupe_first_url(spark, sf):
    return D.dedupe_first_url(_partly_keyed(spark, sf), [F.col("item_ord")]).select("item_ord")


@query("dedupe_first_id", "SELECT min(page_id) AS item_ord FROM pages GROUP BY page_id % 100")
def dedupe_first_id(spark, sf):
    rows = V.items(spark, sf).withColumn("id", (F.col("item_ord") % 100).cast("string"))
    return D.dedupe_first_id(rows, [F.col("item_ord")]).select("item_ord")


@query("dedupe_first_repo", f"""WITH {V.REPO_ROWS_SQL}
SELECT page_id, item_ord FROM repo_rows QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, item_ord) = 1""")
def dedupe_first_repo(spark, sf):
    rows = repos.scan_repo_search(V.repo_pages(spark, sf))
    return D.dedupe_first_repo(rows, [F.col("page_id"), F.col("item_ord")]).select(
        "page_id", F.col("item_ord").cast("int").alias("item_ord"))


KEYED_SQL = V.ITEMS_SQL + f""",
keyed AS (SELECT *, nullif({Q.norm_url('url')}, '') AS url_key,
  CASE WHEN {Q.units(Q.norm_title('title'))} >= 24 THEN {Q.norm_title('title')} END AS title_key FROM items)"""

# The greedy rule has no set form: a recursive query takes one item after the other and carries the kept keys.
HISTORY_SQL = KEYED_SQL + """,
seq AS (SELECT *, row_number() OVER (ORDER BY report_date, CASE category WHEN 'news' THEN 1 WHEN 'project' THEN 2 WHEN 'paper' THEN 3 ELSE 4 END,
  has_media DESC, published_at DESC, source_ord, item_ord) AS n FROM keyed)"""


@query("dedupe_history", "WITH RECURSIVE " + HISTORY_SQL + """,
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR, d DATE)[]) AS kept, false AS keep, NULL::VARCHAR AS id, NULL::DATE AS report_date, '' AS category
  UNION ALL
  SELECT s.n, CASE WHEN b.hit THEN w.kept ELSE list_concat(w.kept, list_filter([{'k': 'u' || s.url_key, 'd': s.report_date}, {'k': 't' || s.title_key, 'd': s.report_date}], lambda x: x.k IS NOT NULL)) END,
    NOT b.hit, s.id, s.report_date, s.category
  FROM walk w JOIN seq s ON s.n = w.n + 1, LATERAL (SELECT len(list_filter(w.kept, lambda x:
    (x.k = 'u' || s.url_key OR x.k = 't' || s.title_key) AND date_diff('day', x.d, s.report_date) <= 7)) > 0 AS hit) b)
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, category, id FROM walk WHERE keep""")
def dedupe_history(spark, sf):
    return D.dedupe_history(V.items(spark, sf)).select(day().alias("report_date"), "category", "id")


def _gaps(spark, sf, bare=False):
    """Items without news on even days, papers on every third and social posts on every fifth day.

    With ``bare`` every sixth item has no URL and only a short title, so that no key protects it.
    """
    n = F.dayofmonth("report_date")
    gone = ((F.col("category") == "news") & (n % 2 == 0)) | ((F.col("category") == "paper") & (n % 3 == 0)) | (
        (F.col("category") == "socialMedia") & (n % 5 == 0))
    rows = V.items(spark, sf).filter(~gone)
    if bare:
        short = F.col("item_ord") % 6 == 0
        rows = rows.withColumn("url", F.when(~short, F.col("url"))).withColumn(
            "title", F.when(short, "Short").otherwise(F.col("title")))
    return rows


def _backfill_sql(lookback, days):
    parts, seen = [], "SELECT report_date AS d, url_key, title_key FROM kept"
    for i, c in enumerate(("news", "paper", "socialMedia")):
        parts.append(f"""
empty{i} AS (SELECT report_date AS d FROM (SELECT DISTINCT report_date FROM items) WHERE report_date NOT IN (SELECT report_date FROM kept WHERE category = '{c}')),
pool{i} AS (SELECT e.d, date_diff('day', k.report_date, e.d) AS back, k.* FROM empty{i} e JOIN kept k
  ON k.category = '{c}' AND k.report_date BETWEEN e.d - {lookback} AND e.d - 1
  WHERE NOT EXISTS (SELECT 1 FROM kept h WHERE h.report_date BETWEEN e.d - {days} AND e.d - 1 AND (h.url_key = k.url_key OR h.title_key = k.title_key))
    AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.d = e.d AND (s.url_key = k.url_key OR s.title_key = k.title_key))),
near{i} AS (SELECT * FROM pool{i} QUALIFY rank() OVER (PARTITION BY d ORDER BY back) = 1),
fill{i} AS (SELECT * FROM near{i} QUALIFY row_number() OVER (PARTITION BY d ORDER BY item_ord) <= 4)""")
        seen += f" UNION ALL SELECT d, url_key, title_key FROM fill{i}"
    return ",".join(parts)


_KEPT_SQL = KEYED_SQL + """,
kept AS (SELECT * FROM keyed WHERE NOT (category = 'news' AND day(report_date) % 2 = 0) AND NOT (category = 'paper' AND day(report_date) % 3 = 0)
  AND NOT (category = 'socialMedia' AND day(report_date) % 5 = 0))"""


def _backfill_union():
    return " UNION ALL ".join(f"SELECT strftime(d, '%Y-%m-%d') AS report_date, category, id, strftime(report_date, '%Y-%m-%d') AS backfilled_from FROM fill{i}"
                              for i in range(3))


@query("backfill_asof", f"WITH {_KEPT_SQL}, {_backfill_sql(5, 1)} {_backfill_union()}")
def backfill_asof(spark, sf):
    """Look-back longer than the de-duplication window: rows older than one day may return."""
    kept = _gaps(spark, sf)
    rows = J.backfill_asof(kept, kept, V.run_dates(spark, sf), [F.col("item_ord")], lookback=5, dedupe_days=1)
    return rows.select(day().alias("report_date"), "category", "id", day("details.backfilled_from").alias("backfilled_from"))


_BARE_SQL = _KEPT_SQL.replace("kept AS (SELECT * FROM keyed", """kept AS (SELECT * REPLACE (
  CASE WHEN item_ord % 6 > 0 THEN url_key END AS url_key, CASE WHEN item_ord % 6 > 0 THEN title_key END AS title_key) FROM keyed""")


@query("backfill_asof_default", f"WITH {_BARE_SQL}, {_backfill_sql(5, 7)} {_backfill_union()}")
def backfill_asof_default(spark, sf):
    """Default windows: only rows without usable keys can return."""
    kept = _gaps(spark, sf, bare=True)
    rows = J.backfill_asof(kept, kept, V.run_dates(spark, sf), [F.col("item_ord")])
    return rows.select(day().alias("report_date"), "category", "id", day("details.backfilled_from").alias("backfilled_from"))


# Joins.

@query("anti_prev_day", f"""WITH {V.PAGES_SQL},
r AS (SELECT page_id, report_date, 'https://github.com/lab/' || CASE WHEN day(report_date) % 5 = 4 THEN 0 ELSE page_id % 37 END AS url FROM pages_v),
snap AS (SELECT DISTINCT report_date + 1 AS d, url FROM r UNION SELECT DISTINCT report_date, 'https://github.com/lab/0' FROM r WHERE day(report_date) % 5 = 4),
f AS (SELECT r.*, s.url IS NULL AS fresh FROM r LEFT JOIN snap s ON s.d = r.report_date AND s.url = r.url),
c AS (SELECT *, count_if(fresh) OVER (PARTITION BY report_date) AS n FROM f)
SELECT page_id, strftime(report_date, '%Y-%m-%d') AS report_date, url FROM c WHERE fresh OR n = 0""")
def anti_prev_day(spark, sf):
    """On some days every repository repeats; those days keep all of them."""
    fixed = F.dayofmonth("report_date") % 5 == 4
    rows = V.pages(spark, sf).select("page_id", "report_date", V.text(
        "https://github.com/lab/", F.when(fixed, 0).otherwise(F.col("page_id") % 37)).alias("url"))
    old = rows.select("report_date", "url").unionByName(rows.filter(fixed).select(
        F.date_sub("report_date", 1).alias("report_date"), F.lit("https://github.com/lab/0").alias("url")))
    return J.anti_prev_day(rows, old).select("page_id", day().alias("report_date"), "url")


@query("translation_by_id", f"""WITH {V.PAGES_SQL}
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '译 ' || title ELSE title END AS title_zh FROM pages_v""")
def translation_by_id(spark, sf):
    p = V.pages(spark, sf).select("page_id", "title")
    some = p.filter(F.col("page_id") % 3 == 0)
    translations = some.select(F.col("page_id").alias("id"), F.lit("old").alias("title_zh"), F.lit(1).alias("ord")).unionByName(
        some.select(F.col("page_id").alias("id"), V.text("译 ", F.col("title")).alias("title_zh"), F.lit(2).alias("ord")))
    return J.translation_by_id(p, translations, "page_id").select("page_id", "title_zh")


@query("translation_by_pos", f"""WITH {V.PAGES_SQL}
SELECT page_id, CASE WHEN (page_id // 10) % 3 = 0 THEN title ELSE '译 ' || title END AS title_zh FROM pages_v""")
def translation_by_pos(spark, sf):
    """Runs of ten pages; every third run's translations miss one text and are ignored."""
    p = V.pages(spark, sf).select("page_id", F.expr("page_id div 10").alias("run"), "title")
    texts = p.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(
        "page_id", V.text("译 ", F.col("title")).alias("t")))).alias("x")).select(
        "run", F.transform("x", lambda s: s["t"]).alias("texts"))
    texts = texts.withColumn("texts", F.when(F.col("run") % 3 == 0, F.slice("texts", 2, 100)).otherwise(F.col("texts")))
    return J.translation_by_pos(p, texts, ["run"], ["page_id"], "title", "title_zh").select("page_id", "title_zh")


@query("selection_join", f"""WITH {V.ITEMS_SQL}
SELECT strftime(i.report_date, '%Y-%m-%d') AS report_date, q.item_ord AS request_ord, i.category || ':' || i.id AS selection, i.title
FROM items q JOIN items i ON i.report_date = q.report_date AND i.category = q.category AND i.id = CAST(q.item_ord // 2 * 2 AS VARCHAR)""")
def selection_join(spark, sf):
    """Each page asks for the even page at or before it in its own category and date; many do not exist."""
    items = V.items(spark, sf)
    asked = items.select("report_date", F.col("item_ord").alias("request_ord"), V.text(
        F.col("category"), ":", F.expr("item_ord div 2 * 2")).alias("selection"))
    return J.selection_join(asked, items, [F.col("item_ord")]).select(
        day().alias("report_date"), "request_ord", "selection", "title")


@query("allowed_url_check", f"""WITH {V.MD_SQL},
links AS (SELECT doc_id, url AS page, unnest({links_sql('body')}) AS m FROM md_docs),
u AS (SELECT doc_id, page, {Q.clean_url(f'regexp_extract(m, {_LINK}, 2)')} AS url FROM links)
SELECT doc_id, url FROM u WHERE NOT (doc_id % 2 = 0 AND {Q.norm_link('url')} = {Q.norm_link('page')})
  AND NOT regexp_matches(url, '^https://src[.]example[.]org/')""")
def allowed_url_check(spark, sf):
    docs = V.md_docs(spark, sf)
    allowed = docs.filter(F.col("doc_id") % 2 == 0).select("doc_id", "url")
    return J.allowed_url_check(docs.select("doc_id", "body"), allowed, ("https://src.example.org",)).select("doc_id", "url")


def plan_requests(spark, sf):
    """Every conversation turn as a plan request; projects, roles and goals vary."""
    c = V.table(spark, sf, "conversations")
    n = F.col("conv_id") + F.col("turn")

    def option(field):
        values = RQ.REQUEST_ENUMS[field]
        return F.array(*[F.lit(v) for v in values])[(n % len(values)).cast("int")].alias(field)

    return c.select("conv_id", "turn", n.alias("n"), *[option(f) for f in RQ.REQUEST_ENUMS],
                    F.when(n % 2 == 0, F.trim("text")).otherwise("").alias("goal"))


def _options_sql(field, labels=None):
    values = RQ.REQUEST_ENUMS[field]
    return "CASE n % {} {} END".format(len(values), " ".join(
        f"WHEN {i} THEN {Q.literal((labels or {}).get(v, v))}" for i, v in enumerate(values)))


@query("catalog_enrich", f"""WITH r AS (SELECT conv_id, turn, conv_id + turn AS n, text FROM conversations),
v AS (SELECT conv_id, turn, {_options_sql('projectId', {'adna-aging-clocks': 'aDNA_aging_clocks', 'pd-biomarker-challenge-scoring': 'PDbiomarkerChallengeScoring'})} AS name,
  {_options_sql('role', RQ.ROLE_LABELS)} AS role, {_options_sql('direction', RQ.DIRECTION_LABELS)} AS direction,
  CASE WHEN n % 2 = 0 THEN trim(text) ELSE '' END AS goal FROM r)
SELECT conv_id, turn, name || '：7 天' || direction || '改造路线' AS title,
  coalesce(nullif(goal, ''), '把 ' || name || ' 做成可核验的' || direction) || '。面向' || role || '，只展示公开项目事实、来源和学习路径，不处理真实生物或患者数据。' AS positioning,
  role || '|AI 与生命科学学习者|开源项目评估者' AS users, 7 AS days, '1:核实事实和边界' AS first_day FROM v""")
def catalog_enrich(spark, sf):
    plan = RQ.catalog_enrich(plan_requests(spark, sf), RQ.catalog(spark))
    return plan.select("conv_id", "turn", "plan.title", "plan.positioning", F.array_join("plan.targetUsers", "|").alias("users"),
                       F.size("plan.sevenDayPlan").alias("days"), F.concat(
                           F.col("plan.sevenDayPlan")[0]["day"].cast("string"), F.lit(":"),
                           F.col("plan.sevenDayPlan")[0]["goal"]).alias("first_day"))


# Aggregations.

@query("source_stats", f"""WITH {V.ITEMS_SQL}
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, category, count(*) AS total, CAST(count_if(has_media) AS BIGINT) AS media FROM items GROUP BY ALL""")
def source_stats(spark, sf):
    return A.source_stats(V.items(spark, sf)).withColumn("report_date", day())


@query("snapshot_counts", f"""WITH {_KEPT_SQL}
SELECT strftime(d.report_date, '%Y-%m-%d') AS report_date, c.category, count(k.id) AS n
FROM (SELECT DISTINCT report_date FROM items) d, (SELECT unnest(['news', 'project', 'paper', 'socialMedia']) AS category) c
LEFT JOIN kept k ON k.report_date = d.report_date AND k.category = c.category GROUP BY ALL""")
def snapshot_counts(spark, sf):
    return A.snapshot_counts(_gaps(spark, sf), V.run_dates(spark, sf)).withColumn("report_date", day())


def _visits(spark, sf):
    return A.clean_visits(V.visits(V.table(spark, sf, "events")))


@query("visitor_stats_total", f"WITH {V.VISITS_SQL} SELECT site, count(*) AS pageviews, count(DISTINCT visitor) AS visitors FROM visits GROUP BY 1")
def visitor_stats_total(spark, sf):
    return A.visitor_stats_total(_visits(spark, sf))


@query("visitor_stats_idle", f"""WITH {V.VISITS_SQL},
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY site, visitor ORDER BY ts) AS gap FROM visits)
SELECT site, count(*) AS pageviews, CAST(count_if(visitor IS NOT NULL AND (gap IS NULL OR gap > INTERVAL 1 DAY)) AS BIGINT) AS visitors FROM g GROUP BY 1""")
def visitor_stats_idle(spark, sf):
    """The idle rule with one day instead of a year."""
    return A.visitor_stats_total(_visits(spark, sf), idle_days=1)


@query("visitor_stats_daily", f"""WITH {V.VISITS_SQL}
SELECT site, strftime(day, '%Y-%m-%d') AS day, count(*) AS pageviews, count(DISTINCT visitor) AS visitors FROM visits GROUP BY ALL""")
def visitor_stats_daily(spark, sf):
    return A.visitor_stats_daily(_visits(spark, sf)).withColumn("day", day("day"))


@query("visitor_approx", f"WITH {V.VISITS_SQL} SELECT site, count(*) AS pageviews, true AS close FROM visits GROUP BY 1")
def visitor_approx(spark, sf):
    """Page views, and whether the estimate of visitors is within 5 % of their exact number."""
    exact = _visits(spark, sf).select("site", "visitor").distinct().groupBy("site").agg(F.count("visitor").alias("exact"))
    return A.visitor_approx(_visits(spark, sf)).join(exact, "site").select(
        "site", "pageviews", (F.abs(F.col("visitors") - F.col("exact")) * 20 <= F.col("exact")).alias("close"))


PERIODS = (("whole", "2024-01-01", "2024-02-01"), ("week", "2024-01-08", "2024-01-14"), ("third", "2024-01-11", "2024-01-20"))


@query("visitor_sketches", f"""WITH {V.VISITS_SQL},
p AS (SELECT * FROM (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)}) AS p(period, first_day, last_day)
  UNION ALL SELECT DISTINCT strftime(day, '%Y-%m-%d'), day, day FROM visits)
SELECT period, site, count(*) AS pageviews, true AS close FROM visits JOIN p ON day BETWEEN first_day AND last_day GROUP BY ALL""")
def visitor_sketches(spark, sf):
    """Stored sketches answer three ranges and every day; whether each estimate is within 5 % of the exact number."""
    path = work_path(spark, "sketches")
    visits = _visits(spark, sf)
    A.visitor_sketches(visits).write.partitionBy("day").parquet(path)
    sketches = spark.read.parquet(path)
    ranges = spark.createDataFrame(PERIODS, "period string, first string, last string").select(
        "period", F.col("first").cast("date").alias("first_day"), F.col("last").cast("date").alias("last_day"))
    each = sketches.select("day").distinct().select(day("day").alias("period"), F.col("day").alias("first_day"),
                                                    F.col("day").alias("last_day"))
    periods = ranges.unionByName(each)
    days = periods.select("period", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    exact = A.visitor_days(visits).select("site", "visitor", "day").join(days, "day").groupBy("period", "site").agg(
        F.count_distinct("visitor").alias("exact"))
    return A.visitors_over(sketches, periods).join(exact, ["period", "site"]).select(
        "period", "site", "pageviews", (F.abs(F.col("visitors") - F.col("exact")) * 20 <= F.col("exact")).alias("close"))


@query("run_summary", """WITH r AS (SELECT o_custkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status FROM orders)
SELECT run_id, CAST(count_if(status = 'success') AS BIGINT) AS success_count, CAST(count_if(status = 'failed') AS BIGINT) AS failed_count,
  CAST(count_if(status = 'skipped') AS BIGINT) AS skipped_count,
  count_if(status = 'failed') = 0 OR count_if(status = 'success') > 0 OR count_if(status = 'skipped') = count(*) AS success FROM r GROUP BY 1""")
def run_summary(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return A.run_summary(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), status.alias("status")))


@query("main_site_links", f"""WITH {V.MD_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_links, doc_id % 3 = 0 AS too_many FROM md_docs""")
def main_site_links(spark, sf):
    from ..operators.gates import GatePolicy, main_site_links as count_links
    policy = GatePolicy(main_origins=("https://www.shop.example.org", "https://shop.example.org"))
    links = F.when(F.col("doc_id") % 3 == 0, "[a](https://shop.example.org/1) [b](https://www.shop.example.org) ![i](https://shop.example.org/i.png)")
    n = count_links(F.concat("body", F.coalesce(links, F.lit(""))), policy)
    return V.md_docs(spark, sf).select("doc_id", n.alias("n_links"), (n > 1).alias("too_many"))


@query("home_pointer", """WITH r AS (SELECT o_orderkey AS run_ord, CAST(o_orderdate AS DATE) AS report_date FROM orders),
b AS (SELECT *, max(report_date) OVER (ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT run_ord, before IS NULL OR report_date >= before AS moved, strftime(greatest(report_date, coalesce(before, report_date)), '%Y-%m-%d') AS pointer FROM b""")
def home_pointer(spark, sf):
    runs = V.reports(spark, sf).select(F.col("ord").alias("run_ord"), "report_date")
    return A.home_pointer(runs).select("run_ord", "moved", day("pointer").alias("pointer"))


@query("rate_limit_decision", """SELECT event_id AS request_id, row_number() OVER (PARTITION BY user_id % 3, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events""")
def rate_limit_decision(spark, sf):
    return A.rate_limit_decision(V.requests(V.table(spark, sf, "events")), 1).select("request_id", "allowed")


@query("rate_limit_hourly", """SELECT event_id AS request_id, row_number() OVER (PARTITION BY user_id % 3, date_trunc('hour', ts) ORDER BY ts, event_id) <= 5 AS allowed FROM events""")
def rate_limit_hourly(spark, sf):
    """The default limit over hours, where it rejects."""
    return A.rate_limit_decision(V.requests(V.table(spark, sf, "events")), 5, period="hour").select("request_id", "allowed")


@query("url_set_union", f"""WITH {V.MD_SQL}, f AS (SELECT doc_id, list_prepend(url, {_URLS}) AS urls FROM md_docs)
SELECT doc_id, array_to_string(list_transform(list_filter(generate_series(1, len(urls)), lambda i: list_position(urls, urls[i]) = i), lambda i: urls[i]), '|') AS urls FROM f""")
def url_union(spark, sf):
    docs = V.md_docs(spark, sf).select("doc_id", F.array("url").alias("allowed_urls"), F.col("body").alias("daily_content"))
    return url_set_union(docs).select("doc_id", F.array_join("urls", "|").alias("urls"))


# The whole daily selection: cap, greedy de-duplication (recursive), quotas.
DAILY_SQL = "WITH RECURSIVE " + KEYED_SQL + """,
best AS (SELECT k.*, r.rank, r.category_ord FROM keyed k JOIN ranked r USING (item_ord) WHERE r.rank <= 30),
seq AS (SELECT *, row_number() OVER (ORDER BY report_date, category_ord, rank) AS n FROM best),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR, d DATE)[]) AS kept, false AS keep
  UNION ALL
  SELECT s.n, CASE WHEN b.hit THEN w.kept ELSE list_concat(w.kept, list_filter([{'k': 'u' || s.url_key, 'd': s.report_date}, {'k': 't' || s.title_key, 'd': s.report_date}], lambda x: x.k IS NOT NULL)) END, NOT b.hit
  FROM walk w JOIN seq s ON s.n = w.n + 1, LATERAL (SELECT len(list_filter(w.kept, lambda x:
    (x.k = 'u' || s.url_key OR x.k = 't' || s.title_key) AND date_diff('day', x.d, s.report_date) <= 7)) > 0 AS hit) b),
cands AS (SELECT report_date, category, category_ord, rank, coalesce(nullif(url, ''), category || ':' || title) AS key, has_media, published_at, id
  FROM seq JOIN walk USING (n) WHERE keep),""" + selection_sql("cands", 18) + """
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, pick, category, key FROM picked"""


@query("daily_report", DAILY_SQL)
def daily_report(spark, sf):
    return daily_selection(V.items(spark, sf)).select(
        day().alias("report_date"), F.col("pick").cast("long").alias("pick"), "category", "key")
