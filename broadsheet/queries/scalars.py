"""Column functions, each as one projection over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import PLAN_REPLY_MAX
from ..functions import dates as D, hashes as X, html as H, markdown as M, text as T, urls as U
from . import sqltext as Q, views as V
from .registry import query

PAGES = "pages"
BLANKS = "\n{3,}"


def _page(fn, column="html", out="value"):
    def run(spark, sf):
        return V.table(spark, sf, PAGES).select("page_id", fn(F.col(column)).alias(out))
    return run


def _doc(fn, out="value"):
    def run(spark, sf):
        return V.md_docs(spark, sf).select("doc_id", fn(F.col("body")).alias(out))
    return run


def _joined(array):
    return F.array_join(array, "|")


ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
query("strip_html", f"SELECT page_id, {Q.strip_html('html')} AS value FROM pages")(_page(H.strip_html))
query("minify_html", f"SELECT page_id, {Q.trim(Q.sub('html', '>' + Q.SPACE + '+<', '><'))} AS value FROM pages")(_page(H.minify_html))
query("escape_html", f"SELECT page_id, {ESCAPED} AS value FROM pages")(_page(H.escape_html))


@query("strip_media_tags", f"WITH {V.ITEMS_SQL} SELECT id, html || 'a  b' AS value FROM pages JOIN items ON page_id = item_ord")
def strip_media_tags(spark, sf):
    media = '<img src="x">a <video src="y">z\nz</video> b<video src="q"/>'
    return V.table(spark, sf, PAGES).select(
        F.col("page_id").cast("string").alias("id"), H.strip_media_tags(V.text(F.col("html"), media)).alias("value"))


@query("decode_entities", f"""WITH {V.PAGES_SQL} SELECT page_id, {V.DECODED.format('title')} || ' <b>' AS value FROM pages_v""")
def decode_entities(spark, sf):
    coded = F.col("title")
    for plain, entity in (("e", "&#101;"), ("a", "&#x61;"), ("u", "&#X75;")):
        coded = F.replace(coded, F.lit(plain), F.lit(entity))
    # Entity names inside the title must stay readable.
    for plain, entity in (("&&#x61;mp;", "&amp;"), ("&q&#X75;ot;", "&quot;")):
        coded = F.replace(coded, F.lit(plain), F.lit(entity))
    return V.pages(spark, sf).select("page_id", H.decode_entities(V.text(coded, "<![CDATA[ <b>]]>")).alias("value"))


def blocks(spark, sf):
    p = V.pages(spark, sf)
    return p.select("page_id", V.text(
        '<TITLE type="html">', F.col("title"), "</TITLE><name> ", F.col("host"), " </name><name>Two</name>",
        '<link rel="x" href="', F.replace("url", F.lit("&"), F.lit("&amp;")), '"/><content:encoded>x</content:encoded>',
        F.when(F.col("page_id") % 3 == 0, V.text('<enclosure length="1" url="http://img.example.com/', F.col("page_id"),
                                                 '.mp3"/>')).otherwise("<img alt='' src='/local.png'>"),
        '<p><a class="c" href="', F.col("url"), '">first</a><a href="second">s</a></p>').alias("block"))


query("xml_tag", f"WITH {V.PAGES_SQL} SELECT page_id, {V.DECODED.format(Q.trim('title'))} AS value, 'x' AS other FROM pages_v")(
    lambda spark, sf: blocks(spark, sf).select("page_id", H.xml_tag("block", "missing", "title").alias("value"),
                                               H.xml_tag("block", "summary", "content", "content:encoded").alias("other")))
query("xml_all_tags", f"WITH {V.PAGES_SQL} SELECT page_id, host || '|Two|x' AS value FROM pages_v")(
    lambda spark, sf: blocks(spark, sf).select("page_id", _joined(H.xml_all_tags("block", "name", "content:encoded")).alias("value")))
query("xml_attr", "SELECT page_id, url AS value FROM pages")(
    lambda spark, sf: blocks(spark, sf).select("page_id", H.xml_attr("block", "link", "href").alias("value")))
query("image_url", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://img.example.com/' || page_id || '.mp3'
  ELSE '/local.png' END AS value FROM pages""")(
    lambda spark, sf: blocks(spark, sf).select("page_id", H.image_url("block").alias("value")))
query("first_link", "SELECT page_id, replace(url, '&amp;', '&') AS value FROM pages")(
    lambda spark, sf: blocks(spark, sf).select("page_id", H.first_link("block").alias("value")))

query("norm_url_dedupe", f"SELECT page_id, {Q.norm_url('url')} AS value FROM pages")(_page(U.norm_url_dedupe, "url"))
query("norm_title_dedupe", f"SELECT doc_id, {Q.norm_title('body')} AS value FROM ({'WITH ' + V.MD_SQL + ' SELECT * FROM md_docs'})")(
    _doc(U.norm_title_dedupe))
query("clean_url", f"SELECT page_id, url AS value FROM pages")(
    lambda spark, sf: V.table(spark, sf, PAGES).select("page_id", U.clean_url(V.text(" ", F.col("url"), "),。； ")).alias("value")))
query("norm_url_link", f"SELECT page_id, {Q.norm_link('url')} AS value FROM pages")(_page(U.norm_url_link, "url"))


@query("is_image_url", """SELECT page_id, page_id % 4 IN (0, 2) AS value FROM pages""")
def is_image_url(spark, sf):
    n = F.col("page_id") % 4
    image = V.text("https://a.example.org/", F.col("page_id"), ".webp?x=1")
    url = F.when(n == 0, image).when(n == 1, V.text("https://a.example.org/", F.col("page_id"), ".html")).when(
        n == 2, V.text("https://images.weserv.nl/?url=", F.url_encode(image))).otherwise(
        V.text("https://images.weserv.nl/?url=https%3A%2F%2Fa.example.org%2F", F.col("page_id")))
    return V.table(spark, sf, PAGES).select("page_id", U.is_image_url(url).alias("value"))


_URLS = f"list_transform(regexp_extract_all(body, '(?i)https?://[^{Q.SPACE[1:-1]})<>\"'']+'), lambda u: {Q.clean_url('u')})"
query("extract_urls", f"""WITH {V.MD_SQL}, found AS (SELECT doc_id, {_URLS} AS urls FROM md_docs)
SELECT doc_id, array_to_string(list_transform(list_filter(generate_series(1, len(urls)), lambda i: list_position(urls, urls[i]) = i),
  lambda i: urls[i]), '|') AS value FROM found""")(_doc(lambda c: _joined(M.extract_urls(c))))
_TARGET = r"\((https?://[^" + Q.SPACE[1:-1] + r")]+)(?:" + Q.SPACE + r"+[\"'][^\"']+[\"'])?\)"
_ANY = Q.literal(r"(?i)!?\[[^\]]+\]" + _TARGET)
_LINK = Q.literal(r"(?i)\[([^\]]+)\]" + _TARGET)
_IMAGE = Q.literal(r"(?i)!\[([^\]]*)\]" + _TARGET)


def links_sql(body: str) -> str:
    return f"list_filter(regexp_extract_all({body}, {_ANY}), lambda m: NOT starts_with(m, '!'))"


query("md_links", f"""WITH {V.MD_SQL} SELECT doc_id, array_to_string(list_transform({links_sql('body')},
  lambda m: {Q.trim(f'regexp_extract(m, {_LINK}, 1)')} || '>' || {Q.clean_url(f'regexp_extract(m, {_LINK}, 2)')}), '|') AS value FROM md_docs""")(
    _doc(lambda c: _joined(F.transform(M.md_links(c), lambda x: F.concat(x["text"], F.lit(">"), x["url"])))))
query("md_images", f"""WITH {V.MD_SQL} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(body, {_IMAGE}),
  lambda m: {Q.trim(f'regexp_extract(m, {_IMAGE}, 1)')} || '>' || {Q.clean_url(f'regexp_extract(m, {_IMAGE}, 2)')}), '|') AS value FROM md_docs""")(
    _doc(lambda c: _joined(F.transform(M.md_images(c), lambda x: F.concat(x["alt"], F.lit(">"), x["url"])))))
query("strip_markdown", f"WITH {V.MD_SQL} SELECT doc_id, {Q.strip_markdown('body')} AS value FROM md_docs")(_doc(M.strip_markdown))


@query("placeholders_to_md", f"""SELECT doc_id, '![AI资讯图片](https://e.example.org/' || doc_id || '.png) ![a b](http://e.example.org/x) <video controls preload="metadata" playsinline style="max-width:100%; height:auto;" src="https://e.example.org/v.mp4"></video>[视频](https://e.example.org/v)[图片: local.png]' || chr(10) || text AS value FROM documents""")
def placeholders(spark, sf):
    head = V.text("[图片: https://e.example.org/", F.col("doc_id"), ".png] [图片:  a  b http://e.example.org/x ] "
                  "[视频: v https://e.example.org/v.mp4][视频: https://e.example.org/v][图片: local.png]\n", F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", M.placeholders_to_md(head).alias("value"))


# Line operators: the SQL works on exploded lines with windows, the columns on arrays inside the row.
LINES_SQL = f"""split_lines AS (
  SELECT doc_id, unnest(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10))) AS line,
    generate_subscripts(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM md_docs)"""
NUMBERED_SQL = f"""{LINES_SQL},
flags AS (SELECT *, {Q.has('line', '(?i)^##' + Q.SPACE + r'*\*\*.*TOP' + Q.SPACE + r'+\d+')} AS is_top, {Q.has('line', '^##' + Q.SPACE + '+')} AS is_h2,
  {Q.has('line', '^###' + Q.SPACE + '+.+$')} AS is_h3, {Q.has('line', '^###' + Q.SPACE + r'+\d+\.' + Q.SPACE + '+')} AS is_done FROM split_lines),
sections AS (SELECT *, sum(CASE WHEN is_top OR is_h2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM flags),
tops AS (SELECT *, max(CASE WHEN is_top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section) AS in_top,
  sum(CASE WHEN is_h3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY n) AS k FROM sections),
numbered AS (SELECT doc_id, string_agg(CASE WHEN in_top = 1 AND is_h3 AND NOT is_done
    THEN regexp_extract(line, '^###{Q.SPACE}+') || k || '. ' || {Q.sub('line', '^###' + Q.SPACE + '+', '', 'c')} ELSE line END,
  chr(10) ORDER BY n) AS value FROM tops GROUP BY doc_id)"""
query("top_numbering", f"WITH {V.MD_SQL}, {NUMBERED_SQL} SELECT doc_id, value FROM numbered")(_doc(M.top_numbering))
_MARK = "## **今日 AI 资讯**"
query("normalize_body", f"""WITH {V.MD_SQL}, {NUMBERED_SQL}
SELECT doc_id, {Q.trim(f"substr(value, instr(value, '{_MARK}'))")} AS value FROM numbered""")(_doc(M.normalize_body))
TOC_SQL = f"""{LINES_SQL.replace("replace(body, chr(13) || chr(10), chr(10))", "body")},
toc_flags AS (SELECT *, {Q.has(Q.trim('line'), '(?i)^#{2,3}' + Q.SPACE + '*(Table of contents|目录)$')} AS is_toc,
  {Q.trim('line')} = '' OR {Q.has('line', '^' + Q.SPACE + r'*([-*+]|\d+\.)' + Q.SPACE + r'+\[[^\]]+\]\(#[^)]+\)')} AS skippable FROM split_lines),
toc_runs AS (SELECT *, last_value(CASE WHEN is_toc THEN 'toc' WHEN NOT skippable THEN 'text' END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY n) AS state FROM toc_flags),
no_toc AS (SELECT doc_id, {Q.trim(Q.sub("kept", BLANKS, chr(10) + chr(10)))} AS value FROM (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n)
  FILTER (WHERE coalesce(state, 'text') = 'text' AND NOT is_toc), '') AS kept FROM toc_runs GROUP BY doc_id))"""
query("drop_toc", f"WITH {V.MD_SQL}, {TOC_SQL} SELECT doc_id, value FROM no_toc")(_doc(M.drop_toc))


@query("normalize_markdown", f"""WITH {V.MD_SQL}, {TOC_SQL},
cut AS (SELECT doc_id, url, replace(value, '![other](https://bad.example.com/x.png)', '') AS value FROM no_toc JOIN md_docs USING (doc_id))
SELECT doc_id, {Q.trim(Q.sub("replace(value, '![page](' || url || ')', '[page](' || url || ')')", BLANKS, chr(10) + chr(10)))} AS value FROM cut""")
def normalize_markdown(spark, sf):
    """The page and its picture are allowed; the page is no image and becomes a link."""
    allowed = F.array(F.col("url"), V.text("http://img.example.com/", F.col("doc_id"), ".jpg#x"))
    return V.md_docs(spark, sf).select("doc_id", M.normalize_markdown("body", allowed, ("https://github.com",)).alias("value"))


@query("unwrap_code_fence", f"SELECT doc_id, {Q.trim('text')} AS value FROM documents")
def unwrap(spark, sf):
    fence = F.when(F.col("doc_id") % 2 == 0, V.text("intro ```markdown\n", F.col("text"), "\n``` tail")).otherwise(
        V.text(" ", F.col("text"), "\n"))
    return V.table(spark, sf, "documents").select("doc_id", T.unwrap_code_fence(fence).alias("value"))


@query("json_object_slice", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN {Q.units("('x {\"t\": ' || to_json(text) || '} y')")} > {PLAN_REPLY_MAX} THEN NULL
  ELSE '{{"t":' || to_json(text) || '}}' END AS value FROM documents""".replace("('x {\"t\": '", "('x {\"t\":'"))
def json_slice(spark, sf):
    body = F.to_json(F.struct(F.col("text").alias("t")))
    reply = F.when(F.col("doc_id") % 3 > 0, V.text("x ", body, " y")).otherwise(V.text("} ", "no object", " {"))
    return V.table(spark, sf, "documents").select("doc_id", T.json_object_slice(reply, PLAN_REPLY_MAX).alias("value"))


@query("plan_reply_slice", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR {Q.units("('x {\"t\":' || to_json(text) || '} y')")} > {PLAN_REPLY_MAX} THEN NULL
  ELSE '{{"t":' || to_json(text) || '}}' END AS value FROM documents""")
def plan_reply_slice(spark, sf):
    """The slice with the limit that replies have."""
    body = F.to_json(F.struct(F.col("text").alias("t")))
    reply = F.when(F.col("doc_id") % 3 > 0, V.text("x ", body, " y")).otherwise(V.text("} ", "no object", " {"))
    return V.table(spark, sf, "documents").select("doc_id", T.json_object_slice(reply, PLAN_REPLY_MAX).alias("value"))


@query("split_title_body", f"""WITH t AS (SELECT doc_id, text, {Q.trim(Q.sub("CASE WHEN doc_id % 2 = 0 THEN 'A proper title ' || doc_id ELSE 'Bad' END", '"', ''))} AS head FROM documents)
SELECT doc_id, CASE WHEN length(head) > 34 OR length(head) < 6 THEN 'Fallback' ELSE head END AS title, {Q.trim('text')} AS body FROM t""")
def split_title(spark, sf):
    head = F.when(F.col("doc_id") % 2 == 0, V.text('## "A proper title ', F.col("doc_id"), '"')).otherwise("Bad")
    title, body = T.split_title_body(V.text(head, "\n\n \n", F.col("text")), F.lit("Fallback"))
    return V.table(spark, sf, "documents").select("doc_id", title.alias("title"), body.alias("body"))


_PARTS = f"list_transform(string_split_regex(body, '\\n{{2,}}'), lambda p: {Q.trim('p')})"
_BAD = r"^#{1,6}" + Q.SPACE + r"|^[-*_]{3,}$|^>" + Q.SPACE + r"|^!\[[^\]]*\]\([^)]+\)$|(?i:^Table of contents$)"
query("derive_description", f"""WITH {V.MD_SQL}, first AS (SELECT doc_id, coalesce(list_filter({_PARTS},
  lambda p: p <> '' AND NOT {Q.has('p', _BAD)} AND {Q.units(Q.strip_markdown('p'))} >= 20)[1], title) AS part FROM md_docs),
plain AS (SELECT doc_id, {Q.strip_markdown('part')} AS d FROM first)
SELECT doc_id, CASE WHEN {Q.units('d')} > 120 THEN substr(d, 1, 117) || '...' ELSE d END AS value FROM plain""")(
    lambda spark, sf: V.md_docs(spark, sf).select("doc_id", M.derive_description("body", F.col("title")).alias("value")))


@query("strip_front_matter", "SELECT doc_id, text AS value FROM documents")
def front_matter(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.strip_front_matter(V.text(
        "---\ntitle: ", F.col("source"), "\nweight: 3\n---\n", F.col("text"))).alias("value"))


def _events(spark, sf):
    return V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


query("shanghai_date", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS value FROM events")(
    lambda spark, sf: _events(spark, sf).select("event_id", F.date_format(D.shanghai_date("ts"), "yyyy-MM-dd").alias("value")))
query("shift_date", "SELECT event_id, strftime(CAST(ts + INTERVAL 8 HOUR AS DATE) - INTERVAL 7 DAY, '%Y-%m-%d') AS value FROM events")(
    lambda spark, sf: _events(spark, sf).select("event_id", F.date_format(
        D.shift_date(D.shanghai_date("ts"), -7), "yyyy-MM-dd").alias("value")))
query("date_formats", """SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y/%-m/%-d') AS zh, strftime(ts + INTERVAL 8 HOUR, '%Y/%-m/%-d %H:%M:%S') AS zh_time,
  strftime(ts, '%Y/%-m/%-d %H:%M:%S') AS gmt, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS rfc FROM events""")(
    lambda spark, sf: _events(spark, sf).select("event_id", D.zh_date("ts").alias("zh"), D.zh_date_time("ts").alias("zh_time"),
                                                D.gmt_date_time("ts").alias("gmt"), D.rfc822("ts").alias("rfc")))


@query("parse_pub_date", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS value FROM events")
def parse_pub_date(spark, sf):
    n = F.col("event_id") % 5
    local = D.local_time("ts")
    raw = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        n == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(
        n == 2, F.concat(F.date_format(local, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0800"))).when(
        n == 3, F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).otherwise("yesterday")
    return _events(spark, sf).select("event_id", F.unix_seconds(D.parse_pub_date(raw)).alias("value"))


_CODES = "list_transform(string_split(v, ''), lambda c: CAST(unicode(c) AS HUGEINT))"
query("fnv1a_base36", f"""WITH v AS (SELECT event_id, event_type || ':visitor-' || user_id AS v FROM events)
SELECT event_id, lower(to_base(CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), {_CODES}),
  lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT), 36)) AS value FROM v""")(
    lambda spark, sf: _events(spark, sf).select("event_id", X.fnv1a_base36(
        V.text(F.col("event_type"), ":visitor-", F.col("user_id"))).alias("value")))
query("client_hash", "SELECT event_id, substr(sha256('client-' || user_id), 1, 24) AS value FROM events")(
    lambda spark, sf: _events(spark, sf).select("event_id", X.client_hash(V.text("client-", F.col("user_id"))).alias("value")))
query("domain_rewrite", f"""WITH {V.MD_SQL} SELECT doc_id, replace(replace(body, 'img.example.com', 'pic.example.com'),
  'http://pic.example.com', 'https://proxy.example.org/?pp=http://pic.example.com') AS value FROM md_docs""")(
    _doc(lambda c: T.replace_all(c, (("img.example.com", "pic.example.com"),
                                     ("http://pic.example.com", "https://proxy.example.org/?pp=http://pic.example.com")))))
_TRIMMED = f"list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {Q.trim('x')}), lambda x: x <> '')"
query("last_three_lines", f"""SELECT doc_id, CASE WHEN len({_TRIMMED}) <= 3 THEN {Q.trim('text')}
  ELSE array_to_string(list_slice({_TRIMMED}, -3, -1), chr(10)) END AS value FROM documents""")(
    lambda spark, sf: V.table(spark, sf, "documents").select("doc_id", T.last_three_lines("text").alias("value")))
