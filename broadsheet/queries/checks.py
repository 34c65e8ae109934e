"""Quality gates and request validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import (AI_SIGNALS, BIO_SIGNALS, BLACKHAT, DIRECTIVES, FABRICATED_TODAY, MATERIAL_GROUPS,
                            REQUEST_ENUMS)
from ..functions.markdown import strip_markdown
from ..operators import gates as G, requests as RQ
from . import sqltext as Q, views as V
from .registry import query
from .scalars import _IMAGE, _LINK, _URLS, links_sql
from .tables import _options_sql, plan_requests

POLICY = G.GatePolicy(main_origins=("https://shop.example.com",), kind_signals=(("bio-daily", BIO_SIGNALS),))


def _any(x, patterns):
    return "(" + " OR ".join(Q.has(x, p) for p in patterns) + ")"


def _rules(x, rules):
    return _any(x, [pattern for _, pattern in rules])


def _words(x, words):
    return Q.has(x, "(?i)" + "|".join(words))


def _list(cases):
    """SQL list of the codes whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {code} END" for cond, code in cases) + "], lambda x: x IS NOT NULL)"


query("gate_directives", f"""WITH {V.DRAFTS_SQL}
SELECT doc_id, array_to_string({_list([(Q.has('body', p), Q.literal(c)) for c, _, p in DIRECTIVES])}, ',') AS codes FROM drafts""")(
    lambda spark, sf: G.gate_directives(V.drafts(spark, sf), "body").select("doc_id", F.array_join("codes", ",").alias("codes")))
query("gate_quarantine", f"WITH {V.DRAFTS_SQL} SELECT doc_id, {_any('body', [p for _, _, p in DIRECTIVES])} AS held FROM drafts")(
    lambda spark, sf: (lambda parts: parts[0].select("doc_id", F.lit(False).alias("held")).unionByName(
        parts[1].select("doc_id", F.lit(True).alias("held"))))(G.quarantine(V.drafts(spark, sf), "body")))
query("gate_blackhat", f"WITH {V.DRAFTS_SQL} SELECT doc_id, {_rules('body', BLACKHAT)} AS flagged FROM drafts")(
    lambda spark, sf: V.drafts(spark, sf).select("doc_id", G.has_blackhat("body").alias("flagged")))

PLAIN_SQL = f"{V.DRAFTS_SQL}, plain AS (SELECT *, {Q.strip_markdown('body')} AS p FROM drafts)"
SENTENCES_SQL = f"""{PLAIN_SQL},
sentences AS (SELECT *, list_transform(regexp_extract_all(p, '[^。！？!?]*[。！？!?]|[^。！？!?]+$'), lambda s: {Q.units(Q.trim('s'))}) AS sizes FROM plain),
counted AS (SELECT *, len(list_filter(sizes, lambda n: n >= 90 AND n < 170)) AS warn, len(list_filter(sizes, lambda n: n >= 170))
  + CASE WHEN len(list_filter(sizes, lambda n: n >= 90 AND n < 170)) >= 6 THEN 1 ELSE 0 END AS grave FROM sentences)"""


@query("gate_long_sentences", f"WITH {SENTENCES_SQL} SELECT doc_id, warn, grave FROM counted")
def gate_long_sentences(spark, sf):
    rows = V.drafts(spark, sf).select("doc_id", strip_markdown("body").alias("p"))
    found = rows.withColumn("s", G.long_sentences(F.col("p")))
    return found.select("doc_id", F.col("s.warn").cast("long").alias("warn"), F.col("s.severe").cast("long").alias("grave"))


MATERIAL_SQL = " + ".join(f"CAST({_words('p', g)} AS INT)" for g in MATERIAL_GROUPS)
query("gate_materials", f"WITH {PLAIN_SQL} SELECT doc_id, {MATERIAL_SQL} >= 2 AS present FROM plain")(
    lambda spark, sf: V.drafts(spark, sf).select("doc_id", strip_markdown("body").alias("p")).select(
        "doc_id", (G.material_count(F.col("p")) >= 2).alias("present")))
query("gate_fabricated", f"WITH {PLAIN_SQL} SELECT doc_id, {_rules('p', FABRICATED_TODAY)} AS flagged FROM plain")(
    lambda spark, sf: V.drafts(spark, sf).select("doc_id", strip_markdown("body").alias("p")).select(
        "doc_id", G.has_fabricated_claim(F.col("p")).alias("flagged")))

SIGNALS_SQL = f"""
sig_lines AS (SELECT doc_id, blog_type, unnest(string_split_regex(daily_content, '\\n+')) AS raw,
  generate_subscripts(string_split_regex(daily_content, '\\n+'), 1) AS n FROM drafts),
sig_clean AS (SELECT doc_id, blog_type, n, {Q.trim(Q.sub('raw', '^#+' + Q.SPACE + '*', '', 'c'))} AS line FROM sig_lines),
sig_kept AS (SELECT doc_id, n, line FROM sig_clean WHERE {Q.units('line')} BETWEEN 12 AND 420
  AND CASE blog_type WHEN 'bio-daily' THEN {_words('line', BIO_SIGNALS)} ELSE {_words('line', AI_SIGNALS)} END
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY n) = 1),
sig_first AS (SELECT * FROM sig_kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 6),
signals AS (SELECT d.doc_id, coalesce(string_agg(line, '|' ORDER BY n), '') AS signals, count(line) AS n_signals
  FROM drafts d LEFT JOIN sig_first USING (doc_id) GROUP BY 1)"""


@query("line_signals", f"WITH {V.DRAFTS_SQL}, {SIGNALS_SQL} SELECT doc_id, signals FROM signals")
def line_signals(spark, sf):
    return V.drafts(spark, sf).select(
        "doc_id", F.array_join(G.line_signals("daily_content", F.col("blog_type"), POLICY), "|").alias("signals"))


_SHORT = f"{Q.units(Q.trim('daily_content'))} < 200"
REASON_SQL = f"""CASE WHEN {_SHORT} THEN 'daily content missing or too short' WHEN n_signals = 0 THEN 'no usable trigger tied to known materials' END"""


@query("qualify_document", f"""WITH {V.DRAFTS_SQL}, {SIGNALS_SQL}
SELECT doc_id, {REASON_SQL} AS reason, {REASON_SQL} IS NULL AS eligible, CASE WHEN {_SHORT} THEN '' ELSE signals END AS signals
FROM drafts JOIN signals USING (doc_id)""")
def qualify_document(spark, sf):
    rows = G.qualify_document(V.drafts(spark, sf), POLICY)
    return rows.select("doc_id", "reason", "eligible", F.array_join("signals", "|").alias("signals"))


_ALLOWED_ORIGIN = "regexp_matches(u, '^https://(github[.]com|shop[.]example[.]com)(/|$)')"
_IMAGES = f"list_transform(regexp_extract_all(body, {_IMAGE}), lambda m: {Q.clean_url(f'regexp_extract(m, {_IMAGE}, 2)')})"
_BODY_LINKS = f"list_transform({links_sql('body')}, lambda m: {Q.clean_url(f'regexp_extract(m, {_LINK}, 2)')})"
VALID_SQL = f"""{SENTENCES_SQL}, {SIGNALS_SQL},
allowed AS (SELECT *, list_transform(list_concat(CAST(allowed_urls AS VARCHAR[]), {_URLS.replace('(body,', '(daily_content,')}), lambda u: {Q.norm_link('u')}) AS ok_urls,
  {_BODY_LINKS} AS links, {_IMAGES} AS images FROM counted JOIN signals USING (doc_id)),
bad AS (SELECT *, list_filter(links, lambda u: NOT list_contains(ok_urls, {Q.norm_link('u')}) AND NOT {_ALLOWED_ORIGIN}) AS bad_links,
  list_filter(images, lambda u: (NOT list_contains(ok_urls, {Q.norm_link('u')}) AND NOT {_ALLOWED_ORIGIN})
    OR NOT {Q.has('u', '(?i)[.](png|jpe?g|webp|gif|avif|svg)([?]|#|$)')}) AS bad_images FROM allowed),
codes AS (SELECT *, {_list([
    (f"{Q.units(Q.trim('title'))} < 6 OR {Q.units('title')} > 34", "'bad_title_length'"),
    (Q.has('title', '(?i)^(今天|日报|AI 日报|AI 观察)'), "'fallback_or_daily_title'"),
    (f"{Q.units('p')} < 350", "'body_too_short'"),
    (Q.has('body', '(?i)Table of contents'), "'toc_visible'"),
    (f"{MATERIAL_SQL} < 2", "'missing_personal_material'"),
    (_rules('p', FABRICATED_TODAY), "'possible_fabricated_today_experience'"),
    (_rules('body', BLACKHAT), "'black_hat_llm_instruction'"),
    ("len(bad_links) > 0", "'unapproved_links:' || array_to_string(list_slice(bad_links, 1, 3), ',')"),
    ("len(bad_images) > 0", "'invalid_images:' || array_to_string(list_slice(bad_images, 1, 3), ',')"),
    ("len(list_filter(links, lambda u: regexp_matches(u, '^https://shop[.]example[.]com(/|$)'))) > 1", "'too_many_shop_links'"),
    ("grave > 0", "'severe_long_sentences:' || grave"),
    (f"{REASON_SQL} IS NOT NULL", f"'source_not_eligible:' || {REASON_SQL}")])} AS severe FROM bad)"""


@query("validate_document", f"""WITH {VALID_SQL}
SELECT doc_id, len(severe) = 0 AS ok, array_to_string(severe, ';') AS severe,
  CASE WHEN warn > 0 THEN 'long_sentences:' || warn ELSE '' END AS warnings, CASE WHEN {_SHORT} THEN '' ELSE signals END AS signals FROM codes""")
def validate_document(spark, sf):
    rows = G.validate_document(V.drafts(spark, sf), POLICY)
    return rows.select("doc_id", "gate.ok", F.array_join("gate.severe", ";").alias("severe"),
                       F.array_join("gate.warnings", ";").alias("warnings"), F.array_join("gate.signals", "|").alias("signals"))


def _request_json(spark, sf):
    """Requests as JSON; every eleventh kind has an unknown field, a bad option, a number as goal or no object."""
    rows = plan_requests(spark, sf)
    k = F.col("n") % 11
    good = {f: F.col(f) for f in (*REQUEST_ENUMS, "goal")}

    def body(**change):
        fields = {**good, **change}
        return F.to_json(F.struct(*[v.alias(name) for name, v in fields.items()]))

    text = (F.when(k == 1, body(biologicalData=F.lit("x"))).when(k == 2, body(role=F.lit("doctor"))).when(k == 3, body(goal=F.lit(5)))
            .when(k == 4, F.lit("[1]")).when(k == 5, F.lit("{not json")).when(k == 6, body(timeBudget=F.lit(2))).otherwise(body()))
    return rows.select("conv_id", "turn", text.alias("request"))


@query("validate_request", f"""WITH r AS (SELECT conv_id, turn, conv_id + turn AS n, text FROM conversations),
g AS (SELECT *, {Q.trim("CASE WHEN n % 2 = 0 THEN trim(text) ELSE '' END")} AS goal, {_options_sql('projectId')} AS project FROM r),
f AS (SELECT *, CASE n % 11 WHEN 1 THEN 'biologicalData' WHEN 2 THEN 'role' WHEN 3 THEN 'goal' WHEN 4 THEN 'request' WHEN 5 THEN 'request' WHEN 6 THEN 'timeBudget'
  ELSE CASE WHEN {Q.units('goal')} > 240 OR {Q.has('goal', r'(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z]{2,}|\b1[3-9][0-9]{9}\b|\b[0-9]{13,}\b')} THEN 'goal' END END AS field FROM g)
SELECT conv_id, turn, field IS NULL AS ok, field, CASE WHEN field IS NULL THEN goal END AS goal, CASE WHEN field IS NULL THEN project END AS project FROM f""")
def validate_request(spark, sf):
    rows = RQ.validate_request(_request_json(spark, sf))
    return rows.select("conv_id", "turn", "ok", "field", "value.goal", F.col("value.projectId").alias("project"))


@query("validate_request_repeated", f"""WITH r AS (SELECT conv_id, turn, conv_id + turn AS n, text FROM conversations),
g AS (SELECT *, {Q.trim("CASE WHEN n % 2 = 0 THEN trim(text) ELSE '' END")} AS goal, {_options_sql('projectId')} AS project FROM r),
f AS (SELECT *, CASE n % 11 WHEN 1 THEN 'biologicalData' WHEN 2 THEN 'role' WHEN 3 THEN 'goal' WHEN 4 THEN 'request' WHEN 5 THEN 'request' WHEN 6 THEN 'timeBudget'
  ELSE CASE WHEN {Q.units('goal')} > 240 OR {Q.has('goal', r'(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z]{2,}|\b1[3-9][0-9]{9}\b|\b[0-9]{13,}\b')} THEN 'goal' END END AS field FROM g)
SELECT conv_id, turn, field IS NULL AS ok, field, CASE WHEN field IS NULL THEN goal END AS goal, CASE WHEN field IS NULL THEN project END AS project FROM f""")
def validate_request_repeated(spark, sf):
    """Requests that give their goal and project twice, first wrongly: the last value of a key holds."""
    rows = _request_json(spark, sf).withColumn("request", F.regexp_replace(
        "request", r'\A\{"', '{"goal":7,"projectId":"none","'))
    return RQ.validate_request(rows).select("conv_id", "turn", "ok", "field", "value.goal", F.col("value.projectId").alias("project"))


def _plans(spark, sf):
    """Catalog plans as JSON, changed in one place by turn."""
    rows = RQ.catalog_enrich(plan_requests(spark, sf), RQ.catalog(spark))
    k = F.col("n") % 10
    plan = F.col("plan")
    none = F.array().cast("array<string>")
    changes = (
        (1, plan.withField("extra", F.lit(1))), (2, plan.withField("title", F.lit("  "))),
        (3, plan.withField("mvpFeatures", none)), (4, plan.withField("dataPlan", F.array(F.lit(1)))),
        (5, plan.withField("sevenDayPlan", F.slice(F.col("plan.sevenDayPlan"), 1, 6))),
        (6, plan.withField("disclaimer", F.lit("none"))),
        (7, plan.withField("mvpFeatures", F.array(F.lit("提供疾病诊断和治疗方案")))),
        (8, plan.dropFields("nonGoals")))
    text = F.when(k == 9, F.lit("[]"))
    for n, changed in changes:
        text = text.when(k == n, F.to_json(changed))
    # Goals are free text and may be long or unsafe; the positioning is checked with them.
    return rows.select("conv_id", "turn", text.otherwise(F.to_json(plan)).alias("plan"))


_PLAN_FIELD = f"""CASE WHEN n % 10 = 9 THEN 'plan' WHEN n % 10 = 1 THEN 'extra' WHEN n % 10 = 2 THEN 'title'
  WHEN {Q.units('positioning')} > 1000 THEN 'positioning' WHEN n % 10 = 6 THEN 'disclaimer' WHEN n % 10 = 3 THEN 'mvpFeatures'
  WHEN n % 10 = 8 THEN 'nonGoals' WHEN n % 10 = 4 THEN 'dataPlan' WHEN n % 10 = 5 THEN 'sevenDayPlan' WHEN n % 10 = 7 THEN 'plan' END"""
_POSITION_SQL = f"""p AS (SELECT conv_id, turn, conv_id + turn AS n, text FROM conversations),
v AS (SELECT *, {_options_sql('projectId', {'adna-aging-clocks': 'aDNA_aging_clocks', 'pd-biomarker-challenge-scoring': 'PDbiomarkerChallengeScoring'})} AS name,
  {_options_sql('role', RQ.ROLE_LABELS)} AS role, {_options_sql('direction', RQ.DIRECTION_LABELS)} AS direction FROM p),
w AS (SELECT *, coalesce(nullif(CASE WHEN n % 2 = 0 THEN trim(text) ELSE '' END, ''), '把 ' || name || ' 做成可核验的' || direction)
  || '。面向' || role || '，只展示公开项目事实、来源和学习路径，不处理真实生物或患者数据。' AS positioning FROM v)"""


@query("validate_plan", f"WITH {_POSITION_SQL}, f AS (SELECT conv_id, turn, {_PLAN_FIELD} AS field FROM w) SELECT conv_id, turn, field IS NULL AS ok, field FROM f")
def validate_plan(spark, sf):
    return RQ.validate_plan(_plans(spark, sf)).select("conv_id", "turn", "ok", "field")


# Phrases with and without a negator, appended in turn.
PHRASES = ("不提供疾病诊断、治疗结论", "提供疾病诊断和治疗方案", "不测算个人生物年龄", "预测用户生物年龄", "请勿上传；诊断疾病",
           "不得给出用药建议，诊断疾病", "普通文字")


@query("gate_medical", """SELECT doc_id, doc_id % 7 IN (1, 3, 4, 5) AS flagged FROM documents""")
def gate_medical(spark, sf):
    phrase = F.array(*[F.lit(p) for p in PHRASES])[(F.col("doc_id") % len(PHRASES)).cast("int")]
    return V.table(spark, sf, "documents").select("doc_id", RQ.gate_medical(F.concat("text", F.lit("。"), phrase)).alias("flagged"))


