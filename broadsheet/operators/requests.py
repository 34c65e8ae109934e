"""Validation of plan requests and plans, and the plan built from the catalog."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import plan_texts as P
from ..fixed_values import (DEPLOYMENT_LABELS, DIRECTION_LABELS, GOAL_MAX, MEDICAL_NEGATORS, MEDICAL_PHRASES,
                            MEDICAL_REACH, MEDICAL_STOPS, PLAN_DAYS, PLAN_DELIVERABLES_MAX, PLAN_DISCLAIMER,
                            PLAN_ITEM_MAX, PLAN_LIST_FIELDS, PLAN_LIST_MAX, PLAN_REPLY_MAX, PLAN_TEXT_FIELDS,
                            PLAN_TEXT_MAX, PRIVATE_DATA, REQUEST_ENUMS, ROLE_LABELS)
from ..functions.text import any_word, filled, json_object_slice, trim_all, utf16_length


def with_variant(df: DataFrame, json: str, out: str) -> DataFrame:
    """Add a JSON text as variant, null where it is no JSON; of repeated keys, at any depth, the last one holds.

    The setting is read while the expression is analysed, so it is put back at once.
    """
    conf, name = df.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        rows = df.withColumn(out, F.try_parse_json(json))
        _ = rows.schema
        return rows
    finally:
        conf.set(name, before)


def _type(value: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))


def _text(value: Column, field: str) -> Column:
    """A JSON string field; null for other JSON types."""
    return F.when(_type(value, field) == "STRING", F.try_variant_get(value, f"$.{field}", "string"))


def _unknown_field(json: Column, fields) -> Column:
    return F.get(F.filter(F.json_object_keys(json), lambda k: ~k.isin(*fields)), F.lit(0))


def validate_request(requests: DataFrame, json: str = "request") -> DataFrame:
    """Check a JSON request; adds ``ok``, ``field`` (first failing field) and the accepted values."""
    fields = [*REQUEST_ENUMS, "goal"]
    rows = with_variant(requests, json, "_v")
    rows = rows.select("*", F.schema_of_variant("_v").startswith("OBJECT<").alias("_object"),
                       _unknown_field(F.col(json), fields).alias("_extra"),
                       *[_text(F.col("_v"), f).alias(f"_{f}") for f in fields])
    goal = trim_all(F.col("_goal"))
    check = F.when(~F.coalesce("_object", F.lit(False)), "request").when(F.col("_extra").isNotNull(), F.col("_extra"))
    for field, values in REQUEST_ENUMS.items():
        check = check.when(~F.coalesce(F.col(f"_{field}").isin(*values), F.lit(False)), field)
    check = check.when(F.col("_goal").isNull() | (utf16_length(goal) > GOAL_MAX) | goal.rlike(PRIVATE_DATA), "goal")
    rows = rows.withColumn("field", check).withColumn("ok", F.col("field").isNull())
    value = F.struct(*[F.col(f"_{f}").alias(f) for f in REQUEST_ENUMS], goal.alias("goal"))
    return rows.withColumn("value", F.when(F.col("ok"), value)).drop("_v", "_object", "_extra", *[f"_{f}" for f in fields])


def gate_medical(text) -> Column:
    """A prohibited medical phrase that no negator excuses.

    Matches are marked by a replacement, which scans from left to right without overlaps; a mark counts
    unless a negator stands at most six characters before it. Other marks in between do not count as
    characters; phrases are at least four characters long, so there is at most one.
    """
    mark = "\u0001"
    plain = f"[^{re.escape(MEDICAL_STOPS)}{mark}]"
    gaps = [f"{plain}{{0,{MEDICAL_REACH}}}"] + [
        f"{plain}{{{n}}}{mark}{plain}{{0,{MEDICAL_REACH - n}}}" for n in range(MEDICAL_REACH + 1)]
    # The mark comes first, so that the look-behind only runs where a phrase was found.
    bare = f"{mark}(?<!(?:{'|'.join(MEDICAL_NEGATORS)})(?:{'|'.join(gaps)}){mark})"
    text = F.replace(F.col(text) if isinstance(text, str) else text, F.lit(mark), F.lit(""))
    found = F.lit(False)
    for words, phrase in MEDICAL_PHRASES:
        found = found | (any_word(text, words) & F.regexp_replace(text, phrase, mark + "$0").rlike(bare))
    return found


def _bounded(text: Column, limit: int) -> Column:
    return F.coalesce((trim_all(text) != "") & (utf16_length(text) <= limit), F.lit(False))


def _short_list(items: Column, limit: int) -> Column:
    return F.coalesce(F.size(items).between(1, limit) & F.forall(items, lambda x: _bounded(x, PLAN_ITEM_MAX)),
                      F.lit(False))


def validate_plan(plans: DataFrame, json: str = "plan") -> DataFrame:
    """Check a plan as JSON object text; adds ``ok`` and ``field`` (first failing field)."""
    fields = [*PLAN_TEXT_FIELDS, *PLAN_LIST_FIELDS, "sevenDayPlan"]
    day_type = "array<struct<day:double,goal:string,deliverables:array<string>>>"
    rows = with_variant(plans, json, "_v")
    v = F.col("_v")
    days_type = (r"\AARRAY<OBJECT<day: (BIGINT|DOUBLE|DECIMAL\(\d+, ?\d+\)), deliverables: ARRAY<STRING>, "
                 r"goal: STRING>>\z")
    rows = rows.select(
        "*", F.schema_of_variant(v).startswith("OBJECT<").alias("_object"),
        _unknown_field(F.col(json), fields).alias("_extra"),
        *[_text(v, f).alias(f"_{f}") for f in PLAN_TEXT_FIELDS],
        *[F.when(_type(v, f) == "ARRAY<STRING>", F.try_variant_get(v, f"$.{f}", "array<string>")).alias(f"_{f}")
          for f in PLAN_LIST_FIELDS],
        F.when(_type(v, "sevenDayPlan").rlike(days_type), F.try_variant_get(v, "$.sevenDayPlan", day_type)).alias("_days"),
        gate_medical(F.to_json(v)).alias("_medical"))
    numbered = F.zip_with("_days", F.sequence(F.lit(1), F.lit(PLAN_DAYS)), lambda d, n: F.struct(d.alias("d"), n.alias("n")))
    days_ok = (F.size("_days") == PLAN_DAYS) & F.forall(numbered, lambda x: F.coalesce(
        x["d"]["day"] == x["n"], F.lit(False)) & _bounded(x["d"]["goal"], PLAN_ITEM_MAX)
        & _short_list(x["d"]["deliverables"], PLAN_DELIVERABLES_MAX))
    check = F.when(~F.coalesce("_object", F.lit(False)), "plan").when(F.col("_extra").isNotNull(), F.col("_extra"))
    for field in PLAN_TEXT_FIELDS:
        check = check.when(~_bounded(F.col(f"_{field}"), PLAN_TEXT_MAX), field)
    for field in PLAN_LIST_FIELDS:
        check = check.when(~_short_list(F.col(f"_{field}"), PLAN_LIST_MAX), field)
    check = check.when(~F.coalesce(days_ok, F.lit(False)), "sevenDayPlan").when(
        ~F.col("_disclaimer").rlike(PLAN_DISCLAIMER), "disclaimer").when(F.col("_medical"), "plan")
    return rows.withColumn("field", check).withColumn("ok", F.col("field").isNull()).drop(
        "_v", "_object", "_extra", "_days", "_medical", *[f"_{f}" for f in (*PLAN_TEXT_FIELDS, *PLAN_LIST_FIELDS)])


def parse_plan(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """Cut the JSON object out of a raw reply and check it; ``response`` fails when there is none."""
    rows = replies.withColumn("plan", json_object_slice(raw, PLAN_REPLY_MAX))
    valid = F.try_parse_json("plan").isNotNull()
    checked = validate_plan(rows).withColumn("field", F.when(~F.coalesce(valid, F.lit(False)), "response").otherwise(
        F.col("field")))
    return checked.withColumn("ok", F.col("field").isNull())


def catalog(spark: SparkSession, sources: dict[str, str] | None = None) -> DataFrame:
    """The project catalog as a dimension table; ``sources`` maps projects to the report they come from."""
    rows = [(*entry[:5], list(entry[5]), (sources or {}).get(entry[0], "")) for entry in P.CATALOG]
    return spark.createDataFrame(rows, "projectId string, name string, repository string, area string, facts string, "
                                       "ideas array<string>, source string")


def _label(column: str, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.create_map(*pairs)[F.col(column)]


def catalog_enrich(valid: DataFrame, projects: DataFrame) -> DataFrame:
    """Accepted requests with the catalog's facts as a plan struct with seven days.

    ``valid`` has the request fields as columns. Only the projects a request may name are used, one row each,
    so the broadcast side is bounded by the enumeration.
    """
    known = projects.filter(F.col("projectId").isin(*REQUEST_ENUMS["projectId"])).dropDuplicates(["projectId"])
    rows = valid.join(F.broadcast(known), "projectId").select(
        "*", _label("role", ROLE_LABELS).alias("_role"), _label("direction", DIRECTION_LABELS).alias("_direction"),
        _label("deployment", DEPLOYMENT_LABELS).alias("_deployment"))
    values = {"name": F.col("name"), "role": F.col("_role"), "direction": F.col("_direction"),
              "deployment": F.col("_deployment"), "idea": F.col("ideas")[0], "facts": F.col("facts"),
              "repository": F.col("repository"), "source": F.col("source")}

    def fill(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[values[part] if i % 2 else F.lit(part) for i, part in enumerate(parts)])

    values["goal"] = F.coalesce(filled("goal"), fill(P.GOAL))
    week = F.array(*[
        F.struct(F.lit(n).alias("day"), F.lit(goal).alias("goal"), F.array(*map(F.lit, items)).alias("deliverables"))
        for n, (goal, items) in enumerate(P.DAYS, 1)])
    plan = F.struct(
        fill(P.TITLE).alias("title"), fill(P.POSITIONING).alias("positioning"),
        *[F.array(*map(fill, items)).alias(field) for field, items in P.LISTS.items() if field != "sourceAttribution"],
        week.alias("sevenDayPlan"),
        F.array(*map(fill, P.LISTS["sourceAttribution"])).alias("sourceAttribution"),
        F.lit(P.DISCLAIMER).alias("disclaimer"))
    return rows.withColumn("plan", plan).drop("_role", "_direction", "_deployment")
