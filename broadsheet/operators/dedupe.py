"""De-duplication within a run, against earlier days and across sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed_values import DEDUPE_DAYS, DEDUPE_TITLE_MIN
from ..functions.text import filled, first_filled, utf16_length
from ..functions.urls import norm_title_dedupe, norm_url_dedupe
from ..session import cut_lineage
from .ordering import keep_first
from .texts import category_ord

IDENTITY = ["report_date", "category", "source_ord", "item_ord"]
KEYS = ["url_key", "title_key"]
#: Rows of one component that one task decides in a pass, and ties of keys that one task joins.
COMPONENT_ROWS = 500_000
FEW_TIES = 200_000


def dedupe_first_url(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """Keep the first row per url, else id, else title; rows without any of them are dropped."""
    keyed = df.withColumn("_key", first_filled("url", "id", "title"))
    return keep_first(keyed.filter(F.col("_key").isNotNull()), [*groups, "_key"], order).drop("_key")


def dedupe_first_id(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    return keep_first(df, [*groups, "id"], order)


def dedupe_first_repo(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """Keep the first repository per url, else name, else owner/name."""
    owner_name = F.concat(F.coalesce("owner", F.lit("")), F.lit("/"), F.coalesce("name", F.lit("")))
    keyed = df.withColumn("_key", F.coalesce(filled("url"), filled("name"), owner_name))
    return keep_first(keyed, [*groups, "_key"], order).drop("_key")


def dedupe_keys(items: DataFrame) -> DataFrame:
    """Add ``url_key`` and ``title_key``; null where the key must not be used."""
    title = norm_title_dedupe("title")
    return items.withColumn("url_key", filled(norm_url_dedupe("url"))).withColumn(
        "title_key", F.when(utf16_length(title) >= DEDUPE_TITLE_MIN, title))


def history_keys(items: DataFrame, key: str) -> DataFrame:
    """Distinct (key, day) pairs: at most one row per key and report date, however often it occurs."""
    return items.filter(F.col(key).isNotNull()).select(key, F.col("report_date").alias("_day")).distinct()


def _never_null(key: str, *spread: str) -> Column:
    """The key; nulls become distinct values that match nothing, so they do not share one task."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0001"), F.xxhash64(*spread).cast("string")))


def drop_seen(rows: DataFrame, history: DataFrame, days: int, key: str, date: str = "report_date",
              first_day: int = 1, spread: Sequence[str] = ("source_ord", "item_ord")) -> DataFrame:
    """Anti join on one key with days ``date - days .. date - first_day`` of the history."""
    seen = history_keys(history, key).withColumnRenamed(key, "_key")
    on = (_never_null(key, *spread) == F.col("_key")) & (F.col("_day") >= F.date_sub(date, days)) & (
        F.col("_day") <= F.date_sub(date, first_day))
    return rows.join(seen, on, "left_anti")


def _arrival() -> Column:
    """Order inside a report date: category order, rank in the category, arrival."""
    return F.struct(
        category_ord().alias("c"),
        (~F.col("has_media")).alias("m"),
        F.coalesce(-F.unix_micros("published_at"), F.lit((1 << 63) - 1)).alias("p"),
        F.col("source_ord").alias("s"),
        F.col("item_ord").cast("long").alias("i"),
        F.col("category").alias("n"))


def _identity(places: DataFrame) -> DataFrame:
    return places.select(F.col("d").alias("report_date"), F.col("o.n").alias("category"),
                         F.col("o.s").alias("source_ord"), F.col("o.i").alias("item_ord"))


def _repeated(rows: DataFrame, key: str, days: int) -> DataFrame:
    """(key, day) pairs where the key occurs again on that day or at most ``days`` days away."""
    per_day = rows.filter(F.col(key).isNotNull()).groupBy(key, "d").agg(F.count(F.lit(1)).alias("n"))
    by_day = W.partitionBy(key).orderBy("d")
    near = (F.datediff("d", F.lag("d").over(by_day)) <= days) | (
        F.datediff(F.lead("d").over(by_day), "d") <= days)
    flagged = per_day.withColumn("near", (F.col("n") > 1) | F.coalesce(near, F.lit(False)))
    return flagged.filter("near").select(F.col(key).alias(f"_{key}"), F.col("d").alias(f"_d_{key}"),
                                         F.lit(True).alias(f"dup_{key}"))


def _flag(rows: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    on = (_never_null(key, "o") == F.col(f"_{key}")) & (F.col("d") == F.col(f"_d_{key}"))
    return rows.join(flags, on, "left").drop(f"_{key}", f"_d_{key}")


def _chains(rows: DataFrame, key: str, days: int) -> DataFrame:
    """Keys whose repeated rows depend on nothing else: kept rows by one pass over their days.

    Per key there is one entry per report date, so the collected list is bounded by the calendar.
    """
    per_day = rows.filter(f"dup_{key}").groupBy(key, "d").agg(
        F.min("o").alias("o"), F.bool_and(~(F.col("dup_url_key") & F.col("dup_title_key"))).alias("pure"))
    per_key = per_day.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("d", "o"))).alias("firsts"), F.bool_and("pure").alias("pure"))
    picked = F.aggregate(
        "firsts", F.slice("firsts", 1, 1),
        lambda kept, x: F.when(F.datediff(x["d"], F.element_at(kept, -1)["d"]) > days, F.array_append(kept, x)
                               ).otherwise(kept))
    return per_key.withColumn("kept", F.when(F.col("pure"), picked)).select(key, "pure", "kept")


def _blockers(rows: DataFrame, key: str, days: int) -> DataFrame:
    """Per (key, day): first kept and first open row, and whether earlier days have one in range."""
    per_day = rows.filter(F.col(key).isNotNull()).groupBy(key, "d").agg(
        F.min(F.when(F.col("kept"), F.col("o"))).alias("k"), F.min(F.when(~F.col("kept"), F.col("o"))).alias("u"))
    earlier = W.partitionBy(key).orderBy("d").rowsBetween(W.unboundedPreceding, -1)

    def near(flag: str) -> Column:
        last = F.max(F.when(F.col(flag).isNotNull(), F.col("d"))).over(earlier)
        return F.coalesce(F.datediff("d", last) <= days, F.lit(False))

    return per_day.select(F.col(key).alias(f"_{key}"), F.col("d").alias(f"_d_{key}"),
                          F.col("k").alias(f"k_{key}"), F.col("u").alias(f"u_{key}"),
                          near("k").alias(f"nk_{key}"), near("u").alias(f"nu_{key}"))


def _round(rows: DataFrame, days: int) -> DataFrame:
    """One round over rows that can be matched by either key; ``kept`` tells those decided for, the rest stays open.

    The round keeps the rows without an earlier neighbour and drops the neighbours of what it keeps, so no open row has a
    kept neighbour afterwards. Neighbours come from per-(key, day) aggregates, never from pairs of rows.
    """
    def matched(rows: DataFrame) -> DataFrame:
        for key in KEYS:
            rows = _flag(rows, _blockers(rows, key, days), key)
        return rows

    def earlier(kind: str) -> Column:
        """An earlier kept (``k``) or open (``u``) row in range shares one of the keys."""
        found = F.lit(False)
        for key in KEYS:
            found = found | F.coalesce(F.col(f"n{kind}_{key}"), F.lit(False)) | F.coalesce(
                F.col(f"{kind}_{key}") < F.col("o"), F.lit(False))
        return found

    columns = ["d", "o", *KEYS]
    kept = matched(rows.withColumn("kept", F.lit(False))).select(*columns, (~earlier("u")).alias("kept"))
    return cut_lineage(matched(kept).filter(F.col("kept") | ~earlier("k")).select(*columns, "kept"))


def _stretches(rows: DataFrame, key: str, days: int) -> DataFrame:
    """Name of the stretch of days in which a key's rows can reach one another: no gap in it is over ``days`` days."""
    per_day = rows.filter(F.col(key).isNotNull()).select(key, "d").distinct()
    by_day = W.partitionBy(key).orderBy("d")
    first = F.when(F.coalesce(F.datediff("d", F.lag("d").over(by_day)) > days, F.lit(True)), F.col("d"))
    begun = per_day.withColumn("_first", first).withColumn("_first", F.max("_first").over(by_day))
    return begun.select(F.col(key).alias(f"_{key}"), F.col("d").alias(f"_d_{key}"),
                        F.xxhash64(F.lit(key), F.col(key), F.col("_first")).alias(f"s_{key}"))


def _joined_stretches(pairs: DataFrame) -> DataFrame:
    """``(s, top)`` for a bounded number of ``pairs (a, b)``: each stretch with the smallest one it is tied to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, int] = {}

        def top(x: int) -> int:
            while own.setdefault(x, x) != x:
                own[x] = own[own[x]]
                x = own[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((top(a), top(b)))
                own[high] = low
        names = list(own)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([top(x) for x in names], pa.int64())],
                                         names=["s", "top"])

    return pairs.repartition(1).mapInArrow(run, "s long, top long")


def _with_components(rows: DataFrame, days: int, few: int) -> DataFrame:
    """Add ``comp``, equal for all rows that are tied by shared keys in range.

    A row ties the stretches of its two keys. In each round every stretch points to its smallest neighbour, pointers are
    followed eight deep, and rows take the stretch they end at as their new one; names are hashes, so a round leaves
    at most about a third of the stretches, whatever the shape. ``few`` ties or fewer are joined in one task.
    """
    for key in KEYS:
        rows = _flag(rows, _stretches(rows, key, days), key)
    url, title = (F.col(f"s_{key}") for key in KEYS)
    rows = cut_lineage(rows.select("d", "o", *KEYS, F.coalesce(url, title).alias("a"), F.coalesce(title, url).alias("b")))
    while True:
        pairs = rows.filter("a <> b").select("a", "b").distinct()
        if pairs.limit(few + 1).count() <= few:
            tops = _joined_stretches(pairs)
            return cut_lineage(rows.join(tops, rows["a"] == tops["s"], "left").select(
                "d", "o", *KEYS, F.coalesce("top", "a").alias("comp")))
        ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut_lineage(ends.groupBy(F.col("a").alias("s")).agg(F.min("b").alias("top")).select(
            "s", F.least("s", "top").alias("top")))
        for _ in range(3):
            step = up.select(F.col("s").alias("_s"), F.col("top").alias("_top"))
            up = up.join(step, F.col("top") == F.col("_s")).select("s", F.col("_top").alias("top"))
        for end in ("a", "b"):
            step = up.select(F.col("s").alias("_s"), F.col("top").alias("_top"))
            rows = rows.join(step, F.col(end) == F.col("_s"), "left").withColumn(end, F.coalesce("_top", end)).drop(
                "_s", "_top")
        rows = cut_lineage(rows)


def _decide(rows: DataFrame, days: int) -> DataFrame:
    """Kept rows of whole components in one pass in their order; only the last kept day of each key is held."""
    names = ["d", "o", *KEYS, "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, last = None, {}
        for batch in batches:
            day = batch.column(0).cast(pa.int32()).to_pylist()
            kept = []
            for d, url, title, own in zip(day, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if own != comp:
                    comp, last = own, {}
                keys = [(side, key) for side, key in enumerate((url, title)) if key is not None]
                fresh = all(d - last.get(key, d - days - 1) > days for key in keys)
                if fresh:
                    last.update(dict.fromkeys(keys, d))
                kept.append(fresh)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.bool_())],
                                             names=["d", "o", "kept"])

    order = rows.select(*names).repartition("comp").sortWithinPartitions("comp", "d", "o")
    return order.mapInArrow(run, rows.select("d", "o").withColumn("kept", F.lit(True)).schema).filter("kept").drop("kept")


def _settle(rows: DataFrame, days: int, most: int, few: int) -> DataFrame:
    """Kept rows ``(d, o)`` among rows that can be matched by either key.

    Rows are split into components, which do not influence one another. Those of up to ``most`` rows are decided in one
    pass each. Larger ones go through rounds, first one, then twice as many each time; what no kept row has reached by
    then is split and decided anew.
    """
    kept, rounds = [], 1
    while True:
        rows = _with_components(rows, days, few)
        large = cut_lineage(rows.groupBy("comp").count().filter(F.col("count") > most).select("comp"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*kept, _decide(rows, days)])
        kept.append(_decide(rows.join(large, "comp", "left_anti"), days))
        rows = rows.join(large, "comp", "left_semi")
        for _ in range(rounds):
            rows = _round(rows, days)
            kept.append(rows.filter("kept").select("d", "o"))
            rows = rows.filter("not kept")
        rounds *= 2


def dedupe_history(items: DataFrame, days: int = DEDUPE_DAYS, history: DataFrame | None = None,
                   component_rows: int = COMPONENT_ROWS, few_ties: int = FEW_TIES) -> DataFrame:
    """Drop items that repeat the URL or the long title of an item *kept* earlier.

    Earlier means before it on the same report date, or on one of the previous ``days`` report dates.
    ``history`` are items kept by former runs. Rows need ``has_media`` and unique identity columns. Only
    keys and order travel; item contents are joined back once, to the few dropped rows. ``component_rows`` and
    ``few_ties`` bound what one task decides or joins; they change the plan, not the result.
    """
    # The keys are normalised once; everything up to the last join works on this narrow table.
    rows = cut_lineage(dedupe_keys(items).select(
        F.col("report_date").alias("d"), _arrival().alias("o"), "url_key", "title_key"))
    if history is not None:
        past = dedupe_keys(history).select("report_date", "url_key", "title_key")
        for key in KEYS:
            rows = drop_seen(rows, past, days, key, date="d", spread=("o",))
        rows = cut_lineage(rows)
    flagged = rows
    for key in KEYS:
        flagged = _flag(flagged, _repeated(rows, key, days), key)
    contested = cut_lineage(
        flagged.withColumn("dup_url_key", F.coalesce("dup_url_key", F.lit(False)))
        .withColumn("dup_title_key", F.coalesce("dup_title_key", F.lit(False)))
        .filter("dup_url_key or dup_title_key"))

    kept = None
    open_rows = contested
    for key in KEYS:
        chains = _chains(contested, key, days)
        firsts = chains.filter("pure").select(F.explode("kept").alias("x")).select("x.d", "x.o")
        kept = firsts if kept is None else kept.unionByName(firsts)
        pure = chains.select(F.col(key).alias(f"_{key}"), F.col("pure").alias(f"pure_{key}"))
        open_rows = open_rows.join(pure, _never_null(key, "o") == F.col(f"_{key}"), "left").drop(f"_{key}")
    open_rows = open_rows.filter(
        (F.col("dup_url_key") & ~F.col("pure_url_key")) | (F.col("dup_title_key") & ~F.col("pure_title_key")))
    open_rows = open_rows.withColumn("url_key", F.when(F.col("dup_url_key"), F.col("url_key"))).withColumn(
        "title_key", F.when(F.col("dup_title_key"), F.col("title_key")))
    kept = cut_lineage(kept.unionByName(_settle(open_rows, days, component_rows, few_ties)))

    dropped = contested.select("d", "o").join(kept, ["d", "o"], "left_anti")
    if history is None:
        return items.join(_identity(dropped), IDENTITY, "left_anti")
    return items.join(_identity(rows.select("d", "o").join(dropped, ["d", "o"], "left_anti")), IDENTITY, "left_semi")
