"""The daily entity series and what is derived from it row by row.

content(content_item_id, platform, author, day, views, likes, comments, override)
resolved(content_item_id, entities array<struct<name, confidence>>)
series(entity_id, day, mention_count, unique_authors, engagement_sum, platforms, confidence_avg,
       growth_rate, momentum, acceleration, volatility, composite_score, trend_state)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions.text import base_name


def entity_hits(content: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row for each (item, base entity): variants of one name count once, the first supplies the confidence.

    resolved has one row for each item, so variants are merged inside its array, without a shuffle.
    """
    return content.join(hits_of(resolved), "content_item_id")


def hits_of(items: DataFrame) -> DataFrame:
    """The rows of items that carry their entities, once for each base entity: no join."""
    others = [c for c in items.columns if c != "entities"]
    named = F.transform("entities", lambda e: F.struct(base_name(e["name"]).alias("entity_id"), e["confidence"].alias("confidence")))
    rows = items.select(*others, named.alias("e")).withColumn("k", F.col("e.entity_id"))
    first = F.filter("e", lambda x, i: F.array_position("k", x["entity_id"]) == i + 1)
    return rows.select(*others, F.explode(first).alias("e")).select(*others, "e.*")


def daily_counts(hits: DataFrame, key: str = "entity_id") -> DataFrame:
    """Grouped sums for each (entity, day); an override of 0 adds engagement and platform only."""
    weight = S.platform_weight(F.col("platform"), F.col("override"))
    counted = weight > 0
    return hits.groupBy(key, "day").agg(
        F.sum(weight).cast("double").alias("mention_count"),
        F.countDistinct(F.when(counted, F.coalesce("author", F.lit("")))).alias("unique_authors"),
        F.sum(S.engagement_total(F.col("platform"), F.col("views"), F.col("likes"), F.col("comments"))).alias("engagement_sum"),
        F.size(F.collect_set("platform")).cast("long").alias("platforms"),  # a handful; a second distinct count would expand all rows
        F.round(F.avg(F.when(counted, F.col("confidence").cast("decimal(10,4)"))).cast("double"), 4).alias("confidence_avg"),
    )


def with_trend(counts: DataFrame, key: str = "entity_id", active_only: bool = False) -> DataFrame:
    """Growth, momentum, acceleration, volatility, composite score and trend state against the previous row.

    The previous row is any earlier one of the entity; with active_only, the
    last one with mentions supplies the previous score.
    """
    w = Window.partitionBy(key).orderBy("day")
    before = F.coalesce(F.lag("mention_count").over(w), F.lit(0.0))
    out = counts.withColumn("_before", before).withColumn("momentum", S.momentum(F.col("mention_count"), F.col("_before")))
    out = out.withColumn("growth_rate", F.round(S.growth(F.col("mention_count"), F.col("_before")), 4))
    out = out.withColumn("acceleration", F.round(F.col("momentum") - F.coalesce(F.lag("momentum").over(w), F.lit(0.0)), 4))
    out = out.withColumn("volatility", F.abs("acceleration"))
    out = out.withColumn(
        "composite_score",
        S.composite(F.col("mention_count"), F.col("engagement_sum"), F.col("growth_rate"), F.col("platforms"), F.col("momentum")),
    )
    last = F.lag("composite_score").over(w)
    if active_only:
        last = F.last(F.when(F.col("mention_count") > 0, F.col("composite_score")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("prev_score", F.coalesce(last, F.lit(0.0)))
    state = S.trend_state(F.col("composite_score"), F.col("prev_score"), F.col("growth_rate"), F.col("momentum"), F.col("mention_count"))
    return out.withColumn("trend_state", state).drop("_before")


def daily_series(content: DataFrame, resolved: DataFrame) -> DataFrame:
    return with_trend(daily_counts(entity_hits(content, resolved)))


def signals(series: DataFrame, key: str = "entity_id", score: float = 15, grown: float = 0.35, spike: float = 1.5, drop: float = 0.40) -> DataFrame:
    """0 to 3 events for each row: new_entry alone, or breakout, acceleration_spike, reversal.

    Growth from a score of zero is infinite and stored as 9999.9.
    """
    w = Window.partitionBy(key).orderBy("day")
    rows = series.withColumn("_p", F.lag("composite_score").over(w)).withColumn("_any", F.lag(F.lit(True)).over(w))
    return signal_events(rows, key, score, grown, spike, drop)


def signal_events(rows: DataFrame, key: str = "entity_id", score: float = 15, grown: float = 0.35, spike: float = 1.5, drop: float = 0.40) -> DataFrame:
    """signals() of rows that carry the score of their previous row, _p, and _any, null where there is none."""
    s, m = F.col("composite_score"), F.col("mention_count")
    p = F.coalesce("_p", F.lit(0.0))
    pct = F.when(p > 0, (s - p) / F.when(p > 0, p)).otherwise(F.lit(9999.9))
    event = lambda cond, kind, value: F.when(cond, F.struct(F.lit(kind).alias("signal_type"), F.round(value, 4).alias("detail")))
    new = F.col("_any").isNull() & (m > 0)
    old = F.col("_any").isNotNull()
    fall = (p - s) / F.when(p > 0, p)
    found = F.array(
        event(new, "new_entry", s),
        event(old & (s >= score) & (m >= 2) & (pct >= grown), "breakout", pct),
        event(old & (F.col("momentum") >= spike), "acceleration_spike", F.col("momentum")),
        event(old & (p >= score) & (fall >= drop) & (m >= 2) & (p / F.greatest(s, F.lit(0.01)) <= 4), "reversal", fall),
    )
    return rows.select(key, "day", F.round(s, 4).alias("strength"), F.explode(F.array_compact(found)).alias("e")).select(
        key, "day", "strength", "e.signal_type", "e.detail"
    )


def carry_forward(series: DataFrame, days: int = 7, key: str = "entity_id", last: DataFrame | None = None) -> DataFrame:
    """Zero rows for quiet entities: active by a real row within the last `days` days and without a row that day.

    Each real row yields the next `days` days, a bounded fan-out, and days with a real row are
    taken out again by an anti-join; the calendar ends with the data, or with the one row _last of `last`.
    """
    last = series.agg(F.max("day").alias("_last")) if last is None else last
    real = series.where(F.col("mention_count") > 0).select(key, F.col("day").alias("_d"))
    ahead = real.select(key, F.explode(F.expr(f"sequence(_d + interval 1 day, _d + interval {days} day, interval 1 day)")).alias("day")).distinct()
    quiet = ahead.crossJoin(F.broadcast(last)).where(F.col("day") <= F.col("_last")).drop("_last")  # one row on the right
    quiet = quiet.join(series.select(key, "day"), [key, "day"], "left_anti")
    return quiet.select(
        key, "day", F.lit(0.0).alias("mention_count"), F.lit(0).cast("long").alias("unique_authors"), F.lit(0).cast("long").alias("engagement_sum"),
        F.lit(-1.0).alias("growth_rate"), F.lit(0.0).alias("composite_score"), F.lit(0.0).alias("momentum"), F.lit(0.0).alias("acceleration"),
        F.lit(0.0).alias("volatility"), F.lit(None).cast("double").alias("confidence_avg"), F.lit(None).cast("string").alias("trend_state"),
    )


def brand_rollup(series: DataFrame, brands: DataFrame, key: str = "entity_id") -> DataFrame:
    """Sums and mention-weighted means for each (brand, day); brands without mentions that day are absent."""
    dec = lambda c: F.col(c).cast("decimal(18,4)")
    m = dec("mention_count")
    mean = lambda c: F.round(F.avg(dec(c)).cast("double"), 4)
    weighted = lambda c: S.rounded(F.sum(F.coalesce(dec(c), F.lit(0).cast("decimal(18,4)")) * m).cast("double") / F.sum(m).cast("double"), 4)
    return (
        series.join(brands, key)
        .where(F.col("brand").isNotNull())
        .groupBy("brand", "day")
        .agg(
            F.sum(m).cast("double").alias("mention_count"),
            F.sum("engagement_sum").alias("engagement_sum"),
            F.sum("unique_authors").alias("unique_authors"),
            F.when(F.sum(m) > 0, weighted("composite_score")).otherwise(mean("composite_score")).alias("composite_score"),
            F.when(F.sum(m) > 0, weighted("growth_rate")).otherwise(mean("growth_rate")).alias("growth_rate"),
            mean("momentum").alias("momentum"),
            mean("acceleration").alias("acceleration"),
            mean("volatility").alias("volatility"),
            mean("confidence_avg").alias("confidence_avg"),
        )
        .where("mention_count > 0")
    )


def with_trend_of_brands(series: DataFrame, brands: DataFrame) -> DataFrame:
    """The brand roll-up with the trend state against the brand's last active day."""
    r = brand_rollup(series, brands)
    w = Window.partitionBy("brand").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("mention_count") > 0, F.col("composite_score")), ignorenulls=True).over(w), F.lit(0.0))
    r = r.withColumn("prev_score", before)
    return r.withColumn("trend_state", S.trend_state(F.col("composite_score"), F.col("prev_score"), F.col("growth_rate"), F.col("momentum"), F.col("mention_count")))


def weighted_scores(series: DataFrame, hits: DataFrame, key: str = "entity_id") -> DataFrame:
    """Score raised by the mean source score of the day's mentions, at most 100; rows with mentions only."""
    score = S.source_score(F.col("platform"), F.col("views"), F.col("likes"), F.col("comments")).cast("decimal(10,4)")
    mean = hits.groupBy(key, "day").agg(F.avg(score).cast("double").alias("_mean"))
    return series.where("mention_count > 0").join(mean, [key, "day"], "left").select(
        key, "day", S.rounded(S.weighted_score(F.col("composite_score"), F.round("_mean", 8)), 4).alias("weighted_score")
    )


def latest(series: DataFrame, key: str = "entity_id", active: bool = True) -> DataFrame:
    """The last (active) row of each entity: one grouped maximum, no self-join and no sort."""
    rows = series.where("mention_count > 0") if active else series
    others = [c for c in series.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "day").alias("_r")).select(key, "_r.*")


def range_rows(series: DataFrame, first: Column, last: Column, key: str = "entity_id") -> DataFrame:
    """Sums, means, maxima and the latest state over a range of days, in one pass."""
    dec = lambda c: F.col(c).cast("decimal(18,4)")
    return (
        series.where((F.col("day") >= first) & (F.col("day") <= last))
        .groupBy(key)
        .agg(
            F.sum(dec("mention_count")).cast("double").alias("mention_count"),
            F.sum("engagement_sum").alias("engagement_sum"),
            F.round(F.avg(dec("composite_score")).cast("double"), 4).alias("avg_score"),
            F.max("composite_score").alias("max_score"),
            F.max_by("trend_state", "day").alias("latest_state"),
            F.max("day").alias("latest_day"),
        )
        .where("mention_count > 0")
    )


def collapse_variants(rows: DataFrame, group: str, name: str = "name") -> DataFrame:
    """One row for each variant group: sums, maxima, the state of highest priority, and an elected primary.

    The primary is the name that equals its group, else the one with the highest score.
    """
    exact = (F.lower(name) != F.lower(group)).cast("int")
    value = S.lookup(S.STATE_PRIORITY, F.col("trend_state"), 0)
    return (
        rows.groupBy(group)
        .agg(
            F.min_by(name, F.struct(exact, -F.coalesce("composite_score", F.lit(0.0)), F.col(name))).alias("primary_name"),
            F.sum(F.col("mention_count").cast("decimal(18,4)")).cast("double").alias("mention_count"),
            F.sum("engagement_sum").alias("engagement_sum"),
            F.max("unique_authors").alias("unique_authors"),
            F.max("composite_score").alias("composite_score"),
            F.max(F.coalesce("growth_rate", F.lit(0.0))).alias("growth_rate"),
            F.max(F.coalesce("momentum", F.lit(0.0))).alias("momentum"),
            F.max(F.abs("acceleration")).alias("acceleration"),
            F.max_by("trend_state", F.struct(value, "trend_state")).alias("trend_state"),
            F.count(F.lit(1)).alias("n_variants"),
        )
        .withColumn("effective_score", S.effective_rank(F.col("composite_score"), F.col("unique_authors")))
    )
