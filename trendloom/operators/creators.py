"""Creators: relationships, scores, early signals, boards; and rules over stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import scores as S


def or_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, left_id: str, right_id: str) -> DataFrame:
    """Rows of left whose any of `keys` equals right.on, as one equi-join: keys are exploded, pairs kept once."""
    spelled = left.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))
    return spelled.join(right, F.col("_key") == right[on]).dropDuplicates([left_id, right_id]).drop("_key")


def relationships(mentions: DataFrame) -> DataFrame:
    """mentions(creator, entity_id, item, day, views, likes, comments) -> one row for each creator and entity."""
    rate = S.engagement_rate(F.col("views"), F.col("likes"), F.col("comments")).cast("decimal(18,8)")
    return mentions.groupBy("creator", "entity_id").agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("item").alias("items"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.sum("views").alias("views"), F.round(F.avg(rate).cast("double"), 6).alias("avg_rate"),
    )


def early_signals(relations: DataFrame, signals: DataFrame, kinds=("breakout", "acceleration_spike")) -> DataFrame:
    """relations with first_signal, early (first mention before it) and days_before."""
    first = signals.where(F.col("signal_type").isin(*kinds)).groupBy("entity_id").agg(F.min("day").alias("first_signal"))
    early = F.coalesce(F.col("first_day") < F.col("first_signal"), F.lit(False))
    return relations.join(first, "entity_id", "left").withColumn("early", early).withColumn("days_before", F.when(early, F.datediff("first_signal", "first_day")))


def creator_scores(items: DataFrame, relations: DataFrame, channels: DataFrame) -> DataFrame:
    """items(creator, item, n_entities), relations with early, channels(creator, subscribers): parts and influence."""
    i = items.groupBy("creator").agg(F.countDistinct("item").alias("items"), F.count_if(F.col("n_entities") > 0).alias("hits"))
    r = relations.groupBy("creator").agg(
        F.sum("mentions").alias("mentions"), F.countDistinct("entity_id").alias("entities"), F.sum(F.col("early").cast("int")).alias("early"), F.avg(F.col("avg_rate").cast("decimal(18,8)")).cast("double").alias("rate"),
    )
    j = channels.join(i, "creator", "left").join(r, "creator", "left")
    noise = F.when(F.col("items") > 0, 1 - F.col("hits") / F.col("items")).otherwise(0.0)
    return j.withColumn("noise", F.round(noise, 6)).withColumn(
        "influence", S.influence_score(F.col("subscribers"), F.col("noise"), F.col("entities"), F.col("mentions"), F.col("early"), F.col("rate"))
    )


def paged(rows: DataFrame, sort: str, allowed, descending: bool = True, offset: int = 0, limit: int = 50, key: str = "creator") -> DataFrame:
    """One page by an allowed column, null as zero, ties by key."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    c = F.coalesce(F.col(sort), F.lit(0))
    return rows.orderBy(c.desc() if descending else c.asc(), key).offset(offset).limit(limit)


def channel_discovery(items: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """items(channel, title, views): channels not yet known with at least `least` items and their mean views, zero views ignored."""
    return items.join(known.select("channel"), "channel", "left_anti").groupBy("channel").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg(F.nullif("views", F.lit(0)).cast("decimal(18,4)")).cast("double"), 4).alias("avg_views"), F.max("views").alias("max_views")
    ).where(F.col("items") >= least)


def due(rows: DataFrame, now: Column, key: str = "creator", limit: int | None = None) -> DataFrame:
    """Rows never polled or due, those never polled first."""
    out = rows.where(F.col("next_poll_after").isNull() | (F.col("next_poll_after") <= now)).orderBy(F.asc_nulls_first("next_poll_after"), key)
    return out if limit is None else out.limit(limit)


def cooled(alerts: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """fired alerts with event triggered or suppressed, and the new last_triggered."""
    cooling = F.coalesce(F.col("last_triggered") + F.make_dt_interval(hours=F.coalesce("cooldown_hours", F.lit(hours))) > now, F.lit(False))
    a = alerts.where("fired").withColumn("event", F.when(cooling, "suppressed").otherwise("triggered"))
    return a.withColumn("last_triggered", F.when(F.col("event") == "triggered", now).otherwise(F.col("last_triggered")))


def queue_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Queue rows of both; finished rows that turn up again are pending."""
    o = old.select(key, F.col("status").alias("_s"), F.col("priority").alias("_p"))
    j = o.join(new.select(key, F.col("priority").alias("_n")), key, "full")
    again = F.col("_n").isNotNull() & (F.col("_s").isNull() | F.col("_s").isin("done", "failed"))
    return j.select(key, F.when(again, "pending").otherwise(F.col("_s")).alias("status"), F.coalesce("_n", "_p").alias("priority"))


def first_capture(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch to append: natural keys that are not stored, one each."""
    return batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def strip_entity(records: DataFrame, name: Column) -> DataFrame:
    """records(entities array<struct<name,...>>) without one entity."""
    return records.withColumn("entities", F.filter("entities", lambda e: e["name"] != name))


def remapped(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """rows with key replaced by mapping(old, new) where one exists; one new key for each old."""
    one = mapping.groupBy("old").agg(F.min("new").alias("_new"))
    return rows.join(one, F.col(key) == F.col("old"), "left").withColumn(key, F.coalesce("_new", key)).drop("old", "_new")


def quality_checks(series: DataFrame, key: str = "entity_id") -> DataFrame:
    """(check, failures): invariants of the series in one pass and one duplicate probe."""
    w = series.agg(
        F.count_if((F.col("composite_score") < 0) | (F.col("composite_score") > 100)).alias("score_out_of_range"),
        F.count_if(F.col("mention_count") < 0).alias("negative_mentions"),
        F.count_if((F.col("mention_count") > 0) & F.col("trend_state").isNull() & (F.col("composite_score") > 0)).alias("state_missing"),
        F.count_if((F.col("mention_count") == 0) & F.col("trend_state").isNotNull()).alias("state_on_quiet_day"),
    )
    names = ("score_out_of_range", "negative_mentions", "state_missing", "state_on_quiet_day")
    one = w.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in names])).alias("c")).select("c.*")
    twice = series.groupBy(key, "day").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("duplicate_rows").alias("check"), F.count(F.lit(1)).alias("failures"))
    return one.unionByName(twice.select("check", "failures"))


def health(metrics: DataFrame) -> DataFrame:
    """metrics(metric, value, warn, critical): level of each metric, low values bad."""
    level = F.when(F.col("value") < F.col("critical"), "CRITICAL").when(F.col("value") < F.col("warn"), "WARNING").otherwise("OK")
    return metrics.withColumn("level", level)


def public_columns(df: DataFrame, allowed) -> DataFrame:
    """The allowed columns; raises where others are present."""
    extra = sorted(set(df.columns) - set(allowed))
    if extra:
        raise ValueError(f"columns not cleared for publication: {', '.join(extra)}")
    return df
