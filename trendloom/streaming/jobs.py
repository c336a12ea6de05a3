"""Incremental variants: watermarked day windows, dedup across runs, alert state.

All take a streaming DataFrame; with trigger(availableNow=True) a run is a micro-batch job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trendloom.functions import scores as S

#: Late items count up to the lookback of ingestion; later ones need a batch rebuild of their day.
LATENESS = "2 days"


def events_stream(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The watermark on an event time, which files may hold without a zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def day_counts(stream: DataFrame, key: str = "entity_id", time: str = "ts", late: str = LATENESS) -> DataFrame:
    """Tumbling one-day windows: mention weight, engagement and (approximately) authors of each entity."""
    w = S.platform_weight(F.col("platform"), F.col("override"))
    return (
        timed(stream, time, late)
        .groupBy(F.window(time, "1 day"), key)
        .agg(
            F.sum(w).cast("double").alias("mention_count"),
            F.sum(S.engagement_total(F.col("platform"), F.col("views"), F.col("likes"), F.col("comments"))).alias("engagement_sum"),
            F.approx_count_distinct(F.when(w > 0, F.coalesce("author", F.lit("")))).alias("unique_authors"),
        )
        .select(key, F.to_date("window.start").alias("day"), "mention_count", "engagement_sum", "unique_authors")
    )


def sliding_counts(stream: DataFrame, key: str = "entity_id", time: str = "ts", length: str = "7 days", slide: str = "1 day", late: str = LATENESS) -> DataFrame:
    """Sliding lookback windows."""
    return timed(stream, time, late).groupBy(F.window(time, length, slide), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.end").alias("until"), "n")


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = LATENESS) -> DataFrame:
    """One mention of each key within the watermark."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def previous_row_signals(days: DataFrame, key: str = "entity_id", score: float = 15.0, grown: float = 0.35) -> DataFrame:
    """days(key, day, composite_score, mention_count) -> new_entry and breakout events against the last state of each entity."""
    kind = days.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("day").itertuples():
            if last is None:
                if row.mention_count > 0:
                    out.append((k[0], row.day, "new_entry", float(row.composite_score)))
            elif row.composite_score >= score and row.mention_count >= 2 and (last <= 0 or (row.composite_score - last) / last >= grown):
                out.append((k[0], row.day, "breakout", float(row.composite_score)))
            last = float(row.composite_score)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "day", "signal_type", "strength"])

    return days.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, day date, signal_type string, strength double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def cooled_alerts(fired: DataFrame, key: str = "alert_id", time: str = "ts", hours: int = 24) -> DataFrame:
    """fired(key, ts) with event triggered or suppressed: a trigger starts a cool-down that later ones fall into."""
    kind = fired.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(time).itertuples():
            at = getattr(row, time).timestamp()
            cooling = last is not None and at < last + hours * 3600
            out.append((k[0], getattr(row, time), "suppressed" if cooling else "triggered"))
            last = last if cooling else at
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, time, "event"])

    return fired.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {time} timestamp, event string", "last double", "append", GroupStateTimeout.NoTimeout)


def expire(experiments: DataFrame, now) -> DataFrame:
    """Life cycle of experiments(status, starts, ends): active once begun, expired once over."""
    status = F.when(F.col("status").isin("confirmed", "suppressed"), F.col("status")).when(F.col("ends") < now, "expired").when(F.col("starts") <= now, "active").otherwise("pending")
    return experiments.withColumn("status", status)
