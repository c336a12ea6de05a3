"""How the driver's tables stand for the model, in Spark and as SQL common table expressions.

events -> content items and their resolved entities, part -> entities and brands,
lineitem baskets -> the note bridge, documents and conversations -> texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.operators import series as O
from trendloom.sources.store import Store
from trendloom.streaming import daystore as D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(e: DataFrame) -> DataFrame:
    """events with _k, the number in their props, so that the text is parsed once."""
    return e.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_of(table(spark, sf_dir, "events"))


def content_of(e: DataFrame, *more: Column) -> DataFrame:
    """Events as content items; errors carry an override weight of zero."""
    e = keyed(e)
    platform = (
        F.when(F.col("event_type") == "click", "youtube").when(F.col("event_type") == "view", "tiktok")
        .when(F.col("event_type") == "signup", "reddit").otherwise("other")
    )
    return e.select(
        F.col("event_id").alias("content_item_id"),
        platform.alias("platform"),
        F.col("user_id").cast("string").alias("author"),
        F.to_date("ts").alias("day"),
        F.round(F.col("value") * 100).cast("long").alias("views"),
        F.col("_k").cast("long").alias("likes"),
        F.pmod("user_id", F.lit(7)).cast("long").alias("comments"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).alias("override"),
        F.col("ts"),
        *more,
    )


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_of(table(spark, sf_dir, "events"))


def items_of(e: DataFrame) -> DataFrame:
    """Content items that carry their entities: both are read from the same event."""
    return content_of(e, entities_of().alias("entities"))


def resolved_of(e: DataFrame) -> DataFrame:
    return keyed(e).select(F.col("event_id").alias("content_item_id"), entities_of().alias("entities"))


def entities_of() -> Column:
    """Two variants of one name and, for some items, a second entity."""
    k = F.col("_k")
    name = lambda n: F.concat(F.lit("Perfume "), n.cast("string"))
    conf = ((F.pmod(k, F.lit(5)) + 5) / 10).cast("decimal(10,4)")
    entity = lambda n, c: F.struct(n.alias("name"), c.alias("confidence"))
    pair = F.array(entity(F.concat(name(k), F.lit(" Eau de Parfum")), conf), entity(name(k), F.lit(1).cast("decimal(10,4)")))
    extra = F.when(F.pmod("event_id", F.lit(3)) == 0, F.array(entity(name(F.pmod(k + 1, F.lit(100))), conf))).otherwise(F.slice(pair, 1, 0))
    return F.concat(pair, extra)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.hits_of(items_of(table(spark, sf_dir, "events")))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.daily_series(content(spark, sf_dir), resolved(spark, sf_dir))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one with a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return base.rstrip("/")


def fingerprint(spark: SparkSession, path: str) -> str:
    """What a stored result of these files is valid for: their place, number, bytes and latest change."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    of, whole = fs.getFileStatus(p), fs.getContentSummary(p)
    return hashlib.sha256(f"{path} {whole.getFileCount()} {whole.getLength()} {of.getModificationTime()}".encode()).hexdigest()[:24]


ITEMS = "content_item_id long, platform string, author string, day date, views long, likes long, comments long, override double, ts timestamp_ntz, entities array<struct<name: string, confidence: decimal(10,4)>>"


def stored(spark: SparkSession, sf_dir: str) -> D.SeriesStore:
    """The series of the events as a table by day: the session's first reader builds it, the others read the days that they ask for."""
    path = f"{shared_folder(spark)}/trendloom-series/{spark.sparkContext.applicationId}-{fingerprint(spark, f'{sf_dir}/events.parquet')}"
    out = D.SeriesStore(Store(spark, path), ITEMS, ["content_item_id"], "ts")
    out.build(O.daily_counts(O.hits_of(items_of(table(spark, sf_dir, "events")))))
    return out


def last_active(store: D.SeriesStore) -> str | None:
    """The last stored day with mentions: days are asked from the last one back, one partition each."""
    for day in reversed(store.days()):
        if store.series([day]).where("mention_count > 0").limit(1).count():
            return day
    return None


def last_day(spark: SparkSession, sf_dir: str, active: bool = False) -> DataFrame:
    """One row: the last day (_last) of the series, with mentions if `active`. It is that of the hits, so no series is built for it."""
    h = hits(spark, sf_dir)
    return (h.where(S.platform_weight(F.col("platform"), F.col("override")) > 0) if active else h).agg(F.max("day").alias("_last"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, brand, name): part k is the entity 'Perfume k'."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("Perfume "), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))


CONTENT = """
content AS (
    SELECT event_id AS content_item_id,
           CASE event_type WHEN 'click' THEN 'youtube' WHEN 'view' THEN 'tiktok' WHEN 'signup' THEN 'reddit' ELSE 'other' END AS platform,
           CAST(user_id AS VARCHAR) AS author, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS views,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS likes, user_id % 7 AS comments,
           CASE WHEN event_type = 'error' THEN 0.0 END AS override, ts
    FROM events
)"""

HITS = (
    CONTENT
    + """, hits AS (
    SELECT content.*, 'Perfume ' || likes AS entity_id, CAST((likes % 5 + 5) / 10.0 AS DECIMAL(10,4)) AS confidence FROM content
    UNION ALL
    SELECT content.*, 'Perfume ' || ((likes + 1) % 100), CAST((likes % 5 + 5) / 10.0 AS DECIMAL(10,4)) FROM content WHERE content_item_id % 3 = 0
), weighed AS (
    SELECT *, CAST(coalesce(override, CASE platform WHEN 'youtube' THEN 1.2 WHEN 'tiktok' THEN 0.9 WHEN 'reddit' THEN 1.0 WHEN 'other' THEN 0.8 ELSE 1.0 END) AS DECIMAL(10,4)) AS w,
           CASE WHEN platform = 'tiktok' THEN least(views, 500000) ELSE views END + 3 * likes + 5 * comments AS engagement
    FROM hits
)"""
)

SERIES = (
    HITS
    + """, counts AS (
    SELECT entity_id, day, CAST(sum(w) AS DOUBLE) AS mention_count, count(DISTINCT CASE WHEN w > 0 THEN author END) AS unique_authors,
           CAST(sum(engagement) AS BIGINT) AS engagement_sum, count(DISTINCT platform) AS platforms,
           round(avg(CASE WHEN w > 0 THEN CAST(confidence AS DOUBLE) END), 4) AS confidence_avg
    FROM weighed GROUP BY entity_id, day
), lagged AS (
    SELECT *, coalesce(lag(mention_count) OVER (PARTITION BY entity_id ORDER BY day), 0.0) AS p FROM counts
), moved AS (
    SELECT *, round(mention_count / greatest(p, 1.0), 4) AS momentum,
           round(CASE WHEN p > 0 THEN (mention_count - p) / p WHEN mention_count > 0 THEN 1.0 ELSE 0.0 END, 4) AS growth_rate
    FROM lagged
), scored AS (
    SELECT * EXCLUDE (p), round(momentum - coalesce(lag(momentum) OVER (PARTITION BY entity_id ORDER BY day), 0.0), 4) AS acceleration,
           round(100.0::DOUBLE * (0.35::DOUBLE * least(mention_count / 10.0::DOUBLE, 1.0::DOUBLE) + 0.25::DOUBLE * least(engagement_sum / 500000.0::DOUBLE, 1.0::DOUBLE)
             + 0.20::DOUBLE * ((least(greatest(growth_rate, -1.0::DOUBLE), 1.0::DOUBLE) + 1.0::DOUBLE) / 2.0::DOUBLE) + 0.10::DOUBLE * least(greatest(momentum, 0.0::DOUBLE) / 3.0::DOUBLE, 1.0::DOUBLE)
             + 0.10::DOUBLE * least(platforms / 3.0::DOUBLE, 1.0::DOUBLE)) + 1e-9, 4) AS composite_score
    FROM moved
), before AS (
    SELECT *, abs(acceleration) AS volatility, coalesce(lag(composite_score) OVER (PARTITION BY entity_id ORDER BY day), 0.0) AS prev_score FROM scored
), series AS (
    SELECT *, CASE
        WHEN mention_count <= 0 THEN NULL
        WHEN composite_score >= 15 AND growth_rate >= 0.35 AND mention_count >= 2 THEN 'breakout'
        WHEN (prev_score >= 10 AND composite_score < 0.5 * prev_score) OR (growth_rate < -0.30 AND prev_score >= 5) THEN 'declining'
        WHEN (growth_rate >= 0.15 AND composite_score >= 5 AND mention_count >= 1) OR (momentum >= 0.30 AND composite_score >= 5) THEN 'rising'
        WHEN composite_score >= 20 AND growth_rate >= -0.05 AND growth_rate <= 0.10 THEN 'peak'
        WHEN (prev_score = 0 AND composite_score > 0 AND mention_count >= 1) OR (composite_score < 10 AND growth_rate > 0 AND mention_count >= 1) THEN 'emerging'
        WHEN composite_score > 0 THEN 'stable' END AS trend_state
    FROM before
), brands AS (
    SELECT 'Perfume ' || p_partkey AS entity_id, p_brand AS brand, p_name AS name, p_type AS kind FROM part
)"""
)


def sql(body: str, upto: str = SERIES) -> str:
    """WITH <shared expressions>, <more or the final SELECT>."""
    body = body.strip()
    return f"WITH {upto.strip()}" + (f", {body}" if not body.upper().startswith("SELECT") else f"\n{body}")
