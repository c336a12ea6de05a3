"""Queries over the daily series: aggregation, signals, roll-up, serving."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.operators import series as O
from trendloom.plans import base as B
from trendloom.plans.registry import query

SERIES_COLUMNS = (
    "entity_id", "day", "mention_count", "unique_authors", "engagement_sum", "platforms", "confidence_avg",
    "growth_rate", "momentum", "acceleration", "volatility", "composite_score", "trend_state",
)


@query("daily_entity_series", B.sql(f"SELECT {', '.join(SERIES_COLUMNS)} FROM series"))
def daily_entity_series(spark, sf_dir):
    """AG01, WN05, JN01, JN02, SCA01-05: the flagship."""
    return B.series(spark, sf_dir).select(*SERIES_COLUMNS)


@query("daily_counts", B.sql("SELECT entity_id, day, mention_count, unique_authors, engagement_sum, platforms, confidence_avg FROM counts"))
def daily_counts(spark, sf_dir):
    """AG01 without history: first pass of the job."""
    return O.daily_counts(B.hits(spark, sf_dir))


SIGNALS = """
p AS (
    SELECT *, lag(composite_score) OVER w AS q, lag(true) OVER w AS seen FROM series WINDOW w AS (PARTITION BY entity_id ORDER BY day)
), g AS (
    SELECT *, coalesce(q, 0.0) AS b, CASE WHEN coalesce(q, 0.0) > 0 THEN (composite_score - q) / q ELSE 9999.9 END AS pct FROM p
), sig AS (
    SELECT entity_id, day, composite_score AS strength, 'new_entry' AS signal_type, round(composite_score, 4) AS detail FROM g WHERE seen IS NULL AND mention_count > 0
    UNION ALL
    SELECT entity_id, day, composite_score, 'breakout', round(pct, 4) FROM g WHERE seen AND composite_score >= 15 AND mention_count >= 2 AND pct >= 0.35
    UNION ALL
    SELECT entity_id, day, composite_score, 'acceleration_spike', round(momentum, 4) FROM g WHERE seen AND momentum >= 1.5
    UNION ALL
    SELECT entity_id, day, composite_score, 'reversal', round((b - composite_score) / b, 4) FROM g
    WHERE seen AND b >= 15 AND (b - composite_score) / b >= 0.40 AND mention_count >= 2 AND b / greatest(composite_score, 0.01) <= 4
)
"""


@query("signal_detection", B.sql(SIGNALS + "SELECT entity_id, day, strength, signal_type, detail FROM sig"))
def signal_detection(spark, sf_dir):
    """SIG01, SCA19."""
    return O.signals(B.series(spark, sf_dir))


@query("latest_signal", B.sql(SIGNALS + "SELECT DISTINCT ON (entity_id) entity_id, day, strength, signal_type FROM sig ORDER BY entity_id, day DESC, strength DESC, signal_type"))
def latest_signal(spark, sf_dir):
    """JN08: the latest signal of each entity, ties to the strongest."""
    s = O.signals(B.series(spark, sf_dir))
    w = Window.partitionBy("entity_id").orderBy(F.desc("day"), F.desc("strength"), "signal_type")
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("entity_id", "day", "strength", "signal_type")


@query("signals_with_entity", B.sql(SIGNALS + "SELECT s.entity_id, s.day, s.signal_type, b.brand, b.name FROM sig s JOIN brands b USING (entity_id) WHERE s.day >= (SELECT max(day) FROM series) - 7"))
def signals_with_entity(spark, sf_dir):
    """JN07, FLT05, API03: recent signals joined to the entity dimension."""
    s = B.series(spark, sf_dir)
    cutoff = B.last_day(spark, sf_dir)
    found = O.signals(s).crossJoin(F.broadcast(cutoff)).where(F.col("day") >= F.date_sub("_last", 7))
    return found.join(B.brands(spark, sf_dir), "entity_id").select("entity_id", "day", "signal_type", "brand", "name")


@query("signal_counts", B.sql(SIGNALS + "SELECT day, signal_type, count(*) AS n FROM sig GROUP BY day, signal_type"))
def signal_counts(spark, sf_dir):
    return O.signals(B.series(spark, sf_dir)).groupBy("day", "signal_type").agg(F.count(F.lit(1)).alias("n"))


@query("carry_forward", B.sql("""
ahead AS (
    SELECT DISTINCT entity_id, CAST(day + CAST(n AS INTEGER) AS DATE) AS day FROM (SELECT entity_id, day, unnest(range(1, 8)) AS n FROM series WHERE mention_count > 0) t
)
SELECT a.entity_id, a.day, 0.0::DOUBLE AS mention_count, -1.0::DOUBLE AS growth_rate, 0.0::DOUBLE AS composite_score
FROM ahead a LEFT JOIN series s ON a.entity_id = s.entity_id AND a.day = s.day
WHERE s.day IS NULL AND a.day <= (SELECT max(day) FROM series)
"""))
def carry_forward(spark, sf_dir):
    """SIG07, JN11, STM07: zero rows for quiet entities."""
    store = B.stored(spark, sf_dir)
    last = spark.createDataFrame([(max(store.days(), default=None),)], "d string").select(F.col("d").cast("date").alias("_last"))
    return O.carry_forward(store.series().select("entity_id", "day", "mention_count"), last=last).select("entity_id", "day", "mention_count", "growth_rate", "composite_score")


@query("brand_rollup", B.sql("""
r AS (
    SELECT brand, day, sum(CAST(mention_count AS DECIMAL(18,4))) AS m, sum(engagement_sum) AS e, sum(unique_authors) AS a,
           sum(CAST(composite_score AS DECIMAL(18,4)) * CAST(mention_count AS DECIMAL(18,4))) AS ws,
           sum(CAST(growth_rate AS DECIMAL(18,4)) * CAST(mention_count AS DECIMAL(18,4))) AS wg,
           avg(momentum) AS mo, avg(volatility) AS v
    FROM series JOIN brands USING (entity_id) GROUP BY brand, day
)
SELECT brand, day, CAST(m AS DOUBLE) AS mention_count, CAST(e AS BIGINT) AS engagement_sum, CAST(a AS BIGINT) AS unique_authors,
       round(CAST(ws AS DOUBLE) / CAST(m AS DOUBLE) + 1e-9, 4) AS composite_score, round(CAST(wg AS DOUBLE) / CAST(m AS DOUBLE) + 1e-9, 4) AS growth_rate
FROM r WHERE m > 0
"""))
def brand_rollup(spark, sf_dir):
    """AG02."""
    out = O.brand_rollup(B.stored(spark, sf_dir).series(), B.brands(spark, sf_dir))
    return out.select("brand", "day", "mention_count", "engagement_sum", "unique_authors", "composite_score", "growth_rate")


@query("weighted_signal_score", B.sql("""
src AS (
    SELECT entity_id, day, CAST(round(CASE
        WHEN platform = 'youtube' THEN 0.7::DOUBLE * least(log10(views + 1.0::DOUBLE) / 5.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * least(coalesce((likes + comments)::DOUBLE / nullif(views, 0), 0) * 10.0::DOUBLE, 1.0::DOUBLE)
        WHEN platform = 'reddit' AND (likes > 0 OR comments > 0) THEN 0.6::DOUBLE * least(log10(likes + 1.0::DOUBLE) / 3.0::DOUBLE, 1.0::DOUBLE) + 0.4::DOUBLE * least(log10(comments + 1.0::DOUBLE) / 2.0::DOUBLE, 1.0::DOUBLE)
        END, 4) AS DECIMAL(10,4)) AS score FROM hits
), mean AS (SELECT entity_id, day, CAST(round(sum(score) / count(score), 8) AS DOUBLE) AS m FROM src GROUP BY entity_id, day)
SELECT s.entity_id, s.day, round(least(100.0, composite_score * (1.0 + coalesce(m, 0.0))) + 1e-9, 4) AS weighted_score
FROM series s LEFT JOIN mean USING (entity_id, day) WHERE mention_count > 0
"""))
def weighted_signal_score(spark, sf_dir):
    """JN10, SCA06, SCA07: pre-aggregated mean source score joined back."""
    return O.weighted_scores(B.series(spark, sf_dir), B.hits(spark, sf_dir))


@query("latest_snapshot", B.sql("SELECT b.entity_id, b.brand, l.day, l.composite_score, l.trend_state FROM brands b LEFT JOIN (SELECT DISTINCT ON (entity_id) * FROM series WHERE mention_count > 0 ORDER BY entity_id, day DESC) l USING (entity_id)"))
def latest_snapshot(spark, sf_dir):
    """JN04, WN02, FLT02: entities with their last active row."""
    last = O.latest(B.stored(spark, sf_dir).series().select("entity_id", "day", "mention_count", "composite_score", "trend_state"))
    return B.brands(spark, sf_dir).join(last, "entity_id", "left").select("entity_id", "brand", "day", "composite_score", "trend_state")


@query("single_day_rows", B.sql("SELECT b.entity_id, s.composite_score, s.mention_count FROM brands b LEFT JOIN (SELECT * FROM series WHERE day = DATE '2024-01-15' AND mention_count > 0) s USING (entity_id)"))
def single_day_rows(spark, sf_dir):
    """JN05: left join on an exact date, of which only its partition is read."""
    day = B.stored(spark, sf_dir).series(["2024-01-15"]).where("mention_count > 0")
    return B.brands(spark, sf_dir).join(day, "entity_id", "left").select("entity_id", "composite_score", "mention_count")


@query("range_rows", B.sql("""
SELECT entity_id, CAST(sum(CAST(mention_count AS DECIMAL(18,4))) AS DOUBLE) AS mention_count, CAST(sum(engagement_sum) AS BIGINT) AS engagement_sum,
       max(composite_score) AS max_score, arg_max(coalesce(trend_state, '-'), day) AS latest_state, max(day) AS latest_day
FROM series WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY entity_id HAVING sum(mention_count) > 0
"""))
def range_rows(spark, sf_dir):
    """JN06, AG06, SUP03: range aggregate and latest metrics in one pass over the range's partitions."""
    out = O.range_rows(B.stored(spark, sf_dir).between("2024-01-10", "2024-01-20"), F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))
    return out.drop("avg_score").withColumn("latest_state", F.coalesce("latest_state", F.lit("-")))


@query("dashboard_kpis", B.sql("""
d AS (SELECT * FROM series WHERE day = (SELECT max(day) FROM series WHERE mention_count > 0) AND mention_count > 0)
SELECT count(*) AS tracked, count(*) FILTER (WHERE composite_score >= 15) AS breakouts, count(*) FILTER (WHERE trend_state = 'rising') AS rising,
       count(DISTINCT b.brand) AS brands, CAST(round(sum(CAST(composite_score AS DECIMAL(18,4))) / count(*), 3) AS DOUBLE) AS avg_score,
       CAST(sum(engagement_sum) AS BIGINT) AS engagement, max(day) AS day
FROM d LEFT JOIN brands b USING (entity_id)
"""))
def dashboard_kpis(spark, sf_dir):
    """AG07, AG08, JN24, API01: conditional counts on the latest active date, the only partition that is read."""
    store = B.stored(spark, sf_dir)
    last = B.last_active(store)
    d = store.series([last] if last else []).where("mention_count > 0").join(B.brands(spark, sf_dir), "entity_id", "left")
    return d.agg(
        F.count(F.lit(1)).alias("tracked"), F.count_if(F.col("composite_score") >= 15).alias("breakouts"), F.count_if(F.col("trend_state") == "rising").alias("rising"),
        F.countDistinct("brand").alias("brands"), F.round(F.sum(F.col("composite_score").cast("decimal(18,4)")) / F.count(F.lit(1)), 3).cast("double").alias("avg_score"),
        F.sum("engagement_sum").alias("engagement"), F.max("day").alias("day"),
    )


COLLAPSED = """
l AS (SELECT DISTINCT ON (entity_id) * FROM series WHERE mention_count > 0 ORDER BY entity_id, day DESC),
v AS (
    SELECT b.name AS grp, entity_id, mention_count, engagement_sum, unique_authors, composite_score, growth_rate, momentum, acceleration, trend_state,
           CASE trend_state WHEN 'breakout' THEN 6 WHEN 'rising' THEN 5 WHEN 'peak' THEN 4 WHEN 'stable' THEN 3 WHEN 'declining' THEN 2 WHEN 'emerging' THEN 1 ELSE 0 END AS prio
    FROM l JOIN brands b USING (entity_id)
), c AS (
    SELECT grp, (list(entity_id ORDER BY composite_score DESC, entity_id))[1] AS primary_name, CAST(sum(CAST(mention_count AS DECIMAL(18,4))) AS DOUBLE) AS mention_count,
           CAST(sum(engagement_sum) AS BIGINT) AS engagement_sum, max(unique_authors) AS unique_authors, max(composite_score) AS composite_score,
           max(growth_rate) AS growth_rate, max(momentum) AS momentum, max(abs(acceleration)) AS acceleration,
           (list(trend_state ORDER BY prio DESC))[1] AS trend_state, count(*) AS n_variants,
           round(CASE WHEN max(unique_authors) < 2 THEN max(composite_score) * 0.6 ELSE max(composite_score) END, 4) AS effective_score
    FROM v GROUP BY grp
)
"""
COLLAPSED_COLUMNS = "grp, primary_name, mention_count, engagement_sum, unique_authors, composite_score, growth_rate, momentum, acceleration, trend_state, n_variants, effective_score"


def _collapsed(spark, sf_dir):
    last = O.latest(B.stored(spark, sf_dir).series().drop("p1", "p2")).join(B.brands(spark, sf_dir).select("entity_id", F.col("name").alias("grp")), "entity_id")
    return O.collapse_variants(last, "grp", "entity_id")


@query("variant_collapse", B.sql(COLLAPSED + f"SELECT {COLLAPSED_COLUMNS} FROM c"))
def variant_collapse(spark, sf_dir):
    """AG05, SCA08: variants merged, primary elected, dampened score."""
    return _collapsed(spark, sf_dir)


@query("top_movers", B.sql(COLLAPSED + "SELECT row_number() OVER (ORDER BY effective_score DESC, grp) AS rank, grp, effective_score, trend_state FROM c QUALIFY rank <= 20"))
def top_movers(spark, sf_dir):
    """TK02, WN08: ranked movers; the rank is taken over the twenty rows left by the top-k."""
    top = _collapsed(spark, sf_dir).orderBy(F.desc("effective_score"), "grp").limit(20)
    return top.select(F.row_number().over(Window.orderBy(F.desc("effective_score"), "grp")).alias("rank"), "grp", "effective_score", "trend_state")


@query("screener", B.sql(COLLAPSED + "SELECT grp, composite_score, mention_count, trend_state FROM c WHERE composite_score >= 10 AND mention_count >= 2 AND contains(lower(grp), 'e') ORDER BY composite_score DESC, grp LIMIT 25 OFFSET 5"))
def screener(spark, sf_dir):
    """FLT03, TK01, API02: conjunctive filters with null as zero, sorted page."""
    c = _collapsed(spark, sf_dir)
    kept = c.where((S.zero(F.col("composite_score")) >= 10) & (S.zero(F.col("mention_count")) >= 2) & F.lower("grp").contains("e"))
    return kept.orderBy(F.desc("composite_score"), "grp").offset(5).limit(25).select("grp", "composite_score", "mention_count", "trend_state")


@query("trend_state_histogram", B.sql("SELECT day, coalesce(trend_state, 'none') AS state, count(*) AS n FROM series GROUP BY 1, 2"))
def trend_state_histogram(spark, sf_dir):
    """AG04."""
    return B.series(spark, sf_dir).groupBy("day", F.coalesce("trend_state", F.lit("none")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("stale_entities", B.sql("""
a AS (SELECT b.entity_id, max(CASE WHEN mention_count > 0 THEN day END) AS last_active FROM brands b LEFT JOIN series s USING (entity_id) GROUP BY b.entity_id)
SELECT entity_id, last_active, CAST(date_diff('day', last_active, (SELECT max(day) FROM series)) AS INTEGER) AS inactive_days FROM a
WHERE last_active IS NULL OR last_active < (SELECT max(day) FROM series) - 3
"""))
def stale_entities(spark, sf_dir):
    """AG31, SCA18, RUL03."""
    s = B.series(spark, sf_dir)
    last = B.last_day(spark, sf_dir)
    a = B.brands(spark, sf_dir).join(s, "entity_id", "left").groupBy("entity_id").agg(F.max(F.when(F.col("mention_count") > 0, F.col("day"))).alias("last_active"))
    a = a.crossJoin(F.broadcast(last))
    return a.where(F.col("last_active").isNull() | (F.col("last_active") < F.date_sub("_last", 3))).select("entity_id", "last_active", F.datediff("_last", "last_active").alias("inactive_days"))


@query("alerts", B.sql(SIGNALS + """, l AS (SELECT DISTINCT ON (entity_id) * FROM series WHERE mention_count > 0 ORDER BY entity_id, day DESC),
rules AS (SELECT entity_id, ['breakout_detected', 'score_above', 'growth_above', 'confidence_below'][1 + hash_mod] AS kind FROM (SELECT entity_id, p % 4 AS hash_mod FROM (SELECT 'Perfume ' || p_partkey AS entity_id, p_partkey AS p FROM part) q) t),
recent AS (SELECT DISTINCT entity_id FROM sig WHERE signal_type = 'breakout' AND day >= (SELECT max(day) FROM series) - 1)
SELECT r.entity_id, r.kind, CASE r.kind WHEN 'breakout_detected' THEN x.entity_id IS NOT NULL WHEN 'score_above' THEN coalesce(l.composite_score > 20, false)
   WHEN 'growth_above' THEN coalesce(l.growth_rate > 0.2, false) ELSE coalesce(l.confidence_avg < 0.7, false) END AS fired
FROM rules r LEFT JOIN l USING (entity_id) LEFT JOIN recent x ON r.entity_id = x.entity_id"""))
def alerts(spark, sf_dir):
    """ALR01, JN42: rules joined to the latest snapshot and to recent signals."""
    s = B.series(spark, sf_dir)
    kinds = F.array(*[F.lit(x) for x in ("breakout_detected", "score_above", "growth_above", "confidence_below")])
    rules = B.table(spark, sf_dir, "part").select(F.concat(F.lit("Perfume "), F.col("p_partkey").cast("string")).alias("entity_id"), F.get(kinds, F.pmod("p_partkey", F.lit(4)).cast("int")).alias("kind"))
    last = B.last_day(spark, sf_dir)
    recent = O.signals(s).where("signal_type = 'breakout'").crossJoin(F.broadcast(last)).where(F.col("day") >= F.date_sub("_last", 1)).select("entity_id").distinct().withColumn("_hit", F.lit(True))
    j = rules.join(O.latest(s), "entity_id", "left").join(recent, "entity_id", "left")
    fired = (
        F.when(F.col("kind") == "breakout_detected", F.col("_hit").isNotNull()).when(F.col("kind") == "score_above", F.col("composite_score") > 20)
        .when(F.col("kind") == "growth_above", F.col("growth_rate") > 0.2).otherwise(F.col("confidence_avg") < 0.7)
    )
    return j.select("entity_id", "kind", F.coalesce(fired, F.lit(False)).alias("fired"))
