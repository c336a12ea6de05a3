"""Queries over catalog upkeep and entity pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import text as T
from trendloom.operators import candidates as C
from trendloom.operators import catalog as G
from trendloom.operators import resolver as R
from trendloom.operators import series as O
from trendloom.plans import base as B
from trendloom.plans.registry import query


@query("substring_matches", """SELECT t.text, (list(n.name ORDER BY length(n.name) DESC, n.name DESC))[1] AS match FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS text FROM part) t
JOIN (SELECT DISTINCT p_name AS name FROM part WHERE length(p_name) >= 5) n ON (contains(lower(n.name), lower(t.text)) OR contains(lower(t.text), lower(n.name))) AND lower(n.name) <> lower(t.text) GROUP BY t.text""")
def substring_matches(spark, sf_dir):
    """JN22."""
    p = B.table(spark, sf_dir, "part")
    return G.substring_matches(p.select(F.substring_index("p_name", " ", 1).alias("text")), p.select(F.col("p_name").alias("name")))


@query("brand_states", B.sql("""r AS (
    SELECT brand, day, sum(CAST(mention_count AS DECIMAL(18,4))) AS m, sum(CAST(composite_score AS DECIMAL(18,4)) * CAST(mention_count AS DECIMAL(18,4))) AS ws FROM series JOIN brands USING (entity_id) GROUP BY brand, day
), s AS (SELECT brand, day, round(CAST(ws AS DOUBLE) / CAST(m AS DOUBLE) + 1e-9, 4) AS composite_score FROM r WHERE m > 0)
SELECT brand, day, composite_score, coalesce(lag(composite_score) OVER (PARTITION BY brand ORDER BY day), 0.0) AS prev_score FROM s"""))
def brand_states(spark, sf_dir):
    """AG02, JN03, RUL07: previous active score of brands."""
    return O.with_trend_of_brands(B.series(spark, sf_dir), B.brands(spark, sf_dir)).select("brand", "day", "composite_score", "prev_score")


@query("brand_derivation")
def brand_derivation(spark, sf_dir):
    """SIG08, FLT12: catalog first, then the guarded heuristic."""
    p = B.table(spark, sf_dir, "part")
    names = p.select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct()
    catalog = p.where("p_size < 25").select(T.slug_canonical(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"), F.col("p_brand").alias("brand"))
    return G.derive_brand(names, catalog, p.select(F.concat_ws(" ", "p_brand", F.substring_index("p_name", " ", 1)).alias("brand")))


@query("ghost_brands", "SELECT DISTINCT p_brand AS brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 2) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)")
def ghost_brands(spark, sf_dir):
    """RUL06, SUP26."""
    p = B.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand")
    return G.ghost_brands(p.select("brand").distinct(), p.where("p_size < 2"), p.where("p_size > 49"))


@query("promoted_aliases")
def promoted_aliases(spark, sf_dir):
    """CAN05: alias rows of merge decisions."""
    p = B.table(spark, sf_dir, "part").select("p_name").distinct()
    texts = p.select(F.concat("p_name", F.lit("s")).alias("text"))
    none = p.select(F.col("p_name").alias("key"), F.col("p_name").alias("target")).where("false")
    merge = R.best_fuzzy(texts, p.select(F.col("p_name").alias("name"))).select("text", "match")
    brands = p.select(F.substring_index("p_name", " ", 1).alias("key"), F.substring_index("p_name", " ", 1).alias("brand")).distinct()
    return G.promotion_writes(C.precheck(texts, C.exact_matches(texts, none, none, none), merge, C.brand_prefix(texts, brands)))["aliases"]


@query("seed_candidates", "SELECT DISTINCT upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS brand_name, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS perfume_name, 'discovery' AS source FROM part")
def seed_candidates(spark, sf_dir):
    """CAN08."""
    return G.seed_candidates(B.table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct())


@query("query_experiments", """SELECT p_brand AS query, count(DISTINCT p_size % 4) AS runs, count(*) AS mentions, CASE WHEN count(*) >= 3 AND count(DISTINCT p_size % 4) >= 2 THEN 'confirm' ELSE 'review' END AS verdict FROM part GROUP BY 1""")
def query_experiments(spark, sf_dir):
    """AG41, SCA22, STM10."""
    p = B.table(spark, sf_dir, "part")
    e = G.experiment_evidence(p.select(F.col("p_brand").alias("query"), F.pmod("p_size", F.lit(4)).alias("run")), p.select(F.col("p_brand").alias("query"), F.col("p_type").alias("entity_id")))
    return e.select("query", "runs", "mentions", G.experiment_verdict(F.col("runs"), F.col("mentions"), F.lit(0)).alias("verdict"))


@query("entity_query_evidence", "SELECT p_name AS entity, p_brand AS query, count(*) AS n, CASE WHEN count(*) >= 11 THEN 0.35 WHEN count(*) >= 6 THEN 0.30 WHEN count(*) >= 3 THEN 0.25 ELSE 0.20 END::DOUBLE AS confidence FROM part GROUP BY 1, 2 HAVING count(*) >= 2")
def entity_query_evidence(spark, sf_dir):
    """AG30, SCA21, CRE04."""
    n = B.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("entity"), F.col("p_brand").alias("query")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return n.withColumn("confidence", G.relationship_confidence(F.col("n")))


@query("data_composition", "SELECT event_type AS platform, count(*) FILTER (WHERE user_id < 10) AS demo, count(*) FILTER (WHERE user_id >= 10) AS real, round(count(*) FILTER (WHERE user_id < 10) / count(*)::DOUBLE, 4) AS share FROM events GROUP BY 1")
def data_composition(spark, sf_dir):
    """AG37."""
    return G.composition(B.table(spark, sf_dir, "events").withColumnRenamed("event_type", "platform"), F.col("user_id") < 10)


@query("query_risks")
def query_risks(spark, sf_dir):
    """SCA23."""
    p = B.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("phrase")).agg(F.countDistinct("p_brand").alias("channels"), F.avg("p_size").alias("score"))
    risk = G.query_risk(F.col("phrase"), F.col("channels"), F.col("score"), ("red",), ("ring",), ("old",))
    return p.select("phrase", risk.alias("risk"), G.query_action(risk, F.col("channels")).alias("action"))


@query("entity_history", B.sql("SELECT entity_id, day, mention_count, composite_score FROM series WHERE entity_id = 'Perfume 7' ORDER BY day DESC LIMIT 30"))
def entity_history(spark, sf_dir):
    """API05, TK04: history of one entity."""
    s = B.series(spark, sf_dir)
    return s.where("entity_id = 'Perfume 7'").orderBy(F.desc("day")).limit(30).select("entity_id", "day", "mention_count", "composite_score")


@query("entity_drivers", B.sql("SELECT content_item_id, engagement FROM weighed WHERE entity_id = 'Perfume 7' ORDER BY engagement DESC, content_item_id LIMIT 5", B.HITS))
def entity_drivers(spark, sf_dir):
    """WN03: best drivers of one entity."""
    from trendloom.functions import scores as S

    e = S.engagement_total(F.col("platform"), F.col("views"), F.col("likes"), F.col("comments"))
    return B.hits(spark, sf_dir).where("entity_id = 'Perfume 7'").select("content_item_id", e.alias("engagement")).orderBy(F.desc("engagement"), "content_item_id").limit(5)


@query("public_brand_top", B.sql("l AS (SELECT DISTINCT ON (entity_id) * FROM series WHERE mention_count > 0 ORDER BY entity_id, day DESC) SELECT brand, entity_id, composite_score FROM l JOIN brands USING (entity_id) QUALIFY row_number() OVER (PARTITION BY brand ORDER BY composite_score DESC, entity_id) <= 5"))
def public_brand_top(spark, sf_dir):
    """JN23, JN14, FLT16, API13: five best entities of each brand, cleared columns only."""
    from pyspark.sql import Window

    from trendloom.operators.creators import public_columns

    j = O.latest(B.series(spark, sf_dir)).join(B.brands(spark, sf_dir), "entity_id")
    w = Window.partitionBy("brand").orderBy(F.desc("composite_score"), "entity_id")
    top = j.withColumn("_r", F.row_number().over(w)).where("_r <= 5").select("brand", "entity_id", "composite_score")
    return public_columns(top, ("brand", "entity_id", "composite_score"))


@query("watchlist", B.sql("l AS (SELECT DISTINCT ON (entity_id) * FROM series WHERE mention_count > 0 ORDER BY entity_id, day DESC) SELECT c_custkey AS watcher, 'Perfume ' || (c_custkey % 120) AS entity_id, l.composite_score, b.brand FROM customer LEFT JOIN l ON l.entity_id = 'Perfume ' || (c_custkey % 120) LEFT JOIN brands b ON b.entity_id = 'Perfume ' || (c_custkey % 120)"))
def watchlist(spark, sf_dir):
    """JN41, API12: watched entities with snapshot and brand."""
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("watcher"), F.concat(F.lit("Perfume "), F.pmod("c_custkey", F.lit(120))).alias("entity_id"))
    last = O.latest(B.series(spark, sf_dir)).select("entity_id", "composite_score")
    return c.join(last, "entity_id", "left").join(B.brands(spark, sf_dir).select("entity_id", "brand"), "entity_id", "left").select("watcher", "entity_id", "composite_score", "brand")
