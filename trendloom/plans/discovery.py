"""Queries over candidates, creators, joins and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions import text as T
from trendloom.operators import candidates as C
from trendloom.operators import creators as K
from trendloom.operators import resolver as R
from trendloom.plans import base as B
from trendloom.plans.market import SIGNALS
from trendloom.plans.registry import query
from trendloom.streaming import daystore as D

TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "unrated", "blocked")


def _phrase_mentions(spark, sf_dir):
    """Events as phrase mentions: part name -> phrase, user -> channel."""
    e, p = B.table(spark, sf_dir, "events"), B.table(spark, sf_dir, "part")
    k = F.get_json_object("props", "$.k").cast("long")
    tier = F.get(F.array(*[F.lit(t) for t in TIERS]), F.pmod("user_id", F.lit(6)).cast("int"))
    m = e.select(k.alias("p_partkey"), F.col("user_id").alias("channel"), tier.alias("tier"), F.to_date("ts").alias("day"))
    return m.join(p.select("p_partkey", F.col("p_name").alias("phrase")), "p_partkey").drop("p_partkey")


EMERGING = """pm AS (
    SELECT p_name AS phrase, user_id AS channel, ['tier_1', 'tier_2', 'tier_3', 'tier_4', 'unrated', 'blocked'][1 + user_id % 6] AS tier, CAST(ts AS DATE) AS day
    FROM events JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT)
), per AS (
    SELECT phrase, channel, count(*) AS n, max(tier) AS tier, min(day) AS f, max(day) AS l FROM pm WHERE day <= DATE '2024-01-30' AND day > DATE '2024-01-30' - 14 GROUP BY 1, 2
), w AS (
    SELECT *, CAST(CASE tier WHEN 'tier_1' THEN 3 WHEN 'tier_2' THEN 2 WHEN 'tier_3' THEN 1 WHEN 'blocked' THEN 0 ELSE 0.5 END AS DECIMAL(10,4)) AS w FROM per
), em AS (
    SELECT phrase, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS channels, CAST(sum(w) AS DOUBLE) AS weighted, arg_max(channel, (w * 1000000 + n) * 1000000 + channel) AS top_channel, min(f) AS first_seen, max(l) AS last_seen,
           round(CAST(sum(w) AS DOUBLE) * exp(-0.1::DOUBLE * date_diff('day', max(l), DATE '2024-01-30')) + 1e-9, 4) AS score,
           CAST(greatest(date_diff('day', min(f), max(l)) + 1, 1) AS INTEGER) AS days_active
    FROM w GROUP BY phrase
)"""


@query("emerging_phrases", f"WITH {EMERGING} SELECT phrase, mentions, channels, weighted, top_channel, first_seen, last_seen, days_active, score FROM em")
def emerging_phrases(spark, sf_dir):
    """AG25, SCA09, CAN07, STM03: per-channel-once weights and decay."""
    return C.emerging(_phrase_mentions(spark, sf_dir), F.lit("2024-01-30").cast("date"), 14).drop("kind")


@query("emerging_review", f"""WITH {EMERGING}, known AS (SELECT DISTINCT p_name AS phrase FROM part WHERE p_size > 48)
SELECT phrase, score FROM em WHERE phrase NOT IN (SELECT phrase FROM known) AND channels >= 2 ORDER BY score DESC, phrase LIMIT 20""")
def emerging_review(spark, sf_dir):
    """JN12, JN16, TK03, API10: anti-joins before the top-k."""
    e = C.emerging(_phrase_mentions(spark, sf_dir), F.lit("2024-01-30").cast("date"), 14)
    known = B.table(spark, sf_dir, "part").where("p_size > 48").select(F.col("p_name").alias("phrase")).distinct()
    return e.join(known, "phrase", "left_anti").where("channels >= 2").orderBy(F.desc("score"), "phrase").limit(20).select("phrase", "score")


@query("containment_suppression", """WITH p AS (
    SELECT p_name AS phrase, count(*) * 1.0::DOUBLE AS score FROM part GROUP BY 1 UNION ALL SELECT split_part(p_name, ' ', 1), count(*) * 0.5::DOUBLE FROM part GROUP BY 1
), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, length(phrase) DESC, phrase) AS n FROM p)
SELECT phrase, score FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.n < r.n AND o.phrase <> r.phrase AND contains(' ' || o.phrase || ' ', ' ' || r.phrase || ' '))""")
def containment_suppression(spark, sf_dir):
    """WN09, FLT07: phrases inside better phrases go."""
    p = B.table(spark, sf_dir, "part")
    whole = p.groupBy(F.col("p_name").alias("phrase")).agg((F.count(F.lit(1)) * 1.0).alias("score"))
    head = p.groupBy(F.substring_index("p_name", " ", 1).alias("phrase")).agg((F.count(F.lit(1)) * 0.5).alias("score"))
    return C.suppress_contained(whole.unionByName(head))


def _candidates(spark, sf_dir):
    t = T.ngrams(T.tokenize_ascii(F.col("text")), 1, 2)
    return B.table(spark, sf_dir, "conversations").select("conv_id", F.explode(t).alias("g")).select("conv_id", F.col("g.phrase").alias("phrase"))


@query("candidate_classification")
def candidate_classification(spark, sf_dir):
    """CAN01, CAN02, FLT08, FLT09: noise rules, kind and status of frequent phrases."""
    c = _candidates(spark, sf_dir).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return C.classify(c, ("thing", "shore"), ("rose", "amber")).select("phrase", "n", "reason", "kind", "status", "tokens")


@query("review_summary")
def review_summary(spark, sf_dir):
    """AG38, AG28: counts by status and reason with confidence buckets."""
    c = candidate_classification(spark, sf_dir)
    bucket = S.bands(S.log_confidence(F.col("n")), [(4.0, "high"), (3.0, "good"), (2.0, "fair")], "low")
    return c.groupBy("status", F.coalesce("reason", F.lit("-")).alias("reason"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("phrase_validity")
def phrase_validity(spark, sf_dir):
    """FLT06, FLT09, FLT11."""
    c = _candidates(spark, sf_dir).select("phrase").distinct()
    return c.withColumn("valid", C.valid_phrase(F.col("phrase"), ("of the",), ("in the",)))


@query("promotion_precheck")
def promotion_precheck(spark, sf_dir):
    """CAN03, CAN04, FLT10, JN33, JN35, JN36, SRC22: decision for each proposed name."""
    p = B.table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    texts = p.select(F.explode(F.array("p_name", F.concat("p_name", F.lit("s")), F.lower("p_type"), F.lit("ab"), F.lit("x dupe"))).alias("text")).distinct()
    names = p.select(F.col("p_name").alias("key"), F.col("p_name").alias("target")).where("key < 'm'")
    none = names.where("false")
    brands = p.select(F.substring_index("p_name", " ", 1).alias("key"), F.initcap(F.substring_index("p_name", " ", 1)).alias("brand")).distinct()
    exact = C.exact_matches(texts, names, none, none)
    merge = R.best_fuzzy(texts, p.select(F.col("p_name").alias("name"))).select("text", "match")
    return C.precheck(texts, exact, merge, C.brand_prefix(texts, brands))


@query("merged_runs", """WITH c AS (SELECT p_name AS phrase, CAST(ts AS DATE) AS day FROM events JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT))
SELECT phrase, count(*) AS occurrences, min(day) AS first_seen, max(day) AS last_seen FROM c GROUP BY phrase""")
def merged_runs(spark, sf_dir):
    """WN11, AG27: two runs merged into prior state."""
    m = _phrase_mentions(spark, sf_dir)
    run = lambda cond: m.where(cond).groupBy("phrase").agg(F.count(F.lit(1)).alias("occurrences"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    half = F.lit("2024-01-15").cast("date")
    return C.merge_runs(run(F.col("day") < half), run(F.col("day") >= half))


def _creator_mentions(spark, sf_dir):
    return B.hits(spark, sf_dir).select(F.col("author").alias("creator"), "entity_id", F.col("content_item_id").alias("item"), "day", "views", "likes", "comments")


REL = """rel AS (
    SELECT author AS creator, entity_id, count(*) AS mentions, count(DISTINCT content_item_id) AS items, min(day) AS first_day, max(day) AS last_day, CAST(sum(views) AS BIGINT) AS views
    FROM hits GROUP BY 1, 2
)"""


@query("creator_relationships", B.sql(REL + " SELECT * FROM rel", B.HITS))
def creator_relationships(spark, sf_dir):
    """AG22, JN29."""
    return K.relationships(_creator_mentions(spark, sf_dir)).drop("avg_rate")


EARLY = SIGNALS.rstrip().rstrip(")") + "), " + REL + """, fs AS (SELECT entity_id, min(day) AS first_signal FROM sig WHERE signal_type IN ('breakout', 'acceleration_spike') GROUP BY 1),
er AS (SELECT rel.*, first_signal, coalesce(first_day < first_signal, false) AS early FROM rel LEFT JOIN fs USING (entity_id)) """


@query("early_signals", B.sql(EARLY + "SELECT creator, entity_id, first_day, first_signal, early, CASE WHEN early THEN CAST(date_diff('day', first_day, first_signal) AS INTEGER) END AS days_before FROM er"))
def early_signals(spark, sf_dir):
    """JN30: first mention before the first signal."""
    rel = K.relationships(_creator_mentions(spark, sf_dir))
    return K.early_signals(rel, D.stored_signals(B.stored(spark, sf_dir).series())).select("creator", "entity_id", "first_day", "first_signal", "early", "days_before")


@query("creator_scores", B.sql(EARLY + """, c AS (SELECT CAST(user_id AS VARCHAR) AS creator, CAST(sum(round(value)) AS BIGINT) AS subscribers FROM events GROUP BY 1),
r AS (SELECT creator, CAST(sum(mentions) AS BIGINT) AS mentions, count(DISTINCT entity_id) AS entities, CAST(sum(early::INT) AS BIGINT) AS early FROM er GROUP BY 1)
SELECT creator, subscribers, mentions, entities, early, round(0.25::DOUBLE * least(log10(subscribers + 1.0) / 7.0, 1.0) + 0.20::DOUBLE + 0.20::DOUBLE * least(entities / 50.0, 1.0) + 0.15::DOUBLE * least(log10(mentions + 1.0) / 3.0, 1.0) + 0.10::DOUBLE * least(early / 20.0, 1.0), 4) AS influence
FROM c JOIN r USING (creator)"""))
def creator_scores(spark, sf_dir):
    """AG23, SCA11, JN28."""
    m = _creator_mentions(spark, sf_dir)
    rel = K.early_signals(K.relationships(m), D.stored_signals(B.stored(spark, sf_dir).series())).withColumn("avg_rate", F.lit(0.0))
    items = m.groupBy("creator", "item").agg(F.count(F.lit(1)).alias("n_entities"))
    ch = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("creator")).agg(F.sum(F.round("value")).cast("long").alias("subscribers"))
    out = K.creator_scores(items, rel, ch)
    return out.select("creator", "subscribers", "mentions", "entities", "early", F.round("influence", 4).alias("influence"))


@query("creator_board", B.sql(REL + ", t AS (SELECT creator, CAST(sum(mentions) AS BIGINT) AS mentions, count(*) AS entities FROM rel GROUP BY 1) SELECT creator, mentions, entities FROM t WHERE entities >= 5 ORDER BY mentions DESC, creator LIMIT 20 OFFSET 10", B.HITS))
def creator_board(spark, sf_dir):
    """CRE01, TK01, API11."""
    t = K.relationships(_creator_mentions(spark, sf_dir)).groupBy("creator").agg(F.sum("mentions").alias("mentions"), F.count(F.lit(1)).alias("entities"))
    return K.paged(t.where("entities >= 5"), "mentions", ("mentions", "entities"), offset=10, limit=20)


@query("creator_profile", B.sql(REL + " SELECT creator, entity_id, mentions, row_number() OVER (PARTITION BY creator ORDER BY mentions DESC, views DESC, entity_id) AS rank FROM rel QUALIFY rank <= 5", B.HITS))
def creator_profile(spark, sf_dir):
    """CRE02, JN27: top entities of each creator."""
    w = Window.partitionBy("creator").orderBy(F.desc("mentions"), F.desc("views"), "entity_id")
    return K.relationships(_creator_mentions(spark, sf_dir)).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("creator", "entity_id", "mentions", "rank")


@query("channel_discovery", "SELECT o_custkey AS channel, count(*) AS items, round(avg(nullif(o_totalprice, 0)) + 1e-9, 2) AS avg_views, max(o_totalprice) AS max_views FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1 HAVING count(*) >= 12")
def channel_discovery(spark, sf_dir):
    """AG24, JN13, CRE03."""
    items = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel"), F.col("o_totalprice").alias("views"))
    known = B.table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("channel"))
    return K.channel_discovery(items, known, 12).withColumn("avg_views", S.rounded(F.col("avg_views"), 2))


@query("or_join", "SELECT DISTINCT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey OR c_custkey = o_orderkey")
def or_join(spark, sf_dir):
    """JN17: an OR condition as one equi-join on exploded keys."""
    o, c = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), B.table(spark, sf_dir, "customer").select("c_custkey")
    return K.or_join(o, c, ["o_custkey", "o_orderkey"], "c_custkey", "o_orderkey", "c_custkey").select("o_orderkey", "c_custkey")


@query("case_insensitive_join", "SELECT p_partkey, k FROM part JOIN (SELECT DISTINCT lower(p_type) AS k FROM part WHERE p_size < 10) t ON lower(p_type) = k")
def case_insensitive_join(spark, sf_dir):
    """JN18: a join on computed lower-case keys."""
    p = B.table(spark, sf_dir, "part")
    return p.join(p.where("p_size < 10").select(F.lower("p_type").alias("k")).distinct(), F.lower(p["p_type"]) == F.col("k")).select("p_partkey", "k")


@query("hierarchy", "SELECT n_nationkey, coalesce(r_name, '-') AS parent, count(c_custkey) AS members FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def hierarchy(spark, sf_dir):
    """JN25, SUP05, JN40: parent lookup and attached counts."""
    n, r, c = (B.table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    members = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("members"))
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").join(members, "n_nationkey", "left").select("n_nationkey", F.coalesce("r_name", F.lit("-")).alias("parent"), F.coalesce("members", F.lit(0)).alias("members"))


@query("in_list_join", "SELECT p_partkey, min(CASE WHEN lower(p_name) = k THEN 0 ELSE 1 END) AS inexact FROM part JOIN (SELECT DISTINCT p_name AS k FROM part WHERE p_size < 5) t ON k IN (p_name, p_name || ' edp') GROUP BY 1")
def in_list_join(spark, sf_dir):
    """JN19, WN01: candidate keys exploded, best match kept."""
    p = B.table(spark, sf_dir, "part")
    keys = p.where("p_size < 5").select(F.col("p_name").alias("k")).distinct()
    spelled = p.select("p_partkey", "p_name", F.explode(F.array("p_name", F.concat("p_name", F.lit(" edp")))).alias("k"))
    return spelled.join(keys, "k").groupBy("p_partkey").agg(F.min(F.when(F.lower("p_name") == F.col("k"), 0).otherwise(1)).alias("inexact"))


@query("semi_and_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_and_anti(spark, sf_dir):
    """JN11-JN16: semi-join flags and anti-joins."""
    c, o = B.table(spark, sf_dir, "customer").select("c_custkey"), B.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    big = o.where("o_totalprice > 400000").select("c_custkey", F.lit(True).alias("_b")).distinct()
    return c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("_b", F.lit(False)).alias("big"))


@query("lateral_top_one", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON o_custkey = c_custkey")
def lateral_top_one(spark, sf_dir):
    """JN23, FLT15: the best order of each customer by a grouped maximum."""
    best = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("m"))
    return B.table(spark, sf_dir, "customer").join(best, "c_custkey").select("c_custkey", (-F.col("m.k")).alias("o_orderkey"), F.col("m.o_totalprice").alias("o_totalprice"))


@query("name_dedup", "SELECT lower(p_name) AS name, max(p_retailprice) AS price FROM part GROUP BY 1")
def name_dedup(spark, sf_dir):
    """WN06, WN04, WN10: best row of each case-insensitive name."""
    w = Window.partitionBy(F.lower("p_name")).orderBy(F.desc("p_retailprice"), "p_partkey")
    return B.table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r = 1").select(F.lower("p_name").alias("name"), F.col("p_retailprice").alias("price"))


@query("source_breakdown", B.sql("SELECT entity_id, platform, count(*) AS n, CAST(sum(views) AS BIGINT) AS views, round(avg(likes), 4) AS avg_likes, max(day) AS last_seen FROM hits GROUP BY 1, 2", B.HITS))
def source_breakdown(spark, sf_dir):
    """AG19, API04."""
    return B.hits(spark, sf_dir).groupBy("entity_id", "platform").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"), F.round(F.avg("likes"), 4).alias("avg_likes"), F.max("day").alias("last_seen"))


@query("cross_source", B.sql("""p AS (SELECT entity_id, platform, count(*) AS n FROM hits GROUP BY 1, 2)
SELECT entity_id, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS platforms, bool_or(platform = 'youtube') AS creators, bool_or(platform = 'reddit') AS community,
  CASE WHEN coalesce(sum(n) FILTER (WHERE platform = 'youtube'), 0) / CAST(nullif(coalesce(sum(n) FILTER (WHERE platform IN ('youtube', 'reddit')), 0), 0) AS DOUBLE) >= 0.75 THEN 'creator'
       WHEN coalesce(sum(n) FILTER (WHERE platform IN ('youtube', 'reddit')), 0) = 0 THEN 'unknown'
       WHEN coalesce(sum(n) FILTER (WHERE platform = 'youtube'), 0) / CAST(nullif(coalesce(sum(n) FILTER (WHERE platform IN ('youtube', 'reddit')), 0), 0) AS DOUBLE) <= 0.25 THEN 'community' ELSE 'mixed' END AS kind
FROM p GROUP BY 1""", B.HITS))
def cross_source(spark, sf_dir):
    """AG09, SCA24, TK06, TK07."""
    p = B.hits(spark, sf_dir).groupBy("entity_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("platform") == name, F.col("n"))), F.lit(0))
    return p.groupBy("entity_id").agg(
        F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("platforms"), F.bool_or(F.col("platform") == "youtube").alias("creators"), F.bool_or(F.col("platform") == "reddit").alias("community"),
        S.signal_mix(of("youtube"), of("reddit")).alias("kind"),
    )


@query("resolution_trends", B.sql("""t AS (SELECT entity_id, count(*) FILTER (WHERE day > DATE '2024-01-29') AS now, count(*) FILTER (WHERE day = DATE '2024-01-29') AS before, CAST(sum(w) AS DOUBLE) AS weight FROM weighed GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY now DESC, entity_id) AS n FROM t)
SELECT entity_id, now, before, weight, CASE WHEN n <= 10 THEN 'top' WHEN now > before THEN 'emerging' ELSE 'stable' END AS kind FROM r""", B.HITS))
def resolution_trends(spark, sf_dir):
    """AG33, AG40, SRC04: one-pass conditional counts; the top ten by a top-k joined back."""
    w = S.platform_weight(F.col("platform"), F.col("override"))
    last = F.lit("2024-01-29").cast("date")
    t = B.hits(spark, sf_dir).groupBy("entity_id").agg(F.count_if(F.col("day") > last).alias("now"), F.count_if(F.col("day") == last).alias("before"), F.sum(w).cast("double").alias("weight"))
    top = t.orderBy(F.desc("now"), "entity_id").limit(10).select("entity_id", F.lit(True).alias("_t"))
    kind = F.when(F.col("_t"), "top").when(F.col("now") > F.col("before"), "emerging").otherwise("stable")
    return t.join(top, "entity_id", "left").select("entity_id", "now", "before", "weight", kind.alias("kind"))


@query("quality_checks", B.sql("""SELECT 'score_out_of_range' AS "check", count(*) FILTER (WHERE composite_score < 0 OR composite_score > 100) AS failures FROM series
UNION ALL SELECT 'negative_mentions', count(*) FILTER (WHERE mention_count < 0) FROM series
UNION ALL SELECT 'state_missing', count(*) FILTER (WHERE mention_count > 0 AND trend_state IS NULL AND composite_score > 0) FROM series
UNION ALL SELECT 'state_on_quiet_day', count(*) FILTER (WHERE mention_count = 0 AND trend_state IS NOT NULL) FROM series
UNION ALL SELECT 'duplicate_rows', count(*) FROM (SELECT entity_id, day FROM series GROUP BY 1, 2 HAVING count(*) > 1)"""))
def quality_checks(spark, sf_dir):
    """RUL01, AG36, JN43."""
    return K.quality_checks(B.series(spark, sf_dir))


@query("health_metrics", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, CASE WHEN count(*) < 300 THEN 'CRITICAL' WHEN count(*) < 340 THEN 'WARNING' ELSE 'OK' END AS level FROM events GROUP BY 1")
def health_metrics(spark, sf_dir):
    """AG35, SCA25, SNK14."""
    m = B.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("click"), F.count_if(F.col("event_type") == "view").alias("view"), F.count(F.lit(1)).alias("value"))
    return K.health(m.withColumns({"warn": F.lit(340), "critical": F.lit(300)})).select("day", "click", "view", "level")


@query("metadata_gaps", "SELECT p_partkey, CASE WHEN l.k IS NULL THEN 'no_notes' ELSE 'ok' END AS gap FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) l ON l.k = p_partkey WHERE p_size > 25")
def metadata_gaps(spark, sf_dir):
    """RUL02, JN26."""
    p, l = B.table(spark, sf_dir, "part").where("p_size > 25"), B.table(spark, sf_dir, "lineitem").where("l_quantity > 48")
    return p.join(l.select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("k")).distinct(), "p_partkey", "left").select("p_partkey", F.when(F.col("k").isNull(), "no_notes").otherwise("ok").alias("gap"))


@query("catalog_counts", "SELECT count(*) AS perfumes, count(DISTINCT p_brand) AS brands, (SELECT count(*) FROM lineitem) AS notes, (SELECT max(CAST(ts AS DATE)) FROM events) AS latest FROM part")
def catalog_counts(spark, sf_dir):
    """AG18, AG16, API08: one-row aggregates side by side."""
    p = B.table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("perfumes"), F.countDistinct("p_brand").alias("brands"))
    n = B.table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("notes"))
    e = B.table(spark, sf_dir, "events").agg(F.max(F.to_date("ts")).alias("latest"))
    return p.crossJoin(n).crossJoin(e)  # one row each


@query("brand_catalog", B.sql("SELECT brand, count(*) AS perfumes, bool_or(s.entity_id IS NOT NULL) AS active FROM brands LEFT JOIN (SELECT DISTINCT entity_id FROM series WHERE mention_count > 0) s USING (entity_id) GROUP BY brand"))
def brand_catalog(spark, sf_dir):
    """AG17, API06."""
    active = B.series(spark, sf_dir).where("mention_count > 0").select("entity_id", F.lit(True).alias("_a")).distinct()
    return B.brands(spark, sf_dir).join(active, "entity_id", "left").groupBy("brand").agg(F.count(F.lit(1)).alias("perfumes"), F.coalesce(F.bool_or("_a"), F.lit(False)).alias("active"))


@query("polling_backoff", "SELECT c_custkey, CASE WHEN tier = 'tier_1' THEN least(base, 24) WHEN tier = 'tier_2' THEN least(base, 72) ELSE base END AS hours FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'tier_1' WHEN 1 THEN 'tier_2' ELSE 'tier_3' END AS tier, CASE WHEN c_nationkey >= 14 THEN 168 WHEN c_nationkey >= 7 THEN 72 WHEN c_nationkey >= 3 THEN 48 WHEN c_custkey % 5 >= 3 AND c_nationkey = 0 THEN 12 ELSE 24 END AS base FROM customer)")
def polling_backoff(spark, sf_dir):
    """SCA16, SCA17, SRC19, STM09."""
    tier = F.get(F.array(F.lit("tier_1"), F.lit("tier_2"), F.lit("tier_3")), F.pmod("c_nationkey", F.lit(3)).cast("int"))
    return B.table(spark, sf_dir, "customer").select("c_custkey", S.poll_interval_hours(F.pmod("c_custkey", F.lit(5)), F.col("c_nationkey"), tier).alias("hours"))


@query("risk_scores", "SELECT p_partkey, round(0.35::DOUBLE * (p_size / 50.0) + 0.25::DOUBLE * (p_partkey % 2) + 0.25::DOUBLE * (p_partkey % 3 / 2.0) + 0.10::DOUBLE + 0.0, 4) AS risk FROM part")
def risk_scores(spark, sf_dir):
    """SCA20, AG32, RUL04."""
    k = F.col("p_partkey")
    return B.table(spark, sf_dir, "part").select("p_partkey", S.ambiguity_risk(F.col("p_size") / 50.0, F.pmod(k, F.lit(2)), F.pmod(k, F.lit(3)) / 2.0, F.lit(1.0), F.lit(0.0)).alias("risk"))


@query("set_operations", "SELECT k, bool_or(s = 1) AS in_first, bool_or(s = 2) AS in_second FROM (SELECT DISTINCT p_brand AS k, 1 AS s FROM part WHERE p_size < 3 UNION ALL SELECT DISTINCT p_brand, 2 FROM part WHERE p_size > 48) GROUP BY k")
def set_operations(spark, sf_dir):
    """ST01-03, ST05: union of keys with membership."""
    p = B.table(spark, sf_dir, "part")
    a, b = p.where("p_size < 3").select(F.col("p_brand").alias("k"), F.lit(1).alias("s")).distinct(), p.where("p_size > 48").select(F.col("p_brand").alias("k"), F.lit(2).alias("s")).distinct()
    return a.unionByName(b).groupBy("k").agg(F.bool_or(F.col("s") == 1).alias("in_first"), F.bool_or(F.col("s") == 2).alias("in_second"))


@query("track_union", "SELECT p_brand AS k, min(t) AS track FROM (SELECT DISTINCT p_brand, 1 AS t FROM part WHERE p_size < 3 UNION ALL SELECT DISTINCT p_brand, 2 FROM part) GROUP BY 1")
def track_union(spark, sf_dir):
    """ST06: two tracks, the first one's row wins."""
    p = B.table(spark, sf_dir, "part")
    return C.two_tracks(p.where("p_size < 3").select(F.col("p_brand").alias("k")).distinct(), p.select(F.col("p_brand").alias("k")).distinct(), "k")
