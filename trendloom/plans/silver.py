"""Queries over landed-post normalisation, identity maps, status overlays and streams run to completion."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions import text as T
from trendloom.operators import candidates as C
from trendloom.operators import catalog as G
from trendloom.operators import creators as K
from trendloom.operators import resolver as R
from trendloom.operators import series as O
from trendloom.operators import topics as P
from trendloom.plans import base as B
from trendloom.plans.registry import query
from trendloom.plans.texts import _aliases
from trendloom.sources import normalize as N
from trendloom.sources import readers


def _raw(frame, schema):
    """A frame of landed records: JSON built from columns, parsed under the declared schema as a file would be."""
    return frame.select(F.from_json("j", schema).alias("r")).select("r.*")


@query("normalized_videos", "SELECT CAST(event_id AS VARCHAR) AS id, 'https://www.youtube.com/watch?v=' || event_id AS source_url, CAST(round(value * 100) AS BIGINT) AS views, 'T' || event_id AS title FROM events")
def normalized_videos(spark, sf_dir):
    """NRM01, NRM05, SRC05-07: video payloads with details and fallback snippet."""
    j = F.format_string(
        '{"query":"q","search_item":{"id":{"videoId":"%d"},"snippet":{"title":"T%d","channelId":"c"}},"video_details":{"statistics":{"viewCount":"%d","likeCount":"x"}}}',
        "event_id", "event_id", F.round(F.col("value") * 100).cast("long"),
    )
    n = N.normalize_youtube(_raw(B.table(spark, sf_dir, "events").select(j.alias("j")), N.YOUTUBE))
    return n.select("id", "source_url", F.col("engagement.views").alias("views"), "title")


@query("normalized_shorts", "SELECT 'tiktok_' || event_id AS id, CASE WHEN user_id % 100 <= 60 THEN 'short' ELSE 'video' END AS content_type, ['tag' || (user_id % 3)] AS hashtags, 'look #Tag' || (user_id % 3) || ' #tag' || (user_id % 3) AS text_content FROM events")
def normalized_shorts(spark, sf_dir):
    """NRM02, NRM09, SRC09."""
    j = F.format_string('{"id":"%d","desc":"look #Tag%d","createTime":1704067200,"author":{"id":"1","uniqueId":"u"},"video":{"duration":%d},"challenges":[]}', "event_id", F.pmod("user_id", F.lit(3)), F.pmod("user_id", F.lit(100)))
    return N.normalize_tiktok(_raw(B.table(spark, sf_dir, "events").select(j.alias("j")), N.TIKTOK)).select("id", "content_type", "hashtags", "text_content")


@query("derived_videos", "SELECT 'tiktok_' || event_id AS id, 0.0::DOUBLE AS mention_weight_override, 'who' || (user_id % 4) AS handle FROM events")
def derived_videos(spark, sf_dir):
    """NRM03, NRM11: addresses found in texts, as items without weight."""
    post = F.format_string("see https://www.tiktok.com/@who%d/video/%d now and https://www.tiktok.com/@who%d/video/%d", F.pmod("user_id", F.lit(4)), "event_id", F.pmod("user_id", F.lit(4)), "event_id")
    urls = N.embedded_video_urls(B.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), post.alias("text")))
    n = N.normalize_tiktok_url(urls.select("url", "context", F.lit("2024-01-01").alias("found_at")))
    return n.select("id", "mention_weight_override", F.col("source_account_handle").alias("handle"))


@query("language_and_region", "SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'en' END AS language, CASE WHEN c_custkey % 2 = 0 THEN 'UK' ELSE 'FR' END AS region FROM customer")
def language_and_region(spark, sf_dir):
    """NRM06, NRM07."""
    k = F.col("c_custkey")
    language = F.when(F.pmod(k, F.lit(3)) == 2, " EN ").otherwise(" ")
    region = N.region_of(F.when(F.pmod(k, F.lit(2)) == 0, "gb"), F.lit(" "), F.lit("fr"))
    return B.table(spark, sf_dir, "customer").select("c_custkey", N.language_of(F.pmod(k, F.lit(3)) > 0, language).alias("language"), region.alias("region"))


@query("enrichment_records", "SELECT p_partkey, [p_name, p_type] AS accords, p_size * 0.5::DOUBLE AS rating_value, CASE WHEN p_size > 25 THEN 2000 + p_size END AS release_year, CASE WHEN p_partkey % 2 = 0 THEN 'unisex' ELSE 'men' END AS gender FROM part")
def enrichment_records(spark, sf_dir):
    """NRM10, SRC16, ENR02, ENR03."""
    p, s = B.table(spark, sf_dir, "part"), lambda c: F.col(c).cast("string")
    raw = p.select(
        F.concat(F.lit(" "), s("p_partkey")).alias("perfume_name"), F.col("p_brand").alias("brand_name"), F.concat_ws(" ; ", "p_name", "p_type").alias("accords"),
        *[F.lit(None).cast("string").alias(c) for c in ("notes_top", "notes_middle", "notes_base")], (F.col("p_size") * 0.5).cast("string").alias("rating_value"), F.lit("n/a").alias("rating_count"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("in "), (F.col("p_size") + 2000).cast("string"))).alias("release_year"), F.when(F.col("p_partkey") % 2 == 0, "women and men").otherwise("for men").alias("gender"),
    )
    n = N.normalize_enrichment(raw)
    return n.select(F.col("perfume_name").cast("long").alias("p_partkey"), "accords", "rating_value", "release_year", "gender")


@query("transcript_queue", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'none' WHEN c_nationkey < 5 OR c_acctbal >= 5000 THEN 'high' ELSE 'low' END AS priority FROM customer")
def transcript_queue(spark, sf_dir):
    """NRM12, NRM17, SRC20, FLT14: priority of transcripts; off-topic titles get none."""
    k = F.col("c_custkey")
    title = F.when(F.pmod(k, F.lit(4)) == 0, "https://perfume.example cooking").otherwise("A Perfume talk")
    tier = F.when(F.col("c_nationkey") < 5, "tier_1").otherwise("tier_3")
    text = N.resolver_text(F.lit("channel_poll"), title, F.lit("ignored perfume"))
    return B.table(spark, sf_dir, "customer").select("c_custkey", N.transcript_priority(text, F.lit(""), F.col("c_acctbal") * 10, tier).alias("priority"))


@query("accent_keys")
def accent_keys(spark, sf_dir):
    """STR13, STR14, SUP05, SUP07: keys without accents of the whole text of every turn."""
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    return c.select("conv_id", "turn", T.without_accents(F.lower("t")).alias("plain"), T.to_ascii(F.lower("t")).alias("ascii"), T.slug(T.to_ascii(F.col("t"))).alias("slug"))


@query("brand_words_and_urls", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'stored' WHEN p_partkey % 3 = 1 THEN 'https://www.youtube.com/watch?v=' || p_partkey ELSE NULL END AS url, ['brand'] AS words FROM part")
def brand_words_and_urls(spark, sf_dir):
    """STR16, STR23."""
    k = F.pmod("p_partkey", F.lit(3))
    url = T.rebuilt_source_url(F.when(k == 1, "youtube").otherwise("other"), F.when(k == 0, "stored").otherwise(" "), F.col("p_partkey").cast("string"))
    return B.table(spark, sf_dir, "part").select("p_partkey", url.alias("url"), F.filter(R.brand_words(F.concat(F.lit("The "), F.col("p_brand"))), lambda w: w == "brand").alias("words"))


@query("query_keywords")
def query_keywords(spark, sf_dir):
    """STR26: of every turn."""
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_keywords(F.col("text")).alias("keywords"))


@query("day_partition", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def day_partition(spark, sf_dir):
    """FLT01: one day, as a range on the stored time so that the scan can skip."""
    e = B.table(spark, sf_dir, "events")
    return e.where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))).select("event_id")


@query("dynamic_filters", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND contains(lower(c_name), '1')")
def dynamic_filters(spark, sf_dir):
    """FLT04, TK10, SUP06: conditions composed from what the caller set."""
    asked = {"segment": "BUILDING", "least": 1000, "most": None, "q": "1"}
    made = {"segment": lambda v: F.col("c_mktsegment") == v, "least": lambda v: F.col("c_acctbal") >= v, "most": lambda v: F.col("c_acctbal") <= v, "q": lambda v: T.search(F.col("c_name"), v)}
    return B.table(spark, sf_dir, "customer").where(reduce(and_, [made[k](v) for k, v in asked.items() if v is not None])).select("c_custkey")


@query("token_brand_lookup", "WITH t AS (SELECT DISTINCT conv_id, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM conversations) SELECT w AS token, count(*) AS conversations FROM t WHERE w IN ('the', 'und', 'que', 'with') GROUP BY 1")
def token_brand_lookup(spark, sf_dir):
    """JN32: tokens joined to a map by equality."""
    words = spark.createDataFrame([("the",), ("und",), ("que",), ("with",)], "token string")
    t = B.table(spark, sf_dir, "conversations").select("conv_id", F.explode(T.tokenize_ascii(F.col("text"))).alias("token")).distinct()
    return t.join(words, "token").groupBy("token").agg(F.count(F.lit(1)).alias("conversations"))


@query("identity_bridge", "SELECT o_orderkey, coalesce(c_custkey + 1000000, o_custkey) AS key FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) m ON o_custkey = c_custkey")
def identity_bridge(spark, sf_dir):
    """JN38, JN39, SUP27: keys remapped where a mapping exists."""
    c = B.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return K.remapped(B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), c, "key")


@query("unmapped_mentions", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def unmapped_mentions(spark, sf_dir):
    """JN37, SNK13: what the bridge does not know."""
    known = B.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return B.table(spark, sf_dir, "orders").join(known, "o_custkey", "left_anti").select("o_orderkey")


@query("brand_names", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand WHEN p_type = 'ECONOMY' THEN 'Typed' ELSE split_part(p_name, ' ', 1) END AS brand FROM part")
def brand_names(spark, sf_dir):
    """JN09: catalog, then a second map, then the name's first word."""
    p = B.table(spark, sf_dir, "part")
    first = p.where("p_size > 10").select("p_partkey", F.col("p_brand").alias("_a"))
    second = p.where("p_type = 'ECONOMY'").select("p_partkey", F.lit("Typed").alias("_b"))
    return p.join(first, "p_partkey", "left").join(second, "p_partkey", "left").select("p_partkey", F.coalesce("_a", "_b", F.substring_index("p_name", " ", 1)).alias("brand"))


@query("safe_aliases")
def safe_aliases(spark, sf_dir):
    """RES10, RES12, SUP24, SUP25: unique new aliases of two words and more."""
    p = B.table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entity_id"), F.min("p_brand").alias("brand"))
    names = p.select("entity_id", "brand", F.concat(F.initcap("p_name"), F.lit(" Eau de Parfum")).alias("name"))
    return R.safe_aliases(names, p.where("p_name < 'm'").select(F.col("p_name").alias("alias")))


@query("entity_roles", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'clone' WHEN p_brand = 'Brand#1' THEN 'designer_original' WHEN p_brand = 'Brand#2' THEN 'niche_original' ELSE 'unknown' END AS role FROM part")
def entity_roles(spark, sf_dir):
    """TOP04, SUP05."""
    p = B.table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("name_key"), F.col("p_brand").alias("brand_key"), "p_size")
    tiers = spark.createDataFrame([("Brand#1", "designer"), ("Brand#2", "niche")], "brand_key string, tier string")
    return P.entity_role(p, p.where("p_size < 5").select("name_key", F.lit("clone").alias("role")), tiers).select("p_partkey", "role")


@query("review_overlay", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'approved' WHEN p_partkey % 5 = 1 THEN 'rejected' ELSE 'pending' END AS status FROM part")
def review_overlay(spark, sf_dir):
    """CAN06, SUP15, SUP18, SUP19, SUP21, SUP22, SIG06: latest decision laid over stored rows."""
    p = B.table(spark, sf_dir, "part").select("p_partkey", F.lit("pending").alias("status"))
    m = F.pmod("p_partkey", F.lit(5))
    first = p.where(m <= 1).select("p_partkey", F.lit(1).alias("seq"), F.lit("rejected").alias("status"))
    second = p.where(m == 0).select("p_partkey", F.lit(2).alias("seq"), F.lit("approved").alias("status"))
    return C.overlay(p, first.unionByName(second), "p_partkey", ["status"])


@query("daily_job_signals", "SELECT count(*) > 0 AS any FROM events")
def daily_job_signals(spark, sf_dir):
    """SIG02, SIG09, SIG10, SUP17: the whole daily job as one plan."""
    job = G.daily_job(B.content(spark, sf_dir), B.resolved(spark, sf_dir), B.brands(spark, sf_dir))
    return job["signals"].agg((F.count(F.lit(1)) > 0).alias("any"))


@query("entity_records", "SELECT DISTINCT p_name AS name, upper(left(split_part(p_name, ' ', 1), 2) || left(split_part(p_name, ' ', 2), 3)) AS ticker FROM part")
def entity_records(spark, sf_dir):
    """SUP02, SUP09."""
    return B.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), T.ticker(F.col("p_name")).alias("ticker")).distinct()


@query("ingested_and_resolved")
def ingested_and_resolved(spark, sf_dir):
    """NRM18, SUP20: landed posts normalised, resolved and joined to one record each."""
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    found = R.resolved_records(R.resolve(d, _aliases(spark, sf_dir)))
    r = G.signal_records(d.select("id", F.length("text").cast("long").alias("n_chars")), found).where("entities IS NOT NULL")
    return r.select("id", "n_chars", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.col("entities.name"), ", ").alias("names"))


@query("confidence_columns", "SELECT p_partkey, round(ln(p_size + 1.0), 6) AS confidence, round(least(ln(p_size + 1.0) / 6, 1.0), 6) AS normalized FROM part")
def confidence_columns(spark, sf_dir):
    """SCA10."""
    c = S.log_confidence(F.col("p_size").cast("double"))
    return B.table(spark, sf_dir, "part").select("p_partkey", F.round(c, 6).alias("confidence"), F.round(F.least(c / 6, F.lit(1.0)), 6).alias("normalized"))


@query("preset_range", B.sql("SELECT entity_id, CAST(sum(CAST(mention_count AS DECIMAL(18,4))) AS DOUBLE) AS mention_count FROM series WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1 HAVING sum(mention_count) > 0"))
def preset_range(spark, sf_dir):
    """SCA15, API01: a seven-day preset anchored on the latest day."""
    import datetime as dt

    a, b = S.date_range("7d", dt.date(2024, 1, 30))
    return O.range_rows(B.series(spark, sf_dir), F.lit(a), F.lit(b)).select("entity_id", "mention_count")


@query("recent_posts", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29'")
def recent_posts(spark, sf_dir):
    """SRC08, SRC10: early-stopping pagination is a filter on landed files."""
    return readers.since(B.table(spark, sf_dir, "events"), F.lit("2024-01-29").cast("timestamp_ntz"), "ts").select("event_id")
