"""Queries over sources, normalisation, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.operators import creators as K
from trendloom.plans import base as B
from trendloom.plans.registry import query
from trendloom.sources import normalize as N
from trendloom.sources import readers as R
from trendloom.sources import sinks as W


@query("content_items", "SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) AS views, user_id AS account FROM events ORDER BY ts DESC, id LIMIT 100")
def content_items(spark, sf_dir):
    """SRC01-04, TK04: projected scan, newest first."""
    e = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("views"), F.col("user_id").alias("account"), "ts")
    return R.newest_first(e, "ts", "id", 100).drop("ts")


@query("parsed_pages")
def parsed_pages(spark, sf_dir):
    """SRC11: HTML scan to records."""
    return R.parse_pages(B.table(spark, sf_dir, "pages")).select("page_id", "title", "heading", F.size("links").alias("n_links"), F.length("text").alias("n_text"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def page_titles(spark, sf_dir):
    """SRC11, SRC12: fixed patterns without a parser."""
    return B.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("links"))


def _posts(spark, sf_dir):
    """Conversation turns as community posts."""
    c = B.table(spark, sf_dir, "conversations")
    s = lambda x, t="string": F.lit(x).cast(t)
    return c.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), s(None).alias("name"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("selftext"), F.col("role").alias("author"), s("sub").alias("subreddit"),
        F.concat(F.lit("/r/sub/"), F.col("conv_id")).alias("permalink"), s(None).alias("url"), (F.col("conv_id") * 86400 + 1704067200).alias("created_utc"), F.col("turn").cast("int").alias("score"), s(0.9, "double").alias("upvote_ratio"),
        F.length("text").cast("int").alias("num_comments"), s(None).alias("link_flair_text"), s(True, "boolean").alias("is_self"),
    )


@query("normalized_posts", """SELECT 'reddit_' || conv_id || '_' || turn AS id, strftime(to_timestamp(conv_id * 86400 + 1704067200) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS published_at, substr(text, 1, 40) AS title, turn AS likes, length(text) AS comments,
    'https://www.reddit.com/r/sub/' || conv_id AS source_url FROM conversations""")
def normalized_posts(spark, sf_dir):
    """NRM04, NRM08."""
    n = N.normalize_reddit(_posts(spark, sf_dir))
    return n.select("id", "published_at", "title", F.col("engagement.likes").alias("likes"), F.col("engagement.comments").alias("comments"), "source_url")


@query("json_engagement", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(try_cast(json_extract_string(props, '$.missing') AS BIGINT), 0) AS missing FROM events")
def json_engagement(spark, sf_dir):
    """SCA26, AG42, JN44: guarded JSON numbers."""
    return B.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing").try_cast("bigint"), F.lit(0).cast("long")).alias("missing"))


@query("source_scores", B.sql("""SELECT content_item_id, CASE WHEN views > 0 THEN round((likes + comments)::DOUBLE / views, 6) END AS rate,
    CASE WHEN views >= 1000000 THEN 1.0 WHEN views >= 100000 THEN 0.8 WHEN views >= 10000 THEN 0.5 WHEN views >= 1000 THEN 0.3 ELSE 0.1 END::DOUBLE AS step FROM content""", B.CONTENT))
def source_scores(spark, sf_dir):
    """NRM13-16, SCA07, SCA17: rates and step influence."""
    c = B.content(spark, sf_dir)
    return c.select("content_item_id", F.round(S.engagement_rate(F.col("views"), F.col("likes"), F.col("comments")), 6).alias("rate"), S.step_influence(F.col("views"), F.lit(0)).alias("step"))


@query("incremental_items", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def incremental_items(spark, sf_dir):
    """SRC21: items without derived rows."""
    o, l = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), B.table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return R.without_results(o, l.select(F.col("l_orderkey").alias("id")))


@query("upsert", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def upsert(spark, sf_dir):
    """SNK01-06: stored rows with the batch's laid over."""
    p = B.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return W.upserted(p, p.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100), ["p_partkey"])


@query("latest_by_key", "SELECT DISTINCT ON (user_id) user_id, event_type FROM events ORDER BY user_id, ts DESC")
def latest_by_key(spark, sf_dir):
    """SNK01, SIG05, WN10: last row of each key."""
    return W.keep_latest(B.table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id"], "ts").drop("ts")


@query("first_capture", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-03')")
def first_capture(spark, sf_dir):
    """SIG03, SIG04, SNK13: natural keys that were not captured before."""
    e = B.table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    cut = F.lit("2024-01-03").cast("timestamp")
    return K.first_capture(e.where(F.col("ts") < cut).select("user_id", "event_type").distinct(), e.where(F.col("ts") >= cut), ["user_id", "event_type"]).select("user_id", "event_type")


@query("enrichment_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'filled' ELSE c_mktsegment END AS c_mktsegment, c_nationkey AS extra FROM customer")
def enrichment_merge(spark, sf_dir):
    """ENR01: additive merge."""
    c = B.table(spark, sf_dir, "customer")
    base = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return W.enriched(base, c.select("c_custkey", F.lit("filled").alias("c_mktsegment"), F.col("c_nationkey").alias("extra")), "c_custkey")


@query("queue_transitions", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 3 THEN 'pending' WHEN c_custkey % 4 = 0 THEN 'running' WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE 'pending' END ELSE 'done' END AS status FROM customer")
def queue_transitions(spark, sf_dir):
    """RUL03, TK09: finished rows that turn up again are pending."""
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    m = F.pmod("k", F.lit(4))
    old = c.where(m != 3).select("k", F.when(m == 0, "running").otherwise("done").alias("status"), F.lit(1).alias("priority"))
    new = c.where((m == 3) | ((m == 1) & (F.pmod("k", F.lit(3)) != 0)) | (m == 0)).select("k", F.lit(2).alias("priority"))
    return K.queue_upsert(old, new, "k").select("k", "status")


@query("alert_cooldown", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-16' - INTERVAL 24 HOUR THEN 'triggered' ELSE 'suppressed' END AS event FROM events WHERE ts < TIMESTAMP '2024-01-16' AND value > 50")
def alert_cooldown(spark, sf_dir):
    """ALR02, STM08."""
    e = B.table(spark, sf_dir, "events")
    now = F.lit("2024-01-16").cast("timestamp")
    a = e.where(F.col("ts") < now).select("event_id", (F.col("value") > 50).alias("fired"), F.col("ts").alias("last_triggered"), F.lit(None).cast("int").alias("cooldown_hours"))
    return K.cooled(a, now).select("event_id", "event")


@query("note_bridge", "SELECT p_partkey AS id, lower(unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])) AS note, unnest(['top', 'base']) AS position FROM part")
def note_bridge(spark, sf_dir):
    """SNK07: note lists to a bridge table."""
    p = B.table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    return W.bridge_rows(p.select(F.col("p_partkey").alias("id"), F.slice(w, 1, 1).alias("notes_top"), F.array().cast("array<string>").alias("notes_middle"), F.slice(w, 2, 1).alias("notes_base")))


@query("summary_sentence", "SELECT (SELECT count(*) FROM part) || ' entities on 2024-01-30: 2 breaking out, 3 rising.' AS summary")
def summary_sentence(spark, sf_dir):
    """SNK12."""
    k = B.table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("tracked")).select("tracked", F.lit(2).alias("breakouts"), F.lit(3).alias("rising"), F.lit("2024-01-30").cast("date").alias("day"))
    return W.summary_sentence(k)


@query("seed_rows")
def seed_rows(spark, sf_dir):
    """SRC13-16, SCA27: catalog rows from varying headers."""
    p = B.table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_size").alias("p_size"))
    return N.seed_rows(p.select(F.col("p_brand").alias("House"), F.col("p_name").alias("Title"), F.concat(F.lit("launched "), F.col("p_size") + 1970).alias("Year"), F.lit("for women and men").alias("gender"))).dropDuplicates(["fragrance_id"])
