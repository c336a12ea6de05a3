"""Queries over stored tables and their rules: catalog loads, alias seeding, synchronisation, review, intake, landed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import master as M
from trendloom.operators import review as V
from trendloom.operators import topics as P
from trendloom.plans import base as B
from trendloom.plans.registry import query
from trendloom.plans.streams import scratch
from trendloom.sources import readers as R
from trendloom.sources import sinks as W
from trendloom.sources.store import Store


def seeds(spark, sf_dir, year: int = 1970):
    p = B.table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("fragrance_id"), F.col("p_brand").alias("brand_name"), F.concat("p_name", F.lit(" "), F.pmod("p_partkey", F.lit(97)).cast("string")).alias("perfume_name"),
        (F.col("p_size") + year).cast("int").alias("release_year"), F.lit("unisex").alias("gender"), F.lit("seed").alias("source"), F.col("p_partkey").alias("seq"),
    )


def loaded(spark, sf_dir) -> Store:
    """Two loads, and a third one with wrong names that is rolled back."""
    store = Store(spark, scratch(spark, "catalog"))
    s = seeds(spark, sf_dir)
    M.load(store, s.where("seq % 2 = 0"), "first")
    good = M.load(store, seeds(spark, sf_dir, 1971), "second")
    M.load(store, s.where("seq % 3 = 0").withColumn("perfume_name", F.lit("wrong")).withColumn("brand_name", F.concat(F.lit("zz "), "brand_name")), "third")
    store.rollback(good)
    return store


CATALOG = """WITH s AS (
    SELECT 'F' || p_partkey AS fragrance_id, p_partkey AS seq, p_size + 1971 AS release_year, p_brand || ' ' || p_name || ' ' || p_partkey % 97 AS canonical_name,
           trim(regexp_replace(lower(p_brand || ' ' || p_name || ' ' || p_partkey % 97), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS nb, p_brand FROM part
), bf AS (SELECT nb, row_number() OVER (ORDER BY nb) AS id FROM (SELECT DISTINCT nb FROM s WHERE seq % 2 = 0)
), b AS (SELECT * FROM bf UNION ALL SELECT nb, coalesce((SELECT max(id) FROM bf), 0) + row_number() OVER (ORDER BY nb) FROM (SELECT DISTINCT nb FROM s WHERE nb NOT IN (SELECT nb FROM bf))
), pf AS (SELECT normalized_name, row_number() OVER (ORDER BY normalized_name) AS id FROM (SELECT DISTINCT normalized_name FROM s WHERE seq % 2 = 0)
), p AS (SELECT * FROM pf UNION ALL SELECT normalized_name, coalesce((SELECT max(id) FROM pf), 0) + row_number() OVER (ORDER BY normalized_name) FROM (SELECT DISTINCT normalized_name FROM s WHERE normalized_name NOT IN (SELECT normalized_name FROM pf))
) """


@query("catalog_load", CATALOG + "SELECT fragrance_id, canonical_name, s.normalized_name, CAST(release_year AS INTEGER) AS release_year, b.id AS brand_id, p.id AS perfume_id FROM s JOIN b USING (nb) JOIN p ON p.normalized_name = s.normalized_name")
def catalog_load(spark, sf_dir):
    """SUP24: the master after two loads and a rolled-back third; ids given by the first load stay."""
    return M.read(loaded(spark, sf_dir), "master").select("fragrance_id", "canonical_name", "normalized_name", "release_year", "brand_id", "perfume_id")


@query("catalog_brand_ids", CATALOG + "SELECT b.id, nb AS normalized_name, (SELECT arg_max(p_brand, seq) FROM s WHERE s.nb = b.nb) AS canonical_name FROM b")
def catalog_brand_ids(spark, sf_dir):
    """SUP24: brands and their ids after the same loads."""
    return M.read(loaded(spark, sf_dir), "brands").select("id", "normalized_name", "canonical_name")


def _alias_tables(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    named = p.withColumn("n", F.concat("p_name", F.lit(" "), F.pmod("p_partkey", F.lit(400)).cast("string")))
    brands = p.select(F.col("p_size").cast("long").alias("id"), F.lower(F.regexp_replace("p_brand", "#", " ")).alias("normalized_name")).where("p_partkey % 13 = 0").distinct()
    perfumes = named.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("n").alias("normalized_name"))
    master = named.where("p_size > 25").select(F.col("p_partkey").alias("perfume_id"), F.col("n").alias("normalized_name"))
    aliases = p.where("p_partkey % 5 = 0").select(F.concat(F.lit("alt "), "p_name").alias("normalized_alias"), F.lit("perfume").alias("entity_type"), F.col("p_partkey").alias("entity_id"))
    targets = named.select(F.concat(F.lit("Alt "), "p_name").alias("alias_text"), F.lit("perfume").alias("entity_type"), F.concat("p_name", F.lit(" "), F.pmod("p_partkey", F.lit(700)).cast("string")).alias("canonical_target"))
    targets = targets.unionByName(p.select(F.concat("p_brand", F.lit(" House")).alias("alias_text"), F.lit("brand").alias("entity_type"), F.col("p_brand").alias("canonical_target"))).distinct()
    return targets, brands, perfumes, master, aliases


PLAN = """WITH named AS (SELECT *, p_name || ' ' || p_partkey % 400 AS n FROM part
), brands AS (SELECT DISTINCT p_size AS id, lower(replace(p_brand, '#', ' ')) AS n FROM part WHERE p_partkey % 13 = 0
), b AS (SELECT n, min(id) AS id, count(DISTINCT id) AS k FROM brands GROUP BY n
), pf AS (SELECT n, min(p_partkey) AS id, count(DISTINCT p_partkey) AS k FROM named WHERE p_partkey % 2 = 0 GROUP BY n
), ms AS (SELECT n, min(p_partkey) AS id, count(DISTINCT p_partkey) AS k FROM named WHERE p_size > 25 GROUP BY n
), t AS (
    SELECT DISTINCT 'Alt ' || p_name AS alias_text, 'alt ' || p_name AS normalized_alias, 'perfume' AS entity_type, p_name || ' ' || p_partkey % 700 AS canonical_target, p_name || ' ' || p_partkey % 700 AS n FROM part
    UNION SELECT DISTINCT p_brand || ' House', lower(replace(p_brand, '#', ' ')) || ' house', 'brand', p_brand, lower(replace(p_brand, '#', ' ')) FROM part
), f AS (
    SELECT t.*, CASE WHEN entity_type = 'brand' THEN CASE WHEN b.n IS NOT NULL THEN 'brands' END WHEN pf.n IS NOT NULL THEN 'perfumes' WHEN ms.n IS NOT NULL THEN 'master' END AS probe,
           CASE WHEN entity_type = 'brand' THEN CASE WHEN b.k = 1 THEN b.id END WHEN pf.n IS NOT NULL THEN CASE WHEN pf.k = 1 THEN pf.id END WHEN ms.k = 1 THEN ms.id END AS entity_id
    FROM t LEFT JOIN b ON b.n = t.n LEFT JOIN pf ON pf.n = t.n LEFT JOIN ms ON ms.n = t.n
), a AS (SELECT DISTINCT 'alt ' || p_name AS normalized_alias, 'perfume' AS entity_type, p_partkey AS entity_id FROM part WHERE p_partkey % 5 = 0
), plan AS (
    SELECT f.alias_text, f.normalized_alias, f.entity_type, f.canonical_target, f.entity_id, f.probe,
           CASE WHEN probe IS NULL THEN 'MISSING' WHEN f.entity_id IS NULL THEN 'AMBIGUOUS' WHEN a.entity_id IS NOT NULL THEN 'EXISTING'
                WHEN row_number() OVER (PARTITION BY f.normalized_alias, f.entity_type, f.entity_id ORDER BY f.alias_text, f.canonical_target) > 1 THEN 'REPEATED' ELSE 'WOULD_INSERT' END AS status
    FROM f LEFT JOIN a ON a.normalized_alias = f.normalized_alias AND a.entity_type = f.entity_type AND a.entity_id = f.entity_id
) """


@query("alias_seed_plan", PLAN + "SELECT * FROM plan")
def alias_seed_plan(spark, sf_dir):
    """SUP25: the audit: what each curated alias would do, and the table that decided."""
    return M.alias_plan(*_alias_tables(spark, sf_dir))


@query("alias_seed_applied", PLAN + "SELECT normalized_alias, entity_type, entity_id, 1 AS n FROM plan WHERE status = 'WOULD_INSERT' UNION ALL SELECT normalized_alias, entity_type, entity_id, 0 FROM a")
def alias_seed_applied(spark, sf_dir):
    """SUP25: the stored aliases once the plan is applied; applied again, it changes nothing."""
    targets, brands, perfumes, master, aliases = _alias_tables(spark, sf_dir)
    store = Store(spark, scratch(spark, "aliases"))
    stored = aliases.select(F.col("normalized_alias").alias("alias_text"), "normalized_alias", "entity_type", "entity_id", F.lit("exact").alias("match_type"), F.lit(1.0).alias("confidence")).distinct()
    store.commit({"aliases": M._upsert(store, "aliases", stored)}, "stored")
    for name in ("plan", "again"):
        M.apply_plan(store, M.alias_plan(targets, brands, perfumes, master, M.read(store, "aliases")), name)
    return M.read(store, "aliases").select("normalized_alias", "entity_type", "entity_id", (F.col("match_type") == "seed").cast("int").alias("n"))


@query("create_bucket_review")
def create_bucket_review(spark, sf_dir):
    """CAN04: the strict second look at names that the first pass would create."""
    p = B.table(spark, sf_dir, "part").select("p_name").distinct()
    head, tail = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    made = F.array(
        F.col("p_name"), F.concat("p_name", F.lit("s")), F.concat(head, F.lit(" notes")), F.concat(head, F.lit(" amber")), head, F.concat(head, F.lit(" zq "), tail), F.lit("le parfum"), F.lit("ab"),
        F.concat(F.lit("noir "), tail), F.concat(F.lit("quark "), tail), F.concat(head, F.lit(" with "), tail), F.concat(head, F.lit(" "), F.reverse("p_name")), F.concat(head, F.lit(" "), tail, F.lit(" é")),
    )
    kinds = F.array(F.lit("perfume"), F.lit("brand"), F.lit("note"))
    candidates = p.select(F.explode(made).alias("text")).distinct().select("text", F.explode(kinds).alias("kind"))
    brands = p.select(head.alias("key"), F.initcap(head).alias("brand")).distinct().unionByName(spark.createDataFrame([("noir", "Noir")], "key string, brand string"))
    known = p.where("p_name < 'd'").select(F.col("p_name").alias("text"))
    aliases = p.where("p_name > 'p'").select(tail.alias("alias")).distinct()
    merges = p.where("p_name LIKE 'f%'").select(F.concat("p_name", F.lit("s")).alias("text"), F.col("p_name").alias("match"))
    return V.second_look(candidates, known, brands, aliases, merges, p.select(F.lower("p_name").alias("name")))


ORDERS = "o_orderkey long, o_totalprice double, o_orderstatus string, part int"


@query("table_sync", """SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 0 THEN 'insert' ELSE 'update' END AS action FROM orders WHERE o_orderkey % 997 = 0 OR o_orderkey % 991 = 1
UNION ALL SELECT -o_orderkey, 'delete' FROM orders WHERE o_orderkey % 983 = 2""")
def table_sync(spark, sf_dir):
    """SNK15: what makes the stored copy equal to the source, from differing partitions alone."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    old = o.where("o_orderkey % 997 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 991 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    old = old.unionByName(o.where("o_orderkey % 983 = 2").withColumn("o_orderkey", -F.col("o_orderkey")))
    source, target = Store(spark, scratch(spark, "source")), Store(spark, scratch(spark, "target"))
    M.synced_parts(source, "orders", ORDERS, o, ["o_orderkey"], 64, "now")
    M.synced_parts(target, "orders", ORDERS, old, ["o_orderkey"], 64, "then")
    return M.change_set(source, target, "orders", ORDERS, ["o_orderkey"], 64)


@query("submission_statuses", """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 4 THEN 'platform_pending' WHEN 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'already_tracked' ELSE 'pending' END ELSE 'needs_manual_resolve' END AS status FROM customer""")
def submission_statuses(spark, sf_dir):
    """SUP10: the first status of submitted sources."""
    c = B.table(spark, sf_dir, "customer")
    key, m = F.col("c_custkey").cast("string"), F.pmod("c_custkey", F.lit(5))
    channel = F.concat(F.lit("UC"), F.lpad(key, 22, "0"))
    url = (
        F.when(m == 0, F.concat(F.lit("https://www.youtube.com/channel/"), channel, F.lit("/about"))).when(m == 1, F.concat(F.lit("https://youtube.com/@user"), key))
        .when(m == 2, F.concat(F.lit("https://youtu.be/v"), key)).when(m == 3, F.concat(F.lit("https://m.youtube.com/shorts/"), key)).otherwise(F.concat(F.lit("https://www.tiktok.com/@u"), key))
    )
    submissions = c.select(F.col("c_custkey").alias("id"), url.alias("url"), F.when(m == 4, "tiktok").otherwise("youtube").alias("platform"))
    return V.submission_status(submissions, c.where("c_custkey % 10 = 0").select(channel.alias("channel_id"))).select("id", "status")


def _intake(spark, sf_dir):
    c, o = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "orders")
    candidates = c.where("c_custkey % 4 <> 3").select(F.col("c_custkey").alias("id"), F.lit("NEEDS_OPERATOR_REVIEW").alias("status"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, "brand_channel").alias("role"), F.lit(None).cast("boolean").alias("eligible"))
    m = F.pmod("o_orderkey", F.lit(7))
    new = F.when(m == 0, "APPLIED").when(m == 1, "REJECTED").otherwise("VERIFIED_ADD_READY")
    return V.intake(candidates, o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.lit("op").alias("actor"), new.alias("new_status"), F.when(m == 2, "retailer").alias("role"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, False).alias("eligible")))


INTAKE = """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'brand_channel' END AS role FROM customer WHERE c_custkey % 4 <> 3
), o AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN 'APPLIED' WHEN 1 THEN 'REJECTED' ELSE 'VERIFIED_ADD_READY' END AS new_status FROM orders
), x AS (SELECT o.*, c.id IS NULL AS stranger, min(CASE WHEN new_status <> 'VERIFIED_ADD_READY' THEN seq END) OVER (PARTITION BY o.id) AS stop FROM o LEFT JOIN c ON c.id = o.id
), log AS (
    SELECT id, seq, 'op' AS actor, new_status, stranger OR seq > coalesce(stop, seq) AS refused,
           CASE WHEN stranger THEN NULL WHEN seq > stop THEN CASE stop % 7 WHEN 0 THEN 'APPLIED' ELSE 'REJECTED' END
                WHEN row_number() OVER (PARTITION BY id ORDER BY seq) = 1 THEN 'NEEDS_OPERATOR_REVIEW' ELSE 'VERIFIED_ADD_READY' END AS old_status FROM x
) """


@query("intake_audit", INTAKE + "SELECT id, seq, actor, old_status, new_status, refused FROM log")
def intake_audit(spark, sf_dir):
    """SUP11, API14: every action on intake candidates, those on settled ones refused."""
    return _intake(spark, sf_dir)[1]


@query("intake_applied", INTAKE + """, l AS (SELECT id, arg_max(new_status, seq) AS s, max(seq) AS seq FROM log WHERE NOT refused GROUP BY id)
SELECT c.id, coalesce(l.s, 'NEEDS_OPERATOR_REVIEW') AS status, CASE WHEN l.s = 'APPLIED' THEN coalesce(role, 'independent_creator') ELSE role END AS role,
       CASE WHEN l.s = 'APPLIED' THEN CASE WHEN l.seq % 2 = 0 THEN false ELSE role IS NULL END END AS eligible FROM c LEFT JOIN l ON l.id = c.id""")
def intake_applied(spark, sf_dir):
    """SUP11, API14: candidates after all actions, with role and eligibility settled where they were applied."""
    return _intake(spark, sf_dir)[0]


@query("channel_verification", """WITH d AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders), u AS (SELECT o_custkey, count(*) AS n FROM orders, d WHERE date_diff('day', CAST(o_orderdate AS DATE), last) <= 400 GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE coalesce(n, 0) END AS recent, CASE WHEN c_custkey % 6 = 0 THEN 'NEEDS_OPERATOR_REVIEW' WHEN n IS NULL THEN 'SKIP_INACTIVE' ELSE 'VERIFIED_ADD_READY' END AS status,
       CASE WHEN c_custkey % 6 = 0 THEN 'Could not resolve to a channel_id' WHEN n IS NULL THEN 'No videos published in last 400 days' ELSE n || ' video(s) in last 400 days' END AS reason
FROM customer LEFT JOIN u ON o_custkey = c_custkey""")
def channel_verification(spark, sf_dir):
    """SUP30: candidates checked by format and by their recent uploads."""
    c, o = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    channel = lambda key: F.concat(F.lit("UC"), F.lpad(key.cast("string"), 22, "0"))
    candidates = c.select(F.col("c_custkey").alias("id"), F.when(F.pmod("c_custkey", F.lit(6)) == 0, "UCshort").otherwise(channel(F.col("c_custkey"))).alias("channel_id"))
    last = o.agg(F.max("day")).first()[0]
    return V.verified(candidates, o.select(channel(F.col("o_custkey")).alias("channel_id"), "day"), F.lit(last), 400).drop("channel_id")


RECORD = "kind string, id bigint, name string, score double"


@query("landed_extractions", """WITH r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'corrupt' WHEN event_id % 10 = 1 THEN 'missing:id' WHEN event_id % 10 = 2 THEN 'unknown_kind' WHEN event_id % 10 = 3 THEN 'missing:name' WHEN event_id % 10 = 4 THEN 'missing:score' END AS reason FROM events)
SELECT CASE WHEN reason IS NULL THEN event_id END AS id, CASE WHEN reason IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 'perfume' ELSE 'topic' END END AS kind, reason, CAST(event_id % 5 AS INTEGER) AS retries, reason IS NOT NULL AND event_id % 5 < 3 AS again FROM r""")
def landed_extractions(spark, sf_dir):
    """EXT02, SRC17: landed model answers under a schema, routed by kind, rejects with a reason and their retries."""
    e, m = B.table(spark, sf_dir, "events"), F.pmod("event_id", F.lit(10))
    kind = F.when(m.isin(3) | ((m >= 5) & (m % 2 == 0)), "perfume").when(m == 2, "song").otherwise("topic")
    line = F.when(m == 0, F.format_string('{"kind":"topic","id":%d,"na', "event_id")).otherwise(
        F.concat(
            F.lit('{"kind":"'), kind, F.lit('"'), F.when(m != 1, F.format_string(',"id":%d', "event_id")).otherwise(F.lit("")),
            F.when(m != 3, F.lit(',"name":"n"')).otherwise(F.lit(',"name":" "')), F.when(m != 4, F.lit(',"score":0.5')).otherwise(F.lit("")), F.lit("}"),
        )
    )
    path = scratch(spark, "landed")
    e.select(F.to_json(F.struct(line.alias("line"), F.pmod("event_id", F.lit(5)).cast("int").alias("retries"))).alias("value")).write.text(path)
    lines = spark.read.schema("line string, retries int").json(path)
    told = R.checked_records(lines, RECORD, ["id"], {"perfume": ["name"], "topic": ["score"]})
    return told.select(F.when(F.col("reason").isNull(), F.col("record.id")).alias("id"), "kind", "reason", "retries", "again")


TOPIC_ROWS = B.HITS + """, rows AS (
    SELECT entity_id, CASE platform WHEN 'youtube' THEN 'query' WHEN 'reddit' THEN 'subreddit' ELSE 'topic' END AS topic_type, 't' || CAST(author AS BIGINT) % 60 AS topic_text, count(*) AS occurrences, round(avg(views), 4) AS avg_score FROM hits GROUP BY 1, 2, 3
)"""


@query("topics_by_type", B.sql("SELECT entity_id, topic_type, list(topic_text ORDER BY r) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, topic_type ORDER BY occurrences DESC, avg_score DESC, topic_text) AS r FROM rows) q WHERE r <= 8 GROUP BY 1, 2", TOPIC_ROWS))
def topics_by_type(spark, sf_dir):
    """TK05: eight topics of each type for every entity, in one pass."""
    kind = F.when(F.col("platform") == "youtube", "query").when(F.col("platform") == "reddit", "subreddit").otherwise("topic")
    h = B.hits(spark, sf_dir).select("entity_id", kind.alias("topic_type"), F.concat(F.lit("t"), F.pmod(F.col("author").cast("long"), F.lit(60)).cast("string")).alias("topic_text"), "views")
    rows = h.groupBy("entity_id", "topic_type", "topic_text").agg(F.count(F.lit(1)).alias("occurrences"), F.round(F.avg("views"), 4).alias("avg_score"))
    return P.top_by_type(rows)


@query("appended_mentions", "SELECT DISTINCT user_id, event_type FROM events")
def appended_mentions(spark, sf_dir):
    """SUP32: inserts that leave stored keys alone, in two runs that overlap."""
    path, e = scratch(spark, "mentions"), B.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    keys, schema = ["user_id", "event_type"], "user_id long, event_type string"
    first, second = e.where("event_id % 3 <> 0").select(*keys), e.where("event_id % 3 <> 1").select(*keys)
    W.append_new(first, spark.createDataFrame([], schema), keys, path)
    W.append_new(second, spark.read.schema(schema).parquet(path), keys, path)
    return spark.read.schema(schema).parquet(path)


@query("alert_records", """WITH cmd AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' ELSE 'update' END AS op,
    CAST(o_totalprice AS DOUBLE) AS threshold, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS state FROM orders
), stored AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS threshold, 'A' AS state FROM customer WHERE c_custkey % 3 <> 2
), ids AS (SELECT id FROM cmd UNION SELECT id FROM stored
), cutoff AS (SELECT ids.id, max(seq) AS d FROM ids LEFT JOIN cmd ON cmd.id = ids.id AND op = 'delete' GROUP BY 1
), base AS (
    SELECT c.id, -1 AS seq, s.threshold, s.state FROM cutoff c JOIN stored s ON s.id = c.id WHERE d IS NULL
    UNION ALL
    SELECT c.id, min(k.seq), arg_min(k.threshold, k.seq), CASE WHEN min(k.seq) % 2 = 0 THEN arg_min(coalesce(k.state, '-'), k.seq) END
    FROM cutoff c JOIN cmd k ON k.id = c.id AND k.op = 'create' AND k.seq > coalesce(d, -1) LEFT JOIN stored s ON s.id = c.id WHERE d IS NOT NULL OR s.id IS NULL GROUP BY c.id
), u AS (
    SELECT b.id, arg_max(k.threshold, k.seq) AS threshold, arg_max(k.state, k.seq) FILTER (k.state IS NOT NULL) AS state FROM base b JOIN cmd k ON k.id = b.id AND k.op = 'update' AND k.seq > b.seq GROUP BY b.id
)
SELECT b.id, coalesce(u.threshold, b.threshold) AS threshold, coalesce(u.state, b.state) AS state FROM base b LEFT JOIN u ON u.id = b.id""")
def alert_records(spark, sf_dir):
    """ALR03: stored alerts after all create, update and delete commands."""
    c, o = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "orders")
    rows = c.where("c_custkey % 3 <> 2").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("threshold"), F.lit("A").alias("state"))
    m = F.pmod("o_orderkey", F.lit(5))
    op = F.when(m == 0, "delete").when(m == 1, "create").otherwise("update")
    commands = o.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), op.alias("op"), F.col("o_totalprice").cast("double").alias("threshold"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("o_orderstatus")).alias("state")
    )
    return V.commanded(rows, commands, "id", ["threshold", "state"])
