"""Streams run to completion and sinks read back, as queries; and small queries over stored state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import candidates as C
from trendloom.operators import creators as K
from trendloom.operators import series as O
from trendloom.plans import base as B
from trendloom.plans.market import SIGNALS
from trendloom.plans.registry import query
from trendloom.sources import readers as R
from trendloom.sources import sinks as W
from trendloom.sources.store import Store
from trendloom.streaming import daystore as D


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{B.shared_folder(spark)}/trendloom-streams/{name}-{uuid.uuid4().hex}"


def arrivals(spark: SparkSession, sf_dir: str, name: str, key: str, batches: int = 4) -> DataFrame:
    """A table as a stream of files in shuffled order, one a micro-batch: every batch holds late rows of all days, and a fifth of the rows comes twice."""
    path = scratch(spark, f"{name}-arrivals")
    h = F.pmod(F.xxhash64(key), F.lit(5 * batches))
    first = F.pmod(h, F.lit(batches))
    again = F.when(h < batches, F.array(first, F.pmod(first + 1, F.lit(batches)))).otherwise(F.array(first))
    rows = B.table(spark, sf_dir, name)
    rows.withColumn("_arrival", F.explode(again)).repartition(batches, "_arrival").write.partitionBy("_arrival").parquet(path)
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_day_counts", B.sql("SELECT entity_id, day, mention_count, unique_authors, engagement_sum, platforms FROM counts"))
def stream_day_counts(spark, sf_dir):
    """STM01, STM02, STM04: one-day windows over items that come late, shuffled and twice; every batch merges into the stored days."""
    path = scratch(spark, "days")
    store = D.DayStore(Store(spark, path), B.ITEMS, ["content_item_id"], "ts")
    D.in_batches(arrivals(spark, sf_dir, "events", "event_id"), lambda rows, name: store.merge(B.items_of(rows), name), f"{path}-checkpoint", "events")
    return O.daily_counts(O.hits_of(store.read())).drop("confidence_avg")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """STM05: one mention of each natural key over all runs, however late a repeat comes."""
    path = scratch(spark, "dedup")
    seen = D.SeenKeys(Store(spark, path), "user_id long, event_type string", ["user_id", "event_type"])
    D.in_batches(arrivals(spark, sf_dir, "events", "event_id"), lambda rows, name: seen.merge(rows, name, "ts"), f"{path}-checkpoint", "events")
    return seen.rows()


def merged_series(spark, sf_dir) -> D.SeriesStore:
    """The series kept up to date over shuffled batches."""
    path = scratch(spark, "series")
    store = D.SeriesStore(Store(spark, path), B.ITEMS, ["content_item_id"], "ts")
    D.in_batches(arrivals(spark, sf_dir, "events", "event_id"), lambda rows, name: store.merge(B.items_of(rows), name), f"{path}-checkpoint", "events")
    return store


@query("stream_signals", B.sql(SIGNALS + "SELECT entity_id, day, signal_type, strength FROM sig WHERE signal_type IN ('new_entry', 'breakout')"))
def stream_signals(spark, sf_dir):
    """STM06: days against the previous state of each entity, put right when a late day changes it."""
    found = D.stored_signals(merged_series(spark, sf_dir).series())
    return found.where(F.col("signal_type").isin("new_entry", "breakout")).select("entity_id", "day", "signal_type", "strength")


@query("signal_corrections", B.sql(SIGNALS + "SELECT entity_id, day, strength, signal_type, detail FROM sig"))
def signal_corrections(spark, sf_dir):
    """STM04, STM06: what the log of corrections comes to: signals that late days have added and not taken back."""
    log = merged_series(spark, sf_dir).corrections()
    net = log.groupBy("entity_id", "day", "strength", "signal_type", "detail").agg(F.sum("change").alias("n"))
    return net.where("n > 0").drop("n")


@query("landed_raw", "SELECT event_id, event_type AS source, CAST(day(ts) AS INTEGER) AS run_id, props AS payload FROM events")
def landed_raw(spark, sf_dir):
    """SRC18: raw payloads as JSON by source and run, read back from their folders."""
    path = scratch(spark, "raw")
    W.land_raw(B.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.dayofmonth("ts").alias("run_id"), F.col("props").alias("payload")), path)
    return spark.read.schema("event_id bigint, payload string, source string, run_id int").json(path).select("event_id", "source", "run_id", "payload")


@query("published_files", "SELECT p_partkey, p_name, [p_brand, p_type] AS tags, p_brand || '; ' || p_type AS flat FROM part")
def published_files(spark, sf_dir):
    """SNK08-10: one table published as JSON and as flat CSV, both read back and joined."""
    p = B.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("tags"))
    a, b = scratch(spark, "json"), scratch(spark, "csv")
    W.write_json(p, a)
    W.write_csv(p.select("p_partkey", F.col("tags").alias("flat")), b)
    return spark.read.schema(p.schema).json(a).join(spark.read.option("header", True).schema("p_partkey bigint, flat string").csv(b), "p_partkey")


@query("markdown_report", """WITH r AS (SELECT r_regionkey, r_name FROM region)
SELECT '# Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) || chr(10) AS report FROM r""")
def markdown_report(spark, sf_dir):
    """SNK11, SUP29: a small table as Markdown."""
    r = B.table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(W.markdown(r, "Regions"),)], "report string")


@query("content_scan", "SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) AS views, user_id AS account, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id) AS place FROM events")
def content_scan(spark, sf_dir):
    """SRC01-04: the full projected scan, newest first within each day."""
    from pyspark.sql import Window

    e = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("views"), F.col("user_id").alias("account"), "ts")
    return e.withColumn("place", F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy(F.desc("ts"), "id")).cast("long")).drop("ts")


@query("stripped_entities", "SELECT event_id AS content_item_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 7 THEN 1 ELSE 2 END - CASE WHEN event_id % 3 = 0 AND (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) % 100 = 7 THEN 1 ELSE 0 END AS n FROM events")
def stripped_entities(spark, sf_dir):
    """RUL05, SUP26: one entity taken out of all resolved arrays."""
    return K.strip_entity(B.resolved(spark, sf_dir), F.lit("Perfume 7")).select("content_item_id", F.size("entities").alias("n"))


@query("admin_overlay", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'verified' WHEN c_custkey % 3 = 1 THEN 'rejected' ELSE 'new' END AS status,
    CASE WHEN c_custkey % 3 = 0 THEN 'brand' WHEN c_custkey % 3 = 1 THEN 'none' ELSE 'user' END AS role FROM customer""")
def admin_overlay(spark, sf_dir):
    """API14, SUP10, SUP11, SUP14: the latest of several decisions over intake rows, two columns at once."""
    rows = B.table(spark, sf_dir, "customer").select("c_custkey", F.lit("new").alias("status"), F.lit("user").alias("role"))
    m = F.pmod("c_custkey", F.lit(3))
    change = lambda cond, seq, status, role: rows.where(cond).select("c_custkey", F.lit(seq).alias("seq"), F.lit(status).alias("status"), F.lit(role).alias("role"))
    return C.overlay(rows, change(m <= 1, 1, "rejected", "none").unionByName(change(m == 0, 2, "verified", "brand")), "c_custkey", ["status", "role"])


@query("backfilled_sources", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 500000 ELSE o_custkey END AS source FROM orders")
def backfilled_sources(spark, sf_dir):
    """ENR04: stored keys remapped where a mapping is known."""
    o = B.table(spark, sf_dir, "orders")
    known = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("old"), (F.col("o_custkey") + 500000).alias("new")).distinct()
    return K.remapped(o.select("o_orderkey", F.col("o_custkey").alias("source")), known, "source")


@query("alert_history", "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 20 OFFSET 20")
def alert_history(spark, sf_dir):
    """ALR03: the second page of a history."""
    e = B.table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "value")
    return K.paged(e, "value", ("value",), offset=20, limit=20, key="event_id")


@query("due_accounts", "SELECT c_custkey AS creator FROM customer WHERE c_nationkey % 5 = 0 OR c_acctbal <= 2000")
def due_accounts(spark, sf_dir):
    """SUP14, SRC19: accounts never polled or due."""
    c = B.table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("creator"), F.when(F.pmod("c_nationkey", F.lit(5)) != 0, F.col("c_acctbal")).alias("next_poll_after"))
    return K.due(rows, F.lit(2000.0)).select("creator")
