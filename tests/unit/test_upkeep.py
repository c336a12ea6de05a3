"""Catalog loads, audited seeding, synchronisation by digests, intake rules, landed records, topics."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trendloom.operators import master as M
from trendloom.operators import resolver as R
from trendloom.operators import review as V
from trendloom.operators import topics as P
from trendloom.sources import readers
from trendloom.sources.store import Store

SEED = "fragrance_id string, brand_name string, perfume_name string, release_year int, gender string, source string, seq long"


def seed(*rows):
    return [(f, b, p, 2000, "u", "s", k) for k, (f, b, p) in enumerate(rows)]


def test_catalog_ids_stay_and_a_load_rolls_back_as_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    table = lambda t: sorted(tuple(r) for r in M.read(store, t).drop("part").collect())
    make = lambda *rows: spark.createDataFrame(seed(*rows), SEED)
    one = M.load(store, make(("1", "Chanel", "No 5"), ("2", "CHANEL ", "Coco"), ("3", "Dior", "Sauvage"), (None, "x", "y"), ("9", "", "y"), ("8", "z", None)), "a")
    assert [r[:3] for r in table("brands")] == [(1, "CHANEL", "chanel"), (2, "Dior", "dior")]
    assert [(r[0], r[1], r[3]) for r in table("perfumes")] == [(1, 1, "chanel coco"), (2, 1, "chanel no 5"), (3, 2, "dior sauvage")]
    before = {t: table(t) for t in M.TABLES}
    M.load(store, make(("4", "Armani", "Si"), ("3", "Dior", "Sauvage Elixir"), ("5", "chanel", "no 5")), "b")
    assert {r[2]: r[0] for r in table("brands")} == {"chanel": 1, "dior": 2, "armani": 3}
    assert {r[3]: r[0] for r in table("perfumes")} == {"chanel coco": 1, "chanel no 5": 2, "dior sauvage": 3, "armani si": 4, "dior sauvage elixir": 5}
    assert {r[0]: (r[4], r[9]) for r in table("master")}["3"] == ("dior sauvage elixir", 5) and {r[0]: r[9] for r in table("master")}["5"] == 2
    assert ("chanel no 5", "perfume", 2) in {r[1:4] for r in table("aliases")} and len(table("aliases")) == len({r[1:4] for r in table("aliases")})
    again = {t: table(t) for t in M.TABLES}
    M.load(store, make(("7", "Other", "Thing")), "b")  # the same load again
    assert {t: table(t) for t in M.TABLES} == again
    store.rollback(one)
    assert {t: table(t) for t in M.TABLES} == before


def test_numbers_are_dense_over_many_partitions(spark, tmp_path):
    keys = spark.range(1_000).select(F.format_string("k%04d", F.col("id")).alias("k")).repartition(9)
    got = M.numbered(keys.unionByName(keys), "k", 5, Store(spark, str(tmp_path / "n")), "x").orderBy("k").collect()
    assert [(r.k, r.id) for r in got] == [(f"k{k:04d}", k + 6) for k in range(1_000)]


def test_alias_plan_names_its_probe_and_writes_nothing(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    brands, perfumes = t([(1, "dior"), (2, "twin"), (3, "twin")], "id long, normalized_name string"), t([(7, "dior joy")], "id long, normalized_name string")
    master, aliases = t([(8, "dior poison"), (8, "dior poison"), (None, "dior none")], "perfume_id long, normalized_name string"), t([("joy", "perfume", 7)], "normalized_alias string, entity_type string, entity_id long")
    targets = [("Cd", "brand", "Dior"), ("tw", "brand", "Twin"), ("joy", "perfume", "Dior Joy"), ("poi", "perfume", "Dior Poison"), ("POI", "perfume", "Dior poison"), ("n", "perfume", "Dior None"), ("x", "brand", "dior joy")]
    got = {r.alias_text: (r.entity_id, r.probe, r.status) for r in M.alias_plan(t(targets, "alias_text string, entity_type string, canonical_target string"), brands, perfumes, master, aliases).collect()}
    assert got == {
        "Cd": (1, "brands", "WOULD_INSERT"), "tw": (None, "brands", "AMBIGUOUS"), "joy": (7, "perfumes", "EXISTING"), "POI": (8, "master", "WOULD_INSERT"),
        "poi": (8, "master", "REPEATED"), "n": (None, None, "MISSING"), "x": (None, None, "MISSING"),
    }


def test_sync_reads_differing_partitions_alone(spark, tmp_path):
    schema, parts = "k long, v string, part int", 64
    a = spark.range(3_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    b = a.where("k <> 17").withColumn("v", F.when(F.col("k") == 99, None).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(-5, "x")], "k long, v string"))
    source, target = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    M.synced_parts(source, "t", schema, a.repartition(5), ["k"], parts, "v")
    M.synced_parts(target, "t", schema, b, ["k"], parts, "v")
    changes = M.change_set(source, target, "t", schema, ["k"], parts)
    assert sorted(tuple(r) for r in changes.collect()) == [(-5, "delete"), (17, "insert"), (99, "update")]
    read = {f.split("part=")[1].split("/")[0] for f in changes.inputFiles()}
    assert 1 <= len(read) <= 3
    assert {str(p) for p in M.applied(source, target, "t", schema, ["k"], parts, "now")} >= read
    assert M.change_set(source, target, "t", schema, ["k"], parts).count() == 0 and M.applied(source, target, "t", schema, ["k"], parts, "later") == []
    assert sorted(r.k for r in target.read("t", schema, "part").collect()) == list(range(3_000))


def test_intake_folds_actions_and_refuses_settled_ones(spark):
    c = spark.createDataFrame([(1, "NEW", None, None), (2, "NEW", "brand_channel", None), (3, "REJECTED", None, None), (4, "NEW", None, None)], "id long, status string, role string, eligible boolean")
    a = [(1, 2, "APPLIED", None, None), (1, 1, "SEEN", None, None), (1, 3, "REJECTED", None, None), (2, 1, "APPLIED", None, True), (3, 1, "APPLIED", None, None), (9, 1, "APPLIED", None, None)]
    actions = spark.createDataFrame([(i, s, "op", n, r, e) for i, s, n, r, e in a], "id long, seq long, actor string, new_status string, role string, eligible boolean")
    after, audit = V.intake(c, actions)
    assert sorted(map(tuple, after.collect())) == [(1, "APPLIED", "independent_creator", True), (2, "APPLIED", "brand_channel", True), (3, "REJECTED", None, None), (4, "NEW", None, None)]
    assert sorted((r.id, r.seq, r.old_status, r.refused) for r in audit.where("id < 9").collect()) == [(1, 1, "NEW", False), (1, 2, "SEEN", False), (1, 3, "APPLIED", True), (2, 1, "NEW", False), (3, 1, "REJECTED", True)]
    assert [(r.old_status, r.refused) for r in audit.where("id = 9").collect()] == [(None, True)]


def test_verification_counts_recent_uploads(spark):
    uc = "UC" + "a" * 22
    day = dt.date(2024, 5, 31)
    uploads = spark.createDataFrame([(uc, day), (uc, day - dt.timedelta(30)), (uc, day - dt.timedelta(31)), (uc, day + dt.timedelta(1))], "channel_id string, day date")
    c = spark.createDataFrame([(1, uc), (2, "UC" + "b" * 22), (3, "UCx"), (4, None)], "id long, channel_id string")
    got = {r.id: (r.recent, r.status) for r in V.verified(c, uploads, F.lit(day)).collect()}
    assert got == {1: (2, "VERIFIED_ADD_READY"), 2: (0, "SKIP_INACTIVE"), 3: (0, "NEEDS_OPERATOR_REVIEW"), 4: (0, "NEEDS_OPERATOR_REVIEW")}


def test_landed_records_are_accepted_or_rejected_with_a_reason(spark):
    lines = [('{"kind":"a","id":1,"n":"x"}', 0), ('{"kind":"a","id":1}', 2), ('{"kind":"b","id":2}', 0), ('{"kind":"c","id":2}', 3), ('{"kind":"a"}', None), ('{"kind":"a","id":"q"', 9), ("", 0), (None, 0), ('{"id":3}', 1)]
    got = readers.checked_records(spark.createDataFrame(lines, "line string, retries int"), "kind string, id bigint, n string", ["id"], {"a": ["n"], "b": []}).collect()
    want = [("a", None, False), (None, "missing:n", True), ("b", None, False), (None, "unknown_kind", False), (None, "missing:id", True), (None, "corrupt", False), (None, "corrupt", True), (None, "corrupt", True)]
    assert [(r.kind, r.reason, r.again) for r in got][:8] == want and got[8].reason == "missing:kind"


def test_topics_by_type_limits_ranks_before_the_shuffle(spark):
    random.seed(1)
    rows = [(e, t, f"w{k}", random.randrange(4), float(random.randrange(3))) for e in "xy" for t in ("topic", "query") for k in range(40)]
    out = P.top_by_type(spark.createDataFrame(rows, "entity_id string, topic_type string, topic_text string, occurrences long, avg_score double"))
    want = {(e, t): [r[2] for r in sorted((r for r in rows if r[:2] == (e, t)), key=lambda r: (-r[3], -r[4], r[2]))[:8]] for e in "xy" for t in ("topic", "query")}
    assert {(r.entity_id, r.topic_type): r.topics for r in out.collect()} == want
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_low_ratios_lose_no_long_pair_and_too_low_ones_raise(spark):
    a, b = "ab" * 70, "abz" * 47
    got = R.fuzzy_pairs(spark.createDataFrame([(a,)], "text string"), spark.createDataFrame([(b,)], "name string"), 0.68, lambda x, y: F.lit(0.7))
    assert got.count() in (0, 1)
    with pytest.raises(ValueError):
        R.fuzzy_pairs(spark.createDataFrame([(a,)], "text string"), spark.createDataFrame([(b,)], "name string"), 0.6)


def test_commands_are_folded_in_order(spark):
    rows = spark.createDataFrame([(1, 5.0, "A"), (2, 6.0, None), (3, 7.0, "A")], "id long, threshold double, state string")
    cmd = [(1, 3, "update", 9.0, None), (1, 2, "create", 1.0, "x"), (2, 1, "delete", None, None), (2, 2, "update", 4.0, "y"), (2, 3, "create", 8.0, None), (4, 1, "update", 1.0, "z"), (5, 1, "create", None, "n"), (5, 2, "update", 2.0, None), (3, 9, "delete", None, None)]
    got = V.commanded(rows, spark.createDataFrame(cmd, "id long, seq long, op string, threshold double, state string"), "id", ["threshold", "state"])
    assert sorted(map(tuple, got.collect())) == [(1, 9.0, "A"), (2, 8.0, None), (5, 2.0, "n")]
    assert V.commanded(rows.limit(0), got.limit(0).selectExpr("id", "1L AS seq", "'x' AS op", "threshold", "state"), "id", ["threshold", "state"]).count() == 0
