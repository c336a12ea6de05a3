"""Stored days, series and keys: nothing is lost, repeated batches change nothing, late days put decisions right."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trendloom.operators import series as O
from trendloom.plans import base as B
from trendloom.sources.store import Change, Store
from trendloom.streaming import daystore as D
from trendloom.streaming import jobs

DAY = dt.date(2024, 1, 1)
ROWS = "k int, day date, v int"


def rows(spark, *xs):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=d), v) for k, d, v in xs], ROWS)


def values(df):
    return sorted(tuple(r) for r in df.select("k", F.datediff("day", F.lit(DAY)).alias("d"), "v").collect())


def test_store_replaces_appends_rolls_back_and_cleans(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    one = s.commit({"t": Change(rows(spark, (1, 0, 1), (2, 1, 1)), "day"), "log": Change(rows(spark, (1, 0, 1)), "day", append=True)}, "a")
    assert s.commit({"t": Change(rows(spark, (9, 0, 9)), "day")}, "a") == one and s.has("a") and not s.has("b")
    s.commit({"t": Change(rows(spark, (3, 1, 3)), "day", touched=["2024-01-01"]), "log": Change(rows(spark, (2, 0, 2)), "day", append=True)}, "b")
    read = lambda t, parts=None: values(Store(spark, s.path).read(t, ROWS, "day", parts))
    assert read("t") == [(3, 1, 3)] and read("log") == [(1, 0, 1), (2, 0, 2)] and read("t", ["2024-01-01"]) == [] and read("none") == []
    s.rollback(one)
    assert read("t") == [(1, 0, 1), (2, 1, 1)] and read("log") == [(1, 0, 1)] and not s.has("b")
    s.commit({"t": Change(rows(spark, (7, 2, 7)), "day")}, "b")
    assert read("t") == [(1, 0, 1), (2, 1, 1), (7, 2, 7)] and s.vacuum() == 2 and read("t") == [(1, 0, 1), (2, 1, 1), (7, 2, 7)]
    for k in range(3):
        s.commit({"log": Change(rows(spark, (k, 0, k)), "day", append=True)})
    before = read("log")
    assert s.compact("log", ROWS, "day", most=2) and read("log") == before and not s.compact("log", ROWS, "day", most=2)


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.commit({"t": Change(rows(spark, (1, 0, 1)), "day")}, "a")
    with pytest.raises(Exception):  # noqa: B017
        s.commit({"t": Change(rows(spark, (2, 0, 2)), "day"), "u": Change(rows(spark, (2, 0, 2)).withColumn("v", F.raise_error(F.lit("x"))), "day")}, "b")
    assert values(s.read("t", ROWS, "day")) == [(1, 0, 1)] and not s.has("b")
    s.commit({"t": Change(rows(spark, (3, 0, 3)), "day")}, "b")
    assert values(s.read("t", ROWS, "day")) == [(3, 0, 3)]


def test_a_later_batch_of_a_day_keeps_the_other_rows(spark, tmp_path):
    store = D.DayStore(Store(spark, str(tmp_path / "s")), ROWS, ["k"], "v")
    store.merge(rows(spark, (1, 0, 1), (2, 0, 1), (3, 4, 1)), "x-0")
    store.merge(rows(spark, (1, 0, 5), (1, 0, 4), (4, 0, 1)), "x-1")
    assert values(store.read()) == [(1, 0, 5), (2, 0, 1), (3, 4, 1), (4, 0, 1)]
    store.merge(rows(spark, (2, 0, 9)), "x-1")  # the same batch again
    store.merge(rows(spark), "x-2")
    store.merge(spark.createDataFrame([(8, None, 1)], ROWS), "x-3")
    assert values(store.read()) == [(1, 0, 5), (2, 0, 1), (3, 4, 1), (4, 0, 1)] and values(store.read(["2024-01-05"])) == [(3, 4, 1)]


def test_stream_into_days_resumes(spark, tmp_path):
    store = D.DayStore(Store(spark, str(tmp_path / "s")), ROWS, ["k"], "v")
    src = str(tmp_path / "in")
    for k in range(4):
        rows(spark, (k, 0, k), (10 + k, 3 - k, k)).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: jobs.events_stream(spark, src, rows(spark).schema, 1)
    D.in_batches(stream(), store.merge, str(tmp_path / "ck"), "in")
    rows(spark, (0, 0, 9)).write.mode("append").parquet(src)
    D.in_batches(stream(), store.merge, str(tmp_path / "ck"), "in")
    assert values(store.read()) == sorted([(0, 0, 9), *[(k, 0, k) for k in range(1, 4)], *[(10 + k, 3 - k, k) for k in range(4)]])


ITEM = "content_item_id long, platform string, author string, day date, views long, likes long, comments long, override double, ts timestamp_ntz, entities array<struct<name: string, confidence: decimal(10,4)>>"


def items(n, seed):
    random.seed(seed)
    out = []
    for k in range(n):
        day = DAY + dt.timedelta(days=random.randrange(12))
        names = random.sample(["A", "A Eau de Parfum", "B", "C", "D", "E"], random.randrange(3))
        out.append((k, random.choice(["youtube", "tiktok", "reddit"]), f"u{random.randrange(9)}", day, random.randrange(900_000), 3, 1, random.choice([None, None, 0.0]), dt.datetime(2024, 1, 1, 0, k % 60), [(x, None) for x in names]))
    return out


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_series_over_shuffled_batches_equals_the_whole(spark, tmp_path):
    store = D.SeriesStore(Store(spark, str(tmp_path / "s")), ITEM, ["content_item_id"], "ts")
    every = items(90, 4)
    moved = [(*r[:9], [("B", None), ("F", None)]) for r in every[:12]]  # twelve items come again with other entities
    order = random.Random(5).sample(every, len(every))
    batches = [order[:40], order[40:41] + order[:9], [], order[41:], moved]
    for k, b in enumerate(batches):
        store.merge(spark.createDataFrame(b, ITEM), f"b-{k}")
        store.merge(spark.createDataFrame(b[:3], ITEM), f"b-{k}")
    whole = spark.createDataFrame(moved + every[12:], ITEM)
    want = D.chained(O.daily_counts(O.hits_of(whole)))
    assert same(store.series(), want) and want.count() > 25
    assert same(D.stored_signals(store.series()), O.signals(want))
    net = store.corrections().groupBy("entity_id", "day", "strength", "signal_type", "detail").agg(F.sum("change").alias("n")).where("n <> 0")
    assert same(net.drop("n"), O.signals(want).select("entity_id", "day", "strength", "signal_type", "detail")) and net.where("n <> 1").count() == 0
    assert store.corrections().where("change = -1").count() > 0  # some decisions were taken back
    for r in store.heads().collect():
        last = want.where(F.col("entity_id") == r.entity_id).orderBy(F.desc("day")).limit(2).collect()
        assert [x.day for x in last] == [h.day for h in (r.h1, r.h2) if h]


def test_days_are_read_from_their_partitions_alone(spark, sf_dir):
    store = B.stored(spark, sf_dir)
    assert {f.split("day=")[1].split("/")[0] for f in store.series(["2024-01-15"]).inputFiles()} == {"2024-01-15"}
    some = store.between("2024-01-10", "2024-01-20")
    assert {f.split("day=")[1].split("/")[0] for f in some.inputFiles()} == {f"2024-01-{d}" for d in range(10, 21)} and len(store.days()) > 11
    some.write.format("noop").mode("overwrite").save()
    whole = B.series(spark, sf_dir).where("day BETWEEN '2024-01-10' AND '2024-01-20'")
    assert same(some.select(*whole.columns[:6]), whole.select(*whole.columns[:6]))
    assert store.series(["1999-01-01"]).count() == 0 and B.stored(spark, sf_dir).store.version() == 1  # built once


def test_keys_are_never_forgotten(spark, tmp_path):
    seen = D.SeenKeys(Store(spark, str(tmp_path / "s")), "user long, url string, at int", ["user", "url"], blocks=8, parts=4)
    make = lambda *xs: spark.createDataFrame(list(xs), "user long, url string, at int")
    seen.merge(make(*[(k, f"u{k}", 5) for k in range(500)], (3, "u3", 2), (7, None, 1), (None, "x", 1)), "a", "at")
    seen.merge(make((1_000, "new", 1), (3, "u3", 1)), "b", "at")
    seen.merge(make(*[(k, f"u{k}", 0) for k in range(450, 520)], (7, None, 0), (None, "x", 0)), "c", "at")  # ten days and three runs apart
    seen.merge(make((2_000, "no", 1)), "c", "at")
    got = sorted((r.user is None, r.user or 0, r.url or "", r.at) for r in seen.rows().collect())
    want = [(k, f"u{k}", 2 if k == 3 else 5 if k < 500 else 0) for k in range(520)] + [(7, None, 1), (None, "x", 1), (1_000, "new", 1)]
    assert got == sorted((a is None, a or 0, b or "", c) for a, b, c in want)
    fresh = make(*[(k, "other", 1) for k in range(3_000, 4_000)])
    assert seen.probed(fresh).where("_likely").count() < 100  # few false alarms reach the index
    assert seen.probed(make(*[(k, f"u{k}", 1) for k in range(520)])).where("NOT _likely").count() == 0


def test_keys_in_many_small_batches(spark, tmp_path):
    seen = D.SeenKeys(Store(spark, str(tmp_path / "s")), "k long, at int", ["k"], blocks=2, parts=2)
    for b in range(10):
        seen.merge(spark.createDataFrame([(k, b) for k in range(b * 5, b * 5 + 10)], "k long, at int"), str(b), "at")
    assert sorted((r.k, r.at) for r in seen.rows().collect()) == sorted([*[(k, 0) for k in range(10)], *[(b * 5 + 5 + k, b) for b in range(1, 10) for k in range(5)]])
    assert max(len(v) for v in seen.store.parts("filter").values()) <= 9  # compacted on the way
