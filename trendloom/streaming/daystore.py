"""Stored days: items, their daily series and the keys seen so far, kept right under late, repeated and shuffled batches.

A batch brings items in any order. Its days are read from the store, its items take the place of stored ones with the
same key, and the days are committed as new versions (sources.store), so nothing that a batch does not hold is lost, and
a batch that comes again changes nothing.

The series is kept by day, too. Each of its rows carries the counts of its two predecessors, which is all that
growth, momentum, acceleration, score and state depend on; `heads` holds the last two rows of each entity. So a late day is
put right from the partitions at and after it, for the entities whose counts it changes, and only rows that
come out different are written; signals that a correction adds or takes back are logged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.operators import series as O
from trendloom.sources.sinks import keep_latest
from trendloom.sources.store import Change, Store, bucket

COUNTS = "mention_count double, unique_authors long, engagement_sum long, platforms long, confidence_avg double"
_PAST = f"struct<day: date, {COUNTS.replace(' ', ': ').replace(',:', ',')}>"
SERIES = (
    f"entity_id string, {COUNTS}, growth_rate double, momentum double, acceleration double, volatility double, composite_score double, "
    f"prev_score double, trend_state string, p1 {_PAST}, p2 {_PAST}, day date"
)
HEADS = f"entity_id string, h1 {_PAST}, h2 {_PAST}, part int"
CORRECTIONS = "entity_id string, day date, strength double, signal_type string, detail double, change int, part string"
#: Hash buckets of the heads.
HEAD_PARTS = 16


def in_batches(stream: DataFrame, merge: Callable[[DataFrame, str], object], checkpoint: str, name: str) -> None:
    """Run the stream over all that has landed; every micro-batch goes to merge() under a name that it keeps when it comes again."""

    def put(batch: DataFrame, number: int) -> None:
        merge(batch, f"{name}-{number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with the batch's rows in place of those with equal keys; of equal keys in the batch the last by `order` stays."""
    fresh = keep_latest(batch, keys, order)
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*stored.columns))


class DayStore:
    """Items by day. An item's key decides which delivery of it stands; its day does not change."""

    def __init__(self, store: Store, schema: str | StructType, keys: list[str], order: str, day: str = "day", table: str = "items"):
        self.store, self.schema, self.keys, self.order, self.day, self.table = store, schema, keys, order, day, table

    def read(self, days=None) -> DataFrame:
        return self.store.read(self.table, self.schema, self.day, days)

    def change(self, batch: DataFrame) -> tuple[list[str], DataFrame]:
        """(days that the batch touches, their rows after it)."""
        days = sorted(str(r[0]) for r in batch.select(self.day).where(F.col(self.day).isNotNull()).distinct().collect())  # one value a day
        stored = self.read(days)
        return days, merged(stored, batch.where(F.col(self.day).isNotNull()).select(*stored.columns), self.keys, self.order)

    def merge(self, batch: DataFrame, name: str) -> None:
        if not self.store.has(name):
            days, rows = self.change(batch)
            self.store.commit({self.table: Change(rows, self.day, touched=days)}, name)


def chained(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Series rows with p1 and p2 from rows(entity_id, day, counts), after the earlier rows `before` of the same columns."""
    names = ["entity_id", "day", *StructType.fromDDL(COUNTS).names]
    own = rows.select(*names, F.lit(True).alias("_own"))
    every = own if before is None else own.unionByName(before.select(*names, F.lit(False).alias("_own")))
    w = Window.partitionBy("entity_id").orderBy("day")
    past = F.struct(*names[1:])
    every = O.with_trend(every).withColumn("p1", F.lag(past, 1).over(w)).withColumn("p2", F.lag(past, 2).over(w))
    return every.where("_own").select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SERIES)])


def stored_signals(rows: DataFrame) -> DataFrame:
    """The signals of stored series rows; each carries what its decision needs."""
    return O.signal_events(rows.withColumn("_p", F.col("prev_score")).withColumn("_any", F.when(F.col("p1").isNotNull(), True)))


class SeriesStore:
    """Items, series, heads and corrections of signals, each merge one commit."""

    def __init__(self, store: Store, items: str | StructType, keys: list[str], order: str):
        self.store, self.items = store, DayStore(store, items, keys, order)

    def series(self, days=None) -> DataFrame:
        """The stored series; of the given days only their partitions are read."""
        return self.store.read("series", SERIES, "day", days)

    def days(self) -> list[str]:
        return sorted(self.store.parts("series"))

    def between(self, first: str, last: str) -> DataFrame:
        return self.series([d for d in self.days() if first <= d <= last])

    def heads(self, parts=None) -> DataFrame:
        return self.store.read("heads", HEADS, "part", parts)

    def corrections(self) -> DataFrame:
        return self.store.read("corrections", CORRECTIONS, "part")

    def build(self, counts: DataFrame, name: str = "build") -> None:
        """The whole series of daily counts, as the first commit."""
        if self.store.has(name):
            return
        self.store.commit({"series": Change(chained(counts), "day")}, name)

    def _staged(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.store.path}/_stage/{name}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def merge(self, batch: DataFrame, name: str) -> None:
        """Take a batch of items in: one commit under its name, whatever order batches come in."""
        if self.store.has(name):
            return
        days, items = self.items.change(batch)
        if not days:
            self.store.commit({}, name)
            return
        key, counted = ["entity_id", "day"], StructType.fromDDL(COUNTS).names
        later = [d for d in self.days() if d >= days[0]]
        old = self.series(later)
        of_days = old.where(F.col("day").isin(*[F.lit(d).cast("date") for d in days]))
        now = O.daily_counts(O.hits_of(items)).select(*key, *[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(COUNTS)])
        a, b = now.select(*key, F.struct(*counted).alias("_new")), of_days.select(*key, F.struct(*counted).alias("_old"))
        differ = a.join(b, key, "full").where(F.expr("NOT (_new <=> _old)")).select(*key, "_new")
        differ = self._staged(differ, f"{name}-differ")

        # the affected entities' rows from their first change on, and the two rows before it
        affected = differ.groupBy("entity_id").agg(F.min("day").alias("_from"))
        rest = old.join(affected, "entity_id").where(F.col("day") >= F.col("_from"))
        first = rest.groupBy("entity_id").agg(F.min_by(F.struct("p1", "p2"), "day").alias("_first"))
        heads = self.heads().select("entity_id", F.struct(F.col("h1").alias("p1"), F.col("h2").alias("p2")).alias("_head"))
        context = affected.join(first, "entity_id", "left").join(heads, "entity_id", "left")
        context = context.select("entity_id", F.when(F.col("_first").isNotNull(), F.col("_first")).otherwise(F.col("_head")).alias("c"))
        before = context.select("entity_id", F.explode(F.array_compact(F.array("c.p1", "c.p2"))).alias("e")).select("entity_id", "e.*")
        kept = rest.join(differ.select(*key), key, "left_anti").select(*key, *counted)
        again = chained(kept.unionByName(differ.where("_new IS NOT NULL").select(*key, "_new.*")), before)
        again = self._staged(again, f"{name}-again")

        names = again.columns
        mine = rest.select(*key, F.struct(*names).alias("_old"))
        moved = again.select(*key, F.struct(*names).alias("_row")).join(mine, key, "full").where(F.expr("_row IS NULL OR _old IS NULL OR NOT (_row <=> _old)"))
        moved = self._staged(moved, f"{name}-moved")
        written = sorted(str(r[0]) for r in moved.select("day").distinct().collect())
        stays = old.where(F.col("day").isin(*[F.lit(d).cast("date") for d in written] or [F.lit(None).cast("date")])).join(moved.select(*key), key, "left_anti")
        series = stays.unionByName(moved.where("_row IS NOT NULL").select("_row.*").select(*names))

        last = again.groupBy("entity_id").agg(F.max_by(F.struct(F.struct("day", *counted).alias("h1"), F.col("p1").alias("h2")), "day").alias("_l"))
        emptied = context.select("entity_id", F.struct(F.col("c.p1").alias("h1"), F.col("c.p2").alias("h2")).alias("_c"))
        renewed = emptied.join(last, "entity_id", "left").select("entity_id", F.coalesce("_l", "_c").alias("h")).select("entity_id", "h.*").where("h1 IS NOT NULL")
        heads = self.heads().join(affected, "entity_id", "left_anti").select("entity_id", "h1", "h2").unionByName(renewed)
        heads = heads.withColumn("part", bucket(["entity_id"], HEAD_PARTS))

        events = lambda side, sign: stored_signals(moved.where(f"{side} IS NOT NULL").select(f"{side}.*")).withColumn("change", F.lit(sign))
        both = events("_row", 1).unionByName(events("_old", -1))
        corrected = both.groupBy("entity_id", "day", "strength", "signal_type", "detail").agg(F.sum("change").cast("int").alias("change")).where("change <> 0")
        corrected = corrected.withColumn("part", F.date_format("day", "yyyy-MM"))
        self.store.commit(
            {
                self.items.table: Change(items, self.items.day, touched=days),
                "series": Change(series, "day", touched=written),
                "heads": Change(heads, "part", touched=[str(k) for k in range(HEAD_PARTS)]),
                "corrections": Change(corrected, "part", append=True),
            },
            name,
        )


#: Bits of one block of the filter: those of one bitmap of Spark's bitmap functions.
BLOCK_BITS = 32_768
PROBES = 3


class SeenKeys:
    """An index of all keys ever taken in, in hash buckets, with a blocked Bloom filter before it.

    A batch's keys are joined with the filter blocks that they fall into: a key whose PROBES bits are not all set was never
    seen. Only the others, repeats and a few false alarms, are joined with the index, in the buckets that they fall into. So nothing is forgotten,
    however late a repeat comes, and a batch reads two bytes for each stored key, not the keys. `blocks` sets
    how many keys the filter serves well (about 2,000 each); beyond, it passes more keys on to the index and stays right.
    """

    def __init__(self, store: Store, schema: str, keys: list[str], blocks: int = 256, parts: int = 16):
        self.store, self.keys, self.blocks, self.parts = store, keys, blocks, parts
        self.types = StructType.fromDDL(schema)
        self.index = StructType([f for f in self.types if f.name in keys]).add("part", "integer")
        self.filter = "block int, bits binary, part int"

    def rows(self) -> DataFrame:
        """Every first occurrence, with its columns."""
        return self.store.read("first", StructType([*self.types]).add("part", "integer"), "part").drop("part")

    def _bits(self, rows: DataFrame) -> DataFrame:
        """rows with _block and _bits, the block of the filter and the places in it of each key."""
        h = F.xxhash64(F.lit("bits"), *[F.col(f"`{k}`") for k in self.keys])
        places = F.array(*[F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(PROBES)])
        return rows.withColumn("_block", bucket(self.keys, self.blocks)).withColumn("_bits", places)

    def probed(self, rows: DataFrame) -> DataFrame:
        """The rows with _likely, false where the filter proves that no earlier batch had the key."""
        blocks = self.store.read("filter", self.filter, "part").groupBy("block").agg(F.bitmap_or_agg("bits").alias("_f"))
        byte = lambda p: F.conv(F.hex(F.substring(F.col("_f"), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        is_set = lambda p: F.getbit(byte(p), p.bitwiseAND(F.lit(7)).cast("int")) == 1
        probed = self._bits(rows).join(blocks, F.col("_block") == F.col("block"), "left")
        likely = F.col("_f").isNotNull()
        for k in range(PROBES):
            likely = likely & is_set(F.col("_bits")[k])
        return probed.withColumn("_likely", F.coalesce(likely, F.lit(False))).drop("block", "_f", "_bits", "_block")

    def merge(self, batch: DataFrame, name: str, order: str) -> None:
        """Take the batch's new keys in; of rows with one key the first by `order`, then by all columns, stands."""
        if self.store.has(name):
            return
        columns = self.types.names
        one = batch.groupBy(*self.keys).agg(F.min_by(F.struct(*columns), F.struct(order, *columns)).alias("_r")).select("_r.*")
        path = f"{self.store.path}/_stage/{name}"
        self.probed(one).withColumn("part", bucket(self.keys, self.parts)).write.mode("overwrite").parquet(path)
        probed = batch.sparkSession.read.parquet(path)
        asked = sorted(str(r[0]) for r in probed.where("_likely").select("part").distinct().collect())
        known = self.store.read("keys", self.index, "part", asked)
        same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in [*self.keys, "part"]]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        fresh = probed.where("NOT _likely").unionByName(probed.where("_likely").alias("a").join(known.alias("b"), condition, "left_anti")).drop("_likely")
        bits = self._bits(fresh).select("_block", F.explode("_bits").alias("p")).groupBy("_block").agg(F.bitmap_construct_agg("p").alias("bits"))
        bits = bits.select(F.col("_block").cast("int").alias("block"), "bits", (F.col("_block") % self.parts).cast("int").alias("part"))
        self.store.commit(
            {
                "first": Change(fresh.select(*columns, "part"), "part", append=True),
                "keys": Change(fresh.select(*self.index.names), "part", append=True),
                "filter": Change(bits, "part", append=True),
            },
            name,
        )
        merged_bits = lambda rows: rows.groupBy("block", "part").agg(F.bitmap_or_agg("bits").alias("bits")).select("block", "bits", "part")
        self.store.compact("filter", self.filter, "part", merged=merged_bits)
        self.store.compact("keys", self.index, "part", most=32)
