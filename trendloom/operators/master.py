"""The catalog as stored tables: loads with ids that stay, audited alias seeding, and synchronisation of two stores by digests.

brands(id, canonical_name, normalized_name), perfumes(id, brand_id, ...), aliases and master are partitioned by a hash of their
key; a load commits all four together, so it is seen, and rolled back, as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.functions import text as T
from trendloom.sources.sinks import keep_latest
from trendloom.sources.store import Change, Store, bucket

TABLES = {
    "brands": "id long, canonical_name string, normalized_name string, part int",
    "perfumes": "id long, brand_id long, canonical_name string, normalized_name string, part int",
    "aliases": "alias_text string, normalized_alias string, entity_type string, entity_id long, match_type string, confidence double, part int",
    "master": "fragrance_id string, brand_name string, perfume_name string, canonical_name string, normalized_name string, release_year int, gender string, source string, brand_id long, perfume_id long, part int",
}
KEYS = {"brands": ["normalized_name"], "perfumes": ["normalized_name"], "aliases": ["normalized_alias", "entity_type", "entity_id"], "master": ["fragrance_id"]}
PARTS = 16


def read(store: Store, table: str, parts=None) -> DataFrame:
    return store.read(table, TABLES[table], "part", parts)


def numbered(keys: DataFrame, key: str, after: int, store: Store, name: str) -> DataFrame:
    """(key, id): distinct keys numbered in their order from after + 1.

    Rows are dealt by range, sorted and numbered in their partition; only the partitions' counts are summed up, so
    no window runs over all keys. The dealt rows are written first: places in partitions are then fixed.
    """
    path = f"{store.path}/_stage/{name}"
    dealt = keys.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    told = keys.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = told.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_low"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")  # one row a partition
    starts = counts.select("_part", (F.lit(after + 1) + before - F.col("_low")).alias("_add"))
    return told.join(F.broadcast(starts), "_part").select(key, (F.col("_at") + F.col("_add")).alias("id"))


def _staged(rows: DataFrame, store: Store, name: str) -> DataFrame:
    """rows, written once and read by what follows."""
    path = f"{store.path}/_stage/{name}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_ids(rows: DataFrame, key: str, stored: DataFrame, store: Store, name: str) -> DataFrame:
    """rows with id: that of the stored row of equal key, else a new one."""
    known = stored.select(key, F.col("id").alias("_known"))
    top = stored.agg(F.max("id")).first()[0] or 0
    new = numbered(rows.select(key).join(known, key, "left_anti"), key, top, store, name).withColumnRenamed("id", "_new")
    return rows.join(known, key, "left").join(new, key, "left").withColumn("id", F.coalesce("_known", "_new")).drop("_known", "_new")


def _upsert(store: Store, table: str, rows: DataFrame, overwrite: bool = True) -> Change:
    """A change of the partitions that rows fall into: rows replace, or are kept out by, stored ones of equal key."""
    names = StructType.fromDDL(TABLES[table]).names
    rows = rows.withColumn("part", bucket(KEYS[table], PARTS)).select(*names)
    stored = read(store, table)
    if overwrite:
        merged = stored.join(rows.select(*KEYS[table]), KEYS[table], "left_anti").unionByName(rows)
    else:
        merged = stored.unionByName(rows.join(stored.select(*KEYS[table]), KEYS[table], "left_anti"))
    return Change(merged, "part", touched=[str(k) for k in range(PARTS)])


def load(store: Store, seeds: DataFrame, name: str) -> int:
    """Load seeds(fragrance_id, brand_name, perfume_name, release_year, gender, source, seq) into all tables: one commit, its version.

    Names are matched by their normalised form; an id, once given, stays. Of rows of one brand, perfume or fragrance_id the one
    with the greatest seq gives the spelling and the attributes. Rows without a brand, a name or an id are left out.
    """
    if store.has(name):
        return store.version()
    s = seeds.withColumn("brand_name", F.trim("brand_name")).withColumn("perfume_name", F.trim("perfume_name"))
    s = s.withColumn("canonical_name", F.trim(F.concat_ws(" ", "brand_name", "perfume_name")))
    s = s.withColumn("_brand", T.normalize_text(F.col("brand_name"))).withColumn("normalized_name", T.normalize_text(F.col("canonical_name")))
    s = s.where(F.col("fragrance_id").isNotNull() & (F.coalesce("_brand", F.lit("")) != "") & (F.coalesce("perfume_name", F.lit("")) != ""))
    s = _staged(s, store, f"{name}-seeds")
    brands = keep_latest(s.select(F.col("_brand").alias("normalized_name"), F.col("brand_name").alias("canonical_name"), "seq"), ["normalized_name"], "seq")
    brands = _staged(with_ids(brands.drop("seq"), "normalized_name", read(store, "brands"), store, f"{name}-new-brands"), store, f"{name}-brands")
    perfumes = keep_latest(s.select("normalized_name", "canonical_name", "_brand", "brand_name", "perfume_name", "seq"), ["normalized_name"], "seq").drop("seq")
    perfumes = perfumes.join(brands.select(F.col("normalized_name").alias("_brand"), F.col("id").alias("brand_id")), "_brand")
    perfumes = _staged(with_ids(perfumes, "normalized_name", read(store, "perfumes"), store, f"{name}-new-perfumes"), store, f"{name}-perfumes")
    master = keep_latest(s, ["fragrance_id"], "seq").join(perfumes.select("normalized_name", "brand_id", F.col("id").alias("perfume_id")), "normalized_name")

    alias = lambda rows, kind, words: rows.select("id", F.explode(words).alias("alias_text")).select(
        "alias_text", T.normalize_text(F.col("alias_text")).alias("normalized_alias"), F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"),
        F.lit("exact").alias("match_type"), F.lit(1.0).alias("confidence"),
    )
    aliases = alias(brands, "brand", T.brand_aliases(F.col("canonical_name"))).unionByName(alias(perfumes, "perfume", T.perfume_aliases(F.col("brand_name"), F.col("perfume_name"))))
    aliases = aliases.groupBy(*KEYS["aliases"], "match_type", "confidence").agg(F.min("alias_text").alias("alias_text"))
    return store.commit(
        {"brands": _upsert(store, "brands", brands), "perfumes": _upsert(store, "perfumes", perfumes), "aliases": _upsert(store, "aliases", aliases), "master": _upsert(store, "master", master)}, name
    )


# --- audit, then apply -------------------------------------------------------------------


def alias_plan(targets: DataFrame, brands: DataFrame, perfumes: DataFrame, master: DataFrame, aliases: DataFrame) -> DataFrame:
    """targets(alias_text, entity_type, canonical_target) with normalized_alias, entity_id, probe and status; nothing is written.

    A brand is looked up by its normalised name, a perfume among the perfumes and, where none has the name, in the master: `probe` names
    the table that decided. No hit is MISSING, several ids are AMBIGUOUS; else the alias is EXISTING or WOULD_INSERT. Of several targets
    with one alias, type and id, one would insert, the first by spelling; the others are REPEATED.
    """
    one = lambda t, column, name: t.where(F.col(column).isNotNull()).groupBy(F.col("normalized_name").alias("_n")).agg(
        F.min(column).alias(f"_{name}"), F.countDistinct(column).alias(f"_{name}s")
    )
    t = targets.withColumn("normalized_alias", T.normalize_text(F.col("alias_text"))).withColumn("_n", T.normalize_text(F.col("canonical_target")))
    t = t.join(one(brands, "id", "b"), "_n", "left").join(one(perfumes, "id", "p"), "_n", "left").join(one(master, "perfume_id", "m"), "_n", "left")
    brand = F.col("entity_type") == "brand"
    probe = F.when(brand & F.col("_bs").isNotNull(), "brands").when(~brand & F.col("_ps").isNotNull(), "perfumes").when(~brand & F.col("_ms").isNotNull(), "master")
    several = F.when(F.col("probe") == "brands", F.col("_bs")).when(F.col("probe") == "perfumes", F.col("_ps")).otherwise(F.col("_ms"))
    found = F.when(F.col("probe") == "brands", F.col("_b")).when(F.col("probe") == "perfumes", F.col("_p")).otherwise(F.col("_m"))
    t = t.withColumn("probe", probe).withColumn("entity_id", F.when(F.col("probe").isNotNull() & (several == 1), found)).withColumn("_several", several)
    there = aliases.select(*KEYS["aliases"]).distinct().withColumn("_there", F.lit(True))
    t = t.join(there, KEYS["aliases"], "left")
    w = Window.partitionBy("normalized_alias", "entity_type", "entity_id").orderBy("alias_text", "canonical_target")
    t = t.withColumn("_r", F.row_number().over(w))
    status = (
        F.when(F.col("probe").isNull(), "MISSING").when(F.col("entity_id").isNull(), "AMBIGUOUS").when(F.col("_there"), "EXISTING")
        .when(F.col("_r") > 1, "REPEATED").otherwise("WOULD_INSERT")
    )
    return t.select("alias_text", "normalized_alias", "entity_type", "canonical_target", "entity_id", "probe", status.alias("status"))


def apply_plan(store: Store, plan: DataFrame, name: str, confidence: float = 0.95) -> int:
    """Insert what the plan would insert, as one commit; aliases that have appeared since are left alone."""
    rows = plan.where("status = 'WOULD_INSERT'").select("alias_text", "normalized_alias", "entity_type", "entity_id", F.lit("seed").alias("match_type"), F.lit(confidence).alias("confidence"))
    return store.commit({"aliases": _upsert(store, "aliases", rows, overwrite=False)}, name)


# --- synchronisation ---------------------------------------------------------------------

#: Children of a node of the digest tree.
FAN = 16


def row_digest(columns: list[str]) -> Column:
    """A 64-bit digest of a row's values; two of them under different seeds make collisions as unlikely as a 128-bit hash's."""
    return F.struct(F.xxhash64(F.lit("a"), *[F.col(f"`{c}`") for c in columns]).alias("a"), F.xxhash64(*[F.col(f"`{c}`") for c in columns], F.lit("b")).alias("b"))


def digests(rows: DataFrame, part: str = "part") -> DataFrame:
    """(level, node, n, a, b): digests of partitions (level 0) and of groups of FAN below each other, up to the whole table."""
    d = row_digest([c for c in rows.columns if c != part])
    level = rows.select(F.col(part).cast("long").alias("node"), d.alias("d")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(d.a)").alias("a"), F.expr("bit_xor(d.b)").alias("b"))
    return level.select(F.lit(0).alias("level"), "node", "n", "a", "b")


def tree(leaves: DataFrame, parts: int) -> DataFrame:
    """The digests of all levels above the leaves, the leaves included."""
    out, level, k = leaves, leaves, 0
    while parts > 1:
        parts, k = -(-parts // FAN), k + 1
        up = level.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(
            F.sum("n").alias("n"), F.expr("bit_xor(xxhash64(node, a))").alias("a"), F.expr("bit_xor(xxhash64(b, node))").alias("b")
        )
        level = up.select(F.lit(k).alias("level"), "node", "n", "a", "b")
        out = out.unionByName(level)
    return out


def differing(source: DataFrame, target: DataFrame) -> list[int]:
    """Partitions whose digests differ, found from the top of two trees: below equal nodes nothing is looked at."""
    both = source.alias("s").join(target.alias("t"), ["level", "node"], "full").where("NOT (s.n <=> t.n AND s.a <=> t.a AND s.b <=> t.b)").select("level", "node")
    top = both.agg(F.max("level")).first()[0]
    open_ = None
    for level in range(top if top is not None else -1, -1, -1):
        here = both.where(F.col("level") == level)
        if open_ is not None:
            here = here.where(F.expr(f"node div {FAN}").isin(open_))
        open_ = [r["node"] for r in here.select("node").collect()]  # partitions, not rows
        if not open_:
            return []
    return sorted(open_ or [])


def synced_parts(store: Store, table: str, schema: str, rows: DataFrame, keys: list[str], parts: int, name: str) -> None:
    """Store a version of a table, dealt into hash partitions of its keys, with its digests."""
    dealt = rows.withColumn("part", bucket(keys, parts)).select(*StructType.fromDDL(schema).names)
    store.commit({table: Change(dealt, "part", touched=[str(k) for k in range(parts)]), f"{table}_digests": Change(digests(dealt).withColumn("all", F.lit("all")), "all")}, name)


DIGESTS = "level int, node long, n long, a long, b long, all string"


def change_set(source: Store, target: Store, table: str, schema: str, keys: list[str], parts: int) -> DataFrame:
    """(keys, action): insert, update or delete, what makes the target equal to the source.

    Both sides' digest trees are compared first; only partitions that differ are read and joined. Rows of one key count as equal if
    all their columns are.
    """
    t = [tree(s.read(f"{table}_digests", DIGESTS, "all").drop("all"), parts) for s in (source, target)]
    open_ = differing(*t)
    names = [n for n in StructType.fromDDL(schema).names if n != "part"]
    a, b = (s.read(table, schema, "part", open_).select(*keys, F.struct(*names).alias(f"_{k}")) for k, s in enumerate((source, target)))
    both = a.join(b, keys, "full").where(F.expr("NOT (_0 <=> _1)"))
    return both.select(*keys, F.when(F.col("_1").isNull(), "insert").when(F.col("_0").isNull(), "delete").otherwise("update").alias("action"))


def applied(source: Store, target: Store, table: str, schema: str, keys: list[str], parts: int, name: str) -> list[int]:
    """Bring the target's differing partitions to the source's rows, one commit; the partitions that were written."""
    t = [tree(s.read(f"{table}_digests", DIGESTS, "all").drop("all"), parts) for s in (source, target)]
    open_ = differing(*t)
    if open_:
        rows = source.read(table, schema, "part", open_)
        told = source.read(f"{table}_digests", DIGESTS, "all")
        target.commit({table: Change(rows, "part", touched=[str(k) for k in open_]), f"{table}_digests": Change(told, "all")}, name)
    return open_
