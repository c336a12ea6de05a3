"""Writes: keyed upserts as rewritten tables, day partitions, quarantine, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by `order`."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """stored with the batch's rows in place of those with equal keys; the caller writes it to a new version."""
    fresh = keep_latest(batch, keys, order) if order else batch.dropDuplicates(keys)
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Overwrite the day partitions that df holds, and no other ones."""
    df.repartition(F.col(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append_new(df: DataFrame, stored: DataFrame, keys: list[str], path: str) -> None:
    df.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").write.mode("append").parquet(path)


def land_raw(df: DataFrame, path: str) -> None:
    """Raw payloads as JSON, by source and run."""
    df.write.mode("append").partitionBy("source", "run_id").json(path)


def quarantine(rows: DataFrame, known: DataFrame, key: str, path: str) -> None:
    rows.join(known.select(key).distinct(), key, "left_anti").write.mode("append").json(path)


def retained(log: DataFrame, now: Column, days: int = 90, time: str = "day") -> DataFrame:
    return log.where(F.col(time) >= F.date_sub(now, days))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat CSV: arrays and maps are joined to text."""
    def flat(field):
        kind = field.dataType.simpleString()
        c = F.col(f"`{field.name}`")
        if kind.startswith("array"):
            return F.array_join(c.cast("array<string>"), "; ").alias(field.name)
        if kind.startswith("map"):
            return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), "; ").alias(field.name)
        return (F.to_json(c).alias(field.name)) if kind.startswith("struct") else c

    df.select(*[flat(f) for f in df.schema]).write.mode("overwrite").option("header", True).csv(path)


def bridge_rows(records: DataFrame) -> DataFrame:
    """Enrichment records(id, notes_top, notes_middle, notes_base) to (id, note, position)."""
    positions = F.array(*[F.struct(F.lit(p).alias("position"), F.col(f"notes_{p}").alias("notes")) for p in ("top", "middle", "base")])
    e = records.select("id", F.explode(positions).alias("p")).select("id", "p.position", F.explode("p.notes").alias("note"))
    return e.select("id", F.lower(F.trim("note")).alias("note"), "position").dropDuplicates(["id", "note", "position"])


def enriched(base: DataFrame, extra: DataFrame, key: str, protected=()) -> DataFrame:
    """Additive merge: extra fills what base lacks; protected columns and non-empty values stay."""
    shared = [c for c in extra.columns if c != key and c in base.columns]
    j = base.join(extra.select(key, *[F.col(c).alias(f"_x_{c}") for c in extra.columns if c != key]), key, "left")

    def value(c):
        if c not in shared or c in protected:
            return F.col(c)
        kind = base.schema[c].dataType.simpleString()
        empty = F.size(c) <= 0 if kind.startswith("array") else (F.trim(c) == "" if kind == "string" else F.lit(False))
        return F.when(F.col(c).isNull() | empty, F.coalesce(F.col(f"_x_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)

    new = [F.col(f"_x_{c}").alias(c) for c in extra.columns if c != key and c not in shared]
    return j.select(*[value(c) for c in base.columns], *new)


def summary_sentence(kpis: DataFrame) -> DataFrame:
    """One-row metrics(tracked, breakouts, rising, day) to one sentence."""
    return kpis.select(F.format_string("%d entities on %s: %d breaking out, %d rising.", "tracked", F.col("day").cast("string"), "breakouts", "rising").alias("summary"))


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small table as Markdown; only the first `most` rows reach the driver, since a report is for reading, and it says how many more there are."""
    rows = df.limit(most + 1).collect()
    more = [f"\nand {df.count() - most} more"] if len(rows) > most else []
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]], *more]) + "\n"


def ranked(df: DataFrame, by: Column, key: str, most: int) -> DataFrame:
    """Top rows with their rank; the rank is taken after the top-k."""
    top = df.withColumn("_b", by).orderBy(F.desc("_b"), key).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_b"), key))).drop("_b")
