"""Landed files to DataFrames: declared schemas, validation, HTML pages, due and new work."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "fragrance_id string, brand_name string, perfume_name string, release_year int, gender string, source string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; unreadable lines go to _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Seed CSV; a malformed row or a missing required value fails the read."""
    rows = spark.read.schema(SEED).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    bad = F.col("fragrance_id").isNull() | (F.trim("brand_name") == "") | F.col("brand_name").isNull() | F.col("perfume_name").isNull()
    return rows.withColumn("fragrance_id", F.when(bad, F.raise_error(F.lit("seed row without id, brand or name"))).otherwise(F.col("fragrance_id")))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON by suffix, all columns as strings, for files with unknown headers."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.option("primitivesAsString", True).option("multiLine", path.endswith(".json")).json(path)


def content(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Full scan of content items with the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def newest_first(df: DataFrame, time: str = "published_at", key: str = "id", limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc_nulls_last(time), key)
    return out if limit is None else out.limit(limit)


def without_results(items: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Items that have no derived row yet."""
    return items.join(results.select(key).distinct(), key, "left_anti")


def with_details(found: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Search results with their details where there are any."""
    return found.join(details, key, "left")


def since(posts: DataFrame, cutoff: Column, time: str = "published_at") -> DataFrame:
    return posts.where(F.col(time) >= cutoff)


def import_catalog(rows: DataFrame, known: DataFrame, key: str = "fragrance_id") -> DataFrame:
    """New catalog rows, one of each key."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def match_notes(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows(brand, name, notes string) x catalog(id, brand, name): by brand and name, else by full name; one row for each note."""
    low = lambda *c: F.lower(F.concat_ws("||", *[F.trim(x) for x in c]))
    by_pair = catalog.groupBy(low("brand", "name").alias("_k1")).agg(F.min("id").alias("_a"))
    by_name = catalog.groupBy(F.lower(F.trim(F.concat_ws(" ", "brand", "name"))).alias("_k2")).agg(F.min("id").alias("_b"))
    j = rows.withColumn("_k1", low("brand", "name")).withColumn("_k2", F.lower(F.trim("name"))).join(by_pair, "_k1", "left").join(by_name, "_k2", "left")
    notes = F.filter(F.transform(F.split("notes", "[,;]"), lambda x: F.lower(F.trim(x))), lambda x: (x != "") & ~x.isin("n/a", "none", "unknown", "notes"))
    return j.withColumn("id", F.coalesce("_a", "_b")).where("id IS NOT NULL").select("id", F.explode(F.array_distinct(notes)).alias("note"))


class _Page(HTMLParser):
    """Collects title, h1, itemprop values, links and visible text of a page."""

    VOID = {"script", "style", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = self.heading = ""
        self.props: dict[str, str] = {}
        self.links: list[str] = []
        self.text: list[str] = []
        self._open: list[tuple[str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        prop = a.get("itemprop")
        if prop and a.get("content"):
            self.props.setdefault(prop, a["content"])
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self._open.append((tag, prop))

    def handle_endtag(self, tag):
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                return

    def handle_data(self, data):
        tags = [t for t, _ in self._open]
        if not data.strip() or any(t in self.VOID for t in tags):
            return
        if "title" in tags:
            self.title += data
        elif "h1" in tags:
            self.heading += data
        for _, prop in self._open:
            if prop:
                self.props[prop] = (self.props.get(prop, "") + data).strip()
        if "title" not in tags:
            self.text.append(data.strip())


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, heading, props map, links and text in place of the markup; null markup gives empty values."""
    others = [c for c in pages.columns if c != html]
    fields = "title string, heading string, props map<string,string>, links array<string>, text string"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*others).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for markup in frame[html]:
                page = _Page()
                page.feed(markup or "")
                page.close()
                rows.append((page.title.strip(), page.heading.strip(), page.props, page.links, " ".join(page.text)))
            got = pd.DataFrame(rows, columns=["title", "heading", "props", "links", "text"], index=frame.index)
            yield pd.concat([frame[others], got], axis=1)

    return pages.mapInPandas(run, f"{kept}, {fields}")


def enrichment_record(parsed: DataFrame) -> DataFrame:
    """Name, brand, rating and year of parsed product pages."""
    p = lambda k: F.element_at("props", k)
    return parsed.withColumns({
        "perfume_name": F.coalesce(F.nullif(p("name"), F.lit("")), F.nullif("heading", F.lit(""))), "brand_name": p("brand"), "rating_value": p("ratingValue").try_cast("double"),
        "rating_count": p("ratingCount").try_cast("int"), "release_year": F.nullif(F.regexp_extract(F.concat_ws(" ", "heading", "text"), r"\b(19\d\d|20\d\d)\b", 1), F.lit("")).try_cast("int"),
    })


def script_json(pages: DataFrame, marker: str, schema: str, html: str = "html") -> DataFrame:
    """The JSON of the script element with an id, parsed under a schema; null where there is none."""
    return pages.withColumn("data", F.from_json(F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{marker}"[^>]*>(.*?)</script>', 1), F.lit("")), schema))


def checked_records(lines: DataFrame, schema: str, required: list[str], kinds: dict[str, list[str]], most_retries: int = 3) -> DataFrame:
    """lines(line, retries) of landed JSON -> (record, kind, reason, retries, again): every line once, whatever is wrong with it.

    schema is a record's DDL with a `kind` field; the line is parsed once, and what does not parse keeps its text in _corrupt. The
    first reason that holds: corrupt, missing:<field> (required of all, the kind itself, and kinds' own of that kind), unknown_kind. A line without a
    reason is accepted and routed by its kind; a rejected one goes back (again) until it was retried most_retries times.
    """
    r = F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    p = lines.select("line", F.coalesce("retries", F.lit(0)).alias("retries"), r.alias("record"))
    lacks = lambda f: F.col(f"record.{f}").isNull() | (F.trim(F.col(f"record.{f}").cast("string")) == "")
    reason = F.when(F.col("record").isNull() | F.col("record._corrupt").isNotNull() | F.col("line").isNull(), "corrupt")
    for f in [*required, "kind"]:
        reason = reason.when(lacks(f), f"missing:{f}")
    reason = reason.when(~F.col("record.kind").isin(*kinds), "unknown_kind")
    for kind, fields in kinds.items():
        for f in fields:
            reason = reason.when((F.col("record.kind") == kind) & lacks(f), f"missing:{f}")
    p = p.withColumn("reason", reason)
    return p.select("line", "record", F.when(F.col("reason").isNull(), F.col("record.kind")).alias("kind"), "reason", "retries", (F.col("reason").isNotNull() & (F.col("retries") < most_retries)).alias("again"))
