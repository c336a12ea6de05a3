"""Catalog upkeep and entity pages: brand derivation, promotion writes, substring search, evidence bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions import text as T
from trendloom.operators import series as O
from trendloom.operators import topics as P


def relationship_confidence(n: Column) -> Column:
    """Bands below the display gate of 0.7, so that machine evidence never publishes itself."""
    return S.bands(n, [(11, 0.35), (6, 0.30), (3, 0.25)], 0.20)


def experiment_verdict(runs: Column, mentions: Column, candidates: Column, confirm=(3, 2), suppress=(3, 0, 0)) -> Column:
    """confirm at (mentions, runs), suppress from runs with at most (mentions, candidates), else review."""
    good = (mentions >= confirm[0]) & (runs >= confirm[1])
    bad = (runs >= suppress[0]) & (mentions <= suppress[1]) & (candidates <= suppress[2])
    return F.when(good, "confirm").when(bad, "suppress").otherwise("review")


# Noise patterns of query candidates.
QUERY_NOISE = (r"^\d+\s+(best|top|cheap|affordable)", r"how (to|do)\b", r"\b(for (men|women|him|her))\s*$", r"^\s*(the\s+)?(best|top)\s+\w+\s+fragrance")


def query_risk(phrase: Column, channels: Column, score: Column, weak=(), niche=(), low_yield=()) -> Column:
    """low, medium or high risk of trying a phrase as a search query; word lists are the caller's."""
    words = F.split(phrase, " ")
    has = lambda xs, test: F.exists(F.array(*[F.lit(x) for x in xs]), test) if xs else F.lit(False)
    noisy = phrase.rlike("(?i)" + "|".join(f"(?:{p})" for p in QUERY_NOISE))
    return (
        F.when(noisy | has(weak, lambda w: F.array_contains(words, w)), "high").when(has(niche, lambda s: F.contains(phrase, s)), "low")
        .when(has(low_yield, lambda p: F.startswith(phrase, p)), "medium").when((channels >= 3) & (score >= 4.0), "low")
        .when((channels >= 2) & (score >= 2.0), "medium").otherwise("high")
    )


def query_action(risk: Column, channels: Column) -> Column:
    return F.when((risk == "low") | ((risk == "medium") & (channels >= 3)), "add_to_experiments").when(risk == "medium", "review_first").otherwise("skip")


def derive_brand(entities: DataFrame, catalog: DataFrame, known_brands: DataFrame) -> DataFrame:
    """entities(name) with brand and via: the catalog(slug, brand) first, else the name without its last word, unless that is a fragment.

    known_brands(brand) guards the heuristic: a derived name that ends in a connector, or that is no
    known brand, is dropped.
    """
    one = catalog.groupBy("slug").agg(F.min("brand").alias("_c"))
    j = entities.withColumn("slug", T.slug_canonical(F.col("name"))).join(one, "slug", "left")
    guess = F.regexp_replace("name", r"\s\S+$", "")
    j = j.withColumn("_g", F.when((guess != F.col("name")) & ~guess.rlike(r"(&|\||&amp;)$"), guess))
    j = j.join(known_brands.select(F.lower("brand").alias("_l"), F.col("brand").alias("_k")).distinct(), F.lower("_g") == F.col("_l"), "left")
    via = F.when(F.col("_c").isNotNull(), "catalog").when(F.col("_k").isNotNull(), "heuristic").otherwise("none")
    return j.select("name", F.coalesce("_c", "_k").alias("brand"), via.alias("via"))


def ghost_brands(market: DataFrame, resolver: DataFrame, profiles: DataFrame) -> DataFrame:
    """market(brand) that neither the resolver nor the profiles know, by lower-case name."""
    low = lambda d: d.select(F.lower("brand").alias("_l")).distinct()
    m = market.withColumn("_l", F.lower("brand"))
    return m.join(low(resolver), "_l", "left_anti").join(low(profiles), "_l", "left_anti").drop("_l")


def promotion_writes(decisions: DataFrame) -> dict[str, DataFrame]:
    """Rows to append for decisions(text, decision, target): aliases, perfumes, outcomes."""
    return {
        "aliases": decisions.where("decision = 'merge'").select(F.col("text").alias("alias"), "target"),
        "perfumes": decisions.where("decision = 'create'").select(F.initcap("text").alias("name"), F.col("target").alias("brand"), T.slug_canonical(F.col("text")).alias("slug")),
        "outcomes": decisions.select("text", "decision", "target"),
    }


def seed_candidates(texts: DataFrame, source: str = "discovery") -> DataFrame:
    """texts(text) as seed rows: first word the brand, Unknown where there is one word alone."""
    w = F.split("text", " ", 2)
    two = F.size(w) == 2
    return texts.select(F.when(two, F.initcap(F.get(w, F.lit(0)))).otherwise("Unknown").alias("brand_name"), F.initcap(F.when(two, F.get(w, F.lit(1))).otherwise(F.col("text"))).alias("perfume_name"), F.lit(source).alias("source"))


def _grams(c: Column, q: int | Column) -> Column:
    """The distinct substrings of q characters."""
    q = F.lit(q) if isinstance(q, int) else q
    last = F.length(c) - q + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substr(c, k, q))))


def _contained(inner: DataFrame, outer: DataFrame, q: int) -> DataFrame:
    """(i, o) of inner(i) and outer(o), distinct strings, where o contains i and i has q characters or more.

    i is looked up by the one of its q-grams that is rarest in o: an equi-join, then the test itself.
    """
    held = outer.select("o", F.explode(_grams(F.col("o"), q)).alias("_g"))
    often = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    key = inner.select("i", F.explode(_grams(F.col("i"), q)).alias("_g")).join(often, "_g").groupBy("i").agg(F.min_by("_g", F.struct("_f", "_g")).alias("_g"))
    return key.join(held, "_g").where(F.contains("o", "i")).select("i", "o")


def substring_matches(texts: DataFrame, names: DataFrame, least: int = 5) -> DataFrame:
    """(text, match): the longest name that contains the text or that it contains, other than itself.

    A condition of this kind has no equi-join of its own. Both directions are searched by exploded
    character q-grams at all sizes; texts shorter than q by the names' shorter grams, and the empty text, which every name contains, by the longest name of all.
    """
    q = max(1, min(least, 5))
    n = names.where(F.length("name") >= least).select("name", F.lower("name").alias("b")).distinct()
    t = texts.where(F.col("text").isNotNull()).select("text", F.lower("text").alias("a")).distinct()
    a, b = t.select("a").distinct(), n.select("b").distinct()
    around = _contained(a.select(F.col("a").alias("i")), b.select(F.col("b").alias("o")), q).select(F.col("i").alias("a"), F.col("o").alias("b"))
    inside = _contained(b.select(F.col("b").alias("i")), a.select(F.col("a").alias("o")), q).select(F.col("o").alias("a"), F.col("i").alias("b"))
    pairs = around.unionByName(inside).where("a <> b").distinct()
    best = F.max(F.struct(F.length("name").alias("l"), F.col("name").alias("name"))).alias("_m")
    found = t.join(pairs, "a").join(n, "b").groupBy("text").agg(best)
    lengths = F.sequence(F.lit(1), F.lit(max(q - 1, 1)))
    short = n.select("name", F.explode(F.array_distinct(F.flatten(F.filter(F.transform(lengths, lambda k: _grams(F.col("b"), k)), lambda g: g.isNotNull())))).alias("a")).groupBy("a").agg(best)
    brief = t.where(F.length("a").between(1, q - 1)).join(short, "a").select("text", "_m")
    empty = t.where("a = ''").crossJoin(F.broadcast(n.agg(best))).where("_m IS NOT NULL").select("text", "_m")
    return found.unionByName(brief).unionByName(empty).groupBy("text").agg(F.max("_m").alias("_m")).select("text", F.col("_m.name").alias("match"))


def composition(mentions: DataFrame, demo: Column) -> DataFrame:
    """Demo and real rows by platform with the demo share."""
    return mentions.groupBy("platform").agg(F.count_if(demo).alias("demo"), F.count_if(~demo).alias("real")).withColumn("share", F.round(F.col("demo") / (F.col("demo") + F.col("real")), 4))


def experiment_evidence(runs: DataFrame, mentions: DataFrame, most: int = 3) -> DataFrame:
    """runs(query, run), mentions(query, entity_id): run and mention counts and the most mentioned entities of each query."""
    r = runs.groupBy("query").agg(F.countDistinct("run").alias("runs"))
    per = mentions.groupBy("query", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query").orderBy(F.desc("n"), "entity_id")
    top = per.withColumn("_r", F.row_number().over(w)).groupBy("query").agg(
        F.sum("n").alias("mentions"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "entity_id")))).alias("_t")
    )
    j = r.join(top, "query", "left")
    return j.select("query", "runs", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.transform("_t", lambda x: x["entity_id"]).alias("top_entities"))


def signal_records(content: DataFrame, *parts: DataFrame, key: str = "id") -> DataFrame:
    """Content with the results of extractors, resolver and scorers, one record for each item."""
    for p in parts:
        content = content.join(p, key, "left")
    return content


def daily_job(content: DataFrame, resolved: DataFrame, brands: DataFrame) -> dict[str, DataFrame]:
    """The daily job as one plan: series, brand roll-up of real rows, zero rows, weighted scores, signals."""
    hits = O.entity_hits(content, resolved)
    series = O.with_trend(O.daily_counts(hits))
    return {
        "series": series, "brands": O.with_trend_of_brands(series, brands), "quiet": O.carry_forward(series),
        "weighted": O.weighted_scores(series, hits), "signals": O.signals(series),
    }


def entity_page(entity: str, series: DataFrame, brands: DataFrame, bridge: DataFrame, hits: DataFrame) -> dict[str, DataFrame]:
    """What an entity's page shows, each a filtered top-k."""
    own = F.col("entity_id") == entity
    return {
        "snapshot": O.latest(series.where(own)).join(brands, "entity_id", "left"),
        "history": series.where(own).orderBy(F.desc("day")).limit(30),
        "mentions": hits.where(own).orderBy(F.desc("ts"), "content_item_id").limit(20),
        "drivers": hits.where(own).withColumn("_e", S.engagement_total(F.col("platform"), F.col("views"), F.col("likes"), F.col("comments"))).orderBy(F.desc("_e"), "content_item_id").drop("_e").limit(5),
        "similar": P.similar_by_shared(bridge, F.lit(entity)),
        "sources": hits.where(own).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views")),
    }
