"""Topics, semantic profiles, notes and vocabulary extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions import text as T
from trendloom.functions import vocabulary as V

# Pattern and label of topic rules.
TOPIC_RULES = (
    (r"\bcompliment(s| getter)?\b", "compliment getter"),
    (r"\boffice\b|\bwork(place)?\b|\bprofessional\b", "office scent"),
    (r"\bdate night\b|\bromantic\b", "date night"),
    (r"\bsignature scent\b|\beveryday\b|\bdaily driver\b", "signature scent"),
    (r"\bwear(able)?\b.*\bgym\b|\bgym\b.*\bwear\b", "gym / sport"),
    (r"\bbeach\b|\bpooside\b|\bvacation\b|\btropic\b", "beach / vacation"),
    (r"\bblind buy\b", "blind buy"),
    (r"\bgift\b|\bpresent\b", "gift idea"),
    (r"\bsample\b|\bdecant\b", "sample / decant"),
    (r"\breview\b|\bfirst impression\b|\bhonest\b", "review"),
    (r"\btop\s*\d+\b|\bbest of\b|\branking\b|\bbest\s+\w+\s+fragrance\b", "ranking / best of"),
    (r"\bcompar\w+\b|\bvs\.?\b|\bversus\b", "comparison"),
    (r"\bdupe\b|\bclone\b|\balternative\b|\blooks like\b|\bsmells like\b", "dupe / alternative"),
    (r"\btrend(ing)?\b|\bviral\b|\bhype\b", "trending / viral"),
    (r"\bnew\s+(release|launch|arrival)\b|\bjust (launched|released|dropped)\b", "new release"),
    (r"\bflanker\b", "flanker"),
    (r"\breformulat\w+\b|\bvintage\b|\bold formula\b", "reformulation"),
    (r"\bvanilla\b", "vanilla"),
    (r"\boud\b", "oud"),
    (r"\bfresh\b|\bcitrus\b|\baquatic\b", "fresh / citrus"),
    (r"\bfloral\b|\bflower\b|\brose\b|\bjasmine\b", "floral"),
    (r"\bwoody\b|\bwood\b|\bsandalwood\b|\bcedar(wood)?\b", "woody"),
    (r"\bmusky\b|\bmusk\b", "musk"),
    (r"\bsweet\b|\bcand(y|ied)\b|\bgourmand\b", "sweet / gourmand"),
    (r"\bspic(y|ed)\b|\bpepper\b|\bcardamom\b", "spicy"),
    (r"\bsmok(y|e)\b|\bleather\b", "smoky / leather"),
    (r"\bgreen\b|\bearthy\b|\bvetiver\b|\bpatchouli\b", "green / earthy"),
    (r"\bniche\b", "niche fragrance"),
    (r"\bdesigner\b", "designer fragrance"),
    (r"\baffordable\b|\bbudget\b|\bcheap\b|\bvalue\b", "affordable"),
    (r"\bluxury\b|\bpremium\b|\bprestige\b", "luxury"),
    (r"\bmen'?s?\b|\bmasculin\w*\b|\bfor (him|men)\b", "men's fragrance"),
    (r"\bwomen'?s?\b|\bfeminin\w*\b|\bfor (her|women)\b", "women's fragrance"),
    (r"\bunisex\b|\bgender.?neutral\b", "unisex"),
    (r"\blong.?last(ing)?\b|\blongevity\b|\bprojection\b|\bsillage\b", "longevity / projection"),
    (r"\bsummer\b", "summer"),
    (r"\bwinter\b|\bcold weather\b|\bcozy\b", "winter"),
    (r"\bfall\b|\bautumn\b", "fall / autumn"),
    (r"\bspring\b", "spring"),
    (r"\barab\w*\b|\barabian\b|\bmiddle east\b|\borient\w*\b", "arab / oriental"),
    (r"\bfrench\b|\bparisian\b|\bparis\b", "french fragrance"),
    (r"\bitalian\b|\bitaliano\b", "italian fragrance"),
)
# Topic classes.
STOPLIST = ("review", "comparison", "trending / viral", "ranking / best of")
DIFFERENTIATORS = ("dupe / alternative", "compliment getter", "longevity / projection", "reformulation", "affordable", "blind buy")
INTENTS = ("review", "ranking / best of", "comparison", "gift idea", "trending / viral", "new release", "flanker", "sample / decant", "blind buy")
POSITIONING = (
    "niche fragrance", "designer fragrance", "luxury", "vanilla", "oud", "fresh / citrus", "floral", "woody", "musk", "sweet / gourmand",
    "spicy", "smoky / leather", "green / earthy", "men's fragrance", "women's fragrance", "unisex", "summer", "winter", "fall / autumn",
    "spring", "arab / oriental", "french fragrance", "italian fragrance", "office scent", "date night", "signature scent", "gym / sport", "beach / vacation",
)
ORIGINAL_ROLES = ("designer_original", "niche_original", "original")


def tag_topics(text: Column, query: Column | None = None, subreddit: Column | None = None, rules=TOPIC_RULES, ascii_words: bool = False) -> Column:
    """array<struct<topic_type, topic_text>> of the query, the community and every rule that matches, each once.

    ascii_words says that words and digits are those of ASCII, as in SQL; letters of all scripts match in
    either case all the same, but the Turkish i with a dot above, or without one, stands for no i.
    """
    def one(kind, value):
        clean = F.lower(F.trim(value))
        return F.when(F.length(clean) >= 2, F.struct(F.lit(kind).alias("topic_type"), clean.alias("topic_text")))

    found = [one(k, v) for k, v in (("query", query), ("subreddit", subreddit)) if v is not None]
    if ascii_words:
        text = F.when(text.contains("İ") | text.contains("ı"), F.translate(text, "İı", "¿¿")).otherwise(text)
        rules = [(f"(?iu){T.ascii_bounds(pattern)}", label) for pattern, label in rules]
    else:
        rules = [(f"(?iU){pattern}", label) for pattern, label in rules]
    found += [F.when(text.rlike(pattern), F.struct(F.lit("topic").alias("topic_type"), F.lit(label).alias("topic_text"))) for pattern, label in rules]
    return F.array_distinct(F.array_compact(F.array(*found)))


def topic_links(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """items(item, topics) x mentions(item, entity_id): one row for each entity, item and topic."""
    each = items.select("item", F.explode("topics").alias("t")).select("item", "t.*")
    return each.join(mentions.select("item", "entity_id").distinct(), "item").dropDuplicates(["entity_id", "item", "topic_type", "topic_text"])


def topic_counts(links: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """(entity_id, topic_type, topic_text, n, avg_quality); quality(item, score) counts as zero where missing."""
    rows = links if quality is None else links.join(quality, "item", "left")
    score = F.lit(0.0) if quality is None else F.coalesce("score", F.lit(0.0))
    return rows.groupBy("entity_id", "topic_type", "topic_text").agg(F.count(F.lit(1)).alias("n"), F.avg(score.cast("decimal(18,6)")).cast("double").alias("avg_quality"))


def semantic_profile(counts: DataFrame, role: Column | None = None, most: int = 5) -> DataFrame:
    """(entity_id, kind, labels): the best topics of each class by n * (1 + quality), at most `most` each.

    Queries and intent labels are intents; alternatives of an original become the intent 'alternative demand'.
    """
    original = F.lit(False) if role is None else role.isin(*ORIGINAL_ROLES)
    rerouted = (F.col("topic_text") == "dupe / alternative") & original
    label = F.when(rerouted, "alternative demand").otherwise(F.col("topic_text"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("topic_text").isin(*DIFFERENTIATORS) & ~rerouted & (F.col("topic_type") == "topic"), "differentiators"),
            F.when(F.col("topic_text").isin(*POSITIONING) & (F.col("topic_type") == "topic"), "positioning"),
            F.when((F.col("topic_type") == "query") | F.col("topic_text").isin(*INTENTS) | rerouted, "intents"),
        )
    )
    rows = counts.withColumn("label", label).withColumn("_s", F.col("n") * (1 + F.col("avg_quality"))).withColumn("kind", F.explode(kinds))
    w = Window.partitionBy("entity_id", "kind").orderBy(F.desc("_s"), "label")
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return top.groupBy("entity_id", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]).alias("labels"))


def opportunity_flags(differentiators: Column, intents: Column, role: Column) -> Column:
    """Names of the opportunities that a profile shows."""
    has = lambda xs, x: F.array_contains(xs, x)
    flag = lambda cond, name: F.when(cond, F.lit(name))
    dupe = has(differentiators, "dupe / alternative")
    clone, original = role.isin("clone", "inspired", "clone_positioned", "inspired_alternative"), role.isin(*ORIGINAL_ROLES)
    known = F.size(F.filter(intents, lambda i: i.isin(*INTENTS)))
    other = F.size(intents) - known
    return F.array_distinct(
        F.array_compact(
            F.array(
                flag(dupe & clone, "clone_market"), flag((dupe & original) | has(intents, "alternative demand"), "alternative_demand"),
                flag(dupe & ~clone & ~original, "alternative_search_interest"), flag(has(differentiators, "affordable"), "affordable_alt"),
                flag((known >= 2) | ((known >= 1) & (other >= 2)), "high_intent"), flag(has(intents, "comparison"), "competitive_comparison"),
                flag(has(intents, "gift idea"), "gifting"), flag(has(intents, "trending / viral"), "viral_momentum"),
                flag(has(intents, "new release") | has(intents, "flanker"), "launch_window"), flag(has(differentiators, "compliment getter"), "social_validation"),
                flag(has(differentiators, "longevity / projection"), "performance_leader"),
            )
        )
    )


def entity_role(entities: DataFrame, dupes: DataFrame, tiers: DataFrame) -> DataFrame:
    """entities(entity_id, name_key, brand_key) with role: a listed dupe profile(name_key, role) first, then the brand tier(brand_key, tier)."""
    j = entities.join(dupes.withColumnRenamed("role", "_role"), "name_key", "left").join(tiers, "brand_key", "left")
    by_tier = F.when(F.col("tier") == "designer", "designer_original").when(F.col("tier") == "niche", "niche_original").when(F.col("tier") == "clone_house", "clone_positioned")
    return j.withColumn("role", F.coalesce("_role", by_tier, F.lit("unknown"))).drop("_role", "tier")


def narrative(name: Column, state: Column, differentiators: Column, positioning: Column) -> Column:
    """One templated sentence about an entity."""
    lead = F.concat(name, F.lit(" is "), F.coalesce(state, F.lit("quiet")))
    known = F.when(F.size(positioning) > 0, F.concat(F.lit(", known as "), F.array_join(F.slice(positioning, 1, 2), " and "))).otherwise("")
    driven = F.when(F.size(differentiators) > 0, F.concat(F.lit(", driven by "), F.array_join(F.slice(differentiators, 1, 2), " and "))).otherwise("")
    return F.concat(lead, known, driven, F.lit("."))


def competitors(queries: Column, name: Column) -> Column:
    """Competitors in comparison queries: what follows or precedes 'vs', else whole queries that do not name the entity."""
    def one(q):
        t = F.trim(q)
        after, before = F.trim(F.regexp_extract(t, r"(?i)\bvs\.?\s+(.+)", 1)), F.trim(F.regexp_extract(t, r"(?i)^(.+?)\s+vs\.?\b", 1))
        fits = lambda x: F.when((F.lower(x) != F.lower(name)) & (F.length(x) > 3), x)
        return F.when(after != "", fits(after)).when(before != "", fits(before)).when(~F.contains(F.lower(t), F.lower(name)) & (F.length(t) > 5), t)

    return F.array_distinct(F.array_compact(F.transform(queries, one)))


def vocabulary_hits(text: Column, vocabulary) -> Column:
    """Terms of a small vocabulary that the text contains, in the vocabulary's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in vocabulary]))


def note_mentions(text: Column, official: Column, vocabulary=V.NOTE_TERMS) -> Column:
    """array<struct<note, confidence>> of the vocabulary terms in a text; 0.9 for those among the official notes, else 0.7."""
    return F.transform(vocabulary_hits(text, vocabulary), lambda n: F.struct(n.alias("note"), F.when(F.array_contains(official, n), 0.9).otherwise(0.7).alias("confidence")))


def canonical_notes(notes: DataFrame, merged: dict[str, str], families: dict[str, str]) -> DataFrame:
    """notes(note) with canonical and family, by merge groups and a family map of the caller."""
    key = F.trim(F.lower("note"))
    canonical = F.coalesce(S.lookup(merged, key) if merged else F.lit(None).cast("string"), key)
    return notes.withColumn("canonical", canonical).withColumn("family", F.coalesce(S.lookup(families, canonical) if families else F.lit(None).cast("string"), F.lit("other")))


def note_stats(bridge: DataFrame) -> DataFrame:
    """bridge(perfume, brand, note, position): distinct perfumes and brands, and rows by position."""
    return bridge.groupBy("note").agg(
        F.countDistinct("perfume").alias("perfumes"), F.countDistinct("brand").alias("brands"), F.count_if(F.col("position") == "top").alias("top"),
        F.count_if(F.col("position") == "middle").alias("middle"), F.count_if(F.col("position") == "base").alias("base"),
    )


def note_brand_share(bridge: DataFrame) -> DataFrame:
    """(note, brand, perfumes, share): distinct perfumes with the note over all perfumes of the brand."""
    total = bridge.groupBy("brand").agg(F.countDistinct("perfume").alias("_all"))
    each = bridge.groupBy("note", "brand").agg(F.countDistinct("perfume").alias("perfumes"))
    return each.join(total, "brand").select("note", "brand", "perfumes", F.round(F.col("perfumes") / F.col("_all"), 4).alias("share"))


def similar_by_shared(bridge: DataFrame, target: Column, most: int = 10) -> DataFrame:
    """Perfumes that share most notes with the target; a note in two positions counts twice."""
    own = bridge.where(F.col("perfume") == target).select("note")
    return bridge.where(F.col("perfume") != target).join(own, "note").groupBy("perfume").agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), "perfume").limit(most)


def co_occurring(left: DataFrame, right: DataFrame, most: int = 15) -> DataFrame:
    """(a, b, n): pairs of left(perfume, a) and right(perfume, b) in one perfume, the `most` frequent b of each a."""
    pairs = left.join(right, "perfume").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def note_momentum(hits: DataFrame, top: DataFrame, official: DataFrame) -> DataFrame:
    """hits(note, perfume, engagement): count, mean engagement, official flag, drivers and score of each note."""
    d = hits.join(top.select("perfume", F.lit(True).alias("_top")), "perfume", "left").join(official.select("note", "perfume", F.lit(True).alias("_off")), ["note", "perfume"], "left")
    g = d.groupBy("note").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("engagement").cast("decimal(18,8)")).cast("double"), 6).alias("avg_engagement"),
        F.coalesce(F.bool_or("_off"), F.lit(False)).alias("official"), F.coalesce(F.bool_or("_top"), F.lit(False)).alias("_t"), F.countDistinct("perfume").alias("perfumes"),
    )
    drivers = F.array_compact(F.array(F.when(F.col("avg_engagement") > 0.001, F.lit("engagement")), F.when(F.col("_t"), F.lit("top_perfume")), F.when(F.col("n") >= 3, F.lit("frequency"))))
    score = S.rounded(0.6 * F.col("n") + 0.3 * F.col("avg_engagement") + 0.1 * F.col("official").cast("double"), 4)
    return g.withColumn("drivers", drivers).withColumn("score", score).drop("_t")


def period_change(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Key union of two periods with delta and direction (dead band 0.05)."""
    j = now.select(key, F.col(value).alias("_n")).join(before.select(key, F.col(value).alias("_b")), key, "full")
    delta = F.round(F.coalesce("_n", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)), 4)
    return j.select(key, delta.alias("delta"), S.direction(delta).alias("direction"))


def top_by_type(rows: DataFrame, most: int = 8, key: str = "entity_id") -> DataFrame:
    """(key, topic_type, topics): the first `most` topics of each type in one pass over rows(key, topic_type, topic_text, occurrences, avg_score).

    More occurrences come first, then the higher mean score, then the smaller text. Ranks are limited before the shuffle, so a
    partition hands on `most` rows of a group at most, however large the group.
    """
    w = Window.partitionBy(key, "topic_type").orderBy(F.desc("occurrences"), F.desc("avg_score"), "topic_text")
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return top.groupBy(key, "topic_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "topic_text"))), lambda x: x["topic_text"]).alias("topics"))
