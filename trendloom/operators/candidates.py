"""Emerging phrases and candidate review: aggregation, filters, classification, promotion."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions import text as T
from trendloom.functions import vocabulary as V

# Markers and suffixes of emerging types.
CLONE_MARKERS = ("dupe", "clone", "inspired by", "smells like", "alternative", "alternative to", "better than")
FLANKER_SUFFIXES = ("intense", "noir", "extreme", "sport", "bleu", "rose", "berry", "wood", "woods", "absolute", "elixir", "parfum", "gold")
COMMUNITY_PAIRS = ("dry down", "skin chemistry", "top note", "base note", "heart note", "blind buy", "sample decant", "fragrance i", "fragrances i", "fragrances that", "fragrances and", "scent or")
CONCENTRATION_WORDS = ("eau", "parfum", "toilette", "cologne", "extrait", "edp", "edt", "edc")
PRONOUNS = ("i", "we", "you", "they", "he", "she", "it")


def emerging_type(phrase: Column) -> Column:
    words = F.split(phrase, " ")
    marked = F.exists(F.array(*[F.lit(m) for m in CLONE_MARKERS]), lambda m: F.contains(phrase, m))
    return F.when(marked, "clone_reference").when(F.size(words) == 1, "unknown").when(T.isin_list(F.element_at(words, -1), FLANKER_SUFFIXES), "flanker").otherwise("perfume")


def valid_phrase(phrase: Column, blocked=(), prefixes=(), stop_starts=V.STOPWORDS, least_tokens: int = 2) -> Column:
    """Whether a phrase may become a signal candidate."""
    words = F.split(phrase, " ")
    return (
        (F.size(words) >= least_tokens)
        & ~(T.isin_list(phrase, blocked) if blocked else F.lit(False))
        & (~F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(phrase, F.concat(p, F.lit(" ")))) if prefixes else F.lit(True))
        & ~T.isin_list(F.get(words, F.lit(0)), stop_starts)
        & ~F.forall(words, lambda w: w.rlike("^[0-9]+$"))
        & ~F.forall(words, lambda w: F.length(w) <= 1)
        & ~F.exists(words, lambda w: T.isin_list(w, V.CONTRACTION_SUFFIXES))
    )


def phrase_rows(texts: DataFrame, whole: Column, longest: int = 4) -> DataFrame:
    """One row with phrase and form for each distinct candidate of a text, beside the columns of texts; whole is the text as T.without_concentration() gives it.

    The candidates of T.candidate_phrases(), without their order, and T.proposed_form() of each. An n-gram without the generic
    words at its ends is an n-gram itself, so those with such a word there only repeat others; what is forbidden in a phrase is
    so in the whole text, so most texts are looked through once. The rows are then judged by plain columns, since
    functions of array elements are interpreted for each phrase; the whole text is judged before it becomes a row.
    """
    generic, leads = V.GENERIC_PERFUME_WORDS, (*V.STOPWORDS, *V.CONTEXT_LEADS)
    forbidden = T.any_ascii(V.PHRASE_BLACKLIST)
    t = texts.withColumn("_s", whole).withColumn("_g1", F.split("_s", " ")).withColumn("_hit", F.col("_s").rlike(forbidden))
    rest = F.when((F.size("_g1") > longest) & ~F.col("_hit"), T.trim_words(F.col("_g1"), generic, generic))
    t = t.withColumn("_rest", rest)
    t = t.withColumn("_whole", F.when(F.exists("_rest", lambda w: ~w.isin(*V.PHRASE_STOP)), F.array_join("_rest", " ")))
    t = t.withColumn("_form", T.proposed_form(F.col("_whole")))
    for n in range(1, longest):
        more = F.greatest(F.size("_g1") - n, F.lit(0))
        longer = F.zip_with(F.slice(f"_g{n}", 1, more), F.slice("_g1", n + 1, more), lambda a, b: F.concat(a, F.lit(" "), b))
        t = t.withColumn(f"_g{n + 1}", longer)
    grams = F.array_distinct(F.concat(*[F.col(f"_g{n}") for n in range(1, longest + 1)], F.array_compact(F.array("_whole"))))
    t = t.withColumn("_grams", grams)
    r = t.select(*texts.columns, "_hit", "_form", F.explode_outer("_grams").alias("phrase"))  # never empty; a filter on its size, as explode() has, would work it out twice
    r = r.select("*", F.explode(F.array(F.split("phrase", " "))).alias("_w"))  # as a row, lest the filter below splits for each of its terms

    n, word = F.size("_w"), [F.get("_w", F.lit(k)) for k in range(longest)]  # null beyond the phrase's end
    named = functools.reduce(operator.or_, [~w.isin(*V.PHRASE_STOP) for w in word])
    ends = ~T.isin_list(word[0], generic) & ~T.isin_list(F.element_at("_w", -1), generic)
    allowed = ~F.col("_hit") | ~F.col("phrase").rlike(forbidden)
    r = r.where((n > longest) | (ends & (F.length("phrase") >= 2) & named & ((n > 1) | ~F.col("phrase").rlike("^[0-9]+$")) & allowed))
    first, last = F, F
    for k in range(longest):
        first = first.when(~word[k].isin(*leads), k + 1)
        last = last.when(~word[longest - 1 - k].isin(*V.STOPWORDS), longest - k)
    r = r.withColumn("_a", F.when(n <= longest, first)).withColumn("_z", F.when(n <= longest, last))
    a, z = F.col("_a"), F.col("_z")
    cut = F.array_join(F.slice("_w", a, z - a + 1), " ")
    form = F.when(n > longest, F.col("_form")).when((a == 1) & (z == n), F.col("phrase")).when(F.length(cut) > 3, cut).otherwise(F.col("phrase"))
    return r.select(*texts.columns, "phrase", form.alias("form"))


def noise_reason(phrase: Column, stop_phrases=(), notes=(), community=V.GENERIC_PERFUME_WORDS) -> Column:
    """First of eleven noise rules that holds, or null."""
    words = T.words_of(phrase)
    ratio = T.stopword_ratio(words)
    content = T.content_tokens(words)
    telling = F.arrays_overlap(words, F.array(*[F.lit(w) for w in (*notes, *CONCENTRATION_WORDS)]))
    return (
        F.when(F.length(F.trim(phrase)) <= 1, "too_short").when(T.is_url_artifact(words), "url_artifact").when(T.looks_like_handle(phrase), "social_handle")
        .when(T.isin_list(phrase, stop_phrases) if stop_phrases else F.lit(False), "stop_phrase").when(T.is_contraction(words), "contraction_fragment")
        .when(F.size(content) == 0, "all_stopwords").when((F.size(words) == 2) & T.isin_list(phrase, COMMUNITY_PAIRS), "community_fragment")
        .when((ratio >= 0.75) & ~telling, F.concat(F.lit("high_stopword_ratio_"), F.format_number(ratio, 2)))
        .when(T.isin_list(F.get(words, F.lit(0)), PRONOUNS) & T.isin_list(F.element_at(words, -1), V.STOPWORDS), "sentence_fragment")
        .when(phrase.rlike(r"^\d[\d\s]*$"), "numeric_artifact")
        .when((F.size(content) == 1) & T.isin_list(F.get(content, F.lit(0)), community), "generic_fragrance_word")
    )


def classify(candidates: DataFrame, brand_tokens, notes, stop_phrases=()) -> DataFrame:
    """candidates(phrase) with reason, kind, status and keyword flags."""
    words = T.words_of(F.col("phrase"))
    has = lambda xs: F.arrays_overlap(words, F.array(*[F.lit(x) for x in xs])) if xs else F.lit(False)
    brand, perfume, note = has(brand_tokens), has((*CONCENTRATION_WORDS, *notes)), F.forall(words, lambda w: T.isin_list(w, notes)) if notes else F.lit(False)
    c = candidates.withColumn("reason", noise_reason(F.col("phrase"), stop_phrases, notes))
    n = F.size(words)
    kind = F.when(F.col("reason").isNotNull(), "noise").when(note, "note").when(brand & (n == 1), "brand").when(brand | perfume, "perfume").otherwise("unknown")
    status = F.when(F.col("reason").isNotNull(), "rejected_noise").when(brand & (n >= 2), "accepted_rule_based").otherwise("review")
    return c.withColumns({"kind": kind, "status": status, "brand_keyword": brand, "perfume_keyword": perfume, "tokens": n})


def safeguard(phrase: Column, descriptors=("dupe", "dupes", "clone", "scent", "dna", "fragrance", "perfume"), common=()) -> Column:
    """Reason to refuse a promotion, or null."""
    words = F.split(phrase, " ")
    hit = F.filter(words, lambda w: T.isin_list(w, descriptors))
    return (
        F.when(F.length(phrase) <= 3, "too_short").when(phrase.rlike(r"[^\x00-\x7F]"), "non_ascii")
        .when(F.size(hit) > 0, F.concat(F.lit("descriptor_token:"), F.get(hit, F.lit(0))))
        .when((F.size(words) == 1) & (T.isin_list(phrase, common) if common else F.lit(False)), "single_common_word")
        .when((F.size(words) == 1) & (F.length(phrase) < 5), "single_token_too_short").when(F.get(words, F.lit(0)).rlike("^[0-9]+$"), "digit_start")
    )


def emerging(mentions: DataFrame, as_of: Column, days: int = 30, tiers: dict = S.TIER_WEIGHTS) -> DataFrame:
    """mentions(phrase, channel, tier, day): counts, once-per-channel tier weights, top channel, decayed score."""
    rows = mentions.where((F.col("day") <= as_of) & (F.col("day") > F.date_sub(as_of, days)))
    per = rows.groupBy("phrase", "channel").agg(F.count(F.lit(1)).alias("n"), F.max("tier").alias("tier"), F.min("day").alias("first"), F.max("day").alias("last"))
    weight = S.lookup(tiers, F.coalesce("tier", F.lit("unrated")), 0.5)
    per = per.withColumn("w", weight.cast("decimal(10,4)"))
    g = per.groupBy("phrase").agg(
        F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("channels"), F.sum("w").cast("double").alias("weighted"),
        F.max_by("channel", F.struct("w", "n", "channel")).alias("top_channel"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    )
    score = S.rounded(F.col("weighted") * S.recency_decay(F.datediff(as_of, F.col("last_seen"))), 4)
    return g.withColumn("days_active", F.greatest(F.datediff("last_seen", "first_seen") + 1, F.lit(1))).withColumn("score", score).withColumn("kind", emerging_type(F.col("phrase")))


def suppress_contained(ranked: DataFrame, longest: int = 6) -> DataFrame:
    """ranked(phrase, score) without phrases that a better-ranked phrase contains as whole words.

    Better: higher score, then longer, then the smaller text. 'Contained in' is
    transitive, so one anti-join on the n-grams of all phrases does what a greedy pass would.
    """
    key = F.struct(-F.col("score"), -F.length("phrase"), F.col("phrase"))
    r = ranked.withColumn("_k", key)
    grams = F.filter(F.array_distinct(F.transform(T.ngrams(F.split("phrase", " "), 1, longest), lambda g: g["phrase"])), lambda g: g != F.col("phrase"))
    inner = r.select(F.explode(grams).alias("phrase"), F.col("_k").alias("_o")).groupBy("phrase").agg(F.min("_o").alias("_o"))
    hidden = r.join(inner, "phrase").where(F.col("_o") < F.col("_k")).select("phrase")
    return ranked.join(hidden, "phrase", "left_anti")


def exact_matches(texts: DataFrame, aliases: DataFrame, master: DataFrame, brands: DataFrame) -> DataFrame:
    """(text, target, via): alias first, then master, then brand; each of (key, target)."""
    j = texts.select("text").distinct()
    for name, t in (("alias", aliases), ("master", master), ("brand", brands)):
        one = t.groupBy("key").agg(F.min("target").alias(f"_{name}"))
        j = j.join(one, F.col("text") == F.col("key"), "left").drop("key")
    via = F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_master").isNotNull(), "master").when(F.col("_brand").isNotNull(), "brand")
    return j.select("text", F.coalesce("_alias", "_master", "_brand").alias("target"), via.alias("via"))


def brand_prefix(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """(text, brand, rest): the brand that the first two words, or else the first word, name."""
    w = F.split("text", " ")
    b = brands.groupBy("key").agg(F.min("brand").alias("brand"))
    j = texts.select("text", F.array_join(F.slice(w, 1, 2), " ").alias("_two"), F.get(w, F.lit(0)).alias("_one"))
    j = j.join(b.select(F.col("key").alias("_two"), F.col("brand").alias("_b2")), "_two", "left").join(b.select(F.col("key").alias("_one"), F.col("brand").alias("_b1")), "_one", "left")
    rest = F.when(F.col("_b2").isNotNull(), F.array_join(F.slice(w, 3, F.greatest(F.size(w), F.lit(1))), " ")).when(F.col("_b1").isNotNull(), F.array_join(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), " "))
    return j.select("text", F.coalesce("_b2", "_b1").alias("brand"), rest.alias("rest"))


def precheck(texts: DataFrame, exact: DataFrame, merge: DataFrame, prefix: DataFrame) -> DataFrame:
    """(text, decision, target): reject, exact, merge, create or review, in that order."""
    j = texts.select("text").distinct().join(exact.where("target IS NOT NULL").select("text", F.col("target").alias("_e")), "text", "left")
    j = j.join(merge.groupBy("text").agg(F.min("match").alias("_m")), "text", "left").join(prefix.where("brand IS NOT NULL").groupBy("text").agg(F.min("brand").alias("_b")), "text", "left")
    bad = safeguard(F.col("text"))
    return j.select(
        "text",
        F.when(bad.isNotNull(), "reject").when(F.col("_e").isNotNull(), "exact").when(F.col("_m").isNotNull(), "merge").when(F.col("_b").isNotNull(), "create").otherwise("review").alias("decision"),
        F.when(bad.isNotNull(), bad).otherwise(F.coalesce(F.col("_e").cast("string"), F.col("_m").cast("string"), F.col("_b").cast("string"))).alias("target"),
    )


def merge_runs(prior: DataFrame, batch: DataFrame, key: str = "phrase") -> DataFrame:
    """Occurrences added, first seen least, last seen greatest, over both runs."""
    return prior.unionByName(batch).groupBy(key).agg(F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def overlay(rows: DataFrame, changes: DataFrame, key: str, columns) -> DataFrame:
    """rows with the latest of changes(key, seq, columns...) laid over; untouched rows stay."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("_c"))
    j = rows.join(last, key, "left")
    return j.select(*[F.coalesce(F.col(f"_c.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def two_tracks(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both tracks, the first one's row where both have a key."""
    both = first.withColumn("track", F.lit(1)).unionByName(second.withColumn("track", F.lit(2)))
    w = Window.partitionBy(key).orderBy("track")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
