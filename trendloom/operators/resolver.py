"""Text to catalog entities: n-gram dictionary join, context guards, candidates, evidence.

texts(id, text); aliases(alias, entity_id, name, brand). Every join is an equi-join whose side
the planner chooses by size; windows carry a few tokens each, never the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions import text as T
from trendloom.functions import vocabulary as V

LONGEST = 6
NEAR = 10
#: Dictionary rows that are broadcast at most; larger dictionaries are joined by a shuffle over SALTS parts of each key.
MOST_BROADCAST, SALTS = 200_000, 8


def tokenized(texts: DataFrame) -> DataFrame:
    return texts.select("id", T.normalized_words(F.coalesce("text", F.lit(""))).alias("tokens"))


def alias_table(aliases: DataFrame) -> DataFrame:
    """One entity for each alias, the lowest id where several claim it, with its length and first token."""
    one = aliases.groupBy("alias").agg(F.min(F.struct(*[c for c in aliases.columns if c != "alias"])).alias("e")).select("alias", "e.*")
    return one.withColumn("n", F.size(F.split("alias", " "))).withColumn("head", F.substring_index("alias", " ", 1))


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a dictionary: broadcast if its counted rows allow, else in SALTS parts of each key, so that a frequent one is split."""
    if table.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), key)
    parts = table.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(parts, [key, "_salt"]).drop("_salt")


def _at_heads(tokens: DataFrame, heads: DataFrame, length: int) -> DataFrame:
    """(id, pos, w, _ns): the `length` tokens from every place that one of heads(head, _ns) holds.

    With a broadcast dictionary the token array is only looked into where a head stands; for a shuffle each place has to carry its own few tokens.
    """
    if heads.count() <= MOST_BROADCAST:
        at = tokens.select("id", "tokens", F.posexplode("tokens").alias("pos", "head")).join(F.broadcast(heads), "head")
        return at.select("id", "pos", F.slice("tokens", F.col("pos") + 1, F.lit(length)).alias("w"), "_ns")
    at = F.transform("tokens", lambda t, i: F.struct(t.alias("head"), i.alias("pos"), F.slice("tokens", i + 1, length).alias("w")))
    return looked_up(tokens.select("id", F.explode(at).alias("x")).select("id", "x.*"), heads, "head")


def matches(texts: DataFrame, aliases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(id, pos, n, alias, entity_id, name, brand) of every window that is an alias; tokens are not consumed.

    Only windows that begin with the first token of some alias are spelled out, in the lengths that occur with it.
    """
    table = alias_table(aliases)
    heads = table.where(F.col("n") <= longest).groupBy("head").agg(F.array_sort(F.collect_set("n")).alias("_ns"))  # at most `longest` lengths each
    tokens = tokenized(texts)
    spelled = _at_heads(tokens, heads, longest + 1).select("id", "pos", "w", F.explode("_ns").alias("_n")).where(F.size("w") >= F.col("_n"))
    spelled = spelled.select("id", "pos", F.array_join(F.expr("slice(w, 1, _n)"), " ").alias("alias"), F.get("w", F.col("_n")).alias("next"))
    found = looked_up(spelled, table, "alias")
    alone = F.col("n") == 1
    guarded = (alone & (T.isin_list(F.coalesce("next", F.lit("")), V.CONTRACTION_TAILS) | T.isin_list(F.col("alias"), V.BLOCKED_WORDS))) | T.isin_list(F.col("alias"), V.BLOCKED_PHRASES)
    return found.where(~guarded).select("id", "pos", "n", "alias", *[c for c in table.columns if c not in ("alias", "n", "head")])


def resolve(texts: DataFrame, aliases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row for each (text, entity): the longest, then leftmost match."""
    m = matches(texts, aliases, longest)
    others = [c for c in m.columns if c not in ("id", "entity_id")]
    best = m.groupBy("id", "entity_id").agg(F.min_by(F.struct(*others), F.struct(-F.col("n"), F.col("pos"), F.col("alias"))).alias("m"))
    return best.select("id", "entity_id", "m.*")


def with_context(found: DataFrame, texts: DataFrame, near: int = NEAR) -> DataFrame:
    """Adds the tokens around each match, the match itself left out; matches that carry them are left as they are."""
    if "context" in found.columns:
        return found
    t = tokenized(texts.join(found.select("id").distinct(), "id", "left_semi"))  # texts without a match are not tokenised
    before = F.expr(f"slice(tokens, greatest(pos - {near}, 0) + 1, least(pos, {near}))")
    after = F.expr(f"slice(tokens, pos + n + 1, {near})")
    return found.join(t, "id").withColumn("context", F.concat(before, after)).drop("tokens")


def guard_phrases(found: DataFrame, texts: DataFrame, guards: DataFrame) -> DataFrame:
    """Matches of a guarded phrase(alias, brand_tokens array) stay only with a brand token near them.

    Several guards over one set of matches take them from with_context(), so that texts are tokenised and joined once.
    """
    g = with_context(found, texts).join(guards, "alias", "left")
    return g.where(F.col("brand_tokens").isNull() | F.arrays_overlap("context", "brand_tokens")).select(*found.columns)


def drop_conflicts(found: DataFrame, texts: DataFrame, brand_tokens: DataFrame) -> DataFrame:
    """Bare aliases, which hold no token of their own brand, go where another brand's token(token, brand) is near and their own is not."""
    c = with_context(found, texts)
    bare = ~F.arrays_overlap(F.split("alias", " "), T.words_of(F.lower(F.coalesce("brand", F.lit("")))))
    near = c.where(bare).select("id", "pos", "n", "entity_id", "brand", F.explode(F.array_distinct("context")).alias("token"))
    seen = near.join(brand_tokens.withColumnRenamed("brand", "_other"), "token").groupBy("id", "pos", "n", "entity_id").agg(
        F.bool_or(F.lower("_other") == F.lower("brand")).alias("_own")
    )
    foreign = seen.where(~F.coalesce("_own", F.lit(False))).select("id", "pos", "n", "entity_id")
    return found.join(foreign, ["id", "pos", "n", "entity_id"], "left_anti")


def unresolved(texts: DataFrame, found: DataFrame, low: int = 2, high: int = 4, generic=V.GENERIC_PERFUME_WORDS) -> DataFrame:
    """(id, phrase): distinct n-grams outside all matched spans whose first token is neither a stop word nor a number."""
    spans = found.groupBy("id").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))
    t = tokenized(texts).join(spans, "id", "left")
    grams = F.filter(
        T.ngrams(F.col("tokens"), low, high),
        lambda g: ~F.exists(F.coalesce("spans", F.array().cast("array<struct<pos:int,n:int>>")), lambda s: (g["pos"] < s["pos"] + s["n"]) & (s["pos"] < g["pos"] + g["n"])),
    )
    out = t.select("id", F.explode(F.array_distinct(F.transform(grams, lambda g: g["phrase"]))).alias("phrase"))
    head = F.substring_index("phrase", " ", 1)
    only_generic = F.forall(F.split("phrase", " "), lambda w: T.isin_list(w, generic))
    return out.where(~T.isin_list(head, V.STOPWORDS) & ~head.rlike("^[0-9]") & ~only_generic)


def resolved_records(found: DataFrame) -> DataFrame:
    """One record for each text, its entities in the order of their places."""
    entity = F.struct("pos", "entity_id", "name", F.col("alias").alias("matched_from"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("match_type"))
    return found.groupBy("id").agg(F.sort_array(F.collect_list(entity)).alias("entities"))


# Weight of a match by platform and field.
FIELD_WEIGHTS = (
    ("youtube", "title", 1.0), ("youtube", "description", 0.5), ("youtube", "hashtags", 0.3), ("reddit", "body", 1.0), ("reddit", "title", 0.7),
    ("reddit", "hashtags", 0.3), ("tiktok_derived", "context", 1.0), ("tiktok_derived", "hashtags", 0.5), ("tiktok_derived", "description", 0.3),
    ("tiktok_derived", "title", 0.2), ("tiktok", "user", 1.0), ("tiktok", "hashtags", 0.6), ("tiktok", "title", 0.5), ("tiktok", "context", 0.4),
    ("tiktok", "description", 0.4), ("tiktok_layer3", "user", 0.8), ("tiktok_layer3", "title", 0.7), ("tiktok_layer3", "hashtags", 0.6), ("tiktok_layer3", "description", 0.5),
)


def resolve_fields(fields: DataFrame, aliases: DataFrame, least: float = 0.3) -> DataFrame:
    """fields(item, platform, field, text) -> (item, entity_id, name, score): the best weight over fields, at least `least`."""
    weight = S.lookup({f"{p}/{f}": w for p, f, w in FIELD_WEIGHTS}, F.concat_ws("/", "platform", "field"), 0.0)
    texts = fields.select(F.struct("item", "platform", "field").alias("id"), "text")
    m = resolve(texts, aliases).select("id.item", "id.platform", "id.field", "entity_id", "name")
    best = m.withColumn("score", weight).groupBy("item", "entity_id").agg(F.max("score").alias("score"), F.min("name").alias("name"))
    return best.where(F.col("score") >= least)


def safe_aliases(names: DataFrame, existing: DataFrame) -> DataFrame:
    """(alias, entity_id): generated aliases that one entity alone claims and that do not exist yet, of 2 to 8 tokens."""
    plain = names.select("entity_id", T.compatible(F.col("brand")).alias("brand"), T.compatible(F.col("name")).alias("name"))
    made = plain.select("entity_id", F.explode(T.perfume_aliases(F.col("brand"), F.col("name"))).alias("alias"))
    unique = made.groupBy("alias").agg(F.countDistinct("entity_id").alias("_n"), F.min("entity_id").alias("entity_id")).where("_n = 1").drop("_n")
    words = F.size(F.split("alias", " "))
    return unique.where(words.between(2, 8)).join(existing.select("alias"), "alias", "left_anti")


def gained(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, lost, gained, gains): set differences of entity lists(id, entities) between two resolutions."""
    none = F.array().cast("array<string>")
    b, a = F.coalesce("_b", none), F.coalesce("_a", none)
    both = before.select("id", F.col("entities").alias("_b")).join(after.select("id", F.col("entities").alias("_a")), "id", "full")
    return both.select("id", F.size(F.array_except(b, a)).alias("lost"), F.size(F.array_except(a, b)).alias("gained"), F.array_sort(F.array_except(a, b)).alias("gains"))


# --- evidence ----------------------------------------------------------------------------


def brand_words(brand: Column, stop=("the", "and", "for", "les", "des", "maison", "parfums", "parfum", "perfumes")) -> Column:
    return F.filter(T.tokenize_ascii(F.coalesce(brand, F.lit(""))), lambda w: (F.length(w) >= 3) & ~T.isin_list(w, stop))


def alias_position(tokens: Column, alias: Column) -> Column:
    """First place of the alias' tokens, else of the alias without its last one or two, else -1."""
    def at(n_cut):
        a = F.split(alias, " ")
        part = F.slice(a, 1, F.greatest(F.size(a) - n_cut, F.lit(1)))
        last = F.size(tokens) - F.size(part)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        hit = F.filter(places, lambda i: F.slice(tokens, i + 1, F.size(part)) == part)
        return F.when(F.size(hit) > 0, F.get(hit, F.lit(0)))

    return F.coalesce(at(0), at(1), at(2), F.lit(-1))


def around(tokens: Column, pos: Column, width: int) -> Column:
    first = F.greatest(pos - width, F.lit(0))
    return F.when(pos >= 0, F.slice(tokens, first + 1, pos - first + width + 1)).otherwise(F.array().cast("array<string>"))


def evidence_scores(mentions: DataFrame, domain, note_phrases, ingredients, recognised=()) -> DataFrame:
    """mentions(.., text, brand, alias, n_entities) with d1..d6, evidence_score and evidence_ok (at least 0.5).

    domain, note_phrases, ingredients and recognised are word lists of the caller.
    """
    words = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    m = mentions.withColumn("_t", T.tokenize_ascii(F.coalesce("text", F.lit("")))).withColumn("_b", brand_words(F.col("brand")))
    m = m.withColumn("_p", alias_position(F.col("_t"), F.array_join(T.tokenize_ascii(F.coalesce("alias", F.lit(""))), " ")))
    t, p, b = F.col("_t"), F.col("_p"), F.col("_b")
    d1 = F.when(F.arrays_overlap(around(t, p, 15), b), 1.0).when(F.arrays_overlap(around(t, p, 30), b), 0.5).otherwise(0.0)
    hits = F.size(F.filter(around(t, p, 20), lambda w: F.array_contains(words(domain), w)))
    near, far = F.array_join(around(t, p, 8), " "), F.array_join(around(t, p, 20), " ")
    listed = F.size(F.filter(F.array_distinct(around(t, p, 8)), lambda w: F.array_contains(words(ingredients), w)))
    d3 = (
        F.when(F.exists(words(note_phrases), lambda x: near.contains(x)), 0.9).when(listed >= 2, 0.8)
        .when(F.exists(words(note_phrases), lambda x: far.contains(x)), 0.5).otherwise(0.0)
    )
    d4 = F.when(F.arrays_overlap(T.tokenize_ascii(F.coalesce("alias", F.lit(""))), b), 1.0).otherwise(0.0)
    d6 = F.when(F.array_contains(words(recognised), F.lower("alias")), 1.0).otherwise(0.0)
    out = m.withColumns({"d1": d1, "d2": F.least(hits / 5.0, F.lit(1.0)), "d3": d3, "d4": d4, "d5": S.entity_density(F.col("n_entities")), "d6": d6})
    score = S.evidence(*[F.col(f"d{k}") for k in range(1, 7)])
    return out.withColumn("evidence_score", score).withColumn("evidence_ok", F.col("evidence_score") >= 0.5).drop("_t", "_b", "_p")


# --- fuzzy -------------------------------------------------------------------------------


def _numbered_pairs(s: Column) -> Column:
    """The pairs of neighbouring characters, each with the number of equal ones before it, so that they form a set."""
    last = F.length(s) - 1
    pairs = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substr(s, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return T.let(pairs, lambda p: F.transform(p, lambda g, i: F.concat(g, F.size(F.filter(F.slice(p, 1, i + 1), lambda x: x == g)).cast("string"))))


def _fuzzy_keys(strings: DataFrame, often: DataFrame, least: float, every_length: bool) -> DataFrame:
    """(s, key): the rarest character pairs of each string, as many as suffice, and lengths where strings are too short for that."""
    size = F.col("size")
    needed = F.ceil(size * 2 / (2 - least) * (1.5 * least - 1) - 1 - 1e-9)  # pairs that the most different allowed partner still shares
    w = Window.partitionBy("s").orderBy("_f", "key")
    ranked = strings.select("s", "size", F.explode("pairs").alias("key")).join(often, "key").withColumn("_r", F.row_number().over(w))
    rare = ranked.where((needed >= 1) & (F.col("_r") <= size - 1 - needed + 1)).select("s", "key")
    short = int((2 - least) / (3 * least - 2) + 1e-9)  # up to this length no pair need be shared
    brief = strings.where(size <= int(short * (2 - least) / least + 1e-9))
    lengths = F.sequence(F.ceil(size * least / (2 - least) - 1e-9).cast("int"), F.floor(size * (2 - least) / least + 1e-9).cast("int")) if every_length else F.array(size)
    return rare.unionByName(brief.select("s", F.explode(F.transform(lengths, lambda k: F.concat(F.lit("length "), k.cast("string")))).alias("key")))


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float = 0.88, ratio=T.sequence_ratio) -> DataFrame:
    """(text, name, ratio): all pairs of left(text) and right(name) of a ratio of `least` (over 2/3, else it raises) or more, case ignored.

    Of two strings of T characters together, M of which match, at most T - 2M + 1 runs of matching characters lie side by side,
    so they share at least 3M - T - 1 pairs of neighbouring characters, and a ratio 2M / T of `least` asks for a number of them. Two sets
    that share c elements share one of the rarest |set| - c + 1 of each, which makes the search
    an equi-join that loses nothing; the ratio is worked out for pairs alone that share enough.
    """
    if least * 3 <= 2:
        raise ValueError("ratios of two thirds and less share no pair of characters for sure")
    form = lambda t, c: t.where(F.col(c).isNotNull()).select(F.col(c).alias("v"), F.lower(c).alias("s")).distinct()
    a, b = form(left, "text"), form(right, "name")
    sized = lambda t: t.select("s").distinct().select("s", F.length("s").alias("size"), _numbered_pairs(F.col("s")).alias("pairs"))
    x, y = sized(a), sized(b)
    often = x.select(F.explode("pairs").alias("key")).unionByName(y.select(F.explode("pairs").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("_f"))
    p = _fuzzy_keys(x, often, least, True).withColumnRenamed("s", "s1")
    q = _fuzzy_keys(y, often, least, False).withColumnRenamed("s", "s2")
    total = F.length("s1") + F.length("s2")
    shared = F.size(F.array_intersect(_numbered_pairs(F.col("s1")), _numbered_pairs(F.col("s2"))))
    near = p.join(q, "key").select("s1", "s2").where(2 * F.least(F.length("s1"), F.length("s2")) >= least * total - 1e-9).distinct()
    near = near.where(shared >= total * (1.5 * least - 1) - 1 - 1e-9).withColumn("ratio", ratio(F.col("s1"), F.col("s2"))).where(F.col("ratio") >= least)
    named = near.join(a.select(F.col("s").alias("s1"), F.col("v").alias("text")), "s1").join(b.select(F.col("s").alias("s2"), F.col("v").alias("name")), "s2")
    return named.select("text", "name", "ratio")


def best_fuzzy(left: DataFrame, right: DataFrame, least: float = 0.88, ratio=T.sequence_ratio) -> DataFrame:
    """(text, match, ratio): the most similar name of right(name) for each left(text), ties by the greater name, if its ratio is `least` or more."""
    r = fuzzy_pairs(left, right, least, ratio)
    return r.groupBy("text").agg(F.max_by("name", F.struct("ratio", "name")).alias("match"), F.max("ratio").alias("ratio"))


def resolve_mentions(mentions: DataFrame, aliases: DataFrame, high: float = 0.92, mid: float = 0.8) -> DataFrame:
    """mentions(id, text), aliases(alias, entity_id) -> one row for each mention: method, candidate, entity_id, confidence.

    The first candidate phrase that is an alias decides (exact, confidence 1); else the candidate and alias of the greatest
    ratio by insertions and deletions: fuzzy_high from `high` on, fuzzy_mid from `mid` on; else unresolved, with the text itself. Of equal
    ratios the earlier candidate wins, then the smaller entity.
    """
    one = aliases.groupBy("alias").agg(F.min("entity_id").alias("entity_id"))
    c = mentions.select("id", F.posexplode(T.candidate_phrases(T.compatible(F.coalesce("text", F.lit(""))))).alias("rank", "candidate"))
    exact = looked_up(c, one.withColumnRenamed("alias", "candidate"), "candidate").groupBy("id").agg(F.min(F.struct("rank", "candidate", "entity_id")).alias("e"))
    left = c.join(exact.select("id"), "id", "left_anti")
    close = fuzzy_pairs(left.select(F.col("candidate").alias("text")), one.select(F.col("alias").alias("name")), mid, T.indel_ratio)
    close = left.join(close, left["candidate"] == close["text"]).join(one.withColumnRenamed("alias", "name"), "name")
    close = close.groupBy("id").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "rank", "candidate", "entity_id")).alias("f"))
    j = mentions.select("id", "text").join(exact, "id", "left").join(close, "id", "left")
    ratio = -F.col("f.r")
    method = F.when(F.col("e").isNotNull(), "exact").when(ratio >= high, "fuzzy_high").when(ratio >= mid, "fuzzy_mid").otherwise("unresolved")
    return j.select(
        "id", method.alias("method"), F.coalesce("e.candidate", "f.candidate", "text").alias("candidate"), F.coalesce("e.entity_id", "f.entity_id").alias("entity_id"),
        F.when(F.col("e").isNotNull(), 1.0).otherwise(F.round(F.coalesce(ratio, F.lit(0.0)), 3)).alias("confidence"),
    )


def prefix_matches(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(text, alias) where text and a blank begin the alias: alias prefixes are spelled out and equi-joined."""
    words = F.split("alias", " ")
    spelled = aliases.select("alias", F.explode(F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " ")))).alias("text"))
    return texts.select("text").distinct().join(spelled, "text")
