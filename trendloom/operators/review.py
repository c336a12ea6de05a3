"""Rules over stored decisions: the strict second look at names to create, submissions, intake with its audit, channel verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trendloom.functions import text as T
from trendloom.operators import candidates as C
from trendloom.operators import resolver as R

# Words by which the second look refuses a name.
PRODUCT_FRAGMENTS = ("rouge", "baccarat", "libre", "pt", "blanc", "noir", "intense", "elixir", "absolute", "extreme", "pure")
GENERIC_BRANDS = ("different", "blend", "essential", "another", "therapy", "secret", "purchase", "join", "notes", "good", "nice", "amazing", "great", "love", "like", "want", "need")
FOREIGN_WORDS = ("el", "en", "de", "del", "les", "du", "le", "la", "al", "un", "una", "por", "il", "gli", "lo", "los")
PYRAMID_WORDS = ("notes", "bottom", "top", "middle", "heart", "base")
CONTEXT_WORDS = (
    "and", "with", "from", "for", "what", "have", "actually", "very", "good", "awesome", "a", "all", "about", "samples", "sample", "i", "we", "is", "by",
    "if", "one", "then", "notes", "bottom", "top", "middle", "heart", "base",
)
NOTE_WORDS = ("vanille", "vanilla", "lilac", "ambrette", "sage", "amber", "musk", "oud")
CONTENT_PHRASES = ("fucking", "bullshit", "actually can", "very good", "samples")
#: Ratio from which a name close to a stored one becomes its alias.
LENIENT = 0.75


def _hit(words: Column, listed) -> Column:
    """The first of the words that is listed, or null."""
    return F.get(F.filter(words, lambda w: T.isin_list(w, listed)), F.lit(0))


def second_look(candidates: DataFrame, exact: DataFrame, brands: DataFrame, aliases: DataFrame, merges: DataFrame, names: DataFrame) -> DataFrame:
    """candidates(text, kind) -> (text, kind, decision, reason) by an ordered list of rules; the first that holds decides.

    exact(text): names known by now. brands(key, brand), aliases(alias), merges(text, match): first search's hits, names(name):
    normalised names of the master. kind is perfume, brand or unknown. Fuzzy evidence is worked out only for names that
    reach that rule; of equal ratios the greater name counts.
    """
    c = candidates.select("text", "kind").distinct()
    words = F.split(F.col("text"), " ")
    known = exact.select("text").distinct().withColumn("_known", F.lit(True))
    prefix = C.brand_prefix(c.select("text").distinct(), brands)
    j = c.join(known, "text", "left").join(prefix, "text", "left")
    parts = F.when(F.coalesce("rest", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("rest", " "))
    phrase = F.get(F.filter(F.array(*[F.lit(p) for p in CONTENT_PHRASES]), lambda p: F.contains(F.col("text"), p)), F.lit(0))
    ruled = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), reason.alias("reason"))
    no = lambda reason: ruled("reject_create_candidate", reason)
    tagged = lambda tag, value: F.concat(F.lit(tag + ":"), value)
    perfume, low = F.col("kind").isin("perfume", "unknown"), F.lower(F.coalesce("brand", F.lit("")))
    early = (
        F.when(F.col("_known"), ruled("exact_now_in_kb", F.lit("now_in_kb_after_seed")))
        .when(F.length("text") <= 3, no(F.lit("too_short"))).when(F.col("text").rlike(r"[^\x00-\x7F]"), no(F.lit("non_ascii")))
        .when(_hit(words, FOREIGN_WORDS).isNotNull(), no(tagged("foreign_function_word", _hit(words, FOREIGN_WORDS))))
        .when(phrase.isNotNull(), no(tagged("content_phrase", phrase)))
        .when(perfume & F.col("brand").isNull() & (F.size(words) == 1), no(F.lit("single_token_no_brand")))
        .when(perfume & F.col("brand").isNull(), ruled("defer_create", F.lit("brand_not_resolvable")))
        .when(perfume & T.isin_list(low, PRODUCT_FRAGMENTS), no(tagged("brand_part_is_product_fragment", low)))
        .when(perfume & T.isin_list(low, GENERIC_BRANDS), no(tagged("brand_part_is_generic", low)))
        .when(perfume & (F.size(parts) == 0), no(F.lit("no_perfume_part_after_brand")))
        .when(perfume & _hit(parts, PYRAMID_WORDS).isNotNull(), no(tagged("perfume_part_is_pyramid_position", _hit(parts, PYRAMID_WORDS))))
        .when(perfume & _hit(parts, CONTEXT_WORDS).isNotNull(), no(tagged("perfume_part_context_token", _hit(parts, CONTEXT_WORDS))))
        .when(perfume & (F.size(parts) == 1) & T.isin_list(F.get(parts, F.lit(0)), NOTE_WORDS), no(tagged("single_note_word_perfume_part", F.get(parts, F.lit(0)))))
        .when((F.col("kind") == "brand") & (F.size(words) == 1) & (F.length("text") < 4), no(F.lit("single_short_token_brand")))
        .when(F.col("kind") == "brand", ruled("keep_as_valid_create", F.lit("new_brand")))
        .when(~perfume, ruled("defer_create", tagged("unknown_entity_type", F.col("kind"))))
    )
    j = j.withColumn("_early", early).withColumn("_proposed", F.lower(F.concat_ws(" ", "brand", "rest")))
    left = j.where("_early IS NULL")
    alias = aliases.select(F.col("alias").alias("rest")).distinct().withColumn("_alias", F.lit(True))
    merge = merges.groupBy("text").agg(F.min("match").alias("_merge"))
    close = R.best_fuzzy(left.select(F.col("_proposed").alias("text")), names, LENIENT).select(F.col("text").alias("_proposed"), F.col("match").alias("_close"), "ratio")
    k = left.join(alias, "rest", "left").join(merge, "text", "left").join(close, "_proposed", "left")
    late = (
        F.when(F.col("_alias"), ruled("convert_to_merge", tagged("perfume_part_in_aliases", F.col("rest"))))
        .when(F.col("_merge").isNotNull(), ruled("convert_to_merge", tagged("fuzzy_merge", F.col("_merge"))))
        .when(F.col("_close").isNotNull(), ruled("convert_to_merge", F.concat(F.lit("lenient_fuzzy:"), F.format_string("%.2f", "ratio"), F.lit(":"), F.col("_close"))))
        .otherwise(ruled("keep_as_valid_create", F.concat(F.lit("new_perfume:brand="), F.col("brand"))))
    )
    return j.where("_early IS NOT NULL").select("text", "kind", "_early.*").unionByName(k.withColumn("_late", late).select("text", "kind", "_late.*"))


def submission_status(submissions: DataFrame, channels: DataFrame) -> DataFrame:
    """submissions(id, url, platform) with status: what a submitted source needs next.

    Other platforms wait for their connector; of video-site addresses only those of channels can be checked here, against
    channels(channel_id): tracked already, or pending. Handles and single videos need a person.
    """
    kind = T.video_url_type(F.col("url"))
    known = channels.select(F.col("channel_id").alias("_c")).distinct()
    j = submissions.withColumn("_id", T.channel_id(F.col("url"))).join(known, F.col("_id") == F.col("_c"), "left")
    status = (
        F.when(F.coalesce(F.col("platform") != "youtube", F.lit(True)), "platform_pending").when(kind != "channel_direct", "needs_manual_resolve")
        .when(F.col("_c").isNotNull(), "already_tracked").otherwise("pending")
    )
    return j.withColumn("status", status).drop("_id", "_c")


# Statuses that a candidate never leaves, and the roles on the creators' board.
TERMINAL = ("APPLIED", "REJECTED", "DUPLICATE")
BOARD_ROLES = ("independent_creator",)


def role_and_eligibility(role: Column, eligible: Column) -> tuple[Column, Column]:
    """(role, eligible): no role is an independent creator's; an explicit eligibility wins over the role's."""
    own = F.coalesce(F.when(role != "", role), F.lit("independent_creator"))
    return own, F.coalesce(eligible, own.isin(*BOARD_ROLES))


def verified(candidates: DataFrame, uploads: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """candidates(id, channel_id) with recent, status and reason, from uploads(channel_id, day) of the last `days` days."""
    near = (F.col("day") <= as_of) & (F.datediff(as_of, "day") <= days)
    recent = uploads.where(near).groupBy("channel_id").agg(F.count(F.lit(1)).alias("_n"))
    j = candidates.join(recent, "channel_id", "left").withColumn("recent", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")
    fine = F.col("channel_id").isNotNull() & T.is_channel_id(F.col("channel_id"))
    status = F.when(~fine | F.col("channel_id").isNull(), "NEEDS_OPERATOR_REVIEW").when(F.col("recent") == 0, "SKIP_INACTIVE").otherwise("VERIFIED_ADD_READY")
    reason = (
        F.when(F.col("status") == "NEEDS_OPERATOR_REVIEW", "Could not resolve to a channel_id")
        .when(F.col("status") == "SKIP_INACTIVE", f"No videos published in last {days} days").otherwise(F.concat(F.col("recent").cast("string"), F.lit(f" video(s) in last {days} days")))
    )
    return j.withColumn("status", status).withColumn("reason", reason)


def intake(candidates: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates after all actions, audit): actions(id, seq, actor, new_status, role, eligible) in the order of seq.

    A candidate that reached a terminal status is not changed any more: later actions on it are refused, which the
    audit(id, seq, actor, old_status, new_status, refused) shows. When a candidate is APPLIED, its role and eligibility are settled.
    Actions on ids that are no candidates are refused, too. Actions of one candidate are few; they are folded in order.
    """
    per = actions.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "actor", "new_status", "role", "eligible"))).alias("_a"))
    j = candidates.join(per, "id", "full")
    step = "struct<seq: bigint, actor: string, old_status: string, new_status: string, refused: boolean>"
    zero = F.struct(F.col("status").alias("status"), F.col("role").alias("role"), F.col("eligible").alias("eligible"), F.array().cast(f"array<{step}>").alias("log"))

    def fold(s: Column, a: Column) -> Column:
        refused = s["status"].isNull() | s["status"].isin(*TERMINAL)
        role, eligible = role_and_eligibility(F.coalesce(a["role"], s["role"]), F.coalesce(a["eligible"], s["eligible"]))
        done = ~refused & (a["new_status"] == "APPLIED")
        entry = F.struct(
            a["seq"].cast("long").alias("seq"), a["actor"].alias("actor"), s["status"].alias("old_status"), a["new_status"].alias("new_status"), refused.alias("refused")
        )
        return F.struct(
            F.when(refused, s["status"]).otherwise(a["new_status"]).alias("status"), F.when(done, role).otherwise(s["role"]).alias("role"),
            F.when(done, eligible).otherwise(s["eligible"]).alias("eligible"), F.concat(s["log"], F.array(entry)).alias("log"),
        )

    told = j.withColumn("_s", F.aggregate(F.coalesce("_a", F.array().cast(per.schema["_a"].dataType)), zero, fold))
    after = told.where("status IS NOT NULL").select(*[F.col(f"_s.{c}").alias(c) if c in ("status", "role", "eligible") else F.col(c) for c in candidates.columns])
    return after, told.select("id", F.explode("_s.log").alias("e")).select("id", "e.*")


def commanded(rows: DataFrame, commands: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows after create, update and delete commands(key, seq, op, columns) in the order of seq, as a table: one shuffle by key.

    A create of a row that is there, and an update or delete of one that is not, change nothing. An update sets the
    columns that it gives and leaves those that are null. Commands of one key are few; they are folded in order.
    """
    stored = rows.select(key, F.lit(None).cast(commands.schema["seq"].dataType).alias("seq"), F.lit("create").alias("op"), *columns)  # the first command of its key
    every = stored.unionByName(commands.select(key, "seq", "op", *columns))
    per = every.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "op", *columns))).alias("_a"))
    none = F.lit(None).cast(StructType([StructField(c, every.schema[c].dataType) for c in columns]))

    def fold(r: Column, a: Column) -> Column:
        given = F.struct(*[a[c].alias(c) for c in columns])
        laid = F.struct(*[F.coalesce(a[c], r[c]).alias(c) for c in columns])
        return F.when((a["op"] == "create") & r.isNull(), given).when((a["op"] == "update") & r.isNotNull(), laid).when(a["op"] == "delete", none).otherwise(r)

    return per.select(key, F.aggregate("_a", none, fold).alias("_r")).where("_r IS NOT NULL").select(key, "_r.*")
