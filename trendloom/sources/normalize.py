"""Raw posts to canonical content items, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions import text as T

CONTENT_COLUMNS = (
    "id", "schema_version", "source_platform", "source_account_id", "source_account_handle", "source_account_type", "source_url", "external_content_id",
    "published_at", "collected_at", "content_type", "title", "caption", "text_content", "hashtags", "media_metadata", "engagement", "language", "region",
    "mention_weight_override", "query",
)

# Schemas of landed files, so that reads never infer.
REDDIT = "id string, name string, title string, selftext string, author string, subreddit string, permalink string, url string, created_utc bigint, score int, upvote_ratio double, num_comments int, link_flair_text string, is_self boolean"
TIKTOK = "id string, `desc` string, createTime bigint, author struct<id:string,uniqueId:string,nickname:string,followerCount:int,verified:boolean>, stats struct<playCount:int,diggCount:int,commentCount:int,shareCount:int>, video struct<duration:int,width:int,height:int>, challenges array<struct<title:string>>"
_SNIPPET = "struct<publishedAt:string,channelId:string,title:string,description:string,channelTitle:string,tags:array<string>>"
YOUTUBE = f"fetched_at string, query string, search_item struct<id:struct<videoId:string>,snippet:{_SNIPPET}>, video_details struct<snippet:{_SNIPPET},statistics:struct<viewCount:string,likeCount:string,commentCount:string>,contentDetails:struct<duration:string>>"

# Countries whose region differs from their code.
REGIONS = {"US": "US", "GB": "UK", "UK": "UK", "FR": "FR", "DE": "DE", "IT": "IT", "ES": "ES", "AE": "AE", "SA": "SA"}


def language_of(attempted: Column, language: Column) -> Column:
    """Null where no detection was attempted, UNKNOWN where it found nothing."""
    clean = F.nullif(F.trim(language), F.lit(""))
    return F.when(F.coalesce(attempted, F.lit(False)), F.coalesce(F.lower(clean), F.lit("UNKNOWN")))


def region_of(*candidates: Column) -> Column:
    """First non-empty candidate, mapped where the map knows it."""
    first = F.coalesce(*[F.nullif(F.upper(F.trim(c)), F.lit("")) for c in candidates])
    return F.coalesce(S.lookup(REGIONS, first), first)


def _engagement(views, likes, comments, shares) -> Column:
    return F.struct(views.try_cast("bigint").alias("views"), likes.try_cast("bigint").alias("likes"), comments.try_cast("bigint").alias("comments"), shares.try_cast("bigint").alias("shares"))


def _media(**fields) -> Column:
    names = (("channel_title", "string"), ("channel_id", "string"), ("subreddit", "string"), ("source_type", "string"), ("influence_score", "double"), ("followers", "bigint"))
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def _items(raw: DataFrame, **c: Column) -> DataFrame:
    """The canonical columns; those not given are null."""
    types = {"hashtags": "array<string>", "mention_weight_override": "double", "media_metadata": None, "engagement": None}
    none = lambda n: F.lit(None).cast(types.get(n) or "string")
    return raw.select(*[(c[n] if n in c else none(n)).alias(n) for n in CONTENT_COLUMNS])


def hashtags_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#(\w+)"), F.lit(1)), F.lower))


def normalize_youtube(raw: DataFrame) -> DataFrame:
    """Details first, the search result's snippet where they are missing."""
    of = lambda f: F.coalesce(F.col(f"video_details.snippet.{f}"), F.col(f"search_item.snippet.{f}"))
    vid, st = F.col("search_item.id.videoId"), "video_details.statistics."
    title, text = F.coalesce(of("title"), F.lit("")), F.coalesce(of("description"), F.lit(""))
    return _items(
        raw, id=vid, schema_version=F.lit("1.0"), source_platform=F.lit("youtube"), source_account_id=of("channelId"), source_account_handle=of("channelTitle"),
        source_account_type=F.lit("creator"), source_url=F.concat(F.lit("https://www.youtube.com/watch?v="), vid), external_content_id=vid, published_at=of("publishedAt"),
        collected_at=F.col("fetched_at"), content_type=F.lit("video"), title=title, caption=F.lit(None).cast("string"), text_content=text,
        hashtags=F.coalesce(of("tags"), F.array().cast("array<string>")), media_metadata=_media(channel_title=of("channelTitle"), channel_id=of("channelId")),
        engagement=_engagement(F.col(st + "viewCount"), F.col(st + "likeCount"), F.col(st + "commentCount"), F.lit(None).cast("string")), query=F.col("query"),
    )


def normalize_tiktok(raw: DataFrame) -> DataFrame:
    """Caption and hashtags as text; up to sixty seconds is a short."""
    named = F.filter(F.transform("challenges", lambda c: F.lower(c["title"])), lambda t: t.isNotNull() & (t != ""))
    tags = F.when(F.size("challenges") > 0, named).otherwise(hashtags_in(F.col("desc")))
    handle = F.col("author.uniqueId")
    return _items(
        raw, id=F.concat(F.lit("tiktok_"), F.col("id")), schema_version=F.lit("1.0"), source_platform=F.lit("tiktok"), source_account_id=F.col("author.id"), source_account_handle=handle,
        source_account_type=F.lit("creator"), source_url=F.concat(F.lit("https://www.tiktok.com/@"), handle, F.lit("/video/"), F.col("id")), external_content_id=F.col("id"),
        published_at=F.date_format(F.timestamp_seconds("createTime"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), content_type=F.when(F.col("video.duration") <= 60, "short").otherwise("video"),
        caption=F.col("desc"), text_content=F.trim(F.concat_ws(" ", F.col("desc"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "))), hashtags=tags,
        media_metadata=_media(followers=F.col("author.followerCount")), engagement=_engagement(F.col("stats.playCount"), F.col("stats.diggCount"), F.col("stats.commentCount"), F.col("stats.shareCount")),
    )


def normalize_tiktok_url(urls: DataFrame) -> DataFrame:
    """urls(url, context, found_at) of videos that other posts point to; their mentions weigh nothing."""
    vid, who = F.regexp_extract("url", r"/video/(\d+)", 1), F.regexp_extract("url", r"tiktok\.com/@([A-Za-z0-9_.]+)", 1)
    return _items(
        urls, id=F.concat(F.lit("tiktok_"), vid), schema_version=F.lit("1.0"), source_platform=F.lit("tiktok"), source_account_handle=who, source_url=F.col("url"), external_content_id=vid,
        published_at=F.col("found_at"), content_type=F.lit("video"), text_content=F.col("context"), hashtags=hashtags_in(F.col("context")), media_metadata=_media(),
        engagement=_engagement(*[F.lit(None).cast("string")] * 4), mention_weight_override=F.lit(0.0),
    )


def normalize_reddit(raw: DataFrame) -> DataFrame:
    """Title and body as text; the score is the likes, views are unknown."""
    none = F.lit(None).cast("string")
    return _items(
        raw, id=F.concat(F.lit("reddit_"), F.col("id")), schema_version=F.lit("1.0"), source_platform=F.lit("reddit"), source_account_handle=F.col("author"), source_account_type=F.lit("community"),
        source_url=F.concat(F.lit("https://www.reddit.com"), F.col("permalink")), external_content_id=F.col("id"), published_at=F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        content_type=F.lit("post"), title=F.col("title"), text_content=F.trim(F.concat_ws(" ", "title", F.nullif("selftext", F.lit("")))), hashtags=F.array().cast("array<string>"),
        media_metadata=_media(subreddit=F.col("subreddit"), source_type=F.lit("community")), engagement=_engagement(none, F.col("score"), F.col("num_comments"), none),
    )


def normalize_enrichment(raw: DataFrame) -> DataFrame:
    """Scraped strings to typed columns; lists split on commas and semicolons."""
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(
        F.nullif(F.trim("perfume_name"), F.lit("")).alias("perfume_name"), F.nullif(F.trim("brand_name"), F.lit("")).alias("brand_name"),
        *[items(c).alias(c) for c in ("accords", "notes_top", "notes_middle", "notes_base")], F.col("rating_value").try_cast("double").alias("rating_value"),
        F.col("rating_count").try_cast("int").alias("rating_count"), F.nullif(F.regexp_extract("release_year", r"\b(1[89]\d\d|20\d\d)\b", 1), F.lit("")).try_cast("int").alias("release_year"), gender_of(F.col("gender")).alias("gender"),
    )


def gender_of(raw: Column) -> Column:
    g = F.lower(F.trim(raw))
    women, men = g.rlike(r"\b(women|woman|female|femme|feminine)\b"), g.rlike(r"\b(men|man|male|homme|masculine)\b")
    return F.when((women & men) | g.rlike("unisex"), "unisex").when(women, "women").when(men, "men")


def embedded_video_urls(posts: DataFrame, text: str = "text", width: int = 200) -> DataFrame:
    """(id, url, context): each distinct video address in a text, with the text around it."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://(?:www\.|m\.)?tiktok\.com/@[A-Za-z0-9_.]+/video/\d+)"), F.lit(1)))
    e = posts.select("id", text, F.explode(found).alias("url"))
    at = F.greatest(F.expr(f"locate(url, {text})") - width // 2, F.lit(1))
    return e.select("id", "url", F.trim(F.substring(text, at, F.lit(width))).alias("context"))


def resolver_text(method: Column, title: Column, text: Column) -> Column:
    """Polled channels are resolved on their titles alone."""
    return F.when(method == "channel_poll", title).otherwise(F.concat_ws(" ", title, text))


def classify_source(followers: Column, handle: Column, views: Column) -> Column:
    brandish = F.lower(F.coalesce(handle, F.lit(""))).rlike("official|brand|parfums|perfumes|house")
    return F.when(brandish, "brand").when(S.zero(followers) >= 100_000, "influencer").when((S.zero(followers) >= 10_000) | (S.zero(views) >= 50_000), "creator").otherwise("user")


def transcript_priority(title: Column, text: Column, views: Column, tier: Column, domain=("fragrance", "perfume", "cologne", "scent", "parfum")) -> Column:
    """none for shorts and off-topic items, high for top tiers or reach, else low."""
    plain = F.lower(F.regexp_replace(F.concat_ws(" ", title, text), r"https?://\S+", " "))
    on_topic = F.exists(F.array(*[F.lit(w) for w in domain]), lambda w: F.contains(plain, w))
    short = F.lower(F.coalesce(title, F.lit(""))).rlike(r"#shorts?\b")
    return F.when(short | ~on_topic, "none").when(tier.isin("tier_1", "tier_2") | (S.zero(views) >= 50_000), "high").otherwise("low")


def seed_rows(raw: DataFrame) -> DataFrame:
    """Catalog rows from files with varying headers: the first column that holds a value wins."""
    have = {c.lower(): c for c in raw.columns}
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{have[n]}`").cast("string")), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    brand, name = pick("brand_name", "brand", "house", "designer"), pick("perfume_name", "name", "perfume", "title")
    year = F.regexp_extract(F.coalesce(pick("release_year", "year", "launch_year"), F.lit("")), r"(1[89]\d\d|20\d\d)", 1)
    return raw.select(
        F.sha2(F.concat_ws("|", T.normalize_text(brand), T.normalize_text(name)), 256).alias("fragrance_id"), brand.alias("brand_name"), name.alias("perfume_name"),
        F.nullif(year, F.lit("")).try_cast("int").alias("release_year"), gender_of(pick("gender", "sex", "for")).alias("gender"), F.coalesce(pick("source"), F.lit("import")).alias("source"),
    ).where("brand_name IS NOT NULL AND perfume_name IS NOT NULL")
