"""Scalar formulas as Column expressions: engagement, growth, composite score, trend state, source scores.

Null inputs count as zero where the formula says so; divisions are guarded. Doubles
are rounded once, at the end, half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of one mention by platform; unknown platforms weigh 1.0.
PLATFORM_WEIGHTS = {"youtube": 1.2, "tiktok": 0.9, "reddit": 1.0, "other": 0.8}
# Priority of trend states when variants merge.
STATE_PRIORITY = {"breakout": 6, "rising": 5, "peak": 4, "stable": 3, "declining": 2, "emerging": 1}
# Tier weights of channels.
TIER_WEIGHTS = {"tier_1": 3.0, "tier_2": 2.0, "tier_3": 1.0, "tier_4": 0.5, "blocked": 0.0}
VIEW_CAP = 500_000


def rounded(x: Column, places: int) -> Column:
    """Half up with exact halves settled upwards, so that every engine rounds a computed double alike."""
    return F.round(x + 1e-9, places)


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def lookup(table: dict, key: Column, default=None) -> Column:
    """A small literal map; default for missing keys."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def platform_weight(platform: Column, override: Column | None = None) -> Column:
    """Decimal weight of a mention, so that sums are exact; a non-null override wins."""
    base = lookup(PLATFORM_WEIGHTS, platform, 1.0).cast("decimal(10,4)")
    return base if override is None else F.coalesce(override.cast("decimal(10,4)"), base)


def engagement_total(platform: Column, views: Column, likes: Column, comments: Column) -> Column:
    """views + 3 likes + 5 comments; views of one platform are capped."""
    v = F.when(platform == "tiktok", F.least(zero(views), F.lit(VIEW_CAP))).otherwise(zero(views))
    return v + 3 * zero(likes) + 5 * zero(comments)


def growth(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before).when(now > 0, 1.0).otherwise(0.0)


def momentum(now: Column, before: Column) -> Column:
    return F.round(now / F.greatest(before, F.lit(1.0)), 4)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def composite(mentions: Column, engagement: Column, grown: Column, platforms: Column, mom: Column) -> Column:
    """0 to 100 from five capped terms, rounded to four places."""
    total = (
        0.35 * F.least(mentions / 10.0, F.lit(1.0))
        + 0.25 * F.least(engagement / 500000.0, F.lit(1.0))
        + 0.20 * ((clamp(grown, -1.0, 1.0) + 1.0) / 2.0)
        + 0.10 * F.least(F.greatest(mom, F.lit(0.0)) / 3.0, F.lit(1.0))
        + 0.10 * F.least(platforms / 3.0, F.lit(1.0))
    )
    return rounded(100.0 * total, 4)


def trend_state(score: Column, before: Column, grown: Column, mom: Column, mentions: Column, latest_signal: Column | None = None) -> Column:
    """First match wins; null without mentions or score."""
    strong = F.lit(False) if latest_signal is None else F.coalesce(latest_signal.isin("breakout", "acceleration_spike"), F.lit(False)) & (score >= 10)
    return (
        F.when(mentions <= 0, F.lit(None).cast("string"))
        .when(((score >= 15) & (grown >= 0.35) & (mentions >= 2)) | strong, "breakout")
        .when(((before >= 10) & (score < 0.5 * before)) | ((grown < -0.30) & (before >= 5)), "declining")
        .when(((grown >= 0.15) & (score >= 5) & (mentions >= 1)) | ((mom >= 0.30) & (score >= 5)), "rising")
        .when((score >= 20) & (grown >= -0.05) & (grown <= 0.10), "peak")
        .when(((before == 0) & (score > 0) & (mentions >= 1)) | ((score < 10) & (grown > 0) & (mentions >= 1)), "emerging")
        .when(score > 0, "stable")
    )


def engagement_rate(views: Column, likes: Column, comments: Column) -> Column:
    return F.when(views > 0, (zero(likes) + zero(comments)) / views)


def source_score(platform: Column, views: Column, likes: Column, comments: Column) -> Column:
    """Log-scaled evidence of reach for two platforms, null for others."""
    rate = zero(engagement_rate(views, likes, comments))
    video = 0.7 * F.least(F.log10(zero(views) + 1.0) / 5.0, F.lit(1.0)) + 0.3 * F.least(rate * 10.0, F.lit(1.0))
    post = 0.6 * F.least(F.log10(zero(likes) + 1.0) / 3.0, F.lit(1.0)) + 0.4 * F.least(F.log10(zero(comments) + 1.0) / 2.0, F.lit(1.0))
    heard = (zero(likes) > 0) | (zero(comments) > 0)
    return F.round(F.when(platform == "youtube", video).when((platform == "reddit") & heard, post), 4)


def weighted_score(score: Column, mean_source_score: Column) -> Column:
    return F.least(F.lit(100.0), score * (1.0 + F.coalesce(mean_source_score, F.lit(0.0))))


def effective_rank(score: Column, authors: Column) -> Column:
    """Scores that fewer than two authors carry are dampened."""
    return F.round(F.when(zero(authors) < 2, score * 0.6).otherwise(score), 4)


def recency_decay(days: Column, rate: float = 0.1) -> Column:
    return F.exp(-F.lit(rate) * days)


def log_confidence(n: Column) -> Column:
    return F.log(n + 1.0)


def trend_unit(influence: Column, multiplier: Column, confidence: Column) -> Column:
    return zero(influence) * zero(multiplier) * zero(confidence)


def influence_score(subscribers: Column, noise: Column, entities: Column, mentions: Column, early: Column, rate: Column) -> Column:
    """Creator influence from six normalised parts, rounded to six places."""
    one = F.lit(1.0)
    return F.round(
        0.25 * F.least(F.log10(zero(subscribers) + 1.0) / 7.0, one)
        + 0.20 * (1.0 - zero(noise))
        + 0.20 * F.least(zero(entities) / 50.0, one)
        + 0.15 * F.least(F.log10(zero(mentions) + 1.0) / 3.0, one)
        + 0.10 * F.least(zero(early) / 20.0, one)
        + 0.10 * F.least(zero(rate) / 0.1, one),
        6,
    )


def poll_interval_hours(last_new: Column, empty_polls: Column, tier: Column) -> Column:
    base = (
        F.when(empty_polls >= 14, 168).when(empty_polls >= 7, 72).when(empty_polls >= 3, 48)
        .when((last_new >= 3) & (empty_polls == 0), 12).otherwise(24)
    )
    return F.when(tier == "tier_1", F.least(base, F.lit(24))).when(tier == "tier_2", F.least(base, F.lit(72))).otherwise(base)


def finite(x: Column, bound: float = 9999.9) -> Column:
    """Infinity becomes +-bound, not-a-number null."""
    return F.when(F.isnan(x), F.lit(None).cast("double")).when(x == float("inf"), bound).when(x == float("-inf"), -bound).otherwise(x)


def direction(delta: Column, band: float = 0.05) -> Column:
    return F.when(F.abs(delta) < band, "flat").when(delta > 0, "up").otherwise("down")


def bands(x: Column, steps: list[tuple[float, str]], otherwise) -> Column:
    """First band whose lower bound x reaches; steps in falling order."""
    out = F
    for low, name in steps:
        out = out.when(x >= low, name)
    return out.otherwise(otherwise)


def signal_mix(creators: Column, community: Column) -> Column:
    total = zero(creators) + zero(community)
    share = zero(creators) / F.when(total > 0, total)
    return F.when(total == 0, "unknown").when(share >= 0.75, "creator").when(share <= 0.25, "community").otherwise("mixed")


def step_influence(views: Column, subscribers: Column) -> Column:
    """Largest of two step functions over reach."""
    v = bands(zero(views), [(1_000_000, 1.0), (100_000, 0.8), (10_000, 0.5), (1_000, 0.3)], 0.1)
    s = bands(zero(subscribers), [(1_000_000, 1.0), (100_000, 0.8), (10_000, 0.5), (1_000, 0.3)], 0.1)
    return F.greatest(v, s)


def source_weight(influence: Column, credibility: Column) -> Column:
    return F.greatest(zero(influence) * zero(credibility), F.lit(0.1))


def raw_influence(views: Column, likes: Column) -> Column:
    return 0.6 * zero(views) + 0.4 * zero(likes)


def community_influence(score: Column, comments: Column) -> Column:
    return 0.7 * zero(score) + 0.3 * zero(comments)


def note_score(n: Column, mean_engagement: Column, official: Column) -> Column:
    return F.round(0.6 * n + 0.3 * mean_engagement + 0.1 * official.cast("double"), 4)


def ambiguity_risk(d1: Column, d2: Column, d3: Column, d4: Column, d5: Column) -> Column:
    return F.round(0.35 * d1 + 0.25 * d2 + 0.25 * d3 + 0.10 * d4 + 0.05 * d5, 4)


def risk_action(risk: Column) -> Column:
    return bands(risk, [(0.72, "A"), (0.52, "B"), (0.32, "C")], "D")


def evidence(d1: Column, d2: Column, d3: Column, d4: Column, d5: Column, d6: Column) -> Column:
    """Six evidence dimensions to one score in 0..1; capped without any brand evidence."""
    raw = 0.35 * d1 + 0.25 * d2 + 0.20 * (1 - d3) + 0.10 * d4 + 0.10 * (1 - d5) + 0.10 * d6
    capped = F.when((d1 == 0) & (d4 == 0) & (d6 == 0), F.least(raw, F.lit(0.45))).otherwise(raw)
    return F.round(clamp(capped, 0.0, 1.0), 4)


def entity_density(n: Column) -> Column:
    """1 beyond 15 entities in an item, 0.1 up to 3, linear between."""
    return F.when(n > 15, 1.0).when(n <= 3, 0.1).otherwise(0.1 + 0.9 * (n - 3) / 12.0)


def date_range(preset: str, latest, start=None, end=None):
    """(first day, last day) of a preset, anchored on the latest active date; on the driver."""
    import datetime as dt

    days = {"today": 0, "7d": 6, "14d": 13, "30d": 29}
    if preset == "custom":
        return start or latest, end or latest
    if preset == "yesterday":
        return latest - dt.timedelta(days=1), latest - dt.timedelta(days=1)
    if preset == "mtd":
        return latest.replace(day=1), latest
    if preset == "ytd":
        return latest.replace(month=1, day=1), latest
    return latest - dt.timedelta(days=days.get(preset, 0)), latest
