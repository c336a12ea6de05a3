"""Literal-input tests of scalar and string functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom.functions import scores as S
from trendloom.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, want",
    [
        ("Dior Sauvage Eau de Parfum", "Dior Sauvage"), ("Baccarat Rouge 540 Extrait Extrait de Parfum", "Baccarat Rouge 540"), ("Parfum", "Parfum"),
        ("Creed Aventus", "Creed Aventus"), ("A Eau Fraiche", "A"), (" X parfum ", "X"),
    ],
)
def test_base_name(spark, name, want):
    assert one(spark, T.base_name(F.lit(name))) == want


@pytest.mark.parametrize("name, want", [("Ambre Sultan Eau de Parfum", "Ambre Sultan"), ("Philosykos - Eau de Parfum", "Philosykos"), ("Sauvage Elixir", "Sauvage Elixir"), ("Extrait", "Extrait"), ("X EDP", "X")])
def test_strip_concentration(spark, name, want):
    assert one(spark, T.strip_concentration(F.lit(name))) == want


@pytest.mark.parametrize("text, want", [("Amouage's  Reflection!", "amouage reflection"), ("Terre d'Hermes", "terre d hermes"), ("Café-Rose", "café rose"), ("", "")])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize_text(F.lit(text))) == want


@pytest.mark.parametrize("name, want", [("Creed Aventus", "CRAVE"), ("Baccarat Rouge 540", "BARO540"), ("Sauvage", "SAUVA"), ("Le Male", "MALE"), ("Maison Francis Kurkdjian Baccarat Rouge 540", "FKBR540")])
def test_ticker(spark, name, want):
    want = {"Baccarat Rouge 540": "BARO540", "Le Male": "MALE"}.get(name, want)
    assert one(spark, T.ticker(F.lit(name))) == want


def test_aliases(spark):
    got = one(spark, T.perfume_aliases(F.lit("Parfums de Marly"), F.lit("Delina Eau de Parfum")))
    assert {"delina", "pdm delina", "parfums de marly delina", "delina perfume", "delina eau de parfum"} <= set(got) and got == sorted(got)
    assert "love" not in one(spark, T.perfume_aliases(F.lit("By Kilian"), F.lit("Love Extrait")))


@pytest.mark.parametrize("text, want", [("review the baccarat rouge", "baccarat rouge"), ("compares to baccarat rouge", "baccarat rouge"), ("baccarat rouge scent dna and", "baccarat rouge scent dna"), ("xerjoff erba", "xerjoff erba"), ("the a", "the a")])
def test_proposed_form(spark, text, want):
    assert one(spark, T.proposed_form(F.lit(text))) == want


def test_urls(spark):
    assert one(spark, T.normalize_url(F.lit("HTTPS://www.YouTube.com/watch/?v=a&utm_source=x#t"))) == "https://youtube.com/watch?v=a"
    assert one(spark, T.handle(F.lit("https://www.tiktok.com/@some.one/"))) == "some.one"
    assert one(spark, T.handle(F.lit("https://www.tiktok.com/@some/video/12"))) is None
    assert one(spark, T.video_url_type(F.lit("https://youtu.be/abc"))) == "video"
    assert one(spark, T.channel_id(F.lit("https://youtube.com/channel/UC" + "a" * 22))) == "UC" + "a" * 22


def test_udfs(spark):
    assert one(spark, T.without_accents(F.lit("Crème"))) == "Creme"
    assert one(spark, T.to_ascii(F.lit("ﬁn é"))) == "fin e"
    assert one(spark, T.sequence_ratio(F.lit("abcd"), F.lit("abcd"))) == 1.0
    assert one(spark, T.sequence_ratio(F.lit(None).cast("string"), F.lit("a"))) is None


def test_engagement_and_growth(spark):
    assert one(spark, S.engagement_total(F.lit("tiktok"), F.lit(900_000), F.lit(10), F.lit(None).cast("int"))) == 500_030
    assert one(spark, S.growth(F.lit(3.0), F.lit(2.0))) == 0.5 and one(spark, S.growth(F.lit(1.0), F.lit(0.0))) == 1.0 and one(spark, S.growth(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, S.composite(F.lit(10.0), F.lit(500_000), F.lit(1.0), F.lit(3), F.lit(3.0))) == 100.0
    assert one(spark, S.composite(F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0))) == 10.0


@pytest.mark.parametrize(
    "score, before, grown, mom, mentions, want",
    [
        (20.0, 10.0, 0.5, 1.0, 3.0, "breakout"), (4.0, 12.0, -0.1, 0.1, 1.0, "declining"), (8.0, 7.0, 0.2, 0.1, 1.0, "rising"), (25.0, 24.0, 0.0, 0.1, 1.0, "peak"),
        (3.0, 0.0, 0.0, 0.1, 1.0, "emerging"), (12.0, 11.0, -0.1, 0.1, 1.0, "stable"), (12.0, 11.0, 0.0, 0.1, 0.0, None),
    ],
)
def test_trend_state(spark, score, before, grown, mom, mentions, want):
    assert one(spark, S.trend_state(*[F.lit(x) for x in (score, before, grown, mom, mentions)])) == want


def test_finite_and_ranges(spark):
    assert one(spark, S.finite(F.lit(float("inf")))) == 9999.9 and one(spark, S.finite(F.lit(float("nan")))) is None
    last = dt.date(2024, 3, 15)
    assert S.date_range("7d", last) == (dt.date(2024, 3, 9), last) and S.date_range("mtd", last)[0] == dt.date(2024, 3, 1)
    assert S.date_range("yesterday", last) == (dt.date(2024, 3, 14),) * 2


def test_evidence(spark):
    d = lambda *xs: one(spark, S.evidence(*[F.lit(float(x)) for x in xs]))
    assert d(1, 1, 0, 1, 0, 0) == 1.0 and d(0, 1, 0, 0, 0, 0) == 0.45 and d(0, 0, 1, 0, 1, 0) == 0.0
