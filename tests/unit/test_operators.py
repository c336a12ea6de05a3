"""Literal-input tests of operators, sources, sinks and streams."""

import datetime as dt
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from trendloom.operators import candidates as C
from trendloom.operators import creators as K
from trendloom.operators import resolver as R
from trendloom.operators import series as O
from trendloom.operators import topics as P
from trendloom.sources import normalize as N
from trendloom.sources import readers, sinks
from trendloom.streaming import jobs

DAY = dt.date(2024, 1, 1)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_one_item_counts_once_for_all_variants(spark):
    content = spark.createDataFrame([(1, "youtube", "a", DAY, 10, 1, 1, None), (2, "reddit", None, DAY, 5, 0, 0, 0.0)], "content_item_id int, platform string, author string, day date, views long, likes long, comments long, override double")
    ent = "content_item_id int, entities array<struct<name:string,confidence:double>>"
    resolved = spark.createDataFrame([(1, [("X Eau de Parfum", 0.5), ("X", 0.9)]), (2, [("X", 1.0)])], ent)
    (r,) = O.daily_series(content, resolved).collect()
    assert (r.entity_id, r.mention_count, r.unique_authors, r.engagement_sum, r.platforms, r.confidence_avg) == ("X", 1.2, 1, 23, 2, 0.5)


def _series(spark, values):
    return spark.createDataFrame([("e", DAY + dt.timedelta(days=d), m, s, mom) for d, m, s, mom in values], "entity_id string, day date, mention_count double, composite_score double, momentum double")


def test_signals(spark):
    s = _series(spark, [(0, 1.0, 5.0, 1.0), (1, 3.0, 20.0, 3.0), (2, 2.0, 8.0, 0.6)])
    got = [(r.day.day, r.signal_type) for r in O.signals(s).orderBy("day", "signal_type").collect()]
    assert got == [(1, "new_entry"), (2, "acceleration_spike"), (2, "breakout"), (3, "reversal")]


def test_carry_forward_is_silent_after_the_window(spark):
    s = _series(spark, [(0, 1.0, 5.0, 1.0)]).unionByName(_series(spark, [(12, 1.0, 5.0, 1.0)]).withColumn("entity_id", F.lit("f")))
    got = O.carry_forward(s).where("entity_id = 'e'").orderBy("day").collect()
    assert [r.day.day for r in got] == list(range(2, 9)) and {r.growth_rate for r in got} == {-1.0}


def test_resolver_guards_and_candidates(spark):
    aliases = spark.createDataFrame([("dior sauvage", 1, "Dior Sauvage", "Dior"), ("sauvage", 1, "Dior Sauvage", "Dior"), ("don", 2, "Don", "X"), ("lost cherry", 3, "Lost Cherry", "Tom Ford")], "alias string, entity_id int, name string, brand string")
    texts = spark.createDataFrame([("a", "I don't like Dior Sauvage, but lost cherry smells nice near chanel"), ("b", None)], "id string, text string")
    found = R.resolve(texts, aliases)
    assert {(r.entity_id, r.alias) for r in found.collect()} == {(1, "dior sauvage"), (3, "lost cherry")}
    guards = spark.createDataFrame([("lost cherry", ["tom", "ford"])], "alias string, brand_tokens array<string>")
    assert [r.entity_id for r in R.guard_phrases(found, texts, guards).collect()] == [1]
    brands = spark.createDataFrame([("chanel", "Chanel"), ("dior", "Dior")], "token string, brand string")
    assert {r.entity_id for r in R.drop_conflicts(found, texts, brands).collect()} == {1}
    phrases = {r.phrase for r in R.unresolved(texts, found).collect()}
    assert "smells nice" in phrases and not any("sauvage" in p or "cherry" in p for p in phrases)


def test_suppression_equals_the_greedy_pass(spark):
    import random

    random.seed(1)
    phrases = {" ".join(random.choices("abcd", k=random.randint(1, 4))): float(random.randint(1, 5)) for _ in range(120)}
    order = sorted(phrases, key=lambda p: (-phrases[p], -len(p), p))
    kept = []
    for p in order:
        if not any(f" {p} " in f" {q} " for q in kept):
            kept.append(p)
    got = C.suppress_contained(spark.createDataFrame(list(phrases.items()), "phrase string, score double"))
    assert sorted(r.phrase for r in got.collect()) == sorted(kept)


@pytest.mark.parametrize("phrase, want", [("a", "too_short"), ("http x", "url_artifact"), ("xkcdfg", "social_handle"), ("don t", "contraction_fragment"), ("of the", "all_stopwords"), ("dry down", "community_fragment"), ("12 3", "numeric_artifact"), ("this fragrance", "generic_fragrance_word"), ("dior homme", None)])
def test_noise(spark, phrase, want):
    assert spark.range(1).select(C.noise_reason(F.lit(phrase)).alias("x")).first().x == want


@pytest.mark.parametrize("phrase, want", [("abc", "too_short"), ("crème rose", "non_ascii"), ("aventus dupe", "descriptor_token:dupe"), ("rosy", "single_token_too_short"), ("24 faubourg", "digit_start"), ("dior homme", None)])
def test_safeguard(spark, phrase, want):
    assert spark.range(1).select(C.safeguard(F.lit(phrase)).alias("x")).first().x == want


def test_topics_and_profile(spark):
    t = spark.range(1).select(P.tag_topics(F.lit("Best vanilla dupe, VIRAL!"), F.lit(" My Query ")).alias("t")).first().t
    assert {(x.topic_type, x.topic_text) for x in t} == {("query", "my query"), ("topic", "vanilla"), ("topic", "dupe / alternative"), ("topic", "trending / viral")}
    counts = spark.createDataFrame([("e", "topic", "dupe / alternative", 3, 0.5), ("e", "topic", "vanilla", 2, 0.0)], "entity_id string, topic_type string, topic_text string, n long, avg_quality double")
    got = {r.kind: r.labels for r in P.semantic_profile(counts, F.lit("niche_original")).collect()}
    assert got == {"intents": ["alternative demand"], "positioning": ["vanilla"]}


def test_competitors(spark):
    q = F.array(F.lit("Creed Aventus vs Baccarat Rouge"), F.lit("Baccarat Rouge vs."), F.lit("dior sauvage review"), F.lit("creed aventus notes"))
    got = spark.range(1).select(P.competitors(q, F.lit("Creed Aventus")).alias("x")).first().x
    assert got == ["Baccarat Rouge", "dior sauvage review"]


def test_or_join_and_queue(spark):
    a = spark.createDataFrame([(1, "u", "x"), (2, None, "u"), (3, "v", "v")], "i int, url string, key string")
    b = spark.createDataFrame([(10, "u"), (11, "x")], "j int, url2 string")
    assert sorted(rows(K.or_join(a, b, ["url", "key"], "url2", "i", "j").select("i", "j"))) == [(1, 10), (1, 11), (2, 10)]
    old = spark.createDataFrame([(1, "done", 1), (2, "running", 1)], "k int, status string, priority int")
    new = spark.createDataFrame([(1, 2), (2, 2), (3, 3)], "k int, priority int")
    assert sorted(rows(K.queue_upsert(old, new, "k"))) == [(1, "pending", 2), (2, "running", 2), (3, "pending", 3)]
    with pytest.raises(ValueError):
        K.public_columns(a, ["i"])


def test_normalizers(spark, tmp_path):
    post = {"id": "p1", "title": "T", "selftext": "", "author": "me", "subreddit": "s", "permalink": "/r/s/1", "created_utc": 1704067200, "score": 7, "num_comments": 2}
    tok = {"id": "9", "desc": "nice #Oud", "createTime": 1704067200, "author": {"id": "1", "uniqueId": "who", "followerCount": 5}, "stats": {"playCount": 3}, "video": {"duration": 30}, "challenges": []}
    vid = {"fetched_at": "2024", "query": "q", "search_item": {"id": {"videoId": "v"}, "snippet": {"title": "old", "channelId": "c"}}, "video_details": {"snippet": {"title": "new"}, "statistics": {"viewCount": "12", "likeCount": "bad"}}}
    for name, raw, schema, fn in (("r", post, N.REDDIT, N.normalize_reddit), ("t", tok, N.TIKTOK, N.normalize_tiktok), ("y", vid, N.YOUTUBE, N.normalize_youtube)):
        (tmp_path / f"{name}.json").write_text(json.dumps(raw))
        r = fn(readers.read_json(spark, str(tmp_path / f"{name}.json"), schema)).first()
        assert len(r) == len(N.CONTENT_COLUMNS)
        if name == "r":
            assert (r.id, r.text_content, r.engagement.likes, r.engagement.views, r.published_at) == ("reddit_p1", "T", 7, None, "2024-01-01T00:00:00Z")
        if name == "t":
            assert (r.content_type, r.hashtags, r.text_content) == ("short", ["oud"], "nice #Oud #oud")
        if name == "y":
            assert (r.title, r.source_account_id, r.engagement.views, r.engagement.likes) == ("new", "c", 12, None)


def test_html(spark):
    html = '<html><title>T</title><h1 itemprop="name">Name</h1><meta itemprop="ratingValue" content="4.5"><p>for women, 2017</p><script>var x = "</p>";</script><a href="/a">l</a>'
    r = readers.enrichment_record(readers.parse_pages(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"))).orderBy("page_id").first()
    assert (r.title, r.perfume_name, r.rating_value, r.release_year, r.links) == ("T", "Name", 4.5, 2017, ["/a"]) and "var x" not in r.text


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "days")
    df = lambda *xs: spark.createDataFrame([(k, DAY + dt.timedelta(days=d), v) for k, d, v in xs], "k int, day date, v int")
    sinks.write_days(df((1, 0, 1), (1, 1, 2)), path)
    sinks.write_days(df((1, 1, 9)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]
    csv = str(tmp_path / "c")
    sinks.write_csv(spark.createDataFrame([(1, ["a", "b"], {"k": 1})], "i int, a array<string>, m map<string,int>"), csv)
    assert spark.read.option("header", True).csv(csv).first().asDict() == {"i": "1", "a": "a; b", "m": "k=1"}
    assert sinks.markdown(df((1, 0, 1)), "t").startswith("# t\n\n| k | day | v |")
    assert sinks.markdown(df((1, 0, 1), (2, 0, 1), (3, 0, 1)), "t", 2).endswith("|\n\nand 1 more\n") and "more" not in sinks.markdown(df((1, 0, 1)), "t", 1)


def test_stateful_streams(spark, tmp_path):
    src = str(tmp_path / "days")
    spark.createDataFrame([("e", DAY, 5.0, 1.0), ("e", DAY + dt.timedelta(days=1), 20.0, 3.0)], "entity_id string, day date, composite_score double, mention_count double").write.parquet(src)
    s = spark.readStream.schema("entity_id string, day date, composite_score double, mention_count double").parquet(src)
    q = jobs.previous_row_signals(s).writeStream.format("memory").queryName("sig").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.signal_type for r in spark.table("sig").collect()) == ["breakout", "new_entry"]


def test_text_queries_read_all_turns_and_whole_texts(spark, tmp_path):
    from trendloom.plans import catalog

    late = "Crème Brûlée vanilla amber saffron leather tonka patchouli bergamot Élixir"
    rows = [("c", 0, "user", "hello"), ("c", 1, "assistant", late), ("c", 2, "user", None)]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    keys = {r.turn: r for r in catalog.QUERIES["accent_keys"](spark, str(tmp_path)).collect()}
    plain = lambda s: "".join(x for x in unicodedata.normalize("NFD", s) if not unicodedata.combining(x))
    assert set(keys) == {0, 1, 2} and keys[1].plain == plain(late.lower()) and keys[1].ascii == plain(late.lower())
    assert keys[1].slug == plain(late.lower()).replace(" ", "-") and keys[2].plain is None
    words = {r.turn: r.keywords for r in catalog.QUERIES["query_keywords"](spark, str(tmp_path)).collect()}
    tokens = [w for w in re.sub("[^a-z0-9]+", " ", late.lower()).split()]
    assert set(words) == {0, 1, 2} and words[0] == ["hello"] and words[1] == sorted(set(tokens), key=lambda w: (-len(w), w))[:4]
    got = [(r.turn, r.phrase) for r in catalog.QUERIES["candidate_phrases"](spark, str(tmp_path)).collect()]
    assert (0, "hello") in got and (1, "saffron leather tonka patchouli") in got and (1, "vanilla amber saffron") in got


def _against_sql(spark, path, name, order=sorted):
    """Rows of a query over the conversations below a folder, and those of its SQL."""
    import duckdb

    from trendloom.plans import catalog

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, str(path))
    assert sorted(got.columns) == sorted(want.columns)
    return order([tuple(r) for r in got.select(*want.columns).collect()]), order(want.fetchall())


WORDS_BESIDE_LETTERS = ("éàdes fin", "thé DERé", "oft théàof", "ʼund ünder undé", "ofé", "CANCIÓN", "canción", "CANCİÓN", "cancıón", "canciON", "deſ x", "deſx", "İdes", "ıdes ı", "١٢٣٤ 123", "12345", "x1234", "", "nothing", None)


def test_topic_tags_as_in_sql(spark, tmp_path):
    rows = [(k, k % 3, "user", x) for k, x in enumerate(WORDS_BESIDE_LETTERS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = _against_sql(spark, tmp_path, "topic_tags")
    assert got == want and (0, 0, "french") in got and (5, 2, "spanish") in got and not any(r[0] in (7, 8, 14) for r in got)


def test_topic_distribution_as_in_sql(spark, tmp_path):
    rows = [(k - 10, k % 3, "user", x) for k, x in enumerate(WORDS_BESIDE_LETTERS)]
    rows += [(100 * k + 4, 1 if k < 57 else 0, "user", "of") for k in range(800)]  # the mean is 0.07125, its product with 10,000 less than 712.5
    rows += [(None, 5, "user", "und"), (-7, None, "user", "und")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    key = lambda rows: sorted(rows, key=str)
    got, want = _against_sql(spark, tmp_path, "topic_distribution", key)
    assert got == want and ("english", 4, 800, 0.0712) in got and any(r[1] is not None and r[1] < 0 for r in got)


def test_candidate_phrases_as_in_sql(spark, tmp_path):
    random.seed(5)
    words = "scent perfume fragrances the of and is best top 10 7 worst to review compares rose amber oud é éedp edp étop we chat far from body spray eau de parfum it would be new fragrance releases out a ñ 12a _x t".split()
    texts = [" ".join(random.choices(words, k=random.choice((1, 2, 3, 4, 5, 6, 9, 30)))) for _ in range(300)]
    texts += ["Rose\u00a0Amber\u3000Oud", "İris ΟΔΟΣ ΣΑΣ", "a²b ½ x‿y", "scent " * 8 + "rose", "rose " * 9, "scent " * 6, "perfume perfume top 10 perfume", "Eau de Parfum", "EDP edp rose body  spray", "...", "", " ", None, "ü", "9", "rose\x0bamber\nnoir\ttea"]
    texts += ["grab them here " + "rose amber oud noir " * 3, "the best of the best of the best", "best review top", "étop 10 rose", "top 10é rose", "top 10a rose"]
    rows = [(k, k % 3, "user", x) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = _against_sql(spark, tmp_path, "candidate_phrases")
    assert got == want and len(got) > 5000


def test_candidate_phrases_judges_rows_in_compiled_code(spark, sf_dir):
    """Nothing that stands above the phrases' rows is interpreted, and no filter works the phrases out twice."""
    from trendloom.plans import catalog

    plan = catalog.QUERIES["candidate_phrases"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.rpartition("Generate explode")
    assert "lambda" in below and "lambda" not in above and not re.search(r"\bFilter ", below)


def test_substring_matches_at_any_number_of_names(spark, monkeypatch):
    from trendloom.operators import catalog as G

    monkeypatch.setattr(G, "MOST_NAMES", 0, raising=False)  # as if there were more names than any bound
    random.seed(3)
    names = ["Rosewood Oil", "rosewood", "Amber", "a b c d e f g h i j", "Oud", "x" * 30] + ["".join(random.choices("abC ", k=random.randint(1, 9))) for _ in range(150)]
    texts = ["rose", "ROSEWOOD", "wood o", "my amberine note", "", "o", None, "a b c d e f g h i j k l m n", "xxxxxx"] + ["".join(random.choices("abC ", k=random.randint(0, 14))) for _ in range(150)]
    want = {}
    for x in texts:
        hits = [y for y in names if x is not None and len(y) >= 5 and (x.lower() in y.lower() or y.lower() in x.lower()) and x.lower() != y.lower()]
        if hits:
            want[x] = max(hits, key=lambda y: (len(y), y))
    out = G.substring_matches(spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(y,) for y in names], "name string"))
    assert {r.text: r.match for r in out.collect()} == want and len(want) > 30


def test_fuzzy_pairs_lose_nothing(spark):
    import difflib

    from trendloom.functions import text as T
    from trendloom.operators import resolver as R

    random.seed(4)
    names = sorted({"".join(random.choices("abc d", k=random.randint(1, 14))).strip() for _ in range(120)} - {""})
    edit = lambda n, k: n[:k] + random.choice(["", "x", "ab"]) + n[k + 1 :]
    texts = sorted({edit(random.choice(names), k) for k in range(8) for _ in range(25)} | set(names[:5]) | {"", "A"})
    a, b = spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.text, r.name): r.ratio for r in R.fuzzy_pairs(a, b, 0.88).collect()}
    want = {(t, n): difflib.SequenceMatcher(None, t.lower(), n).ratio() for t in texts for n in names}
    assert got == {k: v for k, v in want.items() if v >= 0.88} and len(got) > 60
    close = {(r.text, r.name) for r in R.fuzzy_pairs(a, b, 0.8, T.indel_ratio).collect()}
    assert close == {(t, n) for t in texts for n in names if 2 * T.common_subsequence(t.lower(), n) >= 0.8 * (len(t) + len(n)) - 1e-12}
    assert T.common_subsequence("abcbdab", "bdcaba") == 4 and T.common_subsequence("", "a") == 0


def test_dictionary_join_by_shuffle_and_by_broadcast_agree(spark, monkeypatch):
    from trendloom.operators import resolver as R

    texts = spark.createDataFrame([(k, "say dior sauvage elixir and ﬁne Ｄｉｏｒ now" if k % 2 else "sauvage two dior sauvage") for k in range(40)], "id long, text string")
    aliases = spark.createDataFrame([("dior sauvage", 1, "DS", "dior"), ("dior sauvage elixir", 2, "DSE", "dior"), ("fine dior", 3, "FD", "dior"), ("two", 4, "T", "x")], "alias string, entity_id long, name string, brand string")
    rows = lambda: sorted((r.id, r.pos, r.alias) for r in R.matches(texts, aliases).collect())
    one = rows()
    monkeypatch.setattr(R, "MOST_BROADCAST", -1)
    assert rows() == one
    want = {(1, 1, "dior sauvage"), (1, 1, "dior sauvage elixir"), (1, 5, "fine dior"), (0, 2, "dior sauvage")}  # 'two' alone is never matched
    assert {x for x in one if x[0] < 2} == want
