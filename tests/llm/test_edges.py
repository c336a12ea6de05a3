"""Bounded samples, clashing columns, long texts, and brute force of the three classifiers' whole queries."""

import math
import random
import statistics
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import exact_dedup, langid, mixing, quality, tokens, toxicity
from trendloom.llm.common import bounded_sample, sample_threshold, training_rows, without


def test_sample_threshold_at_any_size():
    for most in (4_000, 20_000, 400_000):
        for n in (most + 1, 10**6, 10**9, 10**11, 10**15):
            expected = n * (sample_threshold(n, most) + 1) / 2**63
            assert expected >= min(n, most + 5 * most**0.5) and expected <= max(most + 8 * most**0.5 + 20, 1)
    assert sample_threshold(10, 20) == 2**63 - 1


def test_bounded_sample(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10).alias("text"))
    got = bounded_sample(rows, "doc_id", 20_000, 500).collect()
    assert len(got) == 500 == len({r.doc_id for r in got}) and got == bounded_sample(rows.repartition(7), "doc_id", 20_000, 500).collect()
    assert max(r.doc_id for r in got) > 15_000
    hot = spark.range(5_000).select(F.lit(3).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert bounded_sample(hot, "doc_id", 5_000, 100).count() in (0, 100)  # one id is all in or all out, and bounded
    assert bounded_sample(hot, "doc_id", 100, 100).count() == 100
    few = bounded_sample(rows, "doc_id", 20_000, 500, F.length("text"), 645).collect()
    assert len(few) == 64 and bounded_sample(rows, "doc_id", 20_000, 500, F.length("text"), 600).count() == 0  # no row may fill the sample
    assert without(["A", "b", "Text"], "text", "a") == ["b"]


def test_huge_texts_do_not_end_a_sample(spark):
    limit = 64_000
    size = F.octet_length("text")
    h = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    first = [r.doc_id for r in spark.range(1_000).select(F.col("id").alias("doc_id")).orderBy(h).limit(700).collect()]
    docs = spark.range(1_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == first[0], F.repeat(F.lit("x"), 70_000)).otherwise(F.repeat(F.lit("y"), 20)).alias("text")).cache()
    assert bounded_sample(docs, "doc_id", 1_000, 500, size, limit).count() >= 499
    labels = docs.select("doc_id", F.lit(1).alias("y"))
    got = training_rows(docs, labels, "y", F.lit(True), "text", "doc_id", 500, limit)
    assert got.count() >= 499 and got.agg(F.max(size)).first()[0] == 20  # the huge text never reaches the driver
    many = docs.withColumn("text", F.when(F.col("doc_id").isin(first), F.repeat(F.lit("x"), 2_000)).otherwise(F.col("text")))
    got = training_rows(many, labels, "y", F.lit(True), "text", "doc_id", 200, limit)
    assert got.count() == 200 and got.agg(F.max(size)).first()[0] == 20  # a wider draw makes up for what is left out
    assert training_rows(docs.where(f"doc_id = {first[0]}"), labels, "y", F.lit(True), "text", "doc_id", 500, limit).count() == 0


def test_quality_does_not_depend_on_neighbours():
    model = quality.fit(["aa bb cc. dd", "11 22 33", "a", "ab", "zz 9"] * 4, np.array([1, 0, 1, 1, 0] * 4))
    other = "Some other text of many words, and more."
    for text in ["", "a", "1", "ab", "a ", " b", "a b", "abc", "a\nb", "é", "abcd", "a bc", "11 2"]:
        alone, scores = None, []
        for block in ([text], [text, other], [other, text], [other, text, other], [text, text], ["", text, "x"]):
            raw = [t.encode() for t in block]
            at = np.cumsum([0, *map(len, raw)])
            found = quality.raw_features(np.frombuffer(b"".join(raw), np.uint8), at)
            k = block.index(text)
            alone = found[k] if alone is None else alone
            assert (found[k] == alone).all(), (text, block)
            scores.append(found[k])
    assert model is not None


@pytest.mark.parametrize("rate", [0.0, 0.3, 7.0, 399.0, 401.0, 5e4, 1e7])
def test_counts_of_any_rate(spark, rate):
    steps = spark.createDataFrame([("s", 1, rate)], "_source string, _size long, _rate double")
    got = mixing.with_distribution(steps).crossJoin(spark.createDataFrame([(u,) for u in (0.0, 1e-9, 0.01, 0.3, 0.5, 0.9, 0.999999)], "_u double")).select("_u", F.expr(mixing._COUNT).alias("n")).collect()
    if rate == 0:
        assert all(r.n == 0 for r in got)
    for r in got if rate else []:
        spread = max(1.0, rate**0.5)
        if rate < 1_000:  # the definition itself, in decimal arithmetic
            p, c, n = math.exp(-rate) if rate < 700 else 0.0, 0.0, 0
            while c + p <= r._u:
                c, n = c + p, n + 1
                p *= rate / n
            assert abs(r.n - n) <= (0 if 1e-6 < r._u < 0.99999 else 1)
        elif r._u == 0:
            assert r.n == 0
        else:  # the normal quantile with its first correction
            z = statistics.NormalDist().inv_cdf(min(max(r._u, 1e-12), 1 - 1e-12))
            assert abs(r.n - (rate + z * spread + (z * z - 1) / 6)) < 2 + 0.01 * spread


def test_copies_of_one_document_are_dealt_out(spark):
    docs = spark.createDataFrame([(1, "", "rare"), *[(k, "word " * 200, "big") for k in range(2, 40)]], "doc_id long, text string, source string").repartition(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    mixed = mixing.mix(docs, shuffled=False)
    per = {r.doc_id: r for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m")).collect()}
    assert per[1].n == per[1].d == per[1].m > 3 * mixing.BLOCK
    tasks = mixed.where("doc_id = 1").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < per[1].n
    with pytest.raises(ValueError):
        mixing.mix(docs, epochs=1e8)


def test_columns_that_clash_in_any_case(spark):
    docs = spark.createDataFrame([(1, "some words of text", 1, 2, 3, 4, 5)], "doc_id long, text string, Score int, PREDICTED int, Lang_Pred int, N_Tokens int, Keep_Id int")
    q = quality.fit(["aa bb cc", "11 22 33"], np.array([1, 0]))
    t = toxicity.fit(["aa bb cc", "11 22 33"], np.array([1, 0]))
    m = langid.fit(["der und die", "the of and"], ["de", "en"])
    for out, made in (
        (quality.score(docs, q), {"score", "predicted"}), (toxicity.score(docs, t), {"score", "predicted"}), (langid.identify(docs, m), {"lang_pred", "score", "spans"}),
        (tokens.token_counts(docs), {"n_bytes", "n_tokens", "over_limit"}), (exact_dedup.exact_dedup(docs), {"keep_id"}),
    ):
        low = [c.lower() for c in out.columns]
        assert len(low) == len(set(low)) and made <= set(out.columns) and out.count() == 1
    assert mixing.mix(docs.withColumn("source", F.lit("s"))).count() >= 0


def test_more_languages_than_a_byte_holds():
    names = [f"l{k:03d}" for k in range(200)]
    random.seed(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    own = {n: ["".join(random.choices(alphabet, k=6)) for _ in range(8)] for n in names}
    m = langid.fit([" ".join(random.choices(own[n], k=60)) for n in names], names)
    got, score, _ = langid.predict(m, [" ".join(own[n] * 3) for n in names] + [None, "12 34"])
    assert np.mean([a == b for a, b in zip(got, names, strict=False)]) > 0.95 and got[-2:] == ["und", "und"] and score[-1] == 0


def test_long_texts_are_taken_in_pieces(monkeypatch):
    random.seed(2)
    de, en = ("der und die das ist nicht " * 30).strip(), ("the of and is not with " * 30).strip()
    m = langid.fit([de, en] * 20, ["de", "en"] * 20)
    whole, parts = langid.predict(m, [de + " " + en, en, None]), langid.predict(m, [de + " " + en, en, None], segment=50)
    assert whole[0] == parts[0] and whole[2] == parts[2] and np.allclose(whole[1], parts[1])
    assert "".join(langid.segments(de, 37)) == de and max(map(len, langid.segments("x" * 100, 37))) == 37
    text = " ".join(random.choices(["Bad", "word", "été", "\t\n", "🙂x"], k=500))
    one = np.sort(toxicity.gram_hashes(toxicity.characters(text)))
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert (np.sort(toxicity.gram_hashes(toxicity.characters(text))) == one).all()
    raw = np.frombuffer((de + " " + en).encode(), np.uint8)
    before = quality.raw_features(raw, np.array([0, 400, len(raw)]))
    monkeypatch.setattr(quality, "PIECE", 128)
    after = quality.raw_features(raw, np.array([0, 400, len(raw)]))
    assert np.abs(before - after).max() < 0.1 and np.allclose((after**2)[:, : quality.SHAPES].sum(axis=1), 1)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A small table with labels: edges, ties, repeated rows, mixed languages."""
    random.seed(7)
    where, words = str(tmp_path_factory.mktemp("small")), {"en": "the of and shore thing with from".split(), "de": "und der die schön nicht über".split()}
    docs, labels = [], []
    for i in range(240):
        lang = random.choice(("en", "de"))
        bad, poor = i % 5 == 1, i % 3 == 0
        text = " ".join(random.choices(words[lang] + ["idiot", "scum"] * bad, k=random.randint(5, 40)))
        docs.append((i, text.upper() + "!!" if poor else text, lang, f"s{i % 4}", len(text)))
        labels.append((i, 0 if poor else 1, int(bad)))
    docs += [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, " \n", "de", "s", 0), (303, docs[4][1], None, None, None), (304, "12 ?!", "en", "s", 3), (305, "the und the und schön", None, "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, docs, {i: (q, t) for i, q, t in labels}


def _remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_quality_query_against_brute_force(spark, small):
    where, docs, labels = small
    known = sorted((i, t) for i, t, *_ in docs if i in labels and _remainder(i, 4) != 2)
    model = quality.fit([t for _, t in known], np.array([labels[i][0] for i, _ in known]))

    def vector(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        f = quality.raw_features(raw, np.array([0, len(raw)]))[0].astype(np.float64)
        if not f.any():
            return np.zeros(quality.RANK)
        z = (f * model.idf - model.mean) @ model.basis
        return z / np.linalg.norm(z)

    space = [vector(t) for _, t in known]
    got = {r.doc_id: r for r in quality.query(spark, where).collect()}
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        v = vector(t)
        near = sorted((-round(float(v @ x), 6), k) for k, x in enumerate(space))[: quality.NEIGHBOURS]
        weights = [(max(0.0, -c) ** 4, labels[known[k][0]][0]) for c, k in near]
        total = sum(w for w, _ in weights)
        want = sum(w * y for w, y in weights) / total if total > 1e-9 else model.prior
        assert abs(got[i].score - want) < 2e-3 and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (_remainder(i, 4) == 2)
    assert got[303].score == got[4].score and got[300].score == got[301].score == model.prior


def test_toxicity_query_against_brute_force(spark, small):
    where, docs, labels = small
    known = sorted((i, t) for i, t, *_ in docs if i in labels and _remainder(i, 5) != 0)
    y = np.array([labels[i][1] for i, _ in known], float)
    mask, odd = (1 << 64) - 1, 0xBF58476D1CE4E5B9

    def buckets(text):
        low, out = " ".join((" " + (text or "").lower() + " ").replace("\t", " ").replace("\n", " ").split(" ")), Counter()
        while "  " in low:
            low = low.replace("  ", " ")
        for k, order in enumerate(toxicity.ORDERS):
            for a in range(len(low) - order + 1):
                h = 0
                for c in low[a : a + order]:
                    h = (h * 0x100000001B3 + ord(c) + 1) & mask
                h = ((h ^ h >> 29) * odd) & mask
                out[(h >> 64 - toxicity.BITS) + (k << toxicity.BITS)] += 1
        return set(out) | {g + toxicity.SIZE for g, n in out.items() if n > 1}

    sets = [buckets(t) for _, t in known]
    p, q = defaultdict(lambda: 1), defaultdict(lambda: 1)
    for s, label in zip(sets, y, strict=True):
        for g in s:
            (p if label else q)[g] += 1
    ratio = {}
    for g in set().union(*sets):
        r = math.log(p[g] / (y.sum() + 1)) - math.log(q[g] / (len(y) - y.sum() + 1))
        if p[g] + q[g] - 2 >= 3 and abs(r) >= 1.5:
            ratio[g] = r
    model = toxicity.fit([t for _, t in known], y)
    assert set(np.flatnonzero(model.weights).tolist()) <= set(ratio) and ratio
    got = {r.doc_id: r for r in toxicity.query(spark, where).collect()}
    for i, t, *_ in docs:
        z = model.bias + sum(float(model.weights[g]) for g in buckets(t)) if t else model.bias
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-5 and got[i].held_out == (_remainder(i, 5) == 0)
    z = np.array([model.bias + sum(float(model.weights[g]) for g in s) for s in sets])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    err = weight * (1 / (1 + np.exp(-z)) - y)
    assert abs(err.sum() / len(y)) < 0.02 and np.mean((z >= 0) == (y > 0)) > 0.97  # the slope of the fitted loss is near zero


def test_language_query_against_brute_force(spark, small):
    where, docs, _ = small
    known = [(t, lang) for i, t, lang, *_ in sorted(docs, key=lambda d: d[0]) if t is not None and lang and _remainder(i, 4) != 2]
    model = langid.fit([t for t, _ in known], [lang for _, lang in known])
    counts = {lang: Counter() for lang in model.languages}
    for t, lang in known:
        counts[lang].update(langid.words([t])[0].tolist())
    for k, lang in enumerate(model.languages):
        total = sum(counts[lang].values()) + 0.5 * (1 << langid.BITS)
        for g, n in list(counts[lang].items())[:50]:
            assert abs(model.table[g, k] - math.log((n + 0.5) / total)) < 1e-4
    got = {r.doc_id: r for r in langid.query(spark, where).collect()}
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        words = ["".join(c if c.isalpha() else " " for c in (t or "").lower())][0].split()
        best = {lang: (0.0, []) for lang in model.languages} if words else {}
        for n, w in enumerate(words):
            grams, _, _, scripts, _ = langid.words([w])
            s = {lang: sum(float(model.table[g, k]) for g in grams) if model.allowed[scripts[0], k] else -1e9 for k, lang in enumerate(model.languages)}
            if n == 0:
                best = {lang: (s[lang], [lang]) for lang in s}
                continue
            top = max(model.languages, key=lambda x: best[x][0])
            best = {x: max(((best[x][0], best[x][1]), (best[top][0] - langid.SWITCH, best[top][1])), key=lambda c: c[0]) for x in model.languages}
            best = {x: (v + s[x], [*path, x]) for x, (v, path) in best.items()}
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        path = max(best.values(), key=lambda c: c[0])[1]
        share = Counter()
        for w, x in zip(words, path, strict=True):
            share[x] += len(w)
        lang, n = max(share.items(), key=lambda c: (c[1], c[0] == model.languages[0]))
        assert got[i].lang_pred == lang and abs(got[i].score - n / sum(share.values())) < 1e-9 and got[i].held_out == (_remainder(i, 4) == 2)
