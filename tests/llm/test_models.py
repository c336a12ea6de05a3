"""Language, quality and toxicity: held-out accuracy, brute-force Viterbi, edge cases."""

import itertools
import random
import zlib

import numpy as np

from trendloom.llm import langid, quality, toxicity

WORDS = {"aa": ["thing", "shore", "water", "other"], "bb": ["über", "straße", "schön", "wirklich"], "cc": ["привет", "слово", "река"]}


def _texts(n=120):
    random.seed(1)
    langs = [random.choice(list(WORDS)) for _ in range(n)]
    return [" ".join(random.choices(WORDS[x], k=random.randint(1, 30))) for x in langs], langs


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 5, 0, 6, 3])
    scores = rng.standard_normal((15, 3)) * 4
    got = langid.viterbi(scores, sizes, 2.0)
    at = 0
    for n in sizes:
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(scores[at + t, x] for t, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[at : at + n]) == best
        at += n


def test_language_of_mixed_texts():
    texts, langs = _texts()
    model = langid.fit(texts, langs)
    named, score, spans = langid.predict(model, ["thing water shore", "привет слово", "water water thing thing über schön straße wirklich straße schön", None, "", "123 !?"])
    assert named[:2] == ["aa", "cc"] and named[3:] == ["und"] * 3 and list(score[3:]) == [0, 0, 0]
    assert [x[0] for x in spans[2]] == ["aa", "bb"] and sum(n for _, n in spans[2]) == 10


def test_language_edges(spark):
    model = langid.fit(*_texts())
    schema = "doc_id long, text string, score string"
    assert langid.identify(spark.createDataFrame([], schema), model).count() == 0
    rows = [(1, None, "x"), (2, "thing " * 5000, "x"), (2, "thing " * 5000, "x"), (None, "schön", "x")]
    out = langid.identify(spark.createDataFrame(rows, schema), model).collect()
    assert sorted(r.lang_pred for r in out) == ["aa", "aa", "bb", "und"] and all(0 <= r.score <= 1 for r in out)
    assert langid.predict(langid.fit([], []), ["thing"])[0] == ["und"]


def test_language_held_out(spark):
    out = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out AND lang IS NOT NULL")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()


def test_quality_held_out(spark):
    out = quality.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert set(out.held_out) == {True, False}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out.doc_id, out.held_out, strict=True))
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95


def test_votes_against_brute_force():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((50, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = (rng.random(50) > 0.5).astype(np.float32)
    model = quality.Model(None, None, None, v, y, 0.4)
    z = np.concatenate([v[:5], np.zeros((1, 8), np.float32)])
    got = quality.votes(model, z, neighbours=7)
    for row, p in zip(z[:5], got[:5], strict=True):
        cos = v @ row
        near = np.argsort(-cos)[:7]
        w = np.clip(cos[near].astype(float), 0, None) ** 4
        assert abs(p - (w * y[near]).sum() / w.sum()) < 1e-5
    assert got[5] == 0.4


def test_model_edges(spark):
    schema = "doc_id long, text string, predicted string"
    for module in (quality, toxicity):
        empty = module.fit([], np.zeros(0))
        assert module.score(spark.createDataFrame([], schema), empty).count() == 0
        model = module.fit(["good plain words"] * 6 + ["BAD!! BAD!! $$$"] * 6 + [None, ""], np.array([1] * 6 + [0] * 6 + [1, 0]))
        rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "good plain words " * 20000, "x"), (None, "BAD!! $$$", "x")]
        out = module.score(spark.createDataFrame(rows, schema), model).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
        assert module.fit(["a", "b"], np.array([1, 1])) is not None


def test_toxicity_held_out(spark):
    out = toxicity.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() >= 0.97
    assert out[out.toxic == 1].predicted.mean() >= 0.85 and out[out.toxic == 0].predicted.mean() <= 0.01
