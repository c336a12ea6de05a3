"""Token counts, packing and mixing: exact round trips and counts."""

import collections
import random
import time
import zlib

import numpy as np
import pytest

from trendloom.llm import mixing, packing, tokens

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def own():
    return tokens.encoder(tokens.VOCABULARY)


def test_resynchronised_equals_whole(own):
    random.seed(1)
    alphabet = ["a", "bc", " ", "  ", "\n", "é", "你", "🙂", "'s", "12", ".", SPECIAL, "word", " the"]
    for _ in range(60):
        text = "".join(random.choices(alphabet, k=random.randint(0, 600)))
        assert own.resynchronised(text, random.choice((16, 50, 200)), random.choice((1, 4, 30))) == own.whole(text) == own.array_of(text, 16).tolist()
    assert own.resynchronised("x" * 3000, 100, 8) == own.whole("x" * 3000)  # no boundary at all


def test_second_encoder_equals_the_library(own):
    """Every code point in three contexts, and all texts of a table, long ones from stable boundary to stable boundary."""
    import duckdb

    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    lines = ["".join(f"{a}{c}{b}" for c in points[i : i + 256]) for a, b in (("a", " "), (" ", "1"), ("'", "\n")) for i in range(0, len(points), 256 * 7)]
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    for t in [*lines, *texts]:
        assert own.array_of(t).tolist() == own.whole(t)
    assert own.counts(texts[:50]) == [len(own.whole(t)) for t in texts[:50]]


def test_count_of_long_texts(own):
    """Counts without ids or offsets: equal to the library's, at little more than its time."""
    random.seed(5)
    words = ["don't", "l'été", "你好", "x1", "--", "🙂", "a_b", "\n", " ", "", "naïve", "<|endoftext|>", "3,000", "\u00b2", "e\u0301"]
    for _ in range(300):
        text = " ".join(random.choices(words, k=random.randrange(120)))
        assert own.count(text, random.choice((16, 50, 200)), random.choice((1, 4, 30))) == len(own.whole(text))
    assert own.count("x" * 3000, 100, 8) == len(own.whole("x" * 3000))
    text, took = " ".join(f"word{random.randrange(500)} of, the### text.'" for _ in range(20_000)), {own.count: [], own.whole: []}
    for _ in range(3):
        for f, seconds in took.items():
            began = time.process_time()
            f(text)
            seconds.append(time.process_time() - began)
    assert own.count(text) == len(own.whole(text))
    assert min(took[own.count]) < 1.8 * min(took[own.whole])


def test_token_counts_edges(spark, own):
    schema = "doc_id long, text string, n_tokens string"
    assert tokens.token_counts(spark.createDataFrame([], schema)).count() == 0
    long = ("some words, more words. " * 4000).strip()
    rows = [(1, None, "x"), (2, "", "x"), (3, "héllo", "x"), (3, "héllo", "x"), (4, long, "x"), (None, SPECIAL + " a", "x")]
    out = tokens.token_counts(spark.createDataFrame(rows, schema)).collect()
    want = sorted((len((t or "").encode()), len(own.whole(t or ""))) for _, t, _ in rows)
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)


def test_pack_is_a_partition_of_all_tokens(spark, own):
    random.seed(2)
    rows = [(i, " ".join(random.choices(["one", "two", "séven", "x"], k=random.choice((0, 3, 40, 300))))) for i in range(200)] + [(900, None), (3, "again"), (3, "again")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).collect()
    seqs = collections.defaultdict(list)
    for r in out:
        assert r.length * 4 == len(r.ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    back = collections.defaultdict(list)
    for r in out:
        back[r.doc_id].append((r.piece, r.start, bytes(r.ids)))
    for i, t in rows:
        if i != 3:
            whole = np.array([*own.whole(t or ""), 0], "<u4").tobytes()
            parts = sorted(back[i])
            assert b"".join(p[2] for p in parts) == whole and [p[1] * 4 for p in parts] == [sum(len(q[2]) for q in parts[:k]) for k in range(len(parts))]
            assert all(len(p[2]) == 256 for p in parts[1:])
    total = sum(r.length for r in out)
    assert len(seqs) <= -(-total // 64) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bin_completion_is_optimal_on_small_cases():
    random.seed(3)

    def optimum(items, capacity):
        best = [len(items)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[k] <= capacity and bins[j] not in bins[:j]:
                    go(k + 1, [*bins[:j], bins[j] + items[k], *bins[j + 1 :]])
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best[0]

    for _ in range(60):
        items = sorted((random.randint(1, 20) for _ in range(random.randint(1, 15))), reverse=True)
        plan = packing.bin_completion(collections.Counter(items), 20)
        used = collections.Counter()
        for chosen, times in plan:
            assert sum(chosen) <= 20
            for s in chosen:
                used[s] += times
        assert used == collections.Counter(items) and sum(t for _, t in plan) == optimum(items, 20)


def _best_fit_one_by_one(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [(r, k) for k, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit)[1]] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_search_beats_best_fit():
    random.seed(4)
    for _ in range(200):
        items = [random.randint(1, 60) for _ in range(random.randint(1, 40))]
        assert sum(t for _, t in packing.best_fit(collections.Counter(items), 100)) == _best_fit_one_by_one(items, 100)
    random.seed(1)
    counts = collections.Counter(random.randint(500, 800) for _ in range(3000))
    plan = packing.bin_completion(counts, 2048)
    used = collections.Counter()
    for chosen, times in plan:
        assert sum(chosen) <= 2048
        for s in chosen:
            used[s] += times
    start, bound = sum(t for _, t in packing.best_fit(counts, 2048)), packing.lower_bound(counts, 2048)
    assert used == counts and bound <= sum(t for _, t in plan) <= start - 20
    assert all(packing.lower_bound({a: 2, b: 3}, 100) <= 5 for a in range(1, 101) for b in range(1, 101) if a != b)


def test_pack_with_an_id_of_any_name(spark):
    rows = [(7, "a b", "x"), (7, "a b", "y"), (None, None, None)]
    out = packing.pack(spark.createDataFrame(rows, "Text_Id long, text string, length string"), doc_id="Text_Id", with_ids=False)
    assert out.columns[0] == "Text_Id" and sorted((r.Text_Id or 0, r.length) for r in out.collect()) == [(0, 1), (7, 3), (7, 3)]


def test_mixture_reaches_its_weights(spark):
    rows = [(i, "x" * 99, "big" if i % 10 else "small") for i in range(4000)] + [(5000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.02 and abs(n["small"] + n["big"] - 4000) < 200
    again = mixing.mix(docs, {"big": 1.0, "small": 3.0})
    assert again.select("doc_id", "copy").exceptAll(mixing.mix(docs, {"big": 1.0, "small": 3.0}).select("doc_id", "copy")).count() == 0


def test_poisson_counts_have_the_right_mean_and_variance(spark):
    rows = [(i, "y" * 9, "s") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r.doc_id: r["count"] for r in mixing.mix(docs, epochs=2.5, shuffled=False).groupBy("doc_id").count().collect()}
    k = np.array([copies.get(i, 0) for i in range(20000)])
    assert abs(k.mean() - 2.5) < 0.05 and abs(k.var() - 2.5) < 0.1


def test_mixture_edges(spark):
    schema = "doc_id long, text string, source string, copy string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(None, None, None, "mine"), (1, "", "a", "mine"), (1, "", "a", "mine")], schema)
    out = mixing.mix(one, epochs=50.0)
    assert dict(out.dtypes)["copy"] == "int" and out.where("doc_id = 1").count() % 2 == 0
    assert mixing.mix(one, {}).count() == 0
