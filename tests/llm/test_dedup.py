"""Exact, SimHash, line and embedding dedup against brute force, with edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from trendloom.llm import embedding_dedup, exact_dedup, line_dedup, simhash
from trendloom.llm.common import components, connected, forest

SPACES = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, kept string, _row int"


def test_exact_against_brute_force(spark):
    random.seed(1)
    words = ["a", "b", "aa", "é", "🙂", ""]
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 6)))) for i in range(300)]
    rows += [(300 + i, "x" * 5000 + "y" * (i % 3) + "z" * 3000) for i in range(12)]
    rows += [(400, None), (401, ""), (402, "  "), (403, " \t\n "), (404, "a\tb"), (405, "a b")]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=7).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub(" ", t or ""), []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "same", "mine", 5), (1, "same", "mine", 5), (None, "same", None, None), (None, "alone", None, None)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 4 and sum(r.kept for r in out if r.text == "same") == 1
    assert {r.keep_id for r in out if r.text == "same"} == {1} and all(r._row in (5, None) for r in out)


def test_components_of_paths_and_stars(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    random.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text, n):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    s = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    random.seed(3)
    rows = [(i, " ".join(random.choices(["Ab", "c", "É", "d\te", "F\n"], k=random.randint(0, 700)))) for i in range(40)] + [(50, None), (51, " "), (52, "one two")]
    got = {r.doc_id: r._fp & (2**64 - 1) for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: _fingerprint(t, 3) for i, t in rows}


def test_links_within_three_bits_are_complete(spark):
    random.seed(4)
    base = [random.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:40]:
        for _ in range(6):
            x = b
            for bit in random.sample(range(64), random.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    for bit in range(30):  # a chain and a dense cloud
        fps.add(base[50] ^ (1 << bit))
    fps = sorted(fps)
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    frame = spark.createDataFrame(signed, "_fp long")
    edges = simhash.links(frame, len(fps))
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    got = {r.node & (2**64 - 1): r.component for r in components(edges).collect()}
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(1)
        if (new == label).all():
            break
        label = new
    for i in range(len(a)):
        for j in range(i):
            same = got.get(fps[i], ("own", i)) == got.get(fps[j], ("own", j))
            assert same == (label[i] == label[j])


def test_simhash_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, None), (3, ""), (4, " \n"), (9, "just some words here"), (9, "just some words here"), (None, "just some words here")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6 and {r.component_id for r in out} == {3, 9}


def _line_brute(rows, least):
    """Delete word j iff it lies in a stretch of `least` words that begins after an earlier equal stretch ended."""
    seen, out = {}, {}
    for order, (i, text) in enumerate(rows):
        tokens = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text or "")
        words, gone = [x.strip(" \t\n\v\f\r") for x in tokens], set()
        for a in range(len(words) - least + 1):
            first = seen.setdefault(tuple(words[a : a + least]), (order, a))
            if order != first[0] or a >= first[1] + least:
                gone |= set(range(a, a + least))
        lead = re.match(r"[\x20\x09-\x0D]*", text or "")[0]
        kept = lead + "".join(x for k, x in enumerate(tokens) if k not in gone)
        out[i] = (None if text is None else kept.rstrip(" \t\n\v\f\r") if len(tokens) - 1 in gone else kept, len(tokens), len(gone))
    return out


def _lines_got(spark, rows, least):
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()
    return {r.doc_id: (r.text, r.n_words, r.n_removed) for r in out}


def test_lines_against_brute_force(spark):
    random.seed(5)
    pool = [" ".join(random.choices("abcdefg", k=random.choice((1, 2, 3, 7)))) for _ in range(12)]
    join = lambda parts: "".join(x + random.choice((" ", "\n", "\n\n", " \t")) for x in parts)
    rows = [(i, random.choice(("", " ", "\n")) + join(random.choice([*pool, "u%d" % random.randrange(999)]) for _ in range(random.randint(0, 14)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, " \n"), (93, "a " * 40), (94, "a b " * 30), (95, "é🙂 " * 20)]
    want = _line_brute(rows, 6)
    got = _lines_got(spark, rows, 6)
    assert got == want and sum(x[2] for x in got.values()) > 100


def test_passages_inside_lines(spark):
    """Passages of 51 words that begin and end inside lines, in many documents, and one document that repeats a longer part."""
    random.seed(9)
    own = lambda k: " ".join("v%d" % random.randrange(10**6) for _ in range(k))
    passage = own(51)
    rows = [(i, f"{own(30)} {passage} {own(20)}\n{own(9)}") for i in range(40)]
    rows += [(40, f"{own(5)} {rows[3][1][10:]}"), (41, rows[7][1]), (42, passage[: len(passage) // 2])]
    want = _line_brute(rows, 50)
    assert _lines_got(spark, rows, 50) == want
    assert all(want[i][2] == 51 for i in range(1, 40)) and want[0][2] == want[42][2] == 0 and want[41][0] == ""


def test_line_edges(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, long, "k", 1), (1, f"intro\n{long}\noutro", "k", 2), (2, long, "k", 1), (None, long, None, None)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.text for r in out) == ["", "", "", f"intro\n{long}\noutro"]
    assert all(r.kept in ("k", None) for r in out)
    clash = spark.createDataFrame([(1, "a", 5, "x", 3)], "doc_id long, text string, N_Words int, _cuts string, _c0 int")
    assert line_dedup.line_dedup(clash).collect()[0].asDict() == {"doc_id": 1, "text": "a", "_cuts": "x", "_c0": 3, "n_words": 1, "n_removed": 0}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 24))
    near = base[:150] + 0.08 * rng.standard_normal((150, 24))
    chain = base[0] + 0.2 * np.cumsum(rng.standard_normal((20, 24)) * 0.5, axis=0)
    x = np.concatenate([base, near, chain, base[:30], 2 * base[30:40]]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(len(x))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] + [1.0] * 23, 0), (n + 3, [None] + [1.0] * 23, 0), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:8], 0), (n + 6, [], 0)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.arange(n) % 2
    link = ((u @ u.T) >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    assert {i: got[i].n_links for i in range(n)} == {i: int(link[i].sum()) for i in range(n)}
    comp, reach = np.arange(n), link | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, comp[None, :], n).min(1)
        if (new == comp).all():
            break
        comp = new
    assert {i: got[i].component_id for i in range(n)} == {i: int(comp[i]) for i in range(n)}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 7))


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.embedding_links(spark.createDataFrame([], schema)).count() == 0
    out = embedding_dedup.embedding_links(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in out) == [(0, 0), (1, 1), (2, 1)]


def test_similar_documents_recall_and_precision(spark):
    random.seed(7)
    rows, similarity = [], []
    vocabulary = [f"w{i}" for i in range(3000)]
    for g in range(120):
        base = random.choices(vocabulary, k=200)
        copy = list(base)
        for i in random.sample(range(200), (1, 2, 30)[g % 3]):
            copy[i] = "x"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        a, b = (set(zip(*[t[k:] for k in range(5)])) for t in (base, copy))
        similarity.append(len(a & b) / len(a | b))
    rows += [(900, None), (901, ""), (None, "w1 w2")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[901] == 900
    found = np.array([got[2 * g + 1] == 2 * g for g in range(120)])
    s = np.array(similarity)
    assert found[s >= 0.9].mean() >= 0.95 and not found[s < 0.6].any()
    assert all(got[2 * g] == 2 * g for g in range(120))
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def _similar_brute(rows):
    """The smallest id that exact links of similarity 0.8 reach from each id."""
    sets, near = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    linked = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in rows:
        before = dict(near)
        for i, j in linked:
            near[i] = near[j] = min(near[i], near[j])
        if near == before:
            break
    return near


def _similar_got(spark, rows):
    return {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_similar_documents_keep_those_that_share_boilerplate(spark):
    random.seed(8)
    shared = [f"b{i}" for i in range(166)]
    rows = [(i, " ".join(shared + random.choices([f"w{k}" for k in range(9000)], k=34))) for i in range(300)]
    a, b = _shingles(rows[0][1]), _shingles(rows[1][1])
    assert 0.68 < len(a & b) / len(a | b) < 0.72
    assert _similar_got(spark, rows) == {i: i for i, _ in rows}


def test_similar_documents_recall_from_the_similarity_on(spark):
    random.seed(9)
    rows = []
    for g in range(150):
        base = random.choices([f"w{i}" for i in range(3000)], k=200)
        at = random.randrange(150)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:at] + ["x"] * (8 + g % 30) + base[at + 8 + g % 30 :]))]
    want = _similar_brute(rows)
    assert 100 < sum(i != j for i, j in want.items()) < 150
    assert _similar_got(spark, rows) == want


def test_similar_documents_past_a_failing_centre(spark):
    random.seed(10)
    shared, vocabulary = [f"b{i}" for i in range(160)], [f"w{k}" for k in range(9000)]
    rows = []
    for i in range(80):
        own = random.choices(vocabulary, k=40)
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + own[:-14] + random.choices(vocabulary, k=14)))]
    want = _similar_brute(rows)
    assert want == {i: i - i % 2 for i, _ in rows}
    assert _similar_got(spark, rows) == want


def test_similar_documents_in_many_blocks(spark):
    """A cluster of many blocks: a template without links, a group around one document, and a chain, next to each other."""
    random.seed(21)
    word = lambda: "w%d" % random.randrange(10**6)
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        edits = 1 if i % 3 else 9
        text = list(base)
        for p in random.sample(range(120), edits):
            text[p] = word()
        rows.append((i, " ".join(text)))
    chain = list(base)
    for i in range(60, 80):
        chain[(7 * i) % 120] = word()
        rows.append((i, " ".join(chain)))
    random.shuffle(rows)
    want = _similar_brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame, block_bytes=1_000).collect()}
    assert got == want


def test_similar_documents_by_ball_hashing(spark, monkeypatch):
    """Without shared min-hash keys, near copies within three bits are found all the same, and the exact check still decides."""
    random.seed(22)
    word = lambda: "w%d" % random.randrange(10**6)
    rows = []
    for g in range(30):
        text = [word() for _ in range(600)]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join([*text[:300], word(), *text[301:]]))]
    loop = " ".join(word() for _ in range(11))
    rows += [(k, " ".join([loop] * 100 + [word() for _ in range(20)])) for k in (60, 61)]  # alike fingerprints, unlike sets
    prints = {i: int(simhash.majority(np.array(h := simhash.shingle_hashes(t.encode(), 5), np.uint64), np.array([len(h)]))[0]) for i, t in rows}
    near = {g for g in range(0, 62, 2) if (prints[g] ^ prints[g + 1]).bit_count() <= 3}
    assert 60 in near and len(near) > 10
    alone = lambda sets: np.array([[hash((b, x.tobytes())) & (2**63 - 1) for b in range(30)] for x in sets], np.uint64).reshape(-1, 30)
    monkeypatch.setattr(simhash, "band_keys", alone)
    got = _similar_got(spark, rows)
    assert {g for g in range(0, 62, 2) if got[g + 1] == g} == near - {60}


def test_linked_sets_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        pool = [np.unique(rng.integers(0, 60, rng.integers(0, 30)).astype(np.uint64)) for _ in range(4)]
        sets = [np.unique(np.concatenate((p[rng.random(len(p)) < 0.95], rng.integers(100, 200, 2).astype(np.uint64)))) for p in pool for _ in range(8)]
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9:
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
        got = list(range(len(sets)))
        for i, j in simhash.linked_sets(sets, 0.8):
            a, b = got[i], got[j]
            got = [min(a, b) if x in (a, b) else x for x in got]
        assert got == label


def test_fingerprint_columns_that_clash(spark):
    rows = [(1, "a b c d", 7, 8, 9, 1), (2, "a b c d", 7, 8, 9, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp long, _LABEL long, Component_Id long, node int")
    for made in (simhash.near_duplicates, simhash.similar_documents):
        out = made(docs)
        assert out.columns == ["doc_id", "node", "_fp", "_label", "component_id"]
        assert {(r.doc_id, r.node, r.component_id) for r in out.collect()} == {(1, 1, 1), (2, 2, 1)}


def test_forest_and_connected_against_union_find():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.integers(0, 30, 25), rng.integers(0, 30, 25)
        label = list(range(30))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = label[x], label[y]
            label = [min(p, q) if z in (p, q) else z for z in label]
        nodes, low = connected(a, b)
        assert dict(zip(nodes.tolist(), low.tolist(), strict=True)) == {x: label[x] for x in {*a.tolist(), *b.tolist()} if label[x] != x}
        p, q = forest(a, b)
        assert len(p) == len({*a.tolist(), *b.tolist()}) - len({label[x] for x in {*a.tolist(), *b.tolist()}})
        assert {frozenset(e) for e in zip(p.tolist(), q.tolist(), strict=True)} <= {frozenset(e) for e in zip(a.tolist(), b.tolist(), strict=True)}
    assert not len(forest(np.zeros(0, int), np.zeros(0, int))[0])


def test_embeddings_tiny_huge_and_many_lists(spark):
    rows = [(1, [1e-200, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [1e200, 0.0], 0), (5, [0.0, 5e-324], 0)]
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    old, embedding_dedup.FLAT = embedding_dedup.FLAT, 20  # two levels
    try:
        index = embedding_dedup.fit(x, 30_000, 0.93)
    finally:
        embedding_dedup.FLAT = old
    assert len(index.tops) > 1 and index.first[-1] == len(index.centroids)
    y = x + 0.09 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = (x * y).sum(axis=1) >= 0.93
    home, (r, k) = embedding_dedup.place(index, y), embedding_dedup.probes(index, x)
    found = np.zeros(len(x), bool)
    found[r[k == home[r]]] = True
    assert linked.sum() > 300 and found[linked].mean() > 0.995
    assert embedding_dedup.wanted_lists(10**11) > 100_000 and embedding_dedup.wanted_sample(10**11, 16) == embedding_dedup.TRAIN_VECTORS
    assert embedding_dedup.wanted_sample(10**11, 1536) * 1536 * 8 <= embedding_dedup.TRAIN_BYTES


def test_long_texts_in_pieces_have_the_same_windows(monkeypatch):
    random.seed(4)
    text = (" ".join(random.choices("abcdefgh", k=900)) + "\n").encode()
    raw = np.frombuffer(text, np.uint8)
    keys = lambda f: {(int(f[0][r]), int(f[2][r] + k), int(f[5][e + k])) for r, e in enumerate(np.cumsum(f[4]) - f[4]) for k in range(f[4][r])}
    whole = keys(line_dedup.ranges(raw, np.array([0, len(raw)]), 6))
    for piece in (1, 7, 100, 5000):
        monkeypatch.setattr(line_dedup, "PIECE", piece)
        assert keys(line_dedup.ranges_of_long(raw, 6)) == whole and len(whole) == 895
    assert line_dedup.ranges_of_long(np.frombuffer(b"a b", np.uint8), 6) is None


@pytest.mark.parametrize("inner,dim", [(2, 64), (3, 256), (8, 64), (8, 384), (16, 128)])
def test_no_link_is_lost_on_vectors_of_low_inner_dimension(inner, dim):
    rng = np.random.default_rng(inner * dim)
    x = (np.repeat(rng.normal(size=(300, inner)), 10, axis=0) + 0.3 * rng.normal(size=(3_000, inner))) @ rng.normal(size=(inner, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert _recall(x) >= 0.999


def test_no_link_is_lost_between_clusters_of_other_directions():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=128) + rng.normal(size=(150, 3)) @ rng.normal(size=(3, 128)) for _ in range(20)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert _recall(x) >= 0.999


def _recall(x):
    """The share of the links between lists whose other list is probed from the side that asks."""
    from trendloom.llm import embedding_dedup as E

    index = E.fit(x[:: 2], 3_000, E.THRESHOLD)
    p = E._padded(x)
    lists = E.place(index, p)
    rows, probed = E.probes(index, p)
    asked = np.zeros((len(x), int(index.first[-1])), bool)
    asked[rows, probed] = E.asks(lists[rows], probed)
    a, b = np.nonzero(np.triu(x @ x.T >= E.THRESHOLD, 1))
    assert len(a) > 100
    return (asked[a, lists[b]] | asked[b, lists[a]]).mean()
