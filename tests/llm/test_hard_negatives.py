"""Hard negatives against brute force, the bounds of cells, and edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    ok = [(i, m, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v, m in rows if None not in (i, v, m) and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, q in {r[0]: r for r in sorted(ok, reverse=True) if r[0] % 50 == 0}.values():
        scored = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), j, m) for j, m, p in ok if j != i and len(p) == len(q))
        for j, reached in [(j, -s) for s, j, m in scored if m == label][:positives]:
            inside = [(k, -s) for s, k, m in scored if m != label and low * reached <= 100 * -s <= high * reached]
            out += [(i, j, r + 1, k, reached, s) for r, (k, s) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, **more):
    return sorted(tuple(r) for r in hn.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, **more).collect())


def vectors(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) / dims**0.5 + rng.normal(size=dims) * 0.1
    return [(k, v[k].tolist(), int(rng.integers(labels))) for k in range(n)]


def test_brute_force_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64)  # many blocks of rows and of anchors
    rows = vectors(700, 12, 1)
    rows = [(k * 10, v, m) for k, v, m in rows]
    want = brute(rows)
    assert len(want) > 300 and mined(spark, rows) == want


def test_copies_ties_and_correlated_vectors(spark):
    random.seed(3)
    base = vectors(12, 6, 2)
    rows = [(k, base[random.randrange(12)][1], random.randrange(3)) for k in range(400)]
    assert mined(spark, rows) == brute(rows)
    line = [(k, [x * 0.01 * (k % 37) for x in base[0][1]], k % 3) for k in range(300)]
    assert mined(spark, line) == brute(line)


def test_rows_that_take_no_part(spark):
    rows = vectors(200, 4, 5)
    odd = [(1000, None, 1), (1050, [0.1, None, 0.2, 0.3], 1), (1100, [0.1, float("nan"), 0.2, 0.3], 1), (1150, [float("inf"), 0.0, 0.2, 0.3], 0), (1200, [0.3, 0.1, 0.2, 0.4], None), (None, [0.3, 0.1, 0.2, 0.4], 1), (1250, [], 1)]
    other = [(2000 + 10 * k, [0.1 * k, 0.2], k % 2) for k in range(20)]
    zero = [(3000, [0.0] * 4, 2), (3050, [-1.0, -1.0, -1.0, -1.0], 3)]
    rows = rows + odd + other + zero
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(3, [0.1], 1)]) == [] and mined(spark, [(0, [0.1], 1)]) == []


def test_repeated_rows_are_rows_but_not_their_own_partners(spark):
    rows = [(k, [1.0 + k / 100, 0.5], k % 2) for k in range(20)]
    assert mined(spark, rows + rows[3:9]) == brute(rows + rows[3:9])


def test_large_numbers_and_float_columns(spark):
    rows = [(k, [float(10 ** (k % 12)), -float(k), 0.5], k % 3) for k in range(150)]
    assert mined(spark, rows) == brute(rows)
    small = [(k, [np.float32(x).item() for x in v], m) for k, v, m in vectors(150, 5, 9)]
    assert mined(spark, small, "vec_id long, embedding array<float>, label int, _id int, Rank int".replace(", _id int, Rank int", "")) == brute(small)


def test_other_windows(spark):
    rows = vectors(300, 8, 7)
    assert mined(spark, rows, positives=2, negatives=6, low=10, high=80, scale=100.0) == brute(rows, 2, 6, 10, 80, 100)


def test_bounds_hold_and_cells_exclude():
    rng = np.random.default_rng(0)
    values, anchors = np.floor(256 * rng.normal(size=(500, 16)) / 4), np.floor(256 * rng.normal(size=(20, 16)) / 4)
    edges = hn.borders(values[:50], values.min(axis=0), values.max(axis=0))
    cells = hn.approximated(values, edges)
    low, high = hn.bounds(cells, edges, anchors)
    exact = anchors @ values.T
    assert (low <= exact).all() and (exact <= high).all() and np.median(high - low) < 0.2 * np.std(exact)
    assert set(np.unique(cells)) & {0, 255}
    calls = []
    original, hn.scores = hn.scores, lambda r, a: calls.append(len(r)) or original(r, a)
    try:
        labels = np.zeros(500, int)
        every = np.full(20, -(2**63)), np.full(20, 2**63 - 1)
        hn.search(np.arange(500), labels, cells, values, edges, np.arange(20) + 1000, np.zeros(20, int), anchors, np.arange(20), *every, 5, True)
    finally:
        hn.scores = original
    assert 100 <= sum(calls) < 0.2 * 500 * 20  # most rows are ruled out by their bounds


@pytest.mark.parametrize("dims", [1, 3])
def test_constant_dimensions(spark, dims):
    rows = [(k, [0.25] * dims, k % 2) for k in range(120)]
    assert mined(spark, rows) == brute(rows)
