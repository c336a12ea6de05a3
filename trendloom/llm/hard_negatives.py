"""Hard-negative mining by a vector-approximation file.

Each dimension is cut into CELLS cells; a vector's approximation is one byte a dimension, the cell that its component
lies in, and a table gives each cell's lowest and highest value. For an anchor the table turns approximations into a
lower and an upper bound of the integer score, and only vectors whose bounds allow them to enter a window (the
first positives, or the first negatives in the range of scores that a positive sets) are scored exactly.

The work is dealt as tiles: blocks of anchors (the stated query set) meet blocks of rows, so that memory is bounded by two blocks whatever
their number, and a tile hands on no more than `most` rows for each window; the final choice is a top-k of those.
Positives meet only rows of the anchor's label. Cells are cut at quantiles of a bounded sample, widened so that they
hold every value of the table: the sample decides how tight bounds are, never which rows are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import bounded_sample, materialize, shuffle_partitions

#: Cells of a dimension, SAMPLE vectors from which their borders are taken.
CELLS = 256
SAMPLE = 4_096
#: Rows and numbers of a block at most; numbers of a matrix of bounds, and pairs scored at a time.
BLOCK_ROWS = 16_384
BLOCK_NUMBERS = 1 << 23
MATRIX = 1 << 22
PAIRS = 1 << 15


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, x as double; whole numbers, kept as doubles."""
    return np.floor(scale * np.asarray(vectors, np.float64))


def borders(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(dims, CELLS + 1) borders of the cells: quantiles of the sample, the outer ones the table's own extremes."""
    edges = np.quantile(sample, np.linspace(0, 1, CELLS + 1), axis=0).T if len(sample) else np.repeat(low[:, None], CELLS + 1, axis=1)
    edges = np.clip(edges, low[:, None], high[:, None])
    edges[:, 0], edges[:, -1] = low, high
    return np.maximum.accumulate(edges, axis=1)


def approximated(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component, as a byte; a value lies between its cell's borders, both included."""
    out = np.empty(values.shape, np.uint8)
    for d in range(values.shape[1]):
        out[:, d] = np.clip(np.searchsorted(edges[d], values[:, d], side="right") - 1, 0, CELLS - 1)
    return out


def bounds(cells: np.ndarray, edges: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (anchors, rows) of the scores, from the table of cells."""
    dims, cells = np.arange(cells.shape[1]), cells.astype(np.intp)
    low, high = edges[dims, cells], edges[dims, cells + 1]
    centre, reach = (anchors @ ((low + high) / 2).T), (np.abs(anchors) @ ((high - low) / 2).T)
    largest = np.abs(anchors).max(initial=0) * np.abs(edges).max(initial=0) * cells.shape[1]
    reach += largest * 2.0**-48  # more than the sums can be rounded by; nothing where scores are small whole numbers
    return centre - reach, centre + reach


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of pairs of rows; beyond 64 bits they end at the largest or smallest long."""
    most = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * rows.shape[1]
    if most < 2.0**53:
        return np.einsum("ij,ij->i", rows, anchors).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(rows, anchors, strict=True)]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)


def _nth(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row, minus infinity where there are fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, n - 1, axis=1)[:, n - 1]


def _first(window: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each window: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, ~score, window))
    begins = np.flatnonzero(np.r_[True, np.diff(window[order]) != 0]) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[place < most]


def search(ids, labels, cells, vectors, edges, anchor_ids, anchor_labels, anchors, owner, least, highest, most: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score): the first `most` rows of each window.

    Window w belongs to anchors[owner[w]], owners ascending; its rows have the anchor's label (same) or another one,
    another id, and a score from least[w] to highest[w].
    """
    found = []
    step = max(1, MATRIX // max(1, len(ids)))
    for a in range(0, len(anchors), step):
        begin, end = np.searchsorted(owner, [a, a + step])
        for w0 in range(begin, end, step):
            w1 = min(end, w0 + step)
            own = np.unique(owner[w0:w1])
            low, high = bounds(cells, edges, anchors[own])
            of = np.searchsorted(own, owner[w0:w1])
            low, high, lo, hi = low[of], high[of], least[w0:w1, None], highest[w0:w1, None]
            at = owner[w0:w1]
            fits = ((labels[None, :] == anchor_labels[at, None]) == same) & (ids[None, :] != anchor_ids[at, None]) & (high >= lo) & (low <= hi)
            sure = fits & (low >= lo) & (high <= hi)
            fits &= high >= _nth(np.where(sure, low, -np.inf), most)[:, None]
            window, row = np.nonzero(fits)
            window += w0
            for b in range(0, len(window), PAIRS):
                w, r = window[b : b + PAIRS], row[b : b + PAIRS]
                score = scores(vectors[r], anchors[owner[w]])
                inside = (score >= least[w]) & (score <= highest[w])
                w, r, score = w[inside], r[inside], score[inside]
                some = _first(w, score, ids[r], most)
                found.append((w[some], r[some], score[some]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    window, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
    some = _first(window, score, ids[row], most)
    return window[some], row[some], score[some]


def _vectors(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, dims)


def _cells(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(c, np.uint8) for c in column.to_pylist()])


def _longs(values: list[int]) -> np.ndarray:
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in values], np.int64)


def _extremes(scale: float):
    """Batches of (_dims, _vector) -> (_dims, n, low, high): the number of vectors and the extremes of their scaled components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            dims = np.asarray(batch.column("_dims"))
            for d in map(int, np.unique(dims)):
                v = scaled(_vectors(batch.column("_vector").filter(pa.array(dims == d)), d), scale)
                old = seen.get(d, [0, np.full(d, np.inf), np.full(d, -np.inf)])
                seen[d] = [old[0] + len(v), np.minimum(old[1], v.min(axis=0)), np.maximum(old[2], v.max(axis=0))]
        if seen:
            told = [{"_dims": d, "n": n, "low": low.tolist(), "high": high.tolist()} for d, (n, low, high) in seen.items()]
            ends = pa.list_(pa.float64())
            yield pa.RecordBatch.from_pylist(told, pa.schema([("_dims", pa.int32()), ("n", pa.int64()), ("low", ends), ("high", ends)]))

    return run


def fit(rows: DataFrame, scale: float) -> dict[int, tuple[int, np.ndarray]]:
    """{dimensions: (vectors, borders)} of rows(_id, _dims, _vector), for each length of vector that occurs."""
    part = rows.select("_dims", "_vector").mapInArrow(_extremes(scale), "_dims int, n long, low array<double>, high array<double>")
    each = part.select("_dims", "n", F.posexplode(F.arrays_zip("low", "high")).alias("d", "z"))
    ends = each.groupBy("_dims", "d").agg(F.sum("n").alias("n"), F.min("z.low").alias("low"), F.max("z.high").alias("high")).collect()  # a row for each dimension
    out: dict[int, tuple[int, np.ndarray]] = {}
    for dims in sorted({r["_dims"] for r in ends}):
        own = sorted((r["d"], r["n"], r["low"], r["high"]) for r in ends if r["_dims"] == dims)
        _, n, low, high = zip(*own, strict=True)
        most = max(16, min(SAMPLE, BLOCK_NUMBERS // dims))
        some = bounded_sample(rows.where(F.col("_dims") == dims).select("_id", "_vector"), "_id", n[0], most).toArrow()
        out[dims] = (n[0], borders(scaled(_vectors(some["_vector"], dims), scale), np.array(low), np.array(high)))
    return out


def _approximate(scale: float, edges: dict[int, np.ndarray]):
    """Batches with _dims and _vector as their last columns -> the same with _cells, one byte a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = np.asarray(batch.column("_dims")), [b""] * batch.num_rows
            for d in map(int, np.unique(dims)):
                at = np.flatnonzero(dims == d)
                own = approximated(scaled(_vectors(batch.column("_vector").take(pa.array(at)), d), scale), edges[d])
                for k, row in zip(at, own, strict=True):
                    cells[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], names=[*batch.schema.names, "_cells"])

    return run


def _positives(scale: float, edges: dict[int, np.ndarray], most: int):
    """One tile: (anchor, id, score) of the first rows of each anchor's label."""

    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        out = [np.zeros(0, np.int64)] * 3
        if anchors.num_rows and rows.num_rows:
            ids, labels, cells, vectors = np.asarray(rows["_id"]), np.asarray(rows["_label"]), _cells(rows["_cells"]), scaled(_vectors(rows["_vector"], dims), scale)
            own, own_labels, own_vectors = np.asarray(anchors["_id"]), np.asarray(anchors["_label"]), scaled(_vectors(anchors["_vector"], dims), scale)
            parts = []
            for label in np.intersect1d(labels, own_labels):  # bounds of rows with the anchor's label alone
                r, a = np.flatnonzero(labels == label), np.flatnonzero(own_labels == label)
                every = np.full(len(a), -(2**63)), np.full(len(a), 2**63 - 1)
                w, row, score = search(ids[r], labels[r], cells[r], vectors[r], edges[dims], own[a], own_labels[a], own_vectors[a], np.arange(len(a)), *every, most, True)
                parts.append((own[a][w], ids[r][row], score))
            out = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else out
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), out, strict=True)))

    return run


def _negatives(scale: float, edges: dict[int, np.ndarray], most: int, low: int, high: int):
    """One tile: the first rows of another label within each positive's window."""

    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        windows = [(a, p["place"], p["positive_id"], p["positive_score"]) for a, each in enumerate(anchors["_positives"].to_pylist()) for p in each]
        owner, place, positive, reached = (np.array(x, np.int64) for x in zip(*windows, strict=True)) if windows else (np.zeros(0, np.int64),) * 4
        least = _longs([-((-low * int(s)) // 100) for s in reached])
        highest = _longs([(high * int(s)) // 100 for s in reached])
        w, row, score = (np.zeros(0, np.int64),) * 3
        ids = np.asarray(rows["_id"])
        if len(owner) and len(ids):
            vectors, own = scaled(_vectors(rows["_vector"], dims), scale), scaled(_vectors(anchors["_vector"], dims), scale)
            w, row, score = search(
                ids, np.asarray(rows["_label"]), _cells(rows["_cells"]), vectors, edges[dims],
                np.asarray(anchors["_id"]), np.asarray(anchors["_label"]), own, owner, least, highest, most, False,
            )
        told = (np.asarray(anchors["_id"])[owner[w]], place[w], positive[w], reached[w], ids[row], score)
        return pa.table(dict(zip(("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"), told, strict=True)))

    return run


def _first_of(rows: DataFrame, keys: list[str], score: str, row: str, most: int, name: str) -> DataFrame:
    """The first `most` rows of each group, numbered from 1; ranks are limited before the shuffle, too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), row)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that satisfy `anchors`.

    An anchor's positives are its first rows of the same label; for each of them, the first rows of another label whose
    score lies between low and high per cent of the positive's. Scores are inner products of floor(scale * x); higher ones
    come first, ties by smaller id. Rows take no part if id, label or vector is null, or if the vector is empty or holds a null
    or a number that is not finite. Vectors of different lengths never meet. Repeated rows are rows like others, but never
    partners of their own id, and an id is one anchor (its smallest label and vector). Scores beyond 64 bits end at
    the largest or smallest long. An empty table, or one without anchors, gives an empty result.
    """
    spark = rows.sparkSession
    v = F.col(f"`{vector}`")
    bad = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = rows.select(
        F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("long").alias("_label"), anchors.alias("_anchor"), F.size(v).alias("_dims"), v.alias("_vector")
    )
    some = some.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (F.col("_dims") > 0) & ~F.coalesce(bad, F.lit(True)))
    model = fit(some, scale)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not model:
        return spark.createDataFrame([], empty)
    edges = {d: e for d, (_, e) in model.items()}
    sizes = {d: max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // d)) for d in model}
    tasks = shuffle_partitions(spark)
    row_blocks = {d: max(-(-n // sizes[d]), min(tasks, -(-n // 1024))) for d, (n, _) in model.items()}
    of = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("_dims")]

    kind = rows.schema[vector].dataType.simpleString()
    shape = f"_id long, _label long, _anchor boolean, _dims int, _vector {kind}, _cells binary"
    placed = some.mapInArrow(_approximate(scale, edges), shape).withColumn("_rows", F.pmod(F.monotonically_increasing_id(), of(row_blocks)).cast("int"))
    table = materialize(placed, "cells")
    chosen = table.where("_anchor").groupBy("_id").agg(F.min(F.struct("_label", "_dims", "_vector")).alias("_s")).select("_id", "_s.*")
    chosen = materialize(chosen, "anchors")
    counts = {r["_dims"]: r["n"] for r in chosen.groupBy("_dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], empty)
    anchor_blocks = {d: -(-counts.get(d, 0) // sizes[d]) for d in model}
    chosen = chosen.withColumn("_anchors", F.pmod(F.xxhash64("_id"), of({d: max(1, b) for d, b in anchor_blocks.items()})).cast("int"))

    dealt = table.drop("_anchor").where(of(anchor_blocks) > 0).withColumn("_anchors", F.explode(F.sequence(F.lit(0), of(anchor_blocks) - 1)))
    tiles = lambda a: a.withColumn("_rows", F.explode(F.sequence(F.lit(0), of(row_blocks) - 1))).groupBy("_dims", "_rows", "_anchors")
    blocks = dealt.groupBy("_dims", "_rows", "_anchors")
    near = tiles(chosen).cogroup(blocks).applyInArrow(_positives(scale, edges, positives), "anchor_id long, positive_id long, positive_score long")
    near = materialize(_first_of(near, ["anchor_id"], "positive_score", "positive_id", positives, "place"), "positives")
    windows = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "positive_id", "positive_score")).alias("_positives"))
    asking = chosen.join(windows, chosen["_id"] == windows["anchor_id"]).drop("anchor_id")
    hard = tiles(asking).cogroup(blocks).applyInArrow(
        _negatives(scale, edges, negatives, low, high),
        "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    ranked = _first_of(hard, ["anchor_id", "place"], "negative_score", "negative_id", negatives, "rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: hard negatives of every vector whose id 50 divides, against all vectors; of ids that seven divides the label moves on by one first."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.withColumn("label", moved), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
    SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS place
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""
