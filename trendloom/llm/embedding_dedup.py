"""Near-dedup of embeddings by product quantisation.

A coarse quantiser (inverted lists) and residual subspace codebooks are
fitted on a bounded sample of unit vectors; every vector is indexed, with its list,
its codes and the exact length of its quantisation error. A query probes
every list that lies within a margin of its own cell, measured across the bisecting plane of the two
centroids. A linked vector in that list lies beyond the plane, at most the link radius away, so a margin of
the radius loses nothing, whatever the vectors' inner dimension. A smaller one is taken only where the sample holds many
links between lists, and then half as much again as the widest of them needs. Of two lists
one asks the other, so each pair is searched from one side. In
a probed list, asymmetric distances come from lookup tables; a member is a candidate unless its
distance minus its quantisation error exceeds the radius, which loses
nothing, and candidates are reranked by the exact cosine in double precision.

Work is dealt out in tiles: the members of a list within a label in blocks of bounded size,
its queries in blocks of bounded size, every pair of blocks one task's group. Identical vectors
are one class with a count beforehand. Tiles report sums of links and what each
vector is connected with, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from trendloom.llm.common import again, bounded_sample, components, connected, materialize

THRESHOLD = 0.93
#: Vectors that the quantisers are fitted on, at most.
TRAIN_VECTORS = 400_000
#: Bytes of those vectors as doubles; the centroids, an eighth of them at most, are what is broadcast.
TRAIN_BYTES = 192 << 20
SUBSPACES = 8
#: Lists up to which the coarse quantiser has one level.
FLAT = 1_024
#: Links between lists that the sample must hold for a margin below the radius, what is put on top of the widest, vectors that ask for them.
LEAST_LINKS, SPARE, ASKING = 2_000, 1.5, 2_048
MEMBERS, QUERIES = 2_048, 8_192


@dataclass
class Index:
    tops: np.ndarray  # [cells, dim], dim padded with zeros
    centroids: np.ndarray  # [lists, dim], cell by cell
    first: np.ndarray  # the first list of each cell, and their number
    books: np.ndarray  # [subspaces, 256, dim / subspaces]
    margin: float


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]])


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))


def wanted_lists(n: int) -> int:
    """About sqrt(n) / 2 lists for n vectors of the largest label, so that a list grows like the root of the input."""
    return int(max(4, n**0.5 / 2))


def wanted_sample(n: int, dim: int) -> int:
    """Vectors to fit on: eight for each list, 20,000 at least, TRAIN_VECTORS and TRAIN_BYTES at most."""
    return int(min(TRAIN_VECTORS, max(1, TRAIN_BYTES // (8 * dim)), max(20_000, 8 * wanted_lists(n))))


def measured_margin(index: Index, x: np.ndarray, threshold: float) -> float:
    """The margin that the sample's own links between lists ask for, the radius where there are too few of them."""
    radius = (2 - 2 * threshold) ** 0.5
    lists = place(index, x)
    asking = np.linspace(0, len(x) - 1, min(ASKING, len(x))).astype(int)
    widest, links = 0.0, 0
    for i in range(0, len(asking), 256):
        q = asking[i : i + 256]
        a, b = np.nonzero((x[q] @ x.T >= threshold) & (lists[q][:, None] != lists[None, :]))
        links += len(a)
        if len(a):
            own, other = index.centroids[lists[q[a]]], index.centroids[lists[b]]
            apart = np.maximum(np.linalg.norm(own - other, axis=1), 1e-9)
            over = (((x[q[a]] - other) ** 2).sum(axis=1) - ((x[q[a]] - own) ** 2).sum(axis=1)) / (2 * apart)
            widest = max(widest, float(over.max()))
    return min(radius, SPARE * widest) if links >= LEAST_LINKS else radius


def fit(sample: np.ndarray, n: int, threshold: float) -> Index:
    """Quantisers from unit vectors; beyond FLAT lists the coarse one has two levels, cells and lists inside each cell."""
    x = _padded(sample)
    lists = min(wanted_lists(n), max(1, len(x) // 8))
    cells = 1 if lists <= FLAT else int(lists**0.5)
    tops = _kmeans(x, min(cells, len(x)))
    of = _nearest(x, tops)
    leaves, first = [], [0]
    for c in range(len(tops)):
        own = x[of == c]
        leaves.append(_kmeans(own, min(max(1, -(-lists // cells)), len(own))) if len(own) else tops[c : c + 1])
        first.append(first[-1] + len(leaves[-1]))
    index = Index(tops, np.concatenate(leaves), np.array(first), np.zeros((SUBSPACES, 256, x.shape[1] // SUBSPACES)), 0.0)
    index.margin = measured_margin(index, x, threshold) + 1e-9
    rest = x - index.centroids[place(index, x)]
    parts = np.split(rest, SUBSPACES, axis=1)
    index.books = np.stack([np.resize(_kmeans(p, min(256, len(p))), (256, p.shape[1])) for p in parts])
    return index


def place(index: Index, x: np.ndarray) -> np.ndarray:
    """The list of each vector: the nearest one in the nearest cell."""
    of, out = _nearest(x, index.tops), np.zeros(len(x), np.int64)
    for c in np.unique(of):
        rows = np.flatnonzero(of == c)
        out[rows] = index.first[c] + _nearest(x[rows], index.centroids[index.first[c] : index.first[c + 1]])
    return out


def _beyond(x: np.ndarray, centres: np.ndarray, margin: float) -> np.ndarray:
    """[vectors, centres]: whether the plane between the nearest centre and this one is within the margin."""
    square = (centres**2).sum(axis=1)
    far = square - 2 * x @ centres.T
    near = far.argmin(axis=1)
    apart = np.sqrt(np.maximum(square[near][:, None] + square - 2 * centres[near] @ centres.T, 0))
    return ((far - far[np.arange(len(x)), near][:, None]) / (2 * np.maximum(apart, 1e-9)) <= margin) | (apart < 1e-6)


def probes(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector number, list) of every list to search for each vector, sorted by vector."""
    rows, lists = [], []
    near = _beyond(x, index.tops, index.margin)
    for c in np.flatnonzero(near.any(axis=0)):
        own = np.flatnonzero(near[:, c])
        r, k = np.nonzero(_beyond(x[own], index.centroids[index.first[c] : index.first[c + 1]], index.margin))
        rows.append(own[r])
        lists.append(k + index.first[c])
    rows, lists = np.concatenate(rows), np.concatenate(lists)
    order = np.argsort(rows, kind="stable")
    return rows[order], lists[order]


def asks(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of two different lists one asks the other, a list asks itself: each pair of vectors is searched from one side."""
    return (own == other) | (((own ^ other) & 1).astype(bool) == (own < other))


def _unit(batch: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors scaled by powers of two, so that no square overflows or vanishes, unit vectors), in doubles."""
    raw = np.asarray(batch.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    _, power = np.frexp(np.abs(raw).max(axis=1, keepdims=True))
    raw = np.ldexp(raw, -power)
    return raw, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _indexed(index, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                _, unit = _unit(batch.column(2), dim)
                x = _padded(unit)
                near = place(own, x)
                rest = x - own.centroids[near]
                codes = np.stack([_nearest(p, b) for p, b in zip(np.split(rest, SUBSPACES, axis=1), own.books, strict=True)], axis=1).astype(np.uint8)
                decoded = own.centroids[near] + np.concatenate([own.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
                error = np.linalg.norm(x - decoded, axis=1)
                rows, lists = probes(own, x)
                keep = asks(near[rows], lists)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(rows[keep], minlength=len(x))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                        pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists[keep].astype(np.int32))),
                    ],
                    names=["_rep", "_label", "_v", "_mult", "_list", "_codes", "_error", "_probes"],
                )

    return run


def tile_links(index: Index, list_no: int, members: tuple, queries: tuple, threshold: float, block: int = 256) -> tuple[np.ndarray, ...]:
    """(links of each query, links of each member, node, node that links connect it with) between queries (ids, raw, unit, counts, whether of this
    list) and one list's members (ids, raw, unit, codes, errors, counts). Pairs inside the list are counted from both sides as queries."""
    ids, raw, unit, codes, errors, counts = members
    qids, qraw, qunit, qcounts, at_home = queries
    found, back, a, b = np.zeros(len(qids)), np.zeros(len(ids)), [], []
    radius = (2 - 2 * threshold) ** 0.5
    decoded = index.centroids[list_no] + np.concatenate([index.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
    length = (decoded**2).sum(axis=1)
    norms = np.linalg.norm(raw, axis=1)
    reach = (radius + errors + 1e-9) ** 2
    for i in range(0, len(qids), block):
        q = _padded(qunit[i : i + block])
        table = np.einsum("qsd,scd->qsc", q.reshape(len(q), SUBSPACES, -1), index.books)
        dot = (q @ index.centroids[list_no])[:, None] + sum(table[:, s][:, codes[:, s]] for s in range(SUBSPACES))
        mask = (1 - 2 * dot + length <= reach) & (qids[i : i + block, None] != ids)
        r, c = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        if not len(r):
            continue
        if mask.sum() * 8 < len(r) * len(c):
            x, y = np.nonzero(mask)
            cos = np.einsum("ij,ij->i", qraw[i + x], raw[y]) / (np.linalg.norm(qraw[i + x], axis=1) * norms[y])
            x, y = x[cos >= threshold], y[cos >= threshold]
        else:
            own = qraw[i + r]
            cos = own @ raw[c].T / (np.linalg.norm(own, axis=1)[:, None] * norms[c])
            x, y = np.nonzero((cos >= threshold) & mask[np.ix_(r, c)])
            x, y = r[x], c[y]
        found[i : i + block] += np.bincount(x, counts[y], len(q))
        away = ~at_home[i + x]
        back += np.bincount(y[away], qcounts[i + x[away]], len(ids))
        p, s = connected(qids[i + x], ids[y])
        a.append(p)
        b.append(s)
    empty = np.zeros(0, np.int64)
    return found.astype(np.int64), back.astype(np.int64), *connected(np.concatenate([empty, *a]), np.concatenate([empty, *b]))


def _tile(index, dim: int, threshold: float):
    schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        raw, unit = _unit(left.column("_v").combine_chunks(), dim)
        qraw, qunit = _unit(right.column("_v").combine_chunks(), dim)
        codes = np.frombuffer(b"".join(left.column("_codes").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        list_no = left.column("_list")[0].as_py()
        members = (left.column("_rep").to_numpy(), raw, unit, codes, left.column("_error").to_numpy(), left.column("_mult").to_numpy())
        queries = (right.column("_rep").to_numpy(), qraw, qunit, right.column("_mult").to_numpy(), right.column("_own").to_numpy() == list_no)
        n, m, a, b = tile_links(index.value, list_no, members, queries, threshold)
        counted = pa.array(np.concatenate((queries[0][n > 0], members[0][m > 0])))
        number = pa.array(np.concatenate((n[n > 0], m[m > 0])))
        return pa.table(
            [
                pa.concat_arrays([counted, pa.nulls(len(a), pa.int64())]),
                pa.concat_arrays([number, pa.nulls(len(a), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(a, pa.int64())]),
                pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(b, pa.int64())]),
            ],
            schema=schema,
        )

    return run


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Vectors of different labels or lengths are not compared. A null label, id
    or vector, and a vector that is empty, zero or holds null or non-finite components,
    links with nothing: no links, its own component. Identical rows count as
    vectors of their own and link with each other. Empty in, empty out.
    """
    kind = "float" if vectors.schema[vector].dataType == ArrayType(FloatType()) else "double"  # floats stay floats where they move, products are in doubles
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{label}`").alias("_label"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("_v"))
    fine = F.expr("forall(_v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(_v, x -> x <> 0)")
    good = rows.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & fine)
    classes = good.groupBy("_label", "_v").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_mult"))
    classes = materialize(classes.select("_rep", "_label", "_v", "_mult"), "vectors")
    sizes = sorted(r[0] for r in classes.select(F.size("_v")).distinct().collect())  # the lengths that occur, a few
    found, pairs = [], []
    for dim in sizes:
        result = _search(classes.where(F.size("_v") == dim), dim, threshold)
        found.append(result.where("q IS NOT NULL").select("q", "n"))
        pairs.append(result.where("a IS NOT NULL").select("a", "b"))
    out = rows.select("_id", "_label", "_v")
    if not found:
        return out.select(F.col("_id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    for extra in range(1, len(found)):
        found[0], pairs[0] = found[0].unionByName(found[extra]), pairs[0].unionByName(pairs[extra])
    total = found[0].groupBy("q").agg(F.sum("n").alias("_n"))
    label_of = components(pairs[0], "vector-links")
    told = classes.join(total, classes["_rep"] == total["q"], "left").join(label_of, classes["_rep"] == label_of["node"], "left")
    told = told.select("_label", "_v", (F.coalesce("_n", F.lit(0)) + F.col("_mult") - 1).alias("n_links"), F.coalesce("component", "_rep").alias("component_id"))
    joined = out.join(told, ["_label", "_v"], "left")
    usable = F.col("_id").isNotNull() & F.col("n_links").isNotNull()
    component = F.when(usable, F.col("component_id")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(vec_id),
        F.when(usable, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
    )


def _search(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    spark = classes.sparkSession
    n, most = classes.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    sample = bounded_sample(classes.select("_rep", "_v"), "_rep", n, wanted_sample(most, dim)).toPandas().sort_values("_rep")
    _, unit = _unit(pa.array(sample["_v"]), dim)
    index = spark.sparkContext.broadcast(fit(unit, most, threshold))  # at most TRAIN_VECTORS / 8 centroids
    label = classes.schema["_label"].dataType.simpleString()
    vector = classes.schema["_v"].dataType.simpleString()
    schema = f"_rep long, _label {label}, _v {vector}, _mult long, _list int, _codes binary, _error double, _probes array<int>"
    listed = materialize(classes.mapInArrow(_indexed(index, dim), schema), "vector-index")
    asked = again(listed).select("_rep", "_label", "_v", "_mult", F.col("_list").alias("_own"), F.explode("_probes").alias("_list"))
    members = listed.groupBy("_label", "_list").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(MEMBERS))).cast("int").alias("_blocks"))
    queries = asked.groupBy("_label", "_list").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(QUERIES))).cast("int").alias("_rounds"))
    plan = materialize(members.join(queries, ["_label", "_list"]), "vector-tiles")
    each, mix = F.expr("explode(sequence(0, _rounds - 1))"), F.xxhash64("_rep")
    left = listed.drop("_probes").join(plan, ["_label", "_list"]).withColumn("_bm", F.pmod(mix, F.col("_blocks")).cast("int"))
    left = left.withColumn("_bq", each).drop("_blocks", "_rounds")
    right = asked.join(again(plan), ["_label", "_list"]).withColumn("_bq", F.pmod(mix, F.col("_rounds")).cast("int"))
    right = right.withColumn("_bm", F.expr("explode(sequence(0, _blocks - 1))")).drop("_blocks", "_rounds")
    keys = ["_label", "_list", "_bm", "_bq"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(index, dim, threshold), "q long, n long, a long, b long")
    return materialize(tiles, "vector-links")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: links of cosine 0.93 and more between all vectors of a label."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
    SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
    WHERE list_cosine_similarity(p.e, q.e) >= 0.93
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, min(reach.b) AS component_id, min(reach.b) = v.vec_id AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""
