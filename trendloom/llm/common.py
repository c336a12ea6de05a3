"""Shared plumbing: shared-folder tables, connected components, row keys, Arrow text buffers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's own; a local one only with a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        base = jsc.getCheckpointDir().get()
    return f"{base.rstrip('/')}/trendloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back.

    A lost executor then costs a re-read of files, not a recomputation of
    the plan above. Tables of a session stay until sweep() or drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trendloom_path = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A second, independent scan of a table that materialize() wrote."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._trendloom_path)
    out._trendloom_path = df._trendloom_path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_trendloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete every table that this application materialized."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(column: str, m: int):
    """crc32 of the id written as text, modulo m: the split that contracts use."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long) as (node, component), component the smallest node.

    Alternating large-star and small-star contractions, each a grouped
    minimum (with map-side combine) and an equi-join that adaptive execution can
    split; no neighbourhood is ever gathered into one row or task. Every
    round is written to the shared folder, and the last two rounds alone are
    kept. Nodes without edges do not occur in the result.
    """
    undirected = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = materialize(undirected.distinct(), tag)
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are tables of their own, so that each join shuffles both sides and a hub's rows can be split
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = materialize(
            both.where(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            tag,
        )
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = materialize(small, tag)
        for used in (now, low, large, least):
            drop(used)
        now, before = new, mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: no convergence in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r["n"], r["x"] or 0


def _lowest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that the edges x - y connect each one with."""
    low = np.arange(n)
    while True:
        new, least = low.copy(), np.minimum(low[x], low[y])
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, low, new)  # what a node learns holds for the one it stood for
        new = new[new]
        if (new == low).all():
            return low
        low = new


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it is connected with) of the edges a - b, for all nodes but the smallest ones, on arrays alone."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    low = _lowest(len(nodes), index[: len(a)], index[len(a) :])
    other = low != np.arange(len(nodes))
    return nodes[other], nodes[low[other]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a - b that form a spanning forest: in rounds, each tree takes the first edge that leaves it."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, keep = index[: len(a)], index[len(a) :], np.zeros(len(a), bool)
    tree = np.arange(len(nodes))
    while len(live := np.flatnonzero(tree[x] != tree[y])):
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, tree[x[live]], live)
        np.minimum.at(first, tree[y[live]], live)
        taken = np.unique(first[first < len(a)])
        keep[taken] = True
        tree = _lowest(len(nodes), tree[x[taken]], tree[y[taken]])[tree]
    return a[keep], b[keep]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    at = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes together stay within limit; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def package_path(name: str) -> str:
    """A file of the public tokenizers, or the path itself where it is one."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def without(columns: Iterable[str], *names: str) -> list[str]:
    """The columns whose names differ from all of names, whatever their case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def sample_threshold(n: int, most: int) -> int:
    """Hashes below it, of 63 bits, leave at least `most` of n rows but for a chance of 1e-9, and hardly more."""
    return min(2**63 - 1, int(2**63 * ((most + 6 * most**0.5 + 16) / max(1, n))))


def likely(key: str, n: int, most: int) -> Column:
    """A condition on a hash of the key that a few more than `most` of n rows satisfy."""
    return F.xxhash64(F.lit("sample"), F.col(f"`{key}`")).bitwiseAND(F.lit(2**63 - 1)) <= F.lit(sample_threshold(n, most))


#: A sample takes no row of more than this share of its bytes, so that no single row can fill it.
LARGEST_SHARE = 64


def bounded_sample(rows: DataFrame, key: str, n: int, most: int, size: Column | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """At most `most` of the n rows, of at most most_bytes together, in the order of a hash of the key, then of all columns.

    size is the bytes of a row; rows of more than most_bytes / LARGEST_SHARE are left out before anything is counted, so at least
    LARGEST_SHARE others fit. Only a few more rows than `most` leave the scan, unless many rows share one key: the limit
    holds for them too.
    """
    order = [F.xxhash64(F.lit("sample"), F.col(f"`{key}`")), *[F.col(f"`{c}`") for c in rows.columns]]
    some = rows.where(likely(key, n, most)) if n > most else rows
    if size is None:
        return some.orderBy(*order).limit(most)
    few = some.where(size <= most_bytes // LARGEST_SHARE).orderBy(*order).limit(most)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over `most` rows, whatever the input
    return few.withColumn("_bytes", F.sum(size).over(w)).where(F.col("_bytes") <= most_bytes).drop("_bytes")


def drawn_sample(rows: Callable[[Column], DataFrame], key: str, n: int, most: int, size: Column, most_bytes: int) -> DataFrame:
    """bounded_sample() of rows(condition on the key), n in all, written to a table.

    Where so many rows are too large for a sample that less than half of it is filled, a wider draw is made, up to all rows.
    """
    draw = most
    while True:
        some = likely(key, n, draw) if n > draw else F.lit(True)
        sample = materialize(bounded_sample(rows(some), key, most, most, size, most_bytes), "sample")
        if draw >= n:
            return sample
        got = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
        if got["n"] >= most // 2 or (got["b"] or 0) >= most_bytes // 2:
            return sample
        drop(sample)
        draw *= 8


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, text: str, doc_id: str, most: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, _y): a bounded sample of the labelled rows that satisfy `learn`, a condition on the id."""
    rows = labels.where(F.col(label).isNotNull() & F.coalesce(learn, F.lit(False))).select(doc_id, F.col(label).alias("_y")).distinct()
    joined = lambda some: docs.select(doc_id, text).where(some).join(rows.where(some), doc_id)
    return drawn_sample(joined, doc_id, rows.count(), most, F.octet_length(F.coalesce(text, F.lit(""))), most_bytes)
