"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A document is a vector of hashed shape n-grams (bytes mapped to letter, capital, digit,
blank, other characters themselves), hashed byte trigrams and the share of words that
repeat the word before. Root frequencies are weighted by inverse document
frequency and projected by the singular vectors of a bounded sample of labelled rows. Those
rows' unit vectors are broadcast with their labels; for every document the
exact cosine products with all of them are computed in blocks, and the nearest
vote with a weight that grows with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import crc32_mod, slices, text_buffer, training_rows, without

SHAPES, GRAMS = 2048, 1024
#: Labelled rows that the space is fitted on and that vote, at most.
TRAIN_ROWS = 4_000
#: Bytes of their texts together, at most.
TRAIN_BYTES = 64 << 20
RANK = 48
NEIGHBOURS = 15
#: Rows of one matrix product.
BLOCK = 64
#: Bytes of a text that are counted at once; a longer one is cut at white space.
PIECE = 1 << 20

_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[9:14] = 32
_SHAPE[10] = 10
_SHAPE[128:] = 1  # letters of other scripts


@dataclass
class Model:
    idf: np.ndarray
    mean: np.ndarray
    basis: np.ndarray  # [features, rank]
    vectors: np.ndarray  # unit rows [labelled, rank]
    labels: np.ndarray
    prior: float


def _hash(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def raw_features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Root frequencies of each text in bytes raw[at[i]:at[i+1]], families side by side, each of unit length.

    A text beyond PIECE bytes is counted piece by piece, so what would lie across a cut does not count.
    """
    cuts, owner = [], []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while b - a > PIECE:
            blank = np.flatnonzero(raw[a + PIECE // 2 : a + PIECE] <= 32)
            cuts.append(a)
            owner.append(i)
            a += PIECE // 2 + int(blank[-1]) + 1 if len(blank) else PIECE
        cuts.append(a)
        owner.append(i)
    counts = np.zeros((len(at) - 1, SHAPES + GRAMS + 2), np.float64)
    edges = np.array([*cuts, at[-1]], np.int64)
    k = 0
    while k < len(owner):
        end = max(k + 1, int(np.searchsorted(edges, edges[k] + PIECE, side="right")) - 1)
        end = min(end, len(owner))
        np.add.at(counts, owner[k:end], _counts(raw, edges[k : end + 1]))
        k = end
    out = np.zeros(counts.shape, np.float32)
    for a, b in ((0, SHAPES), (SHAPES, SHAPES + GRAMS), (SHAPES + GRAMS, SHAPES + GRAMS + 2)):
        out[:, a:b] = np.sqrt(counts[:, a:b] / np.maximum(1, counts[:, a:b].sum(axis=1, keepdims=True)))
    return out


def _counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed shapes, of hashed trigrams, and of words that repeat the one before and that do not."""
    rows = len(at) - 1
    raw, at = raw[at[0] : at[-1]], at - at[0]
    out = np.zeros((rows, SHAPES + GRAMS + 2), np.float64)
    n = len(raw)
    if not n:
        return out
    row = np.repeat(np.arange(rows), np.diff(at))
    inner = row[2:] == row[:-2]  # nothing for a text of one or two bytes, whatever stands beside it
    s, b = _SHAPE[raw], raw.astype(np.uint64)
    shape3 = (s[:-2] << np.uint64(16) | s[1:-1] << np.uint64(8) | s[2:])[inner]
    byte3 = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:])[inner]
    at3 = row[2:][inner]
    shape = np.bincount(at3 * SHAPES + _hash(shape3, 11), minlength=rows * SHAPES).reshape(rows, SHAPES)
    grams = np.bincount(at3 * GRAMS + _hash(byte3 + np.uint64(7), 10), minlength=rows * GRAMS).reshape(rows, GRAMS)
    out[:, :SHAPES], out[:, SHAPES : SHAPES + GRAMS] = shape, grams
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    turn = np.concatenate(([True], row[1:] != row[:-1], [True]))  # words never run over a text's end
    start = np.flatnonzero(solid & (turn[:-1] | ~np.concatenate(([False], solid[:-1]))))
    end = np.flatnonzero(solid & (turn[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    if len(start):
        power = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
        place = np.arange(n) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [n]))))
        code = np.add.reduceat(np.append((b + np.uint64(1)) * power[place & 63], np.uint64(0)), np.stack([start, end], 1).ravel())[::2]
        owner = row[start]
        again = np.concatenate(([False], (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])))
        out[:, -2] = np.bincount(owner[again], minlength=rows)
        out[:, -1] = np.bincount(owner, minlength=rows) - out[:, -2]
    return out


def _blocks(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """x in blocks of BLOCK rows, the last one filled with zeros: products of one shape do not depend on the rows beside."""
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        yield i, part if len(part) == BLOCK else np.concatenate((part, np.zeros((BLOCK - len(part), x.shape[1]), x.dtype)))


def _project(model: Model, features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(features), model.basis.shape[1]), np.float32)
    for i, part in _blocks(features):
        z = (part * model.idf - model.mean) @ model.basis
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        z = np.where(norm > 1e-9, z / np.maximum(norm, 1e-9), 0)
        z[~part.any(axis=1)] = 0  # a text without features has no direction and no neighbours
        out[i : i + BLOCK] = z[: len(out) - i]
    return out


def _leading(x: np.ndarray, rank: int, rounds: int = 5) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(1).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    if not len(x):
        return np.zeros((x.shape[1], rank), np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    small = x @ q
    _, turn = np.linalg.eigh(small.T @ small)
    return np.ascontiguousarray((q @ turn[:, ::-1])[:, :rank])


def fit(texts: list[str], labels: np.ndarray, rank: int = RANK) -> Model:
    """The space and its labelled vectors; deterministic. Without rows every score is 0.5, with one label its share."""
    y = np.asarray(labels, np.float32)
    raw = [(t or "").encode() for t in texts]
    x = np.zeros((0, SHAPES + GRAMS + 2), np.float32)
    if raw:
        parts = []
        for k in range(0, len(raw), 256):
            group = raw[k : k + 256]
            at = np.concatenate(([0], np.cumsum([len(t) for t in group])))
            parts.append(raw_features(np.frombuffer(b"".join(group), np.uint8), at))
        x = np.concatenate(parts)
    n = len(x)
    idf = np.log((n + 1) / ((x > 0).sum(axis=0) + 1)) + 1
    idf[SHAPES : SHAPES + GRAMS] *= 0.35  # what a text is about counts less than how it is written
    idf[-2:] = 2.0
    idf = idf.astype(np.float32)
    mean = (x * idf).mean(axis=0) if n else np.zeros(x.shape[1], np.float32)
    centred = x * idf - mean
    basis = _leading(centred, rank)
    model = Model(idf, mean.astype(np.float32), basis, np.zeros((0, rank), np.float32), y, float(y.mean()) if n else 0.5)
    model.vectors = _project(model, x)
    return model


def votes(model: Model, z: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors of each row.

    Cosines are rounded to six decimals; of equal ones at the last place those of the lower index, that is
    of the smaller id, vote.
    """
    out = np.full(len(z), model.prior)
    k = min(neighbours, len(model.vectors))
    if not k:
        return out
    for i, part in _blocks(z):
        cos = np.round((part @ model.vectors.T).astype(np.float64), 6)
        last = np.partition(cos, -k, axis=1)[:, -k, None]
        above, level = cos > last, cos == last
        near = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(near, np.clip(cos, 0, None), 0) ** 4
        total = weight.sum(axis=1)
        share = (weight * model.labels).sum(axis=1)
        out[i : i + BLOCK] = np.where(total > 1e-9, share / np.maximum(total, 1e-9), model.prior)[: len(out) - i]
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, keep_text: bool = False) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= threshold), without the text unless keep_text.

    Null counts as empty; a text without features gets the share of label 1.
    A row's score does not depend on the rows beside it, so repeated rows agree. Empty in, empty out.
    Columns named score or predicted, in any case, are replaced.
    """
    others = without(docs.columns, text, "score", "predicted")
    kept = [*others, text] if keep_text else others
    typed = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TRAIN_ROWS vectors and one fixed basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            raw, at = text_buffer(batch.column(batch.schema.get_field_index(text)))
            p = np.zeros(batch.num_rows)
            for i, j in slices(at, 1 << 20):
                for a in range(i, j, 512):
                    b = min(j, a + 512)
                    p[a:b] = votes(own, _project(own, raw_features(raw, at[a : b + 1])))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(run, typed.schema)


def train(docs: DataFrame, labels: DataFrame, label: str, learn, text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a sample of at most `most` rows and most_bytes of the labelled rows that satisfy `learn`, a condition on the id."""
    got = training_rows(docs, labels, label, learn, text, doc_id, most, most_bytes).toPandas().sort_values([doc_id, "_y", text], na_position="first")
    return fit(got[text].tolist(), got["_y"].to_numpy())


def query(spark, sf_dir: str) -> DataFrame:
    """op9: quality of every whole text, learned where crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "quality", crc32_mod("doc_id", 4) != 2)
    held = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
