"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (lower case, runs of white space
as one blank, so word edges count) in a hashed table for each order; a second
feature is its presence at least twice. On labelled rows each feature gets its log-count ratio; logistic regression
is then fitted on the scaled presences. Features that too few rows hold, or whose
ratio says little, have weight zero. Scoring needs one table lookup for a byte
and order, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import crc32_mod, training_rows, without

ORDERS = (4, 5, 6, 8)
BITS = 19
#: Buckets of single presences; those of repeated presences follow.
SIZE = len(ORDERS) << BITS
#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 5_000
#: Bytes of their texts together, at most.
TRAIN_BYTES = 64 << 20

#: Characters hashed at once, which bounds the memory that a long text takes.
PIECE = 1 << 20


@dataclass
class Model:
    weights: np.ndarray  # float32 [2 * SIZE]
    bias: float


def characters(text: str) -> np.ndarray:
    """Code points of the lower-case text between two blanks, runs of white space as one blank."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    code = np.where(blank, np.uint32(32), code)[~(blank & np.concatenate(([True], blank[:-1])))]
    return np.concatenate((np.array([32], np.uint32), code, np.array([32], np.uint32)))


def gram_hashes(code: np.ndarray, telling: np.ndarray | None = None) -> np.ndarray:
    """Hashed n-grams of one text's characters, all orders, as often as they occur; those of `telling` buckets alone, if given."""
    found = []
    for k, order in enumerate(ORDERS):
        for a in range(0, len(code) - order + 1, PIECE):
            part = code[a : a + PIECE + order - 1].astype(np.uint64)
            h = np.zeros(len(part) - order + 1, np.uint64)
            for j in range(order):
                h = h * np.uint64(0x100000001B3) + part[j : j + len(h)] + np.uint64(1)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h = (h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS)
            found.append(h if telling is None else h[telling[h]])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def features(grams: np.ndarray) -> np.ndarray:
    once, count = np.unique(grams, return_counts=True)
    return np.concatenate((once, once[count > 1] + SIZE))


def fit(texts: list[str], labels: np.ndarray, least_rows: int = 3, least_ratio: float = 1.5, rounds: int = 300, l2: float = 1e-5, rate: float = 0.1) -> Model:
    """Ratios and logistic regression on labelled texts; deterministic.

    With no rows, or rows of one label only, the model is the prior alone.
    """
    size = 2 * SIZE
    y = np.asarray(labels, np.float64)
    n, positive = len(y), float(y.sum())
    prior = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not 0 < positive < n:
        return Model(np.zeros(size, np.float32), prior)
    made = lambda t: features(gram_hashes(characters(t or "")))
    p, q = np.ones(size, np.float32), np.ones(size, np.float32)
    for t, label in zip(texts, y, strict=True):
        (p if label else q)[made(t)] += 1
    ratio = np.log(p / np.float32(positive + 1)) - np.log(q / np.float32(n - positive + 1))
    ratio[(p + q - 2 < least_rows) | (np.abs(ratio) < least_ratio)] = 0
    del p, q
    telling = ratio != 0
    columns = [g[telling[g]].astype(np.int32) for g in map(made, texts)]  # made anew: all of them at once take too much memory
    sizes = np.array([len(c) for c in columns])
    flat = np.concatenate(columns) if sizes.sum() else np.zeros(0, np.int32)
    used, at = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    scale = 1 / np.sqrt(np.maximum(1.0, np.bincount(row, ratio[flat] ** 2, n).mean()))
    value = ratio[flat] * scale
    w, bias = np.zeros(len(used)), prior
    weight = np.where(y > 0, n / (2 * positive), n / (2 * (n - positive)))  # both labels weigh alike
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):  # full-batch Adam
        z = np.bincount(row, value * w[at], n) + bias
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.append(np.bincount(at, value * err[row], len(used)) + l2 * w, err.sum())
        first += 0.1 * (slope - first)
        second += 0.001 * (slope**2 - second)
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    out = np.zeros(size, np.float32)
    out[used] = w * ratio[used] * scale
    return Model(out, float(bias))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the text, with score (0 to 1) and predicted (score >= threshold).

    Null counts as empty and gets the score of a text without features. A text of any length is hashed in pieces. Every
    row is scored alone, so repeated rows agree. Empty in, empty out. Columns named
    score or predicted are replaced.
    """
    others = without(docs.columns, text, "score", "predicted")
    typed = docs.select(*[F.col(f"`{c}`") for c in others], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: 4 bytes for each of 8 << 19 buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights, telling = own.weights, (own.weights[:SIZE] != 0) | (own.weights[SIZE:] != 0)
        for batch in batches:
            z = np.full(batch.num_rows, own.bias)
            for r, value in enumerate(batch.column(batch.schema.get_field_index(text))):
                if t := value.as_py():
                    z[r] += weights[features(gram_hashes(characters(t), telling))].sum(dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*others, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(run, typed.schema)


def train(docs: DataFrame, labels: DataFrame, label: str, learn, text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a sample of at most `most` rows and most_bytes of the labelled rows that satisfy `learn`, a condition on the id."""
    got = training_rows(docs, labels, label, learn, text, doc_id, most, most_bytes).toPandas().sort_values([doc_id, "_y", text], na_position="first")
    return fit(got[text].tolist(), got["_y"].to_numpy())


def query(spark, sf_dir: str) -> DataFrame:
    """op10: toxicity of every whole text, learned where crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "toxic", crc32_mod("doc_id", 5) != 0)
    held = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
