"""Language identification of mixed-language texts.

Words are runs of letters. The script of a word's first letter narrows its
candidate languages to those that were seen in that script; per-word scores are
sums of log-probabilities of character trigrams with word edges; a Viterbi pass with a
penalty for each switch labels every word, and so spans of one language. A
text's language is the one whose spans hold most letters. The model is a table of
trigram log-probabilities for each language, fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import crc32_mod, drawn_sample, slices, text_buffer, without

BITS = 16
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 6_000
#: Bytes of their texts together, at most.
TRAIN_BYTES = 64 << 20
SWITCH = 12.0
#: Characters that one Viterbi pass covers at most; text without a blank for so long is cut between characters.
SEGMENT = 1 << 19
UNKNOWN = "und"

#: Unicode blocks by script, first and last code point.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("indic", ((0x900, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
)


@dataclass
class Model:
    languages: list[str]  # sorted
    table: np.ndarray  # float32 [1 << BITS, languages], log-probabilities
    allowed: np.ndarray  # bool [scripts + 1, languages]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, script number) by code point; script 0 is none of those listed."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for k, (_, blocks) in enumerate(SCRIPTS, 1):
        for a, b in blocks:
            script[a : b + 1] = k
    return letter, script


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram hashes, first trigram of each word, letters, script, text number of each word)."""
    letter, script = _tables()
    points = [np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 1 for p in points])
    code = np.zeros(int(sizes.sum()) + 1, np.uint32)  # a zero before each text and at the end
    begin = np.cumsum(sizes) - sizes + 1
    for p, b in zip(points, begin.tolist(), strict=True):
        code[b : b + len(p)] = p
    inside = letter[code]
    masked = np.where(inside, code, 0).astype(np.uint64)
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    h = (masked[at - 1] * np.uint64(0x9E3779B1) + masked[at] * np.uint64(0x85EBCA77C2B2AE63) + masked[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    first = np.flatnonzero(~inside[at - 1])
    owner = np.searchsorted(begin, at[first], side="right") - 1
    return (h >> np.uint64(64 - BITS)).astype(np.int64), first, np.diff(np.append(first, len(at))), script[code[at[first]]], owner


def fit(texts: list[str], labels: list[str], least_share: float = 0.002) -> Model:
    """Trigram log-probabilities with add-half smoothing; a language is allowed in scripts that hold least_share of its words."""
    languages = sorted(set(labels))
    counts = np.full((1 << BITS, len(languages)), 0.5)
    seen = np.zeros((len(SCRIPTS) + 1, len(languages)))
    for k, language in enumerate(languages):
        own = [t or "" for t, label in zip(texts, labels, strict=True) if label == language]
        for i in range(0, len(own), 500):
            grams, _, _, scripts, _ = words(own[i : i + 500])
            counts[:, k] += np.bincount(grams, minlength=1 << BITS)
            seen[:, k] += np.bincount(scripts, minlength=len(SCRIPTS) + 1)
    table = np.log(counts / counts.sum(axis=0)) if languages else counts
    allowed = seen / np.maximum(1, seen.sum(axis=0)) >= least_share
    return Model(languages, table.astype(np.float32), allowed)


def word_scores(model: Model, grams: np.ndarray, first: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    """Scores [words, languages]; languages not seen in a word's script are ruled out, unless all are."""
    out = np.add.reduceat(model.table[grams], first, axis=0).astype(np.float64)
    may = model.allowed[scripts]
    may |= ~may.any(axis=1, keepdims=True)
    out[~may] = -1e9
    return out


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word, texts of sizes[i] words side by side, all texts advanced together."""
    total, k = scores.shape
    label = np.zeros(total, np.int32)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    n = sizes[order]
    if not len(n):
        return label
    start = (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts longer than t words
    back = np.full((total, k), -1, np.int8 if k < 128 else np.int32)  # the label before a switch, or -1 to stay
    best = scores[start]
    ends = np.zeros((len(n), k))
    lanes = np.arange(k)
    for t in range(1, n[0]):
        m = live[t]
        if m < len(best):
            ends[m : len(best)] = best[m:]
            best = best[:m]
        top = best.argmax(axis=1)
        jump = best[np.arange(m), top] - switch
        moved = best < jump[:, None]
        at = start[:m] + t
        back[at] = np.where(moved, top[:, None], -1)
        best = np.where(moved, jump[:, None], best) + scores[at]
    ends[: len(best)] = best
    now = np.zeros(len(n), np.int64)
    final = ends.argmax(axis=1)
    for t in range(n[0] - 1, -1, -1):
        m = live[t]
        newly = n[:m] == t + 1
        now[:m][newly] = final[:m][newly]
        at = start[:m] + t
        label[at] = now[:m]
        came = back[at, now[:m]]
        now[:m] = np.where(came >= 0, came, now[:m])
    return label


def segments(text: str, most: int) -> list[str]:
    """The text in segments of up to `most` characters, cut after white space where there is some."""
    out, at = [], 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most)) + 1
        if cut <= at:
            cut = at + most
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def predict(model: Model, texts: list[str | None], switch: float = SWITCH, segment: int = SEGMENT) -> tuple[list[str], np.ndarray, list[list[tuple[str, int]]]]:
    """(language, score, [(language, words) of each span]) of each text; score is the share of its letters in that language's spans.

    A text beyond `segment` characters is labelled segment by segment; a span may go on across their borders.
    """
    parts, whose = [], []
    for i, t in enumerate(texts):
        cut = segments(t or "", segment)
        parts += cut
        whose += [i] * len(cut)
    k = len(model.languages)
    share = np.zeros((len(texts), max(k, 1)))
    spans: list[list[tuple[str, int]]] = [[] for _ in texts]
    at = 0
    while at < len(parts) and k:
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) <= 4 * segment):
            size += len(parts[end])
            end += 1
        grams, first, letters, scripts, owner = words(parts[at:end])
        if len(first):
            sizes = np.bincount(owner, minlength=end - at)
            label = viterbi(word_scores(model, grams, first, scripts), sizes, switch)
            text = np.array(whose[at:end])[owner]
            share += np.bincount(text * k + label, letters, len(texts) * k).reshape(-1, k)
            cut = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (text[1:] != text[:-1]))))
            for o, x, n in zip(text[cut].tolist(), label[cut].tolist(), np.diff(np.append(cut, len(label))).tolist(), strict=True):
                if spans[o] and spans[o][-1][0] == model.languages[x]:
                    n += spans[o].pop()[1]
                spans[o].append((model.languages[x], n))
        at = end
    total = share.sum(axis=1)
    top = share.argmax(axis=1)
    named = [model.languages[x] if t else UNKNOWN for x, t in zip(top.tolist(), total.tolist(), strict=True)]
    return named, share[np.arange(len(texts)), top] / np.maximum(total, 1), spans


def identify(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """docs without the text, with lang_pred, score and, unless switched off, spans array<struct<lang, words>>.

    Null, empty and letterless texts are 'und' with score 0. Ties, between
    paths and between the letters of two languages, go to the language that comes first in the alphabet. Every row is
    predicted alone, so repeated rows agree. Any number of languages can be learned. Empty in, empty out. Columns named
    like an output column are replaced.
    """
    made = ["lang_pred", "score", *["spans"] * with_spans]
    others = without(docs.columns, text, *made)
    extra = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")]
    if with_spans:
        extra.append(F.array(F.struct(F.lit("").alias("lang"), F.lit(0).alias("words"))).alias("spans"))
    typed = docs.select(*[F.col(f"`{c}`") for c in others], *extra)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one row of the table for each of 2^16 buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, at = text_buffer(column)
            named, score, spans = [], [], []
            for i, j in slices(at, 2 << 20):
                a, b, c = predict(own, column.slice(i, j - i).to_pylist(), switch)
                named += a
                score.append(b)
                if with_spans:
                    spans += [[{"lang": x, "words": n} for x, n in s] for s in c]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            found = [pa.array(named, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))]
            if with_spans:
                found.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*columns, *found], names=[*others, *made])

    return docs.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(run, typed.schema)


def train(docs: DataFrame, learn, text: str = "text", label: str = "lang", doc_id: str = "doc_id", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a sample of at most `most` rows and most_bytes of those with a label that satisfy `learn`, a condition on the id."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.coalesce(learn, F.lit(False))).select(doc_id, text, label)
    got = drawn_sample(rows.where, doc_id, rows.count(), most, F.octet_length(text), most_bytes).toPandas().sort_values([doc_id, label, text], na_position="first")
    return fit(got[text].tolist(), got[label].tolist())


def query(spark, sf_dir: str) -> DataFrame:
    """op3: language of every whole text, learned where crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"), crc32_mod("doc_id", 4) != 2)
    held = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model, with_spans=False).select("doc_id", held, "lang_pred", "score")
