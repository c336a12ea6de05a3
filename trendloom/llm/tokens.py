"""Token counts of whole texts, huge documents by overlap resynchronisation.

A text of up to CHUNK characters is encoded at once. A longer one is encoded in
overlapping chunks with offsets, and two encodings are spliced at a stable common
boundary: a blank between a letter or digit on its left and on its right. There the
splitting rule of byte-level BPE always ends one piece and begins the next
(a piece has at most one blank, at its front), it looks at nothing before the
place where a piece begins, and merges never cross pieces, so everything after
the boundary is encoded alike whatever came before it. Where an overlap holds no
such boundary, or the encodings do not both break there, the overlap is
doubled; in the end the rest of the text is encoded whole. A count needs no offsets: byte-level ids
spell the text, so the sums of their bytes give the places where tokens end.

Counts come from the vocabulary's own library. Packing, which has less time for a text, takes its ids from a second encoder of
the same vocabulary (ranks file): same splitting pattern, same merges in the same order, so the same ids, as tests
compare on all code points and on whole tables. A worker uses it only after both
agreed on a probe, and texts with a special string always go to the first one.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import package_path, slices, text_buffer, without

VOCABULARY = "byte_bpe_50k.json"
CHUNK = 8_192
OVERLAP = 256
#: Chunks of a long text that are encoded in one call.
TOGETHER = 64

_PROBE = "Don't stop, l'été déjà!  It's 3,000\tµm \n\n naïve ñandú 你好🙂 <tag> a_b'll --==## ''' 12ab x  "


class Encoder:
    """ids and offsets of one vocabulary file; .json by tokenizers, .model by sentencepiece."""

    def __init__(self, vocabulary: str):
        path = package_path(vocabulary)
        self.fast = self.model = self.pieces = self.sizes = None
        self.special: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = self._second(path)
        if type(self.model.pre_tokenizer).__name__ == "ByteLevel" and self.model.normalizer is None:
            names = self.model.get_vocab(with_added_tokens=True)
            self.sizes = np.zeros(max(names.values()) + 1, np.int64)
            for name, k in names.items():
                self.sizes[k] = len(name)  # a character for each byte
            for k, t in self.model.get_added_tokens_decoder().items():
                self.sizes[k] = len(t.content.encode())

    def _second(self, path: str):
        if not os.path.exists(ranks_file := path.removesuffix(".json") + ".tiktoken"):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return fast if fast.encode_ordinary(_PROBE) == self.whole(_PROBE) else None

    def whole(self, text: str) -> list[int]:
        """ids of the text by the vocabulary's own library, in one call."""
        if self.pieces is not None:
            return self.pieces.encode(text, num_threads=1)
        return self.model.encode(text, add_special_tokens=False).ids

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of ids of short texts, by the vocabulary's own library."""
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def array_of(self, text: str, chunk: int = CHUNK) -> array:
        """ids of a text of any length, by the second encoder where it may be used, from stable boundary to stable boundary."""
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.resynchronised(text))
        out, at = array("I"), 0
        while at < len(text):
            end = at + chunk
            while end < len(text) and not (p := _stable_before(text, at, end)):
                end += chunk
            end = p if end < len(text) else len(text)
            out.extend(self.fast.encode_ordinary(text[at:end]))
            at = end
        return out

    def resynchronised(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """ids of a long text from overlapping chunks, equal to whole(text)."""
        if self.model is None or len(text) <= chunk:
            return self.whole(text)
        out: list[int] = []
        at, end = 0, chunk
        left = self._spans(text, at, end)
        while end < len(text):
            wide, spliced = overlap, False
            while not spliced and end - wide > at:
                begin, stop = end - wide, min(len(text), end - wide + chunk + wide)
                right = self._spans(text, begin, stop)
                for p in range(end - 2, begin, -1):
                    if stable(text, p) and (i := _break(left, p)) is not None and (j := _break(right, p)) is not None:
                        out += left[0][:i]
                        left = (right[0][j:], right[1][j:])
                        at, end, spliced = p, stop, True
                        break
                wide *= 2
            if not spliced:  # no boundary in all of the chunk: it grows to twice its length
                end = min(len(text), at + 2 * (end - at))
                left = self._spans(text, at, end)
        return out + left[0]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The number of ids of resynchronised(text), without the library's offsets: the bytes of each id tell where it ends.

        A text without a boundary in some overlap, or with ids that do not spell its bytes, goes to resynchronised().
        """
        if self.sizes is None or len(text) <= chunk:
            return len(self.resynchronised(text, chunk, overlap))
        total, at, stop, left = 0, 0, 0, None
        for k in range(0, len(text), TOGETHER * chunk):
            spans = [(max(0, a - overlap), min(len(text), a + chunk)) for a in range(k, min(len(text), k + TOGETHER * chunk), chunk)]
            for (begin, end), found in zip(spans, self.model.encode_batch_fast([text[a:b] for a, b in spans], add_special_tokens=False), strict=True):
                right = np.cumsum(self.sizes[found.ids])
                if right[-1] != len(text[begin:end].encode()):
                    return len(self.resynchronised(text, chunk, overlap))
                if left is not None:
                    for p in range(stop - 2, max(at, begin), -1):
                        if parted(text, p) and (i := _ended(left, left[-1] - len(text[p:stop].encode()))) and (j := _ended(right, len(text[begin:p].encode()))):
                            total += i - j
                            at = p
                            break
                    else:
                        return len(self.resynchronised(text, chunk, overlap))
                stop, left = end, right
        return total + len(left)

    def _spans(self, text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int]]]:
        found = self.model.encode(text[a:b], add_special_tokens=False)
        return found.ids, [(x + a, y + a) for x, y in found.offsets]


def stable(text: str, p: int) -> bool:
    """A blank between two letters or digits, where every piece before it ends and one begins."""
    return text[p] == " " and text[p - 1].isalnum() and text[p + 1].isalnum()


def parted(text: str, p: int) -> bool:
    """A blank between two characters, each a letter, a digit or visible ASCII: a blank before anything but white space begins a piece too."""
    return text[p] == " " and all(c.isalnum() or "!" <= c <= "~" for c in (text[p - 1], text[p + 1]))


def _stable_before(text: str, a: int, b: int) -> int:
    """The last stable boundary in text[a + 1:b], or 0."""
    p = text.rfind(" ", a + 1, b)
    while p > a and not stable(text, p):
        p = text.rfind(" ", a + 1, p)
    return max(p, 0)


def _ended(ends: np.ndarray, q: int) -> int:
    """The number of tokens that end at or before q, if one ends there; else 0."""
    i = int(np.searchsorted(ends, q, side="right"))
    return i if i and ends[i - 1] == q else 0


def _break(spans: tuple[list[int], list[tuple[int, int]]], p: int) -> int | None:
    """The number of tokens that end at or before p, if the next one begins at p or after it."""
    offsets = spans[1]
    low, high = 0, len(offsets)
    while low < high:
        mid = (low + high) // 2
        if offsets[mid][1] <= p:
            low = mid + 1
        else:
            high = mid
    return low if low < len(offsets) and offsets[low][0] >= p else None


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(vocabulary)


def token_counts(
    docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null text counts as empty: no bytes, no tokens. Any number of rows may hold
    the same id or text; each gives one row. Empty in, empty out. Input columns
    named like an output column are replaced.
    """
    made = ["n_bytes", "n_tokens", "over_limit"]
    others = without(docs.columns, text, *made)
    typed = docs.select(
        *[F.col(f"`{c}`") for c in others],
        F.lit(0).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.lit(False).alias("over_limit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, at = text_buffer(column)
            size, count = np.diff(at), np.zeros(batch.num_rows, np.int64)
            for i, j in slices(at, 1 << 20):
                texts = [s or "" for s in column.slice(i, j - i).to_pylist()]
                short = [k for k, s in enumerate(texts) if len(s) <= chunk]
                count[[i + k for k in short]] = own.counts([texts[k] for k in short])
                for k, s in enumerate(texts):
                    if len(s) > chunk:
                        count[i + k] = own.count(s, chunk, overlap)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            over = pa.array(count > limit)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(count, pa.int64()), over], names=[*others, *made])

    return docs.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(run, typed.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: bytes and tokens of every whole text of documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
