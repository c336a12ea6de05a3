"""Line dedup by winnowing over hashes of line-long runs of words.

A passage that repeats may begin and end inside a line, so what is hashed is not the whole
line but every run of a line's length, a third of `min_words`, at each word; line ends count as any other
white space. A run of at least `min_words` words that occurs earlier, in the order of ids and places, is
deleted where it occurs again:

1. Each stretch of min_words words (a window) selects the smallest of its hashes as its fingerprint. Equal
   windows select equal ones, so a repeated run is sure to share one. Consecutive windows
   that select the same place form a range, with one key for each window.
2. Fingerprints are counted with map-side combine; ranges whose fingerprint occurs once stop here.
3. The places left are joined by fingerprint. A range that equals an earlier one as a whole (the inner part of a
   copy, a passage that a third of all documents hold) is a repeat without a look at its windows.
4. Ranges that differ are matched window by window: each window meets the first equal one alone, never all others. So
   a match extends both ways, word by word, as far as min_words words still agree, and goes on in the
   ranges beside it. Runs of adjoining windows are deleted together.

Windows are equal if 96 bits agree, 64 of the fingerprint and 32 of the window. Windows of one document
repeat each other only if they do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import drop, materialize, slices, text_buffer, without

MIN_WORDS = 50
#: Words of one text that are hashed at once; a longer text is taken in overlapping pieces, which cuts ranges but no window.
PIECE = 1 << 18

_BYTE, _WORD, _LONG = 0x100000001B3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words, and the bytes after them."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _runs(hashes: np.ndarray, base: int, size: int) -> np.ndarray:
    """A hash of each run of `size` word hashes."""
    n = len(hashes)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, n), dtype=np.uint64)))
    return _mix((total[size:] - total[:-size]) * _powers(pow(base, -1, 1 << 64), n)[: n - size + 1])


def ranges(raw: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, ...] | None:
    """(fingerprint, text number, first window, range hash, number of windows, keys of all windows) of the texts raw[at[i]:at[i + 1]]."""
    raw, at = raw[at[0] : at[-1]], at - at[0]
    gaps = np.arange(len(at) - 1)
    spaced = np.full(len(raw) + len(at) - 1, 32, np.uint8)  # a blank after each text, so that no word crosses its end
    spaced[np.arange(len(raw)) + np.repeat(gaps, np.diff(at))] = raw
    begin, end = word_bounds(spaced)
    n, k = len(begin), max(1, min_words // 3)
    if n < min_words:
        return None
    size = end - begin
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    byte = spaced[np.repeat(begin, size) + inner].astype(np.uint64) + np.uint64(1)
    word = _mix(np.add.reduceat(byte * _powers(_BYTE, int(size.max()))[inner], np.cumsum(size) - size))
    owner = np.searchsorted(at + np.arange(len(at)), begin, side="right") - 1
    lead = np.searchsorted(owner, np.arange(len(at)))  # the first word of each text
    short, wide = _runs(word, _WORD, k), min_words - k + 1
    bits = np.uint64(max(1, (wide - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(len(short), dtype=np.uint64) & low
    least, step = (short & ~low) | place, 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = wide - step
    least = np.minimum(least[: len(least) - rest], least[rest:])
    s = np.flatnonzero(owner[: n - min_words + 1] == owner[min_words - 1 :])
    if not len(s):
        return None
    chosen = s + (((least[s] & low) - (s.astype(np.uint64) & low)) & low).astype(np.int64)
    key = (_runs(word, _LONG, min_words)[s] >> np.uint64(32)).astype(np.uint32)
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(chosen) != 0) | (np.diff(s) != 1))))
    many = np.diff(np.append(cut, len(s)))
    turn = np.arange(len(s)) - np.repeat(cut, many)
    whole = _mix(np.add.reduceat(_mix(key.astype(np.uint64) + np.uint64(1)) * _powers(_WORD, int(many.max()))[turn], cut) + (chosen[cut] - s[cut]).astype(np.uint64))
    return short[chosen[cut]], owner[s[cut]], s[cut] - lead[owner[s[cut]]], whole, many, key


def ranges_of_long(raw: np.ndarray, min_words: int) -> tuple[np.ndarray, ...] | None:
    """ranges() of one text of any length, piece by piece."""
    begin, end = word_bounds(raw)
    found = []
    for a in range(0, max(1, len(begin) - min_words + 1), PIECE):
        if len(begin) - a >= min_words:
            b = min(len(begin), a + PIECE + min_words - 1)
            prints, owner, first, *rest = ranges(raw[begin[a] : end[b - 1]], np.array([0, end[b - 1] - begin[a]]), min_words)
            found.append((prints, owner, first + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else None


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """docs(_row, _id, _text) -> one row for each range: _print, _row, _id, _at (its first window's word), _range and _keys."""
    id_type = docs.schema["_id"].dataType.simpleString()
    schema = f"_print long, _row long, _id {id_type}, _at int, _range long, _keys array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(2))
            for i, j in slices(at, 1 << 20):
                found = ranges(raw, at[i : j + 1], min_words) if at[j] - at[i] <= 4 << 20 else ranges_of_long(raw[at[i] : at[j]], min_words)
                if found is None:
                    continue
                prints, owner, first, whole, many, keys = found
                row = pa.array(owner + i)
                ends = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prints.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(first.astype(np.int32)),
                        pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int32))),
                    ],
                    names=["_print", "_row", "_id", "_at", "_range", "_keys"],
                )

    return docs.select("_row", "_id", "_text").mapInArrow(run, schema)


def repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """(_row, _cuts array<struct<a, n>>): first word and number of the windows that repeat earlier ones."""
    prints = fingerprints(docs, min_words)  # made twice, which costs less than to store the keys of all texts
    shared = prints.groupBy("_print").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_print")
    shared = materialize(shared, "line-shared")  # tables of their own: each join shuffles both sides, and a frequent fingerprint's rows can be split
    near = materialize(prints.join(shared, "_print", "left_semi"), "line-ranges")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_at").alias("at"))
    later = (F.col("_row") != F.col("_first.row")) | (F.col("_at") >= F.col("_first.at") + min_words)
    first = materialize(near.groupBy("_print", "_range").agg(F.min(order).alias("_first")), "line-firsts")
    told = near.join(first, ["_print", "_range"]).withColumn("_whole", later).drop("_range", "_first")
    told = materialize(told, "line-told")
    for used in (shared, near, first):
        drop(used)
    mixed = told.where("NOT _whole").groupBy("_print").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_print")
    mixed = materialize(mixed, "line-mixed")
    window = told.where("NOT _whole").join(mixed, "_print", "left_semi").select("_print", "_row", "_id", "_at", F.posexplode("_keys").alias("_i", "_key"))
    window = materialize(window.select("_print", "_key", "_row", "_id", (F.col("_at") + F.col("_i")).alias("_at")), "line-windows")
    drop(mixed)
    start = window.groupBy("_print", "_key").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = window.join(materialize(start, "line-starts"), ["_print", "_key"]).where(later)
    cut = again.select("_row", F.struct(F.col("_at").alias("a"), F.lit(1).alias("n")).alias("c"))
    cut = cut.unionByName(told.where("_whole").select("_row", F.struct(F.col("_at").alias("a"), F.size("_keys").alias("n")).alias("c")))
    return cut.groupBy("_row").agg(F.collect_list("c").alias("_cuts"))


def shortened(text: bytes, cuts: list[dict], min_words: int) -> tuple[bytes, int, int]:
    """(the text without the words of the windows named, its words, the words deleted).

    A word goes together with the white space behind it, and at the end of the text with that before it too.
    """
    raw = np.frombuffer(text, np.uint8)
    begin, _ = word_bounds(raw)
    gone = np.zeros(len(begin) + 1, np.int64)
    for c in cuts:
        gone[c["a"]] += 1
        gone[c["a"] + c["n"] - 1 + min_words] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    size = np.diff(np.concatenate(([0], begin, [len(raw)])))
    kept = raw[np.repeat(np.concatenate(([True], ~gone)), size)].tobytes()
    return kept.rstrip(b" \t\n\v\f\r") if len(gone) and gone[-1] else kept, len(begin), int(gone.sum())


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns and rows of docs, repeated runs of words deleted from the text, with n_words and n_removed.

    Null texts stay null with no words; a text all of whose words are deleted
    becomes empty. Rows with null ids come last in the order, and rows with equal ids in the
    order of their place. Empty in, empty out. Columns named n_words or
    n_removed, in any case, are replaced. docs has to be a stable source (files or a
    materialized table): rows are told apart by their place in it.
    """
    own = without(docs.columns, "n_words", "n_removed")
    base = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(own)], F.monotonically_increasing_id().alias("_row"))
    t, i = own.index(text), own.index(doc_id)
    cuts = repeats(base.select("_row", F.col(f"_c{i}").alias("_id"), F.col(f"_c{t}").alias("_text")), min_words)
    joined = base.join(cuts, "_row", "left").drop("_row")
    typed = joined.drop("_cuts").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")})
    named = typed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(t), batch.column(len(own))
            raw, at = text_buffer(texts)
            words, removed, new = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), {}
            for r in range(batch.num_rows):
                own_text = raw[at[r] : at[r + 1]]
                if marks[r].is_valid:
                    short, words[r], removed[r] = shortened(own_text.tobytes(), marks[r].as_py(), min_words)
                    new[r] = short.decode()
                else:
                    words[r] = len(word_bounds(own_text)[0])
            if new:
                texts = pa.array([new[r] if r in new else x.as_py() for r, x in enumerate(texts)], texts.type)
            columns = [texts if k == t else batch.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(removed)], names=named)

    done = joined.mapInArrow(run, typed.schema)
    return done.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(own)], "n_words", "n_removed")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents with runs of 50 words and more kept once."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH cut AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS t FROM documents
), spelled AS (
    SELECT doc_id, t, list_transform(t, lambda x: regexp_replace(x, '[\x20\x09-\x0D]+$', '')) AS w FROM cut
), placed AS (
    SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM spelled
), windows AS (
    SELECT doc_id, pos, md5(array_to_string(w[pos : pos + 49], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM spelled WHERE len(w) >= 50)
), ranked AS (
    SELECT doc_id, pos, first_value(doc_id) OVER o AS doc0, first_value(pos) OVER o AS pos0
    FROM windows WINDOW o AS (PARTITION BY k ORDER BY doc_id, pos)
), cuts AS (
    SELECT doc_id, pos FROM ranked WHERE doc_id <> doc0 OR pos >= pos0 + 50
), marked AS (
    SELECT p.doc_id, p.pos, p.token,
           coalesce(max(c.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
    FROM placed p LEFT JOIN cuts c ON p.doc_id = c.doc_id AND p.pos = c.pos
), rebuilt AS (
    SELECT doc_id, coalesce(string_agg(token, '' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept, count(*) AS n,
           count(*) FILTER (WHERE gone) AS removed, max_by(gone, pos) AS ends
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN b.doc_id IS NULL THEN d.text
            WHEN b.ends THEN regexp_replace(regexp_extract(d.text, '^[\x20\x09-\x0D]*') || b.kept, '[\x20\x09-\x0D]+$', '')
            ELSE regexp_extract(d.text, '^[\x20\x09-\x0D]*') || b.kept END AS text,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n_words, CAST(coalesce(b.removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN rebuilt b ON d.doc_id = b.doc_id
"""
