"""Best-fit packing by bin completion.

Documents become pieces of at most `capacity` tokens; only longer documents are
cut, the remainder first. What is left to decide depends on how many pieces there are of each
length, a table of at most `capacity` rows whatever the input's size. Bin completion runs on that table: around the
largest remaining length it enumerates undominated fillings, least waste first, and how often to use each,
and prunes branches whose waste, or the lower bound of what is left, rules out a better result than the incumbent
(best-fit decreasing at first). Pieces of one length are interchangeable, so they are counted off
within salted groups and looked up in the plan by their number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import materialize
from trendloom.llm.tokens import VOCABULARY, encoder

CAPACITY = 2048
#: Groups over which the pieces of one length are counted off, at least, and pieces of all lengths for each group.
SALTS, PER_SALT = 256, 1 << 20
#: Levels of the search whose sets of sums are kept.
KEPT = 64


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(_id, piece, start, length, ids_crc32[, ids]): each document's ids and end_id, cut at capacity; ids little-endian uint32."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            rows: list[int] = []
            for r, value in enumerate(batch.column(1)):
                ids = own.array_of(value.as_py() or "")
                ids.append(end_id)
                first = len(ids) % capacity or capacity
                cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    rows.append(r)
                    for column, x in zip(out[1:], (k, a, b - a, zlib.crc32(raw), raw), strict=False):
                        column.append(x)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, t) for x, t in zip(out[1:], types, strict=False)]]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts by length: [(lengths of one sequence, repetitions)].

    A piece goes into the open sequence with the least room that holds it; sequences of equal content are counted, not listed.
    """
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, content: tuple[int, ...], times: int) -> None:
        if times:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((content, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n > 0:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                room, content, times = capacity, (), n
            else:
                room = rooms[k]
                content, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            fit = room // size  # the next piece finds the least room where this one went
            full = min(times, n // fit)
            put(room - fit * size, content + (size,) * fit, full)
            n -= full * fit
            part = 0
            if full < times and n:
                part = 1
                put(room - n * size, content + (size,) * n, 1)
                n = 0
            if content:
                put(room, content, times - full - part)
    return [(list(content), times) for room in rooms for content, times in open_[room]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that every packing needs: those of pieces over half, and what the room beside them does not hold, at the best threshold."""
    sizes = sorted(k for k, v in counts.items() if v > 0)
    best = -(-sum(k * counts[k] for k in sizes) // capacity)
    big = [k for k in sizes if 2 * k > capacity]
    n_big = sum(counts[k] for k in big)
    small = [k for k in sizes if 2 * k <= capacity]
    rest, beside, sum_beside, at = 0, 0, 0, 0
    for low in reversed(small):  # pieces from `low` on count, and only pieces of up to capacity - low have room for one beside them
        rest += low * counts[low]
        while at < len(big) and big[at] <= capacity - low:
            beside, sum_beside, at = beside + counts[big[at]], sum_beside + big[at] * counts[big[at]], at + 1
        best = max(best, n_big + max(0, -(-(rest - (beside * capacity - sum_beside)) // capacity)))
    return max(best, n_big)


def dominated(chosen: list[int], left: dict[int, int], sizes: list[int], waste: int) -> bool:
    """Whether a piece that is left could take the place of some of the filling's pieces and fill it at least as well.

    All subsets of up to twelve pieces are tried, of more pieces those of one or two: fewer fillings are then ruled out, none wrongly.
    """
    rest = chosen[1:]
    most = len(rest) if len(rest) <= 12 else 2
    sums = {0: 0}
    for size in rest:
        for total, k in list(sums.items()):
            if k < most and sums.get(total + size, 0) <= k:
                sums[total + size] = k + 1
    used = {x: chosen.count(x) for x in chosen}
    for total, k in sums.items():
        for x in sizes[bisect_left(sizes, max(total, 1)) : bisect_right(sizes, total + waste)]:
            if left[x] > used.get(x, 0) and (x > total or k > 1):
                return True
    return False


def _reach(sizes: list[int], left: dict[int, int], largest: int, room: int) -> list[int]:
    """Bit sets of the sums up to `room` that the sizes below each place reach."""
    reach = [1]
    for s in sizes:
        bits, n, step = reach[-1], min(left[s] - (s == largest), room // s), 1
        while n > 0:  # n copies as powers of two and a rest
            bits |= bits << (s * min(step, n))
            n, step = n - min(step, n), step * 2
        reach.append(bits & ((1 << (room + 1)) - 1))
    return reach


def fillings(left: dict[int, int], capacity: int, most_waste: int, memo: dict | None = None) -> Iterator[tuple[int, list[int] | None]]:
    """(waste, lengths) of the undominated fillings around the largest length, least waste first, then larger pieces first; None for a dominated one.

    Sums that the smaller pieces reach are bit sets, so the search for one waste enters hardly any branch without a filling.
    memo keeps the sets of the KEPT levels used last; others are made again, so a deep search takes little memory.
    """
    memo = {} if memo is None else memo
    level, largest = object(), max(left)
    room = capacity - largest
    sizes = sorted(s for s in left if s <= room and (s < largest or left[s] > 1))

    def reach(k: int) -> int:
        if level not in memo:
            memo[level] = _reach(sizes, left, largest, room)
            if len(memo) > KEPT:
                del memo[next(iter(memo))]
        return memo[level][k]

    def spelled(k: int, need: int) -> Iterator[list[int]]:
        if need == 0:
            yield []
            return
        for i in range(min(k, bisect_right(sizes, need)), 0, -1):
            if not reach(i) >> need & 1:
                return
            s = sizes[i - 1]
            for times in range(min(left[s] - (s == largest), need // s), 0, -1):
                if reach(i - 1) >> (need - times * s) & 1:
                    for rest in spelled(i - 1, need - times * s):
                        yield [s] * times + rest

    for waste in range(min(most_waste, room) + 1):
        if reach(len(sizes)) >> (room - waste) & 1:
            for rest in spelled(len(sizes), room - waste):
                ruled_out = waste and dominated([largest, *rest], left, sizes, waste)
                yield waste, None if ruled_out else [largest, *rest]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 20_000) -> list[tuple[list[int], int]]:
    """A packing [(lengths of one sequence, repetitions)] of all counted pieces into few sequences.

    Depth first: a branch is an undominated filling around the largest length left and how often it is used,
    as often as the counts allow at first. A branch ends when its waste, or the lower bound of what is left, rules out a packing
    better than the best one so far, best-fit decreasing at the start; fillings of one length are used in one order. The search stops at the lower
    bound of all, or after `nodes` fillings beyond a whole descent, dominated ones included, with the best packing so far: all pieces are packed either way.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    best = best_fit(left, capacity)
    total, bins, bound = sum(k * v for k, v in left.items()), sum(t for _, t in best), lower_bound(left, capacity)
    if bins <= bound:
        return best
    memo: dict = {}

    def branches(used: int, waste: int, after: tuple | None) -> Iterator[tuple]:
        """Each branch with its pieces taken out of `left`; they are put back before the next one."""
        largest = max(left)
        for loss, chosen in fillings(left, capacity, (bins - 1) * capacity - total - waste, memo):
            if chosen is None:
                yield ()
                continue
            key = (loss, [-x for x in chosen])
            if after and after[0] == largest and key <= after[1]:
                continue
            need = {x: chosen.count(x) for x in chosen}
            for times in range(min(left[x] // n for x, n in need.items()), 0, -1):
                if waste + loss * times > (bins - 1) * capacity - total:
                    continue
                for x, n in need.items():
                    left[x] -= n * times
                    if not left[x]:
                        del left[x]
                if used + times + lower_bound(left, capacity) < bins:
                    yield chosen, times, used + times, waste + loss * times, (largest, key)
                for x, n in need.items():
                    left[x] = left.get(x, 0) + n * times

    plan: list[tuple[list[int], int]] = []
    stack = [branches(0, 0, None)]
    seen, most = 0, nodes + len(best)
    while stack and bins > bound and seen < most:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if plan:
                plan.pop()
            continue
        seen += 1
        if step == ():
            continue
        chosen, times, used, waste, after = step
        if left:
            plan.append((chosen, times))
            stack.append(branches(used, waste, after))
        elif used < bins:
            best, bins = [*plan, (chosen, times)], used
    return best


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut(length, ...), a materialized table, with sequence_id and offset; empty in, empty out. Pieces of one length take their places in the table's order."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, base, taken = [], 0, dict.fromkeys(counts, 0)
    for chosen, times in bin_completion(counts, capacity):
        offset = 0
        for size in chosen:
            slots.append((size, taken[size], taken[size] + times, base - taken[size], offset))
            taken[size] += times
            offset += size
        base += times
    plan = spark.createDataFrame(slots, "length long, _from long, _to long, _shift long, offset long")
    salts = max(SALTS, sum(counts.values()) // PER_SALT)
    row = cut.withColumn("_row", F.monotonically_increasing_id())  # tells repeated rows apart, so that they spread too
    salted = row.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row"))
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_at", F.col("_before") + F.col("_rank") - 1)
    # the plan has a row for each slot of each filling: a few thousand, bounded by the capacity and not by the input
    hit = (ranked["length"] == plan["length"]) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    return ranked.join(F.broadcast(plan), hit).select(
        *[ranked[c] for c in cut.columns], (F.col("_at") + F.col("_shift")).alias("sequence_id"), plan["offset"]
    )


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row for each piece: the id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    Null and empty texts are the end id alone, so every document has a piece.
    Repeated rows are packed as often as they occur, and pieces of one length, which are all alike here, in any order. Columns of docs other than
    the id and the text are not carried. The id's column may have any name but those of the output. Empty in, empty out.
    """
    placed = place(materialize(pieces(docs, text, doc_id, vocabulary, capacity, end_id, with_ids), "pieces"), capacity)
    return placed.withColumnRenamed("_id", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False)
