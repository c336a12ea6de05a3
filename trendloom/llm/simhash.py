"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within radius 3 differ in at most three bits. Each distinct
fingerprint emits the variants within half the radius, rounded so that the halves
add up: one flip for those of odd weight, one or two flips for those of even
weight. Two fingerprints at distance 3 have weights of different parity, so the
even one's two flips meet the odd one's single flip; at distance 1 or 2 single
flips meet. Of any three bits two lie in the same 32-bit half, and any two of the
three serve as the even side's flips, so only two-flip variants inside one half
are emitted: at most 1 + 64 + 992 for a fingerprint.

Variants are shuffled in packed blocks by a mixed hash of the variant. Distinct
fingerprints have distinct variants of each kind, so no bucket grows with the
size of a group of copies. A point where variants meet yields a star around its
nearest fingerprint, never all pairs: with a centre at most one flip away every
other member is within distance 3 of the centre, and two members that both lie
two flips away and share no centre meet again at a single-flip point if they
are linked at all. Each star edge is verified by its bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import components, drop, forest, materialize, shuffle_partitions, slices, text_buffer, without

SEED = 42
_LANES = np.uint64(0x0101010101010101)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Min-hash keys of a document in similar_documents, and minima in each: pairs of similarity 0.8 share a key with probability 1 - (1 - 0.8 ** 6) ** 30.
BANDS, BAND_ROWS = 30, 6
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache
def masks(bits: int) -> np.ndarray:
    """Flips of the low bits: none, each single one, and each pair inside one half; the first 1 + bits flip at most one."""
    half = bits // 2
    one = [1 << i for i in range(bits)]
    two = [1 << (h + i) | 1 << (h + j) for h in (0, half) for i in range(half) for j in range(i + 1, half)]
    return np.array([0, *one, *two], dtype=np.uint64)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each word shingle of an ASCII-lower-cased text, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return []
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of sizes[i] hashes: the bits that more than half of them set."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    parts = (n + 254) // 255  # byte lanes hold sums of up to 255 bits
    lead = np.concatenate(([0], np.cumsum(parts)[:-1]))
    cuts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(lead, parts))
    result = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), lead, axis=0)
        for j in range(8):
            result |= (2 * sums[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    out[full] = result
    return out


def remixed(hashes: np.ndarray, copy: int) -> np.ndarray:
    """Another hash of each shingle, from its first one; copy 0 is the hash itself."""
    if not copy:
        return hashes
    h = hashes + np.uint64(copy) * _MIX
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, copies: int = 1) -> DataFrame:
    """docs with _fp long (64 bits), and _fp1, _fp2, ... of further copies, in place of the text; null text has fingerprint zero."""
    others = [c for c in docs.columns if c != text]
    made = ["_fp", *[f"_fp{k}" for k in range(1, copies)]]
    schema = docs.select(*[F.col(f"`{c}`") for c in others], *[F.lit(0).cast("long").alias(c) for c in made]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(batch.schema.get_field_index(text)))
            found = np.zeros((copies, batch.num_rows), np.uint64)
            for i, j in slices(at, 2 << 20):
                each = [shingle_hashes(raw[at[r] : at[r + 1]].tobytes(), words) for r in range(i, j)]
                sizes = np.array([len(x) for x in each], np.int64)
                hashes = np.array([h for x in each for h in x], np.uint64)
                for k in range(copies):
                    found[k, i:j] = majority(remixed(hashes, k), sizes)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(f.view(np.int64)) for f in found]], names=[*others, *made])

    return docs.mapInArrow(run, schema)


def _emit(buckets: int, bits: int):
    both, single = masks(bits), masks(bits)[: 1 + bits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 2048):
                part = fps[i : i + 2048]
                odd = (np.bitwise_count(part) & 1).astype(bool)
                points, codes = [], []
                for own, flips in ((part[odd], single), (part[~odd], both)):
                    points.append((own[:, None] ^ flips[None, :]).ravel())
                    codes.append(np.tile(np.arange(len(flips), dtype=np.uint16), len(own)))
                points, codes = np.concatenate(points), np.concatenate(codes)
                to = ((points * _MIX) >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(to.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
                points, codes, to = points[order], codes[order], to[order]
                keys, begin = np.unique(to, return_index=True)
                end = [*begin[1:].tolist(), len(to)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.astype(np.int32)),
                        pa.array([points[a:b].tobytes() for a, b in zip(begin.tolist(), end, strict=True)], pa.binary()),
                        pa.array([codes[a:b].tobytes() for a, b in zip(begin.tolist(), end, strict=True)], pa.binary()),
                    ],
                    names=["bucket", "points", "codes"],
                )

    return run


def stars(points: np.ndarray, codes: np.ndarray, bits: int = 64, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges (fingerprint, fingerprint) between the variants that meet in one bucket, a forest of them."""
    order = np.argsort(points, kind="stable")
    points = points[order]
    same = points[1:] == points[:-1]
    meets = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    points, codes = points[meets], codes[order[meets]]
    if not len(points):
        return points, points
    order = np.lexsort((codes, points))  # the nearest of each point comes first
    points, codes = points[order], codes[order]
    first = np.concatenate(([True], points[1:] != points[:-1]))
    group = np.cumsum(first) - 1
    lead = np.flatnonzero(first)
    own = points ^ masks(bits)[codes]
    centre = own[lead][group]
    near = (codes[lead] <= bits)[group] & ~first
    a, b = np.minimum(own, centre)[near], np.maximum(own, centre)[near]
    close = np.bitwise_count(a ^ b) <= radius
    pairs = np.unique(np.stack([a[close], b[close]], axis=1), axis=0)
    return forest(pairs[:, 0], pairs[:, 1])


def _meet(bits: int):
    def run(table: pa.Table) -> pa.Table:
        points = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("points").to_pylist()])
        codes = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("codes").to_pylist()])
        a, b = stars(points, codes, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def links(fps: DataFrame, n: int, bits: int = 64, per_bucket: int = 1_000_000) -> DataFrame:
    """Edges (a, b) that connect exactly the n distinct fingerprints of fps(_fp) within three of the low bits.

    per_bucket is the mean number of variants that one task sorts (10 bytes
    each), which sets the number of buckets and tasks; raise it where tasks get too many. It drops nothing.
    """
    spark = fps.sparkSession
    variants = (len(masks(bits)) + 1 + bits) // 2
    buckets = max(shuffle_partitions(spark), -(-n * variants // per_bucket))
    sent = fps.select("_fp").mapInArrow(_emit(buckets, bits), "bucket int, points binary, codes binary")
    # as many tasks as buckets: a task's share does not grow with n
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet(bits), "a long, b long")


def _named(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with neutral column names, _text last, and the name of each other column that is kept."""
    others = without(docs.columns, text, "_fp", "_label", "component_id")
    names = {f"_c{k}": c for k, c in enumerate(others)}
    return docs.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.col(f"`{text}`").alias("_text")), names


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """docs(doc_id, ...) without the text, with _fp, _label and component_id, the smallest id reachable by links.

    _label, the smallest fingerprint reachable, tells components apart even where ids repeat.

    Null and empty texts, and texts of white space alone, have fingerprint zero
    and link like any other. Repeated rows share a fingerprint. Null ids never
    name a component unless it has no other id. An empty table gives an empty
    result. Other columns named like an output column, in any case, are replaced.
    """
    base, names = _named(docs, text)
    low = next(k for k, c in names.items() if c == doc_id)
    fp = materialize(fingerprints(base, "_text", words), "simhash")
    own = materialize(fp.groupBy("_fp").agg(F.min(low).alias("_low")), "simhash-distinct")
    labels = components(links(own, own.count()), "simhash-links")
    return _labelled(fp, own, labels, names)


def _labelled(fp: DataFrame, own: DataFrame, labels: DataFrame, names: dict[str, str]) -> DataFrame:
    named = own.join(labels, own["_fp"] == labels["node"], "left").select(
        "_fp", "_low", F.coalesce("component", "_fp").alias("_label")
    )
    low = materialize(named.groupBy("_label").agg(F.min("_low").alias("component_id")), "simhash-low")
    told = fp.join(named.join(low, "_label").select("_fp", "_label", "component_id"), "_fp", "left")
    return told.select(*[F.col(k).alias(c) for k, c in names.items()], "_fp", "_label", "component_id")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """docs(..., _text) with _node (a hash of the shingle set, equal for equal sets), _print (the fingerprint), _keys (min-hash bands) and _size (bytes) in place of the text."""
    others, zero = docs.columns[:-1], F.lit(0).cast("long")
    schema = docs.select(*others, zero.alias("_node"), zero.alias("_print"), F.array(zero).alias("_keys"), zero.alias("_size")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, ends = text_buffer(whole.column(len(others)))
            for i, j in slices(ends, 2 << 20):
                batch = whole.slice(i, j - i)
                raw, at = text_buffer(batch.column(len(others)))
                each = [np.array(shingle_hashes(raw[a:b].tobytes(), words), np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                prints = majority(np.concatenate(each), np.array([len(x) for x in each], np.int64))
                sets = [np.unique(x) for x in each]
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sets).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                columns = [batch.column(k) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), keys, pa.array(np.diff(at))], names=[*others, "_node", "_print", "_keys", "_size"])

    return docs.mapInArrow(run, schema)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys for each set: hashes of BAND_ROWS minima each, under as many different orders of the shingles."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    full = np.flatnonzero([len(x) for x in sets])
    if not len(full):
        return out
    flat = np.concatenate([sets[k] for k in full])
    lead = np.concatenate(([0], np.cumsum([len(sets[k]) for k in full])[:-1]))
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(BAND_ROWS):
            key = remixed(key ^ np.minimum.reduceat(flat * _ORDERS[b * BAND_ROWS + r], lead), 1)
        out[full, b] = key
    return out


class _Postings:
    """For each set of a list, how many elements it shares with the others that are still alive."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.ends = np.concatenate(([0], np.cumsum(self.sizes)))
        values, self.element = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        order = np.argsort(self.element, kind="stable")
        self.kinds, self.who, self.what = len(values), np.repeat(np.arange(len(sets)), self.sizes)[order], self.element[order]
        self.alive = np.ones(len(sets), bool)
        self.left = self.at_last = len(sets)
        self._index()

    def _index(self) -> None:
        self.many = np.bincount(self.what, minlength=self.kinds)
        self.first = np.cumsum(self.many) - self.many

    def remove(self, rows: np.ndarray | int) -> None:
        self.alive[rows] = False
        self.left -= np.size(rows)
        if self.left < self.at_last // 2:  # lists of the dead are dropped whenever their share has doubled
            keep = self.alive[self.who]
            self.who, self.what, self.at_last = self.who[keep], self.what[keep], self.left
            self._index()

    def shared(self, row: int) -> np.ndarray:
        own = self.element[self.ends[row] : self.ends[row + 1]]
        many, first = self.many[own], self.first[own]
        at = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        return np.bincount(self.who[at], minlength=len(self.sizes))


def linked_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with an exact Jaccard similarity of `similarity` or more.

    Breadth first: a set is compared once, by counts over postings, with all that are not yet reached.
    """
    edges, lists = [], _Postings(sets)
    for seed in range(len(sets)):
        if not lists.alive[seed]:
            continue
        lists.remove(seed)
        waiting = [seed]
        while waiting and lists.left:
            i = waiting.pop()
            shared = lists.shared(i)
            near = lists.alive & (shared * (1 + similarity) >= similarity * (lists.sizes[i] + lists.sizes) - 1e-9)
            found = np.flatnonzero(near)
            if len(found):
                edges += [(i, j) for j in found.tolist()]
                lists.remove(found)
                waiting += found.tolist()
    return edges


def _compare(words: int, similarity: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, of = table.column("node").to_numpy(), table.column("c").to_numpy()
        raw, at = text_buffer(table.column("_text"))
        order = np.lexsort((nodes, of))
        cuts = np.flatnonzero(np.diff(of[order], prepend=of[order[0]] - 1)).tolist() if len(of) else []
        a, b = [], []
        for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[x:y].tolist()
            for i, j in linked_sets([shingle_set(raw[at[r] : at[r + 1]].tobytes(), words) for r in rows], similarity):
                a.append(nodes[rows[i]])
                b.append(nodes[rows[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _tiles(members: DataFrame, pairs: list, texts: DataFrame, words: int, similarity: float, n: int) -> DataFrame:
    """Links found in tiles: members(c, node, ...) go to the tiles that `pairs`, an array column of structs (bucket, one, two), names."""
    sent = members.select("c", "node", F.explode(pairs).alias("t")).select("c", "node", "t.*").distinct().join(texts, "node")
    keys = ["bucket", "one", "two"]
    return sent.repartition(n, *keys).groupBy(*keys).applyInArrow(_compare(words, similarity), "a long, b long")


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """Like near_duplicates, for shingle sets of an exact Jaccard similarity of `similarity` or more; _fp is a hash of the set.

    Candidates come from near_duplicates' own method: the components of fingerprints within three bits, by
    meet-in-the-middle ball hashing, are the first clusters. An exact check follows: every link is decided by the two sets.
    Fingerprints of pairs of similarity 0.8 differ in about ten of 64 bits, and balls of that radius are too
    large to emit. For what lies beyond three bits there are BANDS min-hash keys, one of which pairs
    of similarity 0.8 share with a probability of 0.9999; a key whose documents are all of one component adds nothing and goes.

    The smallest node of each key that is left is its centre, and all documents that share a key with a centre are its
    cluster, so the two of any candidate pair are in one cluster, of this kind or the first. A cluster's texts are compared by exact
    counts over postings, which gives a forest of its links and no pairs. Small clusters are put
    together in tasks of about block_bytes. A larger one is cut into blocks of that size: first every block meets the
    first one, then the documents outside the cluster's largest component, if any, meet all blocks. Two
    documents that are never compared are linked by then, so no link is lost and a group of near
    copies costs no pairs of blocks. docs has to be a stable source: texts of candidates are read again by their place.
    """
    spark = docs.sparkSession
    base, names = _named(docs, text)
    low = next(k for k, c in names.items() if c == doc_id)
    place = base.select(*names, F.monotonically_increasing_id().alias("_place"), "_text")
    fp = materialize(shingle_sets(place, words), "similar-sets")
    rep = F.min_by(F.struct("_place", "_size", "_print", "_keys"), "_place").alias("_rep")
    own = materialize(fp.groupBy(F.col("_node").alias("_fp")).agg(F.min(low).alias("_low"), rep).select("_fp", "_low", "_rep.*"), "similar-distinct")
    prints = materialize(own.select(F.col("_print").alias("_fp")).distinct(), "similar-prints")
    balls = components(links(prints, prints.count()), "similar-balls").withColumnRenamed("node", "_ball")
    told = own.join(balls, own["_print"] == balls["_ball"], "left").select(F.col("_fp").alias("node"), F.coalesce("component", "_print").alias("ball"), "_keys")
    told = materialize(told, "similar-balls")
    groups = told.groupBy("ball").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("ball")
    groups = materialize(groups, "similar-groups")  # a table of its own: a large group's rows can be split
    each = materialize(told.select(F.explode("_keys").alias("key"), "node", "ball"), "similar-keys")
    centre = each.groupBy("key").agg(F.min("node").alias("c"), F.min("ball").alias("low"), F.max("ball").alias("high")).where("low < high").select("key", "c")
    centre = materialize(centre, "similar-centres")  # likewise
    star = each.join(centre, "key").select("c", "node")  # a centre is a member too
    star = materialize(star.unionByName(told.join(groups, "ball").select(F.col("ball").alias("c"), "node")).distinct(), "similar-members")
    for used in (prints, told, groups, each):
        drop(used)
    sized = own.select(F.col("_fp").alias("node"), "_place", "_size")
    needed = sized.join(star.select("node").distinct(), "node", "left_semi")
    texts = materialize(place.select("_place", "_text").join(needed, "_place").select("node", "_text"), "similar-texts")
    blocks = F.ceil(F.sum("_size") / F.lit(float(block_bytes))).cast("int")
    plan = star.join(sized, "node").groupBy("c").agg(F.greatest(F.lit(1), blocks).alias("blocks"), F.sum("_size").alias("bytes"))
    plan = materialize(plan, "similar-plan")
    total = plan.agg(F.sum("bytes"), F.sum(F.when(F.col("blocks") > 1, F.col("blocks")))).first()
    n = max(shuffle_partitions(spark), -(-(total[0] or 0) // block_bytes), 2 * (total[1] or 0))
    members = materialize(star.join(plan, "c").withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "similar-blocks")
    tile = lambda bucket, one, two: F.struct(bucket.cast("int").alias("bucket"), one.cast("int").alias("one"), two.cast("int").alias("two"))
    zero, k, count = F.lit(0), F.col("k"), F.col("blocks")
    small = F.array(tile(F.pmod(F.xxhash64(F.lit(1), "c"), F.lit(n)), F.lit(-1), F.lit(-1)))
    with_first = F.when(k == 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), count - 1)), lambda x: tile(F.hash("c"), zero, x))).otherwise(F.array(tile(F.hash("c"), zero, k)))
    found = materialize(_tiles(members, F.when(count == 1, small).otherwise(with_first), texts, words, similarity, n), "similar-links")
    labels = components(found, "similar-cc")
    if total[1]:  # clusters of several blocks
        big = members.where(count > 1).join(sized.select("node", "_size"), "node").join(labels.withColumnRenamed("component", "label"), "node", "left")
        big = materialize(big.withColumn("label", F.coalesce("label", "node")), "similar-big")
        most = big.groupBy("c", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("c").agg(F.max(F.struct("m", "label"))["label"].alias("most"))
        told = materialize(big.join(materialize(most, "similar-most"), "c").withColumn("outside", F.col("label") != F.col("most")), "similar-told")
        rounds = told.where("outside").groupBy("c").agg(F.ceil(F.sum("_size") / F.lit(float(block_bytes))).cast("int").alias("rounds"))
        again_ = told.join(materialize(rounds, "similar-rounds"), "c").withColumn("r", F.pmod(F.xxhash64(F.lit(2), "node"), F.greatest(F.lit(1), F.col("rounds"))).cast("int"))
        to_all = F.transform(F.sequence(F.lit(0), count - 1), lambda x: tile(F.hash("c"), F.col("r"), x))
        from_all = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("rounds")) - 1), lambda x: tile(F.hash("c"), x, k))
        pairs = F.when(F.col("outside"), F.array_union(to_all, from_all)).otherwise(from_all)
        found = found.unionByName(materialize(_tiles(again_, pairs, texts, words, similarity, n), "similar-links"))
        labels = components(found, "similar-cc")
    for used in (centre, star, plan, members, texts):
        drop(used)
    return _labelled(fp.drop("_keys", "_print", "_size", "_place").withColumnRenamed("_node", "_fp"), own.select("_fp", "_low"), labels, names)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprints of three-word shingles of all documents, linked at three or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
