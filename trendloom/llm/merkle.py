"""Merkle manifest of a table, with proofs from parent preimages. DataFrame functions only.

Rows are leaves; each group's leaves, in order, form a tree of WIDTH children a node, and the groups' roots, in order,
form the last one. For each parent the table stores its preimage, that is, the hashes of its children one after the
other, 64 characters each. A leaf's proof needs no sibling rows: its place says which parents stand above it
and which slot of each preimage leads to it. Cutting that slot out leaves the siblings; putting another hash
in its place and hashing gives the parent that this hash would have had, up to the root.

Places in a group are counted off without a window over it: rows are dealt by range, sorted in their partition and
numbered by it, and only the counts of (partition, group) are summed up. Levels shrink eightfold; preimages travel down
the tree the same way, so a leaf meets those of all its ancestors in one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import crc32_mod, materialize, without

WIDTH = 8
#: Characters of one hash, that is, of one slot of a preimage.
SLOT = 64


def field(value: Column) -> Column:
    """`-` for null, else the bytes of the value's UTF-8 text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def hash_of(preimage: Column) -> Column:
    return F.sha2(preimage.cast("binary"), 256)


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with _i, the place (from 0) of each in its group in the given order, and _n, the rows of its group."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    told = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "places")  # partition * 2^33 + place in it
    part = F.shiftright("_at", 33).alias("_part")
    counts = told.groupBy(group, part).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_low"))
    whole = Window.partitionBy(group)  # one row for each partition that holds some of the group
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    starts = counts.select(group, "_part", (F.col("_low") - before).alias("_from"), F.sum("_rows").over(whole).alias("_n"))
    return told.withColumn("_part", part).join(starts, [group, "_part"]).withColumn("_i", F.col("_at") - F.col("_from")).drop("_at", "_part", "_from")


def levels(nodes: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """nodes(_g, _n, _i, _h) -> ([parents(_g, _n, _i, _h, _pre) level by level], roots(_g, _h, _depth)).

    A parent's _i counts the parents of its level in the group and _n is how many there are; a group ends at its
    single node, which is a lone leaf where it has one.
    """
    made, roots, level = [], None, nodes
    while True:
        ended = level.where("_n = 1").select("_g", "_h", F.lit(len(made)).alias("_depth"))
        roots = ended if roots is None else roots.unionByName(ended)
        if level.where("_n > 1").limit(1).count() == 0:
            return made, materialize(roots, tag)
        children = F.sort_array(F.collect_list(F.struct("_i", "_h")))  # WIDTH at most
        pre = F.array_join(children["_h"], "").alias("_pre")
        up = level.where("_n > 1").groupBy("_g", F.expr(f"(_n + {WIDTH - 1}) div {WIDTH}").alias("_n"), F.expr(f"_i div {WIDTH}").alias("_i")).agg(pre)
        level = materialize(up.withColumn("_h", hash_of(F.col("_pre"))), tag)
        made.append(level)


def ancestors(made: list[DataFrame], above: DataFrame) -> DataFrame:
    """(_g, _i, _up, more): _up holds the preimages from the leaves' parent _i to the group's root.

    above(_g, _depth, more) is carried down with them. A lone leaf's parent is a row without preimages.
    """
    none = F.array().cast("array<string>").alias("_up")
    more = [c for c in above.columns if c not in ("_g", "_depth")]
    start = lambda k: above.where(F.col("_depth") == k).select("_g", F.lit(0).cast("long").alias("_i"), none, *more)
    up = start(len(made))
    for k in range(len(made) - 1, -1, -1):
        parent = up.select("_g", F.col("_i").alias("_p"), F.col("_up").alias("_rest"), *more)
        here = made[k].select("_g", "_i", "_pre", F.expr(f"_i div {WIDTH}").alias("_p"))
        joined = here.join(parent, ["_g", "_p"]).select("_g", "_i", F.concat(F.array("_pre"), F.col("_rest")).alias("_up"), *more)
        up = joined.unionByName(start(k))
    return up


def _slot(i: Column, level: Column) -> Column:
    """Where the slot of leaf i begins in its ancestor's preimage at that level (from 0)."""
    return (F.pmod(F.floor(i / F.pow(F.lit(float(WIDTH)), level)).cast("long"), F.lit(WIDTH)) * SLOT).cast("int")


def siblings(up: Column, i: Column) -> Column:
    """The hashes beside the path of leaf i, level by level and from left to right, as one text."""
    cut = lambda p, k: F.concat(F.substr(p, F.lit(1), _slot(i, k)), F.substr(p, _slot(i, k) + SLOT + 1))
    return F.array_join(F.transform(up, cut), "")


def folded(leaf: Column, up: Column, i: Column) -> Column:
    """The root that leaf i would give if its hash were `leaf`, the siblings staying as they are."""
    put = lambda p, k, h: hash_of(F.concat(F.substr(p, F.lit(1), _slot(i, k)), h, F.substr(p, _slot(i, k) + SLOT + 1)))
    numbered = F.transform(up, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    return F.aggregate(numbered, leaf, lambda h, s: put(s["p"], s["k"], h))


@dataclass
class Manifest:
    """leaves(own columns, leaf, _g, _i, _n), their parents level by level, and groups(_g, _i, subroot, _depth) with their own parents."""

    leaves: DataFrame
    parents: list[DataFrame]
    groups: DataFrame
    group_parents: list[DataFrame]
    root: DataFrame

    def proofs(self) -> DataFrame:
        """leaves with subroot, root, _up, _top (preimages within and above the group) and _j, the group's place."""
        none = self.root.select("_g", "_depth", F.col("_h").alias("root"))
        above = ancestors(self.group_parents, none).withColumnRenamed("_g", "_all").withColumnRenamed("_up", "_top")
        groups = self.groups.withColumn("_p", F.expr(f"_i div {WIDTH}")).join(above.withColumnRenamed("_i", "_p").drop("_all"), "_p")
        groups = materialize(groups.select("_g", "_depth", "subroot", "root", "_top", F.col("_i").alias("_j")), "groups")
        up = ancestors(self.parents, groups).withColumnRenamed("_i", "_p")
        return self.leaves.withColumn("_p", F.expr(f"_i div {WIDTH}")).join(up, ["_g", "_p"]).drop("_p")


def build(leaves: DataFrame) -> Manifest:
    """The manifest of leaves(leaf, _g, _o, more): groups ascend by the text _g, leaves by _o, null first, then by leaf."""
    told = materialize(leaves, "leaves")  # so that texts are hashed once, and not for the ranges, too
    own = places(told.withColumn("_row", F.monotonically_increasing_id()), "_g", ["_o", "leaf", "_row"]).drop("_row")
    own = materialize(own, "leaves")
    parents, subroots = levels(own.select("_g", "_n", "_i", F.col("leaf").alias("_h")), "manifest")
    ranked = places(subroots.select(F.lit("").alias("_all"), F.col("_g").alias("_key"), "_h", "_depth"), "_all", ["_key"])
    ranked = materialize(ranked, "groups")
    group_parents, root = levels(ranked.select(F.col("_all").alias("_g"), "_n", "_i", "_h"), "manifest")
    return Manifest(own, parents, ranked.select(F.col("_key").alias("_g"), "_i", F.col("_h").alias("subroot"), "_depth"), group_parents, root)


def verified(docs: DataFrame, fields: list[str], group: str, order: str, presented: dict[str, Column], when: Column, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with leaf, subroot, root, proof_sha256, folded_root and verified.

    fields are hashed in their order. Groups ascend by the UTF-8 bytes of their value, null first; a group's leaves by
    `order`, null first. Where `when` holds, a row is presented with the columns of `presented` in place of its own,
    and the root is folded from that leaf and the original siblings; elsewhere from the original leaf. An empty table
    gives an empty result; a lone leaf of a lone group is its own root and has no siblings; equal rows are leaves of
    their own. Columns of docs named like results are replaced.
    """
    made = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    own = without(keep if keep is not None else docs.columns, *made)
    value = {c: F.col(f"`{c}`") for c in fields}
    key = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    leaves = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(own)],
        key.alias("_g"),
        F.col(f"`{order}`").alias("_o"),
        leaf_hash([value[c] for c in fields]).alias("leaf"),
        F.when(F.coalesce(when, F.lit(False)), leaf_hash([presented.get(c, value[c]) for c in fields])).alias("_shown"),
    )
    proof = build(leaves).proofs()
    beside = F.concat(siblings(F.col("_up"), F.col("_i")), siblings(F.col("_top"), F.col("_j")))
    inner = folded(F.coalesce("_shown", "leaf"), F.col("_up"), F.col("_i"))
    kept = [f"_c{k}" for k in range(len(own))]
    told = proof.select(*kept, "leaf", "subroot", "root", hash_of(beside).alias("proof_sha256"), folded(inner, F.col("_top"), F.col("_j")).alias("folded_root"))
    told = told.withColumn("verified", F.col("folded_root") == F.col("root"))
    return told.select(*[F.col(c).alias(name) for c, name in zip(kept, own, strict=True)], *made)  # own names come last, so that none is taken for a helper


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every document a leaf; those whose crc32 three divides are presented with A-Z of the text in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return verified(docs, FIELDS, "lang", "doc_id", {"text": lower}, crc32_mod("doc_id", 3) == 0, keep=["doc_id"])


def _level_sql(name: str, k: int) -> str:
    """Parents of level k of a tree whose nodes are the table <name><k-1>(g, n, i, h)."""
    return f"""{name}{k} AS (SELECT g, (n + 7) // 8 AS n, i // 8 AS i, string_agg(h, '' ORDER BY i) AS pre, sha256(string_agg(h, '' ORDER BY i)) AS h
    FROM {name}{k - 1} WHERE n > 1 GROUP BY g, (n + 7) // 8, i // 8)"""


def _sql(depth: int = 6, group_depth: int = 3) -> str:
    """The same rows up to 8^depth documents of a language and 8^group_depth languages, level by level."""
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    hashed = lambda text: "sha256(" + " || ".join(part(c) for c in (*FIELDS[:-1], text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    slot = lambda i, k: f"64 * (({i} // {8 ** (k - 1)}) % 8)"
    cut = lambda t, i, k: f"coalesce(left({t}{k}.pre, {slot(i, k)}) || substr({t}{k}.pre, {slot(i, k)} + 65), '')"
    roots = lambda t, d: " UNION ALL ".join(f"SELECT g, h FROM {t}{k} WHERE n = 1" for k in range(d + 1))
    walk = [(t, i, k) for t, i, d in (("a", "x.i", depth), ("b", "x.j", group_depth)) for k in range(1, d + 1)]
    joins = "\n    ".join(f"LEFT JOIN {t}{k} ON {t}{k}.g = {'x.g' if t == 'a' else chr(39) * 2} AND {t}{k}.i = {i} // {8**k}" for t, i, k in walk)
    folds = ", ".join(
        f"f{m + 1} AS (SELECT x.* EXCLUDE (f), CASE WHEN p{m} IS NULL THEN f ELSE sha256(left(p{m}, {slot(i, k)}) || f || substr(p{m}, {slot(i, k)} + 65)) END AS f FROM f{m} x)"
        for m, (t, i, k) in enumerate(walk)
    )
    return f"""WITH RECURSIVE crc(doc_id, s, p, k, c) AS (
    SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, 8, 4294967295 FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT doc_id, s, CASE WHEN k = 8 THEN p + 1 ELSE p END, CASE WHEN k = 8 THEN 0 ELSE k + 1 END,
           CASE WHEN k = 8 THEN xor(c, ascii(substr(s, p + 1, 1))) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
    FROM crc WHERE NOT (k = 8 AND p = length(s))
), tampered AS (SELECT doc_id FROM crc WHERE k = 8 AND p = length(s) AND xor(c, 4294967295) % 3 = 0
), leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS g, {hashed("text")} AS leaf, {hashed(lower)} AS shown FROM documents
), a0 AS (
    SELECT *, leaf AS h, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), {", ".join(_level_sql("a", k) for k in range(1, depth + 1))}, subroots AS ({roots("a", depth)}
), b0 AS (SELECT '' AS g, g AS lang, h, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS i FROM subroots
), {", ".join(_level_sql("b", k) for k in range(1, group_depth + 1))}, top AS ({roots("b", group_depth)}
), x AS (
    SELECT a0.doc_id, a0.g, a0.i, b0.i AS j, a0.leaf, b0.h AS subroot, top.h AS root, CASE WHEN tampered.doc_id IS NULL THEN a0.leaf ELSE a0.shown END AS f
    FROM a0 JOIN b0 ON b0.lang = a0.g CROSS JOIN top LEFT JOIN tampered ON tampered.doc_id = a0.doc_id
), f0 AS (
    SELECT x.*, sha256({" || ".join(cut(t, i, k) for t, i, k in walk)}) AS proof_sha256, {", ".join(f"{t}{k}.pre AS p{m}" for m, (t, i, k) in enumerate(walk))}
    FROM x
    {joins}
), {folds}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(walk)}
"""


SQL = _sql()
