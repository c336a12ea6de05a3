"""Exact dedup by deterministic block naming. DataFrame functions only.

Texts are cut into fixed-size blocks. Equal blocks get one integer name, their
rank among the sorted blocks of a hash bucket; then adjacent names are named
as pairs, level by level, until a document is one name. Names are ranks of
distinct values, so unlike digests they cannot collide, and two documents of as
many blocks have the same last name exactly when their texts are equal.

A block or pair that occurs once proves its document different from all others,
which then leaves the recursion: only candidates for copies travel on. Every
grouping has map-side combine, and names come back by an equi-join whose
frequent keys adaptive execution splits, so one text may hold any share of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import materialize

#: Buckets in which distinct values are sorted and counted off; a name is bucket * 2^40 + rank.
BUCKETS = 1 << 16


def normalized(text: Column) -> Column:
    """The text with each run of white space as one blank; null counts as empty.

    Byte-wise replacements turn every white-space character into a blank; the regular expression
    runs only on texts in which blanks then follow each other.
    """
    blanks = F.coalesce(text, F.lit(""))
    for c in "\t\n\v\f\r":
        blanks = F.replace(blanks, F.lit(c), F.lit(" "))
    return F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, " {2,}", " ")).otherwise(blanks)


def _named(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name) of the values that occur at least twice, one integer for each."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    repeated = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return repeated.select(*keys, bucket.alias("_bucket")).select(
        *keys, (F.col("_bucket") * F.lit(1 << 40) + rank).alias("_name")
    )


def block_identities(texts: DataFrame, block: int = 2048) -> DataFrame:
    """texts(_row, _text) -> (_row, _blocks, _name) of the rows whose text occurs more than once.

    Rows with equal (_blocks, _name) hold equal texts, and rows that are absent
    hold texts that no other row has.
    """
    pieces = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{int(block)}}}"), F.lit(0))
    cut = texts.select("_row", F.when(F.length("_text") == 0, F.array(F.lit(""))).otherwise(pieces).alias("_cut"))
    rows = cut.select("_row", F.size("_cut").alias("_blocks"), F.posexplode("_cut").alias("_pos", "_block"))
    names = _named(rows.select("_block"), ["_block"])
    level = materialize(_whole(rows.join(names, "_block"), "_blocks"), "names")
    done = None
    while True:
        ended = level.where(F.size("_names") == 1).select("_row", "_blocks", F.col("_names")[0].alias("_name"))
        done = ended if done is None else done.unionByName(ended)
        if level.where(F.size("_names") > 1).limit(1).count() == 0:
            return done
        pairs = level.where(F.size("_names") > 1).select(
            "_row",
            "_blocks",
            F.expr("int((size(_names) + 1) / 2)").alias("_size"),
            F.posexplode(
                F.expr("transform(sequence(0, size(_names) - 1, 2), i -> struct(_names[i] as a, if(i + 1 < size(_names), _names[i + 1], -1L) as b))")
            ).alias("_pos", "_pair"),
        ).select("_row", "_blocks", "_size", "_pos", "_pair.a", "_pair.b")
        names = _named(pairs.select("a", "b"), ["a", "b"])
        level = materialize(_whole(pairs.join(names, ["a", "b"]), "_size"), "names")


def _whole(named: DataFrame, size: str) -> DataFrame:
    """The names of each row in order, for rows all of whose blocks have one."""
    keep = sorted({"_blocks", size})
    return (
        named.groupBy("_row", *keep)
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_name"))).alias("_at"))
        .where(F.size("_at") == F.col(size))
        .select("_row", "_blocks", F.col("_at._name").alias("_names"))
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = 2048) -> DataFrame:
    """One row for each input row: keep_id, group_size, kept, text_sha256 beside all input columns.

    Equal texts (after white-space normalisation, null as empty) form a group;
    the row with the smallest id stays, null ids last, one row alone where ids
    repeat. Input columns keep their names, but those four are replaced. An
    empty table gives an empty result. docs has to be a stable source (files or
    a materialized table): rows are told apart by their place in it.
    """
    out = ["keep_id", "group_size", "kept", "text_sha256"]
    own = [c for c in docs.columns if c.lower() not in out]
    named = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(own)]
    placed = docs.select(*named, F.monotonically_increasing_id().alias("_row"))
    key, content = F.col(f"_c{own.index(doc_id)}"), normalized(F.col(f"_c{own.index(text)}"))
    same = block_identities(placed.select("_row", content.alias("_text")), block)
    members = placed.select("_row", key.alias("_id")).join(same, "_row")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = members.groupBy("_blocks", "_name").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_size"))
    groups = materialize(groups, "copies")  # a table of its own: the join shuffles both sides, and a large group's rows can be split
    told = members.join(groups, ["_blocks", "_name"]).select("_row", "_first", "_size")
    hashed = placed.withColumn("_sha", F.sha2(content.cast("binary"), 256))  # before the join, which then need not move texts
    return hashed.join(told, "_row", "left").select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(own)],
        F.when(F.col("_size").isNull(), key).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | (F.col("_first.row") == F.col("_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: exact groups over whole texts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).drop("text")


SQL = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY s) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept,
       sha256(s) AS text_sha256
FROM t
"""
