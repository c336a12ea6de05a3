"""The corpus pipeline: five stages over documents, each on all that the one before kept.

1. quality: documents scored below 0.7 by nearest-neighbour voting go.
2. lines: later copies of runs of 50 words and more, wherever they begin and end, are deleted.
3. near_duplicates: of each component of near copies the smallest id stays. Candidates come from SimHash fingerprints of five-word
   shingles by meet-in-the-middle ball hashing, as in op5, and, beyond three bits, from min-hash keys; two texts are near copies
   when the exact Jaccard similarity of their shingle sets is 0.8 or more.
4. mixture: sources are repeated at Poisson rates towards equal shares of bytes.
5. packing: what is left is packed into sequences of at most 2048 tokens.

All but the last stage return the five columns of documents, in their order; further columns of
their input, whatever their names, are not carried. No stage drops, caps or samples rows beyond its own decision. A null score cannot occur; null texts go through
all stages as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import line_dedup, mixing, packing, quality, simhash
from trendloom.llm.common import crc32_mod, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents alone."""
    return df.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents predicted to be of quality 1; fitted on the labelled rows of this input, held-out ids excepted."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "quality", crc32_mod("doc_id", 4) != 2)
    return _documents(quality.score(docs, model, keep_text=True).where("predicted = 1"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated runs of words; a document whose text changed gets its new n_chars."""
    out = line_dedup.line_dedup(docs)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _documents(out.withColumn("n_chars", chars))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies, the one with the smallest id, null ids last; SimHash by ball hashing, then exact similarities."""
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    found = simhash.similar_documents(placed.select("_row", "doc_id", "text"), words=5, similarity=0.8)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.col("_row").alias("row"))
    keep = found.groupBy("_label").agg(F.min(order).alias("_first")).select(F.col("_first.row").alias("_row"))
    return _documents(placed.join(keep, "_row", "left_semi"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources reach equal shares of bytes, in a global shuffle."""
    return _documents(mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every document, repetitions included; the last stage returns pieces and their places."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints and the tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as a table in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
