"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source's mean repetition rate is what its target share of the output asks for,
divided by what it has. Each document draws its number of copies by inverting the
Poisson distribution with that mean at a uniform number hashed from seed and id:
the number of cumulative probabilities at or below it. Documents are exploded by their counts
and ordered by a hash of seed, id and copy, a global shuffle.

Probabilities are worked out around the mean only, some 24 of its roots wide, since those further out are
below any hashed number; a document finds its count by halving. A document of many copies is first dealt
out as blocks of copies, so no task writes all copies of one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import materialize

SEED = 20240
#: Distributions of so many probabilities together, and of so many sources, are broadcast: under 40 MB.
MOST_STEPS, MOST_SOURCES = 4_000_000, 10_000
#: Rates above it begin their distribution below the mean, not at zero.
FROM_ZERO = 400.0
#: Copies that one row is exploded to at a time.
BLOCK = 4_096
#: Rates above it would ask for more copies of one document than an int counts; they raise.
MOST_RATE = 2e9
#: 2^52: uniform numbers are 13 hexadecimal digits of an MD5.
_UNIT = 4503599627370496.0


def _uniform(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, text: str = "text", source: str = "source", epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): bytes and mean repetitions of each source; a null source is the source ''.

    Without weights all sources weigh alike; a source without a weight in a given table has
    rate 0. The output's expected size is epochs times the input's, as far as sources
    with weights have any bytes.
    """
    name = F.coalesce(F.col(f"`{source}`"), F.lit(""))
    size = F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")) + F.lit(1)  # one for the separator
    sizes = docs.groupBy(name.alias("_source")).agg(F.sum(size.cast("long")).alias("_size"))
    if weights is None:
        weighed = sizes.withColumn("_weight", F.lit(1.0))
    elif weights:
        table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))])
        weighed = sizes.withColumn("_weight", F.coalesce(F.element_at(table, F.col("_source")), F.lit(0.0)))
    else:
        weighed = sizes.withColumn("_weight", F.lit(0.0))
    total = weighed.agg(F.sum("_size").alias("_all"), F.sum("_weight").alias("_weights"))
    share = F.col("_weight") / F.when(F.col("_weights") > 0, F.col("_weights"))
    return weighed.crossJoin(F.broadcast(total)).select(  # the right side is one row
        "_source", "_size", F.coalesce(share * F.lit(epochs) * F.col("_all") / F.col("_size"), F.lit(0.0)).alias("_rate")
    )


def with_distribution(rated: DataFrame) -> DataFrame:
    """(_source, _lowest, _cumulative): the Poisson probabilities of at most _lowest, _lowest + 1, ... copies, on both sides far beyond any hashed uniform number."""
    reach = F.lit(12.0) * F.sqrt("_rate") + F.lit(30.0)
    lowest = F.when(F.col("_rate") > FROM_ZERO, F.floor(F.col("_rate") - reach)).otherwise(F.lit(0)).cast("long")
    steps = rated.select("_source", "_rate", lowest.alias("_lowest"), F.explode(F.sequence(lowest, F.ceil(F.col("_rate") + reach).cast("long"))).alias("_n"))
    n, rate, up = F.col("_n").cast("double"), F.col("_rate"), Window.partitionBy("_source").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    factorial = F.sum(F.when(F.col("_n") > 0, F.log(n)).otherwise(F.lit(0.0))).over(up)
    near_zero = F.when(rate > 0, F.exp(n * F.log(rate) - rate - factorial)).otherwise(F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    # around a large mean: deviance and Stirling's remainder, both small, in place of differences of large logarithms
    x = (n - rate) / rate
    deviance = rate * ((F.lit(1.0) + x) * F.log1p(x) - x)
    stirling = F.lit(1.0) / (12 * n) - F.lit(1.0) / (360 * n * n * n) + F.lit(1.0) / (1260 * n * n * n * n * n)
    around = F.exp(-deviance - stirling) / F.sqrt(F.lit(2 * math.pi) * n)
    each = steps.withColumn("_p", F.when(rate > FROM_ZERO, around).otherwise(near_zero)).withColumn("_c", F.sum("_p").over(up))
    listed = each.groupBy("_source", "_lowest").agg(F.sort_array(F.collect_list(F.struct("_n", "_c"))).alias("_l"))
    return listed.select("_source", "_lowest", F.col("_l._c").alias("_cumulative"))


#: How many probabilities are at or below _u, by halving.
_COUNT = """if(_u = 0, 0L, _lowest + aggregate(sequence(0, cast(log2(size(_cumulative)) as int) + 1), named_struct('a', 0, 'b', size(_cumulative)),
    (s, x) -> if(s.a >= s.b, s, if(_cumulative[cast((s.a + s.b) div 2 as int)] <= _u,
        named_struct('a', cast((s.a + s.b) div 2 as int) + 1, 'b', s.b), named_struct('a', s.a, 'b', cast((s.a + s.b) div 2 as int)))),
    s -> s.a))"""


def _repeated(counted: DataFrame, ident: Column, own: list[str], split: bool) -> DataFrame:
    """Each row _copies times, with copy; counts beyond BLOCK, where there may be any, are dealt out in blocks first."""
    kept = [F.col(f"`{c}`") for c in own]
    copy = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")
    if not split:
        return counted.select(*kept, copy)
    blocks = counted.where(F.col("_copies") > BLOCK).select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {BLOCK}").cast("int"))).alias("_block"))
    dealt = blocks.repartition(ident, F.col("_block"))
    inside = F.sequence(F.col("_block") * BLOCK + 1, F.least(F.col("_copies"), (F.col("_block") + 1) * BLOCK))
    return counted.where(F.col("_copies") <= BLOCK).select(*kept, copy).unionByName(dealt.select(*kept, F.explode(inside).alias("copy")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id", epochs: float = 1.0, seed: int = SEED, shuffled: bool = True) -> DataFrame:
    """docs, each row as often as drawn, with copy int (from 1) and shuffle_key, in the order of shuffle_key.

    Rows with the same id draw the same number. Null ids draw as the empty
    string. Rows drawn zero times are absent. Empty in, empty out. Columns named
    copy or shuffle_key are replaced. The distributions are one row for each source. They are
    counted: up to MOST_SOURCES and MOST_STEPS they are broadcast, so that documents are not shuffled by
    source; beyond that the planner joins them, and adaptive execution splits a
    source that holds most rows. A rate above MOST_RATE raises.
    """
    own = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rated = materialize(rates(docs, weights, text, source, epochs), "mix-rates")
    steps = F.lit(24.0) * F.sqrt("_rate") + F.lit(62.0)
    told = rated.agg(F.count(F.lit(1)).alias("n"), F.sum(steps).alias("steps"), F.max("_rate").alias("most")).first()
    most = told["most"] or 0.0
    if most > MOST_RATE:
        raise ValueError(f"a source would have to be repeated {most:.3g} times: give it a smaller weight")
    few = told["n"] <= MOST_SOURCES and (told["steps"] or 0) <= MOST_STEPS
    drawn_from = with_distribution(rated)
    drawn_from = F.broadcast(drawn_from) if few else drawn_from
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    named = docs.withColumn("_source", F.coalesce(F.col(f"`{source}`"), F.lit("")))
    drawn = named.join(drawn_from, "_source").withColumn("_u", _uniform(F.lit(str(seed)), ident))
    counted = drawn.withColumn("_copies", F.expr(_COUNT).cast("int")).where("_copies > 0").select(*[F.col(f"`{c}`") for c in own], "_copies")
    copies = _repeated(counted, ident, own, split=most + 12 * most**0.5 + 30 > BLOCK)
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), ident, F.col("copy").cast("string")).cast("binary")))
    return keyed.orderBy("shuffle_key") if shuffled else keyed


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all sources mixed to equal shares of bytes, one epoch in size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "copy", "shuffle_key")


SQL = """
WITH d AS (
    SELECT doc_id, source, coalesce(source, '') AS s, strlen(coalesce(text, '')) + 1 AS size,
           ('0x' || substr(md5('20240|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM documents
), r AS (
    SELECT s, sum(sum(size)) OVER () / (count(*) OVER ())::DOUBLE / sum(size) AS rate FROM d GROUP BY s
), k AS (
    SELECT s, rate, n, sum(CASE WHEN n = 0 THEN 0 ELSE ln(n) END) OVER (PARTITION BY s ORDER BY n) AS f
    FROM r, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS n)
), c AS (
    SELECT s, n, sum(exp(n * ln(rate) - rate - f)) OVER (PARTITION BY s ORDER BY n) AS cumulative FROM k
), drawn AS (
    SELECT d.doc_id, d.source, count(*) AS copies FROM d JOIN c ON d.s = c.s AND c.cumulative <= d.u GROUP BY d.doc_id, d.source
)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy,
       md5('20241|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy) AS shuffle_key
FROM drawn, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy)
"""
