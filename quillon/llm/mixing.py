"""Operator 5: mixing sources to target weights by Poisson replication.

Every source has a rate: the copies that its documents should have on average so that the sources' expected sizes are in
proportion to their weights and the whole is of the wanted size.  A document's number of copies inverts the Poisson
distribution of that mean at a uniform number hashed from (seed, document), so it does not depend on partitions, order
or retries; a mean above PART is a sum of several such draws.  Documents are exploded by their counts and shuffled
globally: the output is sorted by a hash of (seed, document, copy).  The hash is uniform, so the ranges of a global sort are
known beforehand (equal parts of it) and no pass over the documents is spent on finding them.

Sources may be many.  Their sizes are map-side sums, written once and counted: up to ``BROADCAST_SOURCES`` rates are
broadcast, more are joined by source, where a hot source's side may be split.  So documents are shuffled once, to sort.

Defined results: a null text counts as any other; null is a source of its own; a source that ``weights`` does not name
has weight ``other``; weight 0 drops a source; repeated rows get equal counts; an empty table gives no rows; all columns
are kept and ``mix_copy`` (from 1) and ``mix_key`` (sort key) come last, with underscores after their names if the input
has columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.shared import partitions, staged, unused

SEED = 17
#: largest mean of one inverted draw: exp(-PART) is far from underflow, and TERMS cover its tail beyond 2**-52
PART = 16
TERMS = 96
#: output documents per input document
SIZE = 1.0
TWO_52 = 1 << 52
#: rates are broadcast up to so many sources, which is checked; beyond it the join is left to Spark
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 over the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(TWO_52)


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) >= u for a Poisson variable of this mean (at most PART)."""
    first = F.exp(-mean)
    start = F.struct(F.lit(0).alias("k"), first.alias("p"), first.alias("cdf"))

    def step(s: Column, j: Column) -> Column:
        p = s["p"] * mean / j
        on = s["cdf"] < u
        return F.struct(F.when(on, j).otherwise(s["k"]).alias("k"), p.alias("p"), F.when(on, s["cdf"] + p).otherwise(s["cdf"]).alias("cdf"))

    # most means are small: the terms beyond a bound of the mean cannot be reached at 52 bits
    terms = F.least(F.lit(TERMS), F.ceil(mean * 4 + 24).cast("int"))
    return F.when(first >= u, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda s: s["k"]))


def copies(key: Column, mean: Column, seed: int) -> Column:
    draws = F.greatest(F.ceil(mean / PART).cast("int"), F.lit(1))
    one = poisson(uniform(F.lit(seed), F.lit(0), key), mean)
    many = F.aggregate(F.transform(F.sequence(F.lit(0), draws - 1), lambda j: poisson(uniform(F.lit(seed), j, key), mean / draws)), F.lit(0), lambda a, b: a + b)
    return F.when(draws == 1, one).otherwise(many)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, size: float = SIZE, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Documents repeated so that the sources have the weights (default: all the same) in expectation.

    size: expected output documents per input document.
    """
    spark = docs.sparkSession
    source = F.col(source_col)
    sizes = docs.groupBy(source.alias("__mix_source")).agg(F.count(F.lit(1)).alias("__mix_n"))
    if weights:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__mix_name string, __mix_weight double")
        sizes = sizes.join(table, F.col("__mix_source") == F.col("__mix_name"), "left").withColumn("__mix_weight", F.coalesce("__mix_weight", F.lit(float(other))))
    else:
        sizes = sizes.withColumn("__mix_weight", F.lit(1.0))
    total = sizes.agg(F.sum("__mix_n").alias("__mix_all"), F.sum("__mix_weight").alias("__mix_weights"))  # one row
    rates = sizes.crossJoin(F.broadcast(total)).select("__mix_source", F.when(F.col("__mix_weights") > 0, F.lit(size) * F.col("__mix_all") * F.col("__mix_weight") / F.col("__mix_weights") / F.col("__mix_n")).otherwise(0.0).alias("__mix_rate"))
    rates = staged(rates, "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rated = docs.join(rates, source.eqNullSafe(F.col("__mix_source"))).drop("__mix_source")
    counted = rated.withColumn("__mix_count", copies(F.col(id_col), F.col("__mix_rate"), seed)).filter("__mix_count > 0").drop("__mix_rate")
    copy_col, key_col = unused(docs.columns, "mix_copy"), unused(docs.columns, "mix_key")
    many = counted.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col("__mix_count")))).drop("__mix_count")
    keyed = many.withColumn(key_col, F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy_col))))
    # partition k gets the k-th of n equal ranges of the hash
    n = partitions(spark)
    part = F.floor(F.conv(F.substring(key_col, 1, 8), 16, 10).cast("long") * n / (1 << 32)).cast("int")
    return keyed.repartitionById(n, part).sortWithinPartitions(key_col)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to equal weights of their sources."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_BODY = """
sizes AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM sizes)::DOUBLE * 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE / n::DOUBLE AS rate FROM sizes),
draws AS (
    SELECT d.*, rate, greatest(ceil(rate / 16), 1)::BIGINT AS m FROM {docs} d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
each AS (
    SELECT doc_id, j, rate / m AS mean, (('0x' || substr(md5(concat_ws('|', '17', j::VARCHAR, coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
    FROM (SELECT DISTINCT doc_id, rate, m, unnest(range(m)) AS j FROM draws)),
pmf AS (SELECT doc_id, j, u, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM each, (SELECT unnest(range(0, 97)) AS k)),
cdf AS (SELECT doc_id, j, u, k, sum(p) OVER (PARTITION BY doc_id, j ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM pmf),
counts AS (SELECT doc_id, sum(k)::BIGINT AS n FROM (SELECT doc_id, j, min(k) FILTER (c >= u) AS k FROM cdf GROUP BY doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, n + 1))::INTEGER AS mix_copy,
    md5(concat_ws('|', '17', coalesce(d.doc_id::VARCHAR, ''), unnest(range(1, n + 1))::VARCHAR)) AS mix_key
FROM {docs} d JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id
"""
SQL = "WITH " + SQL_BODY.format(docs="documents")
