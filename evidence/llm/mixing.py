"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidence.operators.scale import stored

#: A rate above this is the sum of equal parts, so that exp(-rate) never underflows.
PART_RATE = 16.0
#: Terms of the distribution function of one part: the chance of more is below 1e-40.
TERMS = 100
#: Hash keys have 52 bits, exact in a double.
KEY_BITS = 52


def hash_key(*parts: Column | str | int) -> Column:
    """52 uniform bits from the MD5 of the parts (null as an empty string), as any SQL engine can repeat them."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, KEY_BITS // 4), 16, 10).cast("long")


def _distribution(rate: Column) -> Column:
    """P(N <= i) for i = 0 .. TERMS of a Poisson variable."""
    first = F.exp(-rate)
    start = F.struct(first.alias("term"), F.array(first).alias("cdf"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * rate / i
        return F.struct(term.alias("term"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + term)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["cdf"])


def source_rates(
    docs: DataFrame, source: str = "source", weights: DataFrame | None = None, temperature: float = 0.5,
    total: float | None = None,
) -> DataFrame:
    """(source, n_docs, rate): how often a document of each source should appear on average.

    The expected output holds ``total`` documents (default: as many as now) and source s a share in proportion to
    its target weight. ``weights`` is (source, weight); without it the weight is
    n_docs ** temperature. Null is a source of its own. A source without a
    weight, or with one that is null or not positive, has rate 0.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature))))
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    # one row per source, stored so that its size is known before it is joined
    weighed = stored(weighed.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))))
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n_docs").alias("all_docs"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_docs")
    rate = F.when(F.col("all_weight") > 0, wanted * F.col("weight") / F.col("all_weight") / F.col("n_docs"))
    return weighed.crossJoin(sums).select("source", "n_docs", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None,
    temperature: float = 0.5, total: float | None = None, seed: int = 0,
) -> DataFrame:
    """Documents repeated by a hash-seeded Poisson count and shuffled: their columns, then copy and shuffle_key.

    For each document, uniform numbers hashed from (seed, key) are put through the inverse Poisson distribution
    of its source's rate: the count is the number of values of the distribution
    function that a uniform number reaches. A document is repeated ``count`` times (copy = 1 .. count) and all copies
    are ordered by a hash of (seed, key, copy), cut into equal ranges without a sampling pass. Nothing depends on
    partitions or retries, and a hot source is never gathered: only its count is.

    A null key hashes like an empty string; rows that repeat a key draw the same count. Null source: see
    :func:`source_rates`. No documents: no rows. Other columns are carried as they are; columns of the
    input named copy or shuffle_key are replaced.
    """
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rates = stored(
        source_rates(docs, source, weights, temperature, total).where("rate > 0")
        .withColumn("_parts", F.ceil(F.col("rate") / PART_RATE).cast("int"))
        .withColumn("_cdf", _distribution(F.col("rate") / F.col("_parts")))
        .select(F.col("source").alias("_source"), "_parts", "_cdf")
    )
    # the row travels as one column, so that its names meet no others
    packed = docs.select(F.struct(*names).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_from"))
    wide = packed.join(rates, F.col("_from").eqNullSafe(F.col("_source")))
    scale = float(2**KEY_BITS)

    def draw(part: Column) -> Column:
        u = hash_key(seed, F.col("_key"), part) / scale
        return F.size(F.filter("_cdf", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda acc, part: acc + draw(part))
    copies = wide.withColumn("_count", count).where("_count > 0").select(
        "_row", "_key", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy")
    ).withColumn("shuffle_key", hash_key(seed, "order", F.col("_key"), F.col("copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col("shuffle_key") * parts / scale).cast("int")
    dealt = copies.repartitionById(parts, place).sortWithinPartitions("shuffle_key", "_key", "copy")
    return dealt.select("_row.*", "copy", "shuffle_key")
