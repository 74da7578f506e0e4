"""Families of related items: connected components over equal digests and near signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidence.operators.dedup import signature_pairs
from evidence.operators.scale import stored


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id connected with every id of the links (a, b).

    Alternates two rounds until the links stop changing: each id links its larger neighbours to its smallest one, then its
    smaller neighbours and itself. Every component ends as a star around its smallest id, after a number of rounds
    that grows with the logarithm of its size. A round is one aggregate and one join by id (an id with very many links is
    left to adaptive skew splitting) and is written to the shared folder; the driver sees counts and checksums only.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def rewired(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return pairs.join(least.hint("merge"), "u")

    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = rewired(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = rewired(large)
        edges = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.withColumnRenamed("u", "id").unionAll(roots.select(F.col("root").alias("id"), "root").distinct())


def near_families(items: DataFrame, item: str, digests: list[str], signature: str, threshold: int, **options) -> DataFrame:
    """The items with ``family``: the smallest item that is reached over equal digests and signatures within ``threshold`` bits.

    Equal values give a star around the first item that has them, so a value that a third of the items share costs one row an item.
    Null digests and signatures relate nothing; an item without relatives is its own family.
    """
    rows = stored(items.select(item, *digests, signature))
    links = []
    for c in [*digests, signature]:
        first = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(item).alias("b"))
        links.append(rows.select(F.col(item).alias("a"), c).join(first.hint("merge"), c).select("a", "b"))
    heads = stored(rows.where(F.col(signature).isNotNull()).groupBy(F.col(signature).alias("h")).agg(F.min(item).alias("first")))
    pairs = signature_pairs(heads, None, threshold, **options)
    left, right = (heads.select(F.col("h").alias(f"{s}_h"), F.col("first").alias(n)) for s, n in (("left", "a"), ("right", "b")))
    left, right = left.hint("merge"), right.hint("merge")
    links.append(pairs.join(left, "left_h").join(right, "right_h").select("a", "b"))
    every = links[0]
    for more in links[1:]:
        every = every.unionAll(more)
    roots = components(every).withColumnRenamed("id", item).withColumnRenamed("root", "_root")
    return items.join(roots.hint("merge"), item, "left").withColumn("family", F.coalesce("_root", item)).drop("_root")
