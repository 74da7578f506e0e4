"""Reproducible samples and splits ordered by hash keys, so results never depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evidence.functions.hashing import stable_key
from evidence.operators.scale import hash_rank

#: Up to this rank Spark trims each stratum inside every task before the shuffle.
GROUP_LIMIT = 1000


def hash_sample(
    df: DataFrame, strata: list[str], item: str, n: int, seed: int, into: str = "rank", key: list[str] | None = None
) -> DataFrame:
    """The first n rows of each stratum in the order of sha256(``seed|strata…|item``), numbered by an int from 1.

    ``key`` names other columns to hash, so that strata can share an order.
    """
    key = stable_key(seed, *[F.col(c) for c in (key or [*strata, item])])
    if n > GROUP_LIMIT:
        return hash_rank(df, strata, key, item, into).where(F.col(into) <= n).withColumn(into, F.col(into).cast("int"))
    keyed = df.withColumn("order_key", key)
    if not strata:  # a global top n, cut inside every task first
        keyed = keyed.orderBy("order_key", item).limit(n)
    order = Window.partitionBy(*strata).orderBy("order_key", item)
    return keyed.withColumn(into, F.row_number().over(order)).where(F.col(into) <= n)


def shortfall(df: DataFrame, strata: list[str], n: int) -> DataFrame:
    """Strata with fewer than n rows: must be empty before an exact sample is drawn."""
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("available")).where(F.col("available") < n)


def select_cases(common: DataFrame, strata: list[str], item: str, systems: int, n: int, seed: int) -> DataFrame:
    """n items per stratum and majority outcome; a smaller stratum gives what it has."""
    majority = systems // 2 + 1
    labelled = common.withColumn(
        "stratum", F.when(F.col("correct_systems") >= majority, "majority_correct").otherwise("majority_error")
    )
    return hash_sample(labelled, [*strata, "stratum"], item, n, seed)


def representative_cases(rows: DataFrame, by: list[str], item: str, per_group: int, shown: int, correct: str, seed: int) -> DataFrame:
    """per_group correct cases for each group, then errors in hash order until ``shown`` rows."""
    chosen = hash_sample(rows.where(F.col(correct)), by, item, per_group, seed)
    errors = hash_sample(rows.where(~F.col(correct)), [], item, shown, seed)
    both = chosen.withColumn("_turn", F.lit(0)).unionByName(errors.withColumn("_turn", F.lit(1)))
    order = Window.orderBy("_turn", *by, "rank", item)
    # at most per_group × groups + shown rows reach this window
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= shown).drop("_turn")


def nested_budgets(df: DataFrame, cls: str, item: str, budgets: list[int], seed: int) -> DataFrame:
    """Per class the first max(budgets) items in hash order, with the budgets each belongs to."""
    picked = hash_sample(df, [cls], item, max(budgets), seed, "selection_rank")
    every = F.array(*[F.lit(b) for b in sorted(budgets)])
    return picked.withColumn("budget_membership", F.filter(every, lambda b: F.col("selection_rank") <= b))


def ratio_split(
    df: DataFrame, cls: str, item: str, seed: int, train: float = 0.7, validation: float = 0.15, smallest: int = 7
) -> DataFrame:
    """Per class: the first int(n·train) rows in hash order, then int(n·validation), then test.

    A class with fewer than ``smallest`` rows fails the job.
    """
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("train and validation ratios must be positive and leave room for test")
    ranked = hash_rank(df, [cls], stable_key(seed, F.col(cls), F.col(item)), item, total="_total")
    size = F.when(F.col("_total") >= smallest, F.col("_total")).otherwise(
        F.raise_error(F.concat(F.lit("class too small to split: "), F.col(cls).cast("string"))).cast("bigint")
    )
    n_train = F.floor(F.col("_size") * F.lit(train))
    n_validation = F.floor(F.col("_size") * F.lit(validation))
    return (
        ranked.withColumn("_size", size)
        .withColumn(
            "split",
            F.when(F.col("rank") <= n_train, "train")
            .when(F.col("rank") <= n_train + n_validation, "validation")
            .otherwise("test"),
        )
        .drop("_size", "_total")
    )


def group_split(df: DataFrame, family: str, is_test: str, seed: int, share: float = 0.85) -> DataFrame:
    """Keep the test rows, drop training rows related to them, split the other families.

    Whole families move together: the hash order runs over distinct families, and the first
    floor(share · families) of them are training. A row without a family is related to equal rows only, and is split
    by a hash of all its columns; a null flag marks no test row.
    """
    flagged = df.withColumn("_test", F.coalesce(F.col(is_test), F.lit(False)))
    alone = F.concat(F.lit("row|"), F.sha2(F.to_json(F.struct(*[F.col(c).cast("string") for c in df.columns])), 256))
    kept = flagged.withColumn("_family", F.coalesce(F.col(family).cast("string"), alone))
    families = kept.groupBy("_family").agg(F.max(F.col("_test").cast("int")).alias("_in_test"))
    free = families.where(F.col("_in_test") == 0).select("_family")
    ranked = hash_rank(free, [], stable_key(seed, F.col("_family")), "_family", total="_total")
    assigned = ranked.select(
        "_family", F.when(F.col("rank") <= F.floor(F.col("_total") * F.lit(share)), "train").otherwise("validation").alias("split")
    )
    test = kept.where("_test").withColumn("split", F.lit("test"))
    rest = kept.where("NOT _test").join(assigned.hint("merge"), "_family").select(*test.columns)
    return test.unionByName(rest).drop("_test", "_family")


def stratified_folds(df: DataFrame, cls: str, item: str, k: int, seed: int) -> DataFrame:
    """Fold numbers 0…k-1, each class spread evenly in hash order."""
    ranked = hash_rank(df, [cls], stable_key(seed, F.col(cls), F.col(item)), item)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "order_key")


def subset_rows(selected: DataFrame, vectors: DataFrame, item: str, budget: int) -> DataFrame:
    """The rows of one budget joined to their vectors by item."""
    member = selected.where(F.array_contains("budget_membership", budget))
    return member.join(vectors, item)


def subset_balance(selected: DataFrame, cls: str, item: str, budget: int, classes: list[str]) -> DataFrame:
    """One row per class: PASS when it has exactly ``budget`` distinct items."""
    counted = selected.where(F.col("selection_rank") <= budget).groupBy(cls).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(item).alias("items")
    )
    names = selected.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias(cls))
    zero = F.lit(0).cast("bigint")
    return names.join(counted, cls, "left").select(
        cls, F.coalesce("rows", zero).alias("rows"), F.coalesce("items", zero).alias("items"),
        F.when((F.coalesce("rows", zero) == budget) & (F.coalesce("items", zero) == budget), "PASS")
        .otherwise("FAIL").alias("status"),
    )
