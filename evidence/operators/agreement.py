"""Paired systems: agreement, outcomes, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evidence.functions.labels import outcome
from evidence.operators.metrics import ratio
from evidence.operators.scale import quantile_summary


def pair_systems(predictions: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """One row per item predicted by both systems, without a self-join: both predictions of an
    item meet in one partially aggregated group."""
    side = lambda s, c: F.max(F.when(F.col("system") == s, F.col(c)))
    both = (
        predictions.where(F.col("system").isin(left, right))
        .groupBy(*keys)
        .agg(
            F.max("true_class").alias("true_class"),
            side(left, "predicted_class").alias("left_class"),
            side(right, "predicted_class").alias("right_class"),
            side(left, "margin").alias("left_margin"),
            side(right, "margin").alias("right_margin"),
        )
        .where(F.col("left_class").isNotNull() & F.col("right_class").isNotNull())
    )
    return both.withColumn(
        "outcome",
        outcome(F.col("left_class") == F.col("true_class"), F.col("right_class") == F.col("true_class")),
    )


def disagreement(paired: DataFrame, by: list[str]) -> DataFrame:
    """Agreement rate and the four outcome shares per group."""
    n = F.count(F.lit(1))
    return paired.groupBy(*by).agg(
        n.alias("samples"),
        ratio(F.count_if(F.col("left_class") == F.col("right_class")), n).alias("agreement_rate"),
        *[
            ratio(F.count_if(F.col("outcome") == o), n).alias(o)
            for o in ("both_correct", "left_only_correct", "right_only_correct", "both_wrong")
        ],
    )


def outcome_margins(paired: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean margins and the median right margin per outcome."""
    extra = [
        F.count(F.lit(1)).alias("n"), F.avg("left_margin").alias("left_margin_mean"), F.avg("right_margin").alias("right_margin_mean"),
    ]
    return quantile_summary(paired, [*by, "outcome"], "right_margin", {"right_margin_median": 0.5}, extra)


def class_outcomes(paired: DataFrame, by: list[str]) -> DataFrame:
    """Share of each outcome within each true class."""
    keys = [*by, "true_class"]
    counted = paired.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))  # at most four counts per class
    return counted.select(*keys, "outcome", "n", ratio(F.col("n"), total).alias("share"))


def common_items(predictions: DataFrame, systems: list[str], keys: list[str]) -> DataFrame:
    """Items predicted by every system, with the number of correct systems; one pass, no joins."""
    seen = F.array_distinct(F.collect_set("system"))
    return (
        predictions.where(F.col("system").isin(*systems))
        .groupBy(*keys)
        .agg(
            F.max("true_class").alias("true_class"),
            F.size(seen).alias("systems"),
            F.count_if(F.col("true_class") == F.col("predicted_class")).alias("correct_systems"),
        )
        .where(F.col("systems") == len(systems))
    )
