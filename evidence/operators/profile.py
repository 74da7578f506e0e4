"""Counts and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidence.operators.metrics import OTHER, listed
from evidence.operators.scale import fits_buffers, quantile_summary


def class_counts(items: DataFrame, by: list[str], cls: str, classes: list[str]) -> DataFrame:
    """Rows per class, zero for a class without rows; classes off the list and nulls share the row OTHER, if there are any."""
    counted = items.groupBy(*by, listed(F.col(cls), classes).alias(cls)).agg(F.count(F.lit(1)).alias("n"))
    held = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(cls, "n"))).alias("_m"))
    names = F.array(*[F.lit(c) for c in classes])
    names = F.when(F.map_contains_key("_m", OTHER), F.array_append(names, OTHER)).otherwise(names)
    return held.withColumn(cls, F.explode(names)).select(
        *by, cls, F.coalesce(F.try_element_at("_m", F.col(cls)), F.lit(0)).alias("n")
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) for several columns in one pass with grouping sets."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counted = texts.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        field = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(field)
        value = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return counted.select(field.alias("field"), value.alias("value"), "n")


def _described(value: str) -> list[Column]:
    return [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    ]


def describe(long: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Count, mean, population deviation, range and exact quantiles per group; nulls are not counted."""
    return quantile_summary(long, by, value, quantiles, _described(value))


def describe_columns(df: DataFrame, by: list[str], columns: list[str], quantiles: dict[str, float]) -> DataFrame:
    """:func:`describe` of several double columns: (by…, metric, n, mean, …), without a row per value and column.

    One wide aggregate reads every row once. Where groups are too large for exact percentiles in one buffer, the columns
    are described one under the other from sketches.
    """
    if not fits_buffers(df, by):
        long = df.select(*by, *columns).unpivot(by, columns, "metric", "value")
        return quantile_summary(long, [*by, "metric"], "value", quantiles, _described("value"), small=False)
    points = list(quantiles.values())
    wide = df.groupBy(*by).agg(*[
        F.struct(F.lit(c).alias("metric"), *_described(c), F.percentile(c, points).alias("_q")).alias(f"_s_{i}") for i, c in enumerate(columns)
    ])
    rows = wide.select(*by, F.explode(F.array(*[F.col(f"_s_{i}") for i in range(len(columns))])).alias("_s")).select(*by, "_s.*")
    return rows.select(*rows.columns[:-1], *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(quantiles)])


def domain_profile(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, population deviation, median, 5 % and 95 % quantiles and range of several columns."""
    numbers = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return describe_columns(numbers, by, columns, {"q05": 0.05, "median": 0.5, "q95": 0.95})


def dimension_summary(df: DataFrame, by: list[str], width: str, height: str) -> DataFrame:
    """Summaries of width, height and their ratio, with the number of distinct sizes."""
    sized = df.select(
        *by, F.col(width).cast("double").alias("width"), F.col(height).cast("double").alias("height"),
        F.try_divide(F.col(width).cast("double"), F.col(height).cast("double")).alias("aspect_ratio"),
    )
    summary = describe_columns(sized, by, ["width", "height", "aspect_ratio"], {"median": 0.5})
    sizes = df.groupBy(*by).agg(F.count_distinct(F.struct(width, height)).alias("distinct_sizes"))
    return summary.join(sizes, by)


def timing_summary(log: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Total seconds, items and milliseconds per item of a run log."""
    total: Column = F.sum(seconds)
    items = F.count(F.lit(1))
    return log.groupBy(*by).agg(
        items.alias("items"), total.alias("total_seconds"), F.try_divide(total * 1000, items).alias("ms_per_item")
    )


# --- profiles that grow ------------------------------------------------------------------

#: Size of a sketch, and the share of a group's rows by which the rank of a quantile read from it may be off.
SKETCH_K, RANK_ERROR = 800, 0.01


def profile_states(df: DataFrame, by: list[str], columns: list[str], k: int = SKETCH_K) -> DataFrame:
    """(by…, metric, n, mean, squares, minimum, maximum, sketch): what a profile keeps of some rows, to be stored per source or day.

    ``squares`` is the sum of squared distances from the mean, ``sketch`` a mergeable quantile sketch of bounded size. Nulls are
    not counted. One partially aggregated pass.
    """
    wide = df.groupBy(*by).agg(*[
        F.struct(
            F.lit(c).alias("metric"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("squares"),
            F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.kll_sketch_agg_double(v, k).alias("sketch"),
        ).alias(f"_s_{i}")
        for i, (c, v) in enumerate((c, F.col(c).cast("double")) for c in columns)
    ])
    return wide.select(*by, F.explode(F.array(*[F.col(f"_s_{i}") for i in range(len(columns))])).alias("_s")).select(*by, "_s.*")


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """The states of coarser groups, as if all their rows had been read together; old states and new ones come as one table."""
    held = states.where("n > 0")
    mean = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy(*by, "metric")) / F.sum("n").over(Window.partitionBy(*by, "metric"))
    around = held.withColumn("_mean", mean)
    return around.groupBy(*by, "metric").agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))).alias("squares"),
        F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def describe_states(states: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(by…, metric, n, mean, standard_deviation, minimum, maximum, a column per quantile) of stored states.

    A quantile is a value of the group whose rank is within RANK_ERROR of the asked one (for the default sketch size);
    where exact ones are asked, use :func:`describe`.
    """
    return states.where("n > 0").select(
        *by, "metric", "n", "mean", F.sqrt(F.col("squares") / F.col("n")).alias("standard_deviation"), "minimum", "maximum",
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in quantiles.items()],
    )
