"""Tables of region importances and deletion curves: orders, areas, shares, group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidence.functions.grids import grid_radius, is_edge
from evidence.operators.scale import quantile_summary, stored

IMAGE = ["system", "domain", "identifier"]


def deletion_order(regions: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """Order of removal: importance falling, then region index."""
    order = Window.partitionBy(*by).orderBy(F.desc("importance"), F.asc("index"))
    return regions.withColumn("order", F.row_number().over(order))


def random_order(regions: DataFrame, key: Column, by: list[str] = IMAGE) -> DataFrame:
    """A reproducible random order of removal from a hash key per region."""
    order = Window.partitionBy(*by).orderBy(key, F.asc("index"))
    return regions.withColumn("order", F.row_number().over(order))


def deletion_counts(regions: int, fractions: list[float]) -> list[int]:
    """Regions removed at each fraction, rounded half to even."""
    return [min(regions, round(f * regions)) for f in fractions]


def region_summary(regions: DataFrame, rows: int, cols: int, by: list[str] = IMAGE) -> DataFrame:
    """Edge and interior share of positive importance (null without any) and mean radius of the top five."""
    positive = F.greatest(F.col("importance"), F.lit(0.0))
    edge = is_edge(F.col("row"), F.col("column"), rows, cols)
    sums = deletion_order(regions, by).groupBy(*by).agg(
        F.sum(positive).alias("positive_sum"),
        F.sum(F.when(edge, positive).otherwise(0.0)).alias("_edge"),
        F.sum(F.when(~edge, positive).otherwise(0.0)).alias("_inside"),
        F.avg(F.when(F.col("order") <= 5, grid_radius(F.col("row"), F.col("column"), rows, cols))).alias("top5_radius"),
    )
    share = lambda c: F.try_divide(F.col(c), F.col("positive_sum"))
    return sums.select(*by, "positive_sum", share("_edge").alias("edge_share"), share("_inside").alias("interior_share"), "top5_radius")


def deletion_areas(curve: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """Trapezoid area of margin / max(|base margin|, 1e-8) over the fraction, for both orders, and random − top."""
    along = Window.partitionBy(*by, "kind").orderBy("fraction")
    relative = F.col("margin") / F.greatest(F.abs("base_margin"), F.lit(1e-8))
    steps = (
        curve.withColumn("_r", relative)
        .withColumn("_f0", F.lag("fraction").over(along))
        .withColumn("_r0", F.lag("_r").over(along))
    )
    area = (F.col("fraction") - F.col("_f0")) * (F.col("_r") + F.col("_r0")) / 2
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, area)), F.lit(0.0))
    return steps.groupBy(*by).agg(side("top").alias("top_auc"), side("random").alias("random_auc")).withColumn(
        "gap", F.col("random_auc") - F.col("top_auc")
    )


def with_groups(records: DataFrame) -> DataFrame:
    """Each record under the groups it belongs to: all, its domain, its class and its outcome."""
    named = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    groups = F.array(F.lit("all"), named("domain", "domain"), named("class", "class"), named("outcome", "correct"))
    return records.withColumn("group", F.explode(groups))


def group_summary(records: DataFrame) -> DataFrame:
    """Images, gap mean, median and positive share, mean areas, edge share and radius per group."""
    grouped = with_groups(stored(records))
    by = ["system", "group"]
    extra = [
        F.count(F.lit(1)).alias("images"),
        F.avg("gap").alias("gap_mean"),
        F.avg((F.col("gap") > 0).cast("double")).alias("gap_positive"),
        F.avg("top_auc").alias("top_auc_mean"),
        F.avg("random_auc").alias("random_auc_mean"),
        F.avg("edge_share").alias("edge_share_mean"),
        F.avg("top5_radius").alias("top5_radius_mean"),
    ]
    return quantile_summary(grouped, by, "gap", {"gap_median": 0.5}, extra)


def importance_grid(regions: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """Mean share of positive importance per cell and group; ``regions`` carries class and correct."""
    positive = F.greatest(F.col("importance"), F.lit(0.0))
    total = F.sum(positive).over(Window.partitionBy(*by))  # the cells of one image
    shared = regions.withColumn("_share", positive / F.greatest(total, F.lit(1e-12)))
    return with_groups(shared).groupBy("system", "group", "row", "column").agg(F.avg("_share").alias("mean_share"))
