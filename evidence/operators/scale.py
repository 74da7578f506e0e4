"""Shared building blocks that keep one huge group from landing in one task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidence.session import delete_on_exit, work_folder

#: A table may be handed to every executor only up to this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


#: A checked table of up to this many narrow rows is sent to every executor.
BROADCAST_ROWS = 100_000


#: Exact percentiles keep the values of a group in one buffer: allowed up to so many values in all groups together, or in each.
BUFFERED_VALUES, BUFFERED_GROUP = 2_000_000, 15_000


def fits_buffers(df: DataFrame, by: list[str]) -> bool:
    """Whether the counted values of the groups fit the buffers of built-in percentiles; only the key columns are read."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    found = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("all"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest")).first()
    return found["all"] <= BUFFERED_VALUES or found["largest"] <= BUFFERED_GROUP


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """A table read several times, written once to the shared folder of the cluster and read back.

    It cuts the lineage, survives lost executors, and its size is known to the optimizer.
    The folder is deleted when the application ends. Rows of one value of a column ``by`` can be read alone.
    """
    spark = df.sparkSession
    path = work_folder(spark, "stored")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than the session has cores.

    Only for plain scans ahead of heavy per-row work; a large table has more splits than cores
    and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hash_rank(
    df: DataFrame, strata: list[str], key: Column, tie: str, into: str = "rank", total: str | None = None, digits: int = 3
) -> DataFrame:
    """Number the rows of each stratum from 1 in the order of a hexadecimal hash key.

    A plain ``row_number`` would sort a whole stratum in one task. The leading ``digits``
    of the hash cut each stratum into even slices instead: slices are numbered on their
    own, and the row counts of the slices before them (at most ``16**digits`` per stratum)
    give the offset. The numbers equal those of the plain window. ``key`` must start
    with uniformly spread hex digits. ``total`` adds the size of the stratum.
    """
    # one struct as the stratum keeps null strata together and lets window and join share a shuffle
    keyed = (
        df.withColumn("order_key", key)
        .withColumn("_slice", F.substring("order_key", 1, digits))
        .withColumn("_stratum", F.struct(*strata) if strata else F.lit(0))
    )
    slices = keyed.groupBy("_stratum", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_stratum").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        "_stratum", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_stratum")).alias("_stratum_size"),
    )
    within = Window.partitionBy("_stratum", "_slice").orderBy("order_key", tie)
    numbered = keyed.withColumn("_in_slice", F.row_number().over(within)).join(offsets, ["_stratum", "_slice"])
    out = numbered.withColumn(into, F.col("_in_slice") + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_stratum_size"))
    return out.drop("_in_slice", "_before", "_stratum_size", "_slice", "_stratum")


def _match(by: list[str], prefix: str) -> Column:
    """Null-safe equality of the key columns with their prefixed copies."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in by], F.lit(True))


def _prefixed(by: list[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in by]


def quantile_summary(
    df: DataFrame, by: list[str], value: str, named: dict[str, float], extra: list[Column] = [], accuracy: int = 10_000,
    small: bool | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles with other aggregates: (by…, extra…, one column per name).

    The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. It is used where the
    groups are small by count (``small`` tells if that is known). Otherwise one aggregate computes ``extra`` and a mergeable sketch that brackets each quantile to within
    ``2/accuracy`` of the ranks. One more pass counts the rows below the bracket and the values
    inside it, and only the few values inside are sorted. A small group is bracketed by its
    whole range.
    """
    if fits_buffers(df, by) if small is None else small:
        number = F.col(value).cast("double")
        return df.groupBy(*by).agg(*extra, *[F.percentile(number, p).alias(n) for n, p in named.items()])
    points = sorted(set(named.values()))
    slack = 2.0 / accuracy
    edges = [max(0.0, p - slack) for p in points] + [min(1.0, p + slack) for p in points]
    v = F.col(value).cast("double")
    bounds = stored(
        df.groupBy(*by).agg(
            *extra, F.count(v).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"),
            F.percentile_approx(v, edges, accuracy).alias("_edges"),
        )
    )
    found = _inside(df.select(*by, v.alias("_v")), by, bounds, points, accuracy)
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for n, p in named.items()])
    kept = bounds.drop("_n", "_min", "_max", "_edges")
    wide = wide.select(*_prefixed(by, "_w_"), *named)
    return kept.join(wide, _match(by, "_w_"), "left").select(*kept.columns, *named)


def _inside(base: DataFrame, by: list[str], bounds: DataFrame, points: list[float], accuracy: int) -> DataFrame:
    """(by…, p, quantile) from the bracket of each group and probability."""
    small = F.col("_n") < 2 * accuracy

    def target(i: int, p: float) -> Column:
        return F.struct(
            F.lit(p).alias("p"),
            F.when(small, F.col("_min")).otherwise(F.col("_edges")[i]).alias("lo"),
            F.when(small, F.col("_max")).otherwise(F.col("_edges")[i + len(points)]).alias("hi"),
        )

    targets = bounds.where("_n > 0").select(
        *_prefixed(by, "_b_"), "_n", F.array(*[target(i, p) for i, p in enumerate(points)]).alias("_targets")
    )
    if bounds.count() <= BROADCAST_ROWS:  # else a shuffle join, where adaptive execution splits a hot key
        targets = F.broadcast(targets)
    placed = base.where(F.col("_v").isNotNull()).join(targets, _match(by, "_b_"))
    counted = (
        placed.select(*by, "_n", "_v", F.explode("_targets").alias("_t")).where(F.col("_v") <= F.col("_t.hi"))
        .select(*by, "_n", F.col("_t.p").alias("p"), F.when(F.col("_v") >= F.col("_t.lo"), F.col("_v")).alias("_v"))
        .groupBy(*by, "_n", "p", "_v")  # a null value counts the rows below the bracket
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    running = Window.partitionBy(*by, "_n", "p").orderBy(F.col("_v").asc_nulls_first())
    position = F.col("p") * (F.col("_n") - 1)
    ranked = counted.withColumn("_end", F.sum("_c").over(running)).where(F.col("_v").isNotNull())
    picked = ranked.groupBy(*by, "_n", "p").agg(
        F.min(F.when(F.col("_end") > F.floor(position), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_end") > F.ceil(position), F.col("_v"))).alias("_hi"),
    )
    return picked.select(
        *by, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (position - F.floor(position))).alias("quantile")
    )


def small_matrix(
    df: DataFrame, key: str, vec: str, carry: list[str] = [], max_bytes: int = BROADCAST_BYTES
) -> tuple[pd.DataFrame, np.ndarray] | None:
    """A table of keys and vectors as (frame of key and carried columns, float64 matrix), in key
    order, or None when it is too large.

    The size is measured on the data first, so a large table never reaches the driver.
    """
    size = df.agg(
        F.coalesce(F.sum(F.size(vec)), F.lit(0)).alias("numbers"), F.count(F.lit(1)).alias("rows")
    ).first()
    if size["numbers"] * 8 + size["rows"] * 64 > max_bytes:
        return None
    rows = df.select(key, *carry, vec).orderBy(key).toPandas()
    matrix = np.vstack(rows[vec].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0))
    return rows.drop(columns=[vec]), matrix
