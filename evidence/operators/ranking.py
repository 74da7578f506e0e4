"""Ranks, selections and rank statistics over metric tables (a row per system, run or budget)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from evidence.operators.scale import stored

#: Fixed value: two-sided 95 % point of Student's t with 4 degrees of freedom.
T_CRITICAL_DF4 = 2.7764451051977987


def average_rank(df: DataFrame, by: list[str], value: str, into: str = "rank") -> DataFrame:
    """Rank by falling value; equal values share the mean of their ranks."""
    order = Window.partitionBy(*by).orderBy(F.desc(value))
    ties = Window.partitionBy(*by, value)
    return df.withColumn(into, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def rank_volatility(ranked: DataFrame, unit: str) -> DataFrame:
    return ranked.groupBy(unit).agg(
        F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), (F.max("rank") - F.min("rank")).alias("rank_range")
    )


def rank_by_budget(stats: DataFrame, budget: str, value: str) -> DataFrame:
    return stats.withColumn("position", F.rank().over(Window.partitionBy(budget).orderBy(F.desc(value))))


def robustness_order(summary: DataFrame) -> DataFrame:
    """Position by worst external accuracy, then mean external accuracy, then name."""
    order = Window.orderBy(F.desc("worst_external_accuracy"), F.desc("mean_external_accuracy"), F.asc("system"))
    return summary.withColumn("position", F.row_number().over(order))


def best_epoch(history: DataFrame, run: list[str]) -> DataFrame:
    """Per run the epoch of highest accuracy, then lowest loss, then earliest; a plain aggregate."""
    order = F.struct(F.col("validation_accuracy"), -F.col("validation_loss"), -F.col("epoch"))
    kept = F.struct("epoch", "validation_accuracy", "validation_loss")
    return history.groupBy(*run).agg(F.max_by(kept, order).alias("best")).select(*run, "best.*")


def running_best(history: DataFrame, run: list[str]) -> DataFrame:
    """Best accuracy before each epoch and whether the epoch improves on it."""
    before = Window.partitionBy(*run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    traced = history.withColumn("best_before", F.max("validation_accuracy").over(before))
    return traced.withColumn(
        "improved", F.col("best_before").isNull() | (F.col("validation_accuracy") > F.col("best_before"))
    )


def select_family(results: DataFrame, by: list[str], simplicity: list[str]) -> DataFrame:
    """Highest macro F1, then accuracy, then the simplest family of the given order."""
    order = F.array(*[F.lit(f) for f in simplicity])
    rank = F.array_position(order, F.col("family"))
    best = F.max_by(F.struct("family", "macro_f1", "accuracy"), F.struct(F.col("macro_f1"), F.col("accuracy"), -rank))
    return results.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def experiment_order(runs: DataFrame, by: list[str]) -> DataFrame:
    """Validation accuracy falling, loss rising, |train − validation| rising, id rising."""
    gap = F.abs(F.col("train_accuracy") - F.col("validation_accuracy"))
    order = Window.partitionBy(*by).orderBy(
        F.desc("validation_accuracy"), F.asc("validation_loss"), gap.asc(), F.asc("experiment")
    )
    return runs.withColumn("position", F.row_number().over(order))


def draw_statistics(runs: DataFrame, by: list[str], value: str, t: float = T_CRITICAL_DF4) -> DataFrame:
    """Mean, sample deviation, range and t interval of a metric over the draws of each group."""
    stats = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("draws"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("standard_deviation"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    half = F.lit(t) * F.col("standard_deviation") / F.sqrt(F.col("draws").cast("double"))
    return stats.withColumn("lower", F.col("mean") - half).withColumn("upper", F.col("mean") + half)


def first_budgets(stats: DataFrame, full: DataFrame, model: str, budget: str) -> DataFrame:
    """Smallest budget within 0.01 of the full accuracy and smallest with 95 % of it; no interpolation."""
    joined = stats.join(full, model)
    first = lambda c: F.coalesce(F.min(F.when(c, F.col(budget))).cast("string"), F.lit("Not reached."))
    return joined.groupBy(model).agg(
        first(F.col("full_accuracy") - F.col("mean") <= 0.01).alias("within_one_point"),
        first(F.col("mean") >= 0.95 * F.col("full_accuracy")).alias("at_least_95_percent"),
    )


# --- rank correlation -------------------------------------------------------------------


def paired_values(df: DataFrame, unit: str, domain: str, value: str, pairs: list[tuple]) -> DataFrame:
    """(pair, unit, x, y): the value of a unit in both domains of each pair, from one group-by."""
    held = df.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(domain, value))).alias("_m"))
    entries = F.array(
        *[
            F.struct(
                F.lit(f"{a}_vs_{b}").alias("pair"),
                F.try_element_at("_m", F.lit(a)).alias("x"),
                F.try_element_at("_m", F.lit(b)).alias("y"),
            )
            for a, b in pairs
        ]
    )
    return held.select(unit, F.explode(entries).alias("e")).select(unit, "e.*").where("x IS NOT NULL AND y IS NOT NULL")


#: Values of a group are cut into about so many slices of rows, and as many values that make a cut.
SLICES = 128
#: A group has fewer slices if they would hold less than so many rows.
SLICE_ROWS = 4096


def _cells(paired: DataFrame, by: list[str], slices: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(_g, x, y, n, xs, ys), stored: counted pairs of values with the slices of both.

    Approximate quantiles cut the values of a group. A value that makes a cut is a slice of its own with an odd number, and the
    values between two cuts share an even one. So a slice of several values holds at most about 1/slices of the rows, however
    many rows tie at one value.
    """
    key = F.struct(*by).alias("_g")  # null groups stay groups
    rows = paired.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y")
    points = [i / slices for i in range(1, slices)]
    edges = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(c, points, 20 * slices).alias(f"_{c}") for c in "xy"])
    apart = F.greatest(F.lit(1), F.floor(F.lit(slices * slice_rows) / F.col("_n"))).cast("int")  # a small group keeps every so many cuts
    cuts = stored(edges.withColumn("_apart", apart).select(
        "_g", *[F.array_distinct(F.filter(f"_{c}", lambda _, i: (i + 1) % F.col("_apart") == 0)).alias(f"_{c}") for c in "xy"]
    ))
    step = 1 << (slices.bit_length() - 1)
    steps = F.array(*[F.lit(step >> i) for i in range(step.bit_length())])

    def number(c: str):
        # binary search for the count of cuts that are not above the value
        below = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(f"_{c}", p + s - 1) <= F.col(c), p + s).otherwise(p))
        return F.struct(below.alias("k"))

    counted = rows.groupBy("_g", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    # one row a group: its stored size lets the optimizer send it to all tasks, beyond that a join with skew handling
    placed = counted.join(cuts, "_g").withColumn("_kx", number("x")).withColumn("_ky", number("y"))
    odd = lambda c: 2 * F.col(f"_k{c}.k") - F.when(F.get(f"_{c}", F.col(f"_k{c}.k") - 1) == F.col(c), 1).otherwise(0)
    return stored(placed.select("_g", "x", "y", "n", odd("x").cast("int").alias("xs"), odd("y").cast("int").alias("ys")))


def _average_ranks(cells: DataFrame, value: str, into: str) -> DataFrame:
    """Average rank from the smallest value, less the mean rank of the group, of every cell.

    The rows of earlier slices are a running count over the few slices of a group; inside a slice a window counts on.
    A slice of one value needs no order, so its cells are dealt over several windows.
    """
    place = f"{value}s"
    totals = cells.groupBy("_g", place).agg(F.sum("n").alias("_in"))
    earlier = Window.partitionBy("_g").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_g", place, "_in", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_in").over(Window.partitionBy("_g")).alias("_all"),
    )
    single = F.col(place) % 2 == 1
    part = F.when(single, F.pmod(F.xxhash64("x", "y"), F.lit(SLICES))).otherwise(0)
    same = Window.partitionBy("_g", place, "_part").orderBy(value)
    upto = same.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cells.withColumn("_part", part).withColumn("_upto", F.sum("n").over(upto))
    ties = counted.withColumn("_same", F.sum("n").over(Window.partitionBy("_g", place, "_part", value)))
    inside = F.when(single, (F.col("_in") + 1) / 2).otherwise(F.col("_upto") - (F.col("_same") - 1) / 2)
    ranked = ties.join(offsets, ["_g", place])
    return ranked.withColumn(into, F.col("_before") + inside - (F.col("_all") + 1) / 2).drop("_part", "_upto", "_same", "_in", "_before", "_all")


def _spearman(cells: DataFrame) -> DataFrame:
    ranked = _average_ranks(_average_ranks(cells, "x", "_rx"), "y", "_ry")
    product = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    return ranked.groupBy("_g").agg(
        F.sum("n").alias("n"), F.try_divide(product("_rx", "_ry"), F.sqrt(product("_rx", "_rx") * product("_ry", "_ry"))).alias("spearman_rho")
    )


def concordance(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """Sum of n[i] * n[j] * sign(a[i] - a[j]) * sign(b[i] - b[j]) over all pairs, without forming them.

    Two values differ first at one bit of their dense ranks: per bit, running weights in the order of ``a`` give what lies
    above and below among the values of equal higher bits.
    """
    if len(a) < 2:
        return 0
    low = np.unique(a, return_inverse=True)[1]
    high = np.unique(b, return_inverse=True)[1]
    total = 0
    for bit in range(int(high.max()).bit_length()):
        order = np.lexsort((low, high >> (bit + 1)))
        prefix, x, w = high[order] >> (bit + 1), low[order], n[order]
        one = (high[order] >> bit) & 1
        new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        tie = new | np.concatenate([[True], x[1:] != x[:-1]])
        place = np.arange(len(w))
        group, run = np.maximum.accumulate(np.where(new, place, 0)), np.maximum.accumulate(np.where(tie, place, 0))
        for bit_of_other, sign in ((0, 1), (1, -1)):
            held = np.concatenate([[0], np.cumsum(np.where(one == bit_of_other, w, 0))])
            before = held[run] - held[group]
            total += sign * int((w * before)[one != bit_of_other].sum())
    return total


def _concordances(cells: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """(_g, _s): concordance of each group of counted cells, summed."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = concordance(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["n"].to_numpy(np.int64))
        return pd.DataFrame({"_g": [key[0]], "_s": [s]})

    keyed = cells.select("_g", *[F.col(c).alias(f"_{c}") for c in groups], F.col(a).alias("a"), F.col(b).alias("b"), "n")
    schema = T.StructType([T.StructField("_g", T.StringType()), T.StructField("_s", T.LongType())])
    packed = keyed.withColumn("_g", F.to_json("_g"))
    return packed.groupBy("_g", *[f"_{c}" for c in groups]).applyInPandas(count, schema)


def _kendall(cells: DataFrame) -> DataFrame:
    """Pairs of units fall into three kinds: of other slices in x and y, of one slice in x, or of one slice in y alone.

    The first are counted over the slices' counts, the others inside each slice of several values. So no task
    holds more than one slice, or the counts of (2 * slices)^2 pairs of slices.
    """
    grid = cells.groupBy("_g", "xs", "ys").agg(F.sum("n").alias("n"))
    across = _concordances(grid, [], "xs", "ys")
    column = cells.where("xs % 2 = 0").groupBy("_g", "xs", "x", "y").agg(F.sum("n").alias("n"))
    row = cells.where("ys % 2 = 0").groupBy("_g", "ys", "xs", "y").agg(F.sum("n").alias("n"))
    parts = across.unionAll(_concordances(column, ["xs"], "x", "y")).unionAll(_concordances(row, ["ys"], "xs", "y"))
    signed = parts.groupBy(F.col("_g").alias("_j")).agg(F.sum("_s").alias("_s"))

    def tied(c: str, name: str) -> DataFrame:
        return cells.groupBy("_g", c).agg(F.sum("n").alias("_t")).groupBy("_g").agg(
            F.sum(F.col("_t") * (F.col("_t") - 1) / 2).alias(name), F.sum("_t").alias(f"{name}_n")
        )

    n0 = F.col("_n1_n") * (F.col("_n1_n") - 1) / 2
    joined = tied("x", "_n1").join(tied("y", "_n2"), "_g").withColumn("_j", F.to_json("_g")).join(signed, "_j")
    return joined.select(
        "_g", F.try_divide(F.col("_s"), F.sqrt((n0 - F.col("_n1")) * (n0 - F.col("_n2")))).alias("kendall_tau_b")
    )


def spearman(paired: DataFrame, by: list[str], slices: int = SLICES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(by…, n, spearman_rho) over (by…, x, y): equal values share the mean of their ranks; null for constant values."""
    return _spearman(_cells(paired, by, slices, slice_rows)).select("_g.*", "n", "spearman_rho")


def kendall_tau_b(paired: DataFrame, by: list[str], slices: int = SLICES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(by…, kendall_tau_b) over (by…, x, y); null where a side is constant."""
    return _kendall(_cells(paired, by, slices, slice_rows)).select("_g.*", "kendall_tau_b")


def rank_correlations(paired: DataFrame, by: list[str], slices: int = SLICES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(by…, n, spearman_rho, kendall_tau_b) from one table of counted and sliced pairs."""
    cells = _cells(paired, by, slices, slice_rows)
    return _spearman(cells).join(_kendall(cells), "_g").select("_g.*", "n", "spearman_rho", "kendall_tau_b")
