"""Metric tables from predictions: everything is computed from confusion cells.

``predictions`` needs ``true_class`` and ``predicted_class``; ``by`` names the columns that
tell systems, domains or runs apart. The cells are counted in one partially aggregated
pass; all later steps work on at most (classes × classes) rows per system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidence.functions.labels import error_category

#: Name of the row for classes off the list, nulls included.
OTHER = "(other)"


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def cells(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Non-empty confusion cells: (by…, true_class, predicted_class, n)."""
    return predictions.groupBy(*by, "true_class", "predicted_class").agg(F.count(F.lit(1)).alias("n"))


def confusion(predictions: DataFrame, by: list[str], classes: list[str], off_list: str = "keep") -> DataFrame:
    """All class × class cells, zeros included, rows true and columns predicted; see :func:`full_grid` for other classes."""
    return full_grid(cells(predictions, by), by, classes, off_list)


def listed(cls: Column, classes: list[str]) -> Column:
    """The class where it is on the list, else OTHER."""
    return F.when(cls.isin(*classes), cls).otherwise(F.lit(OTHER))


def fold_cells(counted: DataFrame, by: list[str], classes: list[str], off_list: str = "keep") -> DataFrame:
    """Cells with classes off the list, and nulls, under the name OTHER, so that no row is lost.

    A cell (OTHER, OTHER) is right: both sides have one and the same name off the list. Where a true class off the list meets
    another name off the list or a null, the predicted side is null: never right. ``off_list="fail"`` stops the query instead.
    """
    true, predicted = listed(F.col("true_class"), classes), listed(F.col("predicted_class"), classes)
    if off_list == "fail":
        bad = (true == OTHER) | (predicted == OTHER)
        name = F.concat_ws(" -> ", F.coalesce("true_class", F.lit("null")), F.coalesce("predicted_class", F.lit("null")))
        true = F.when(bad, F.raise_error(F.concat(F.lit("class off the list: "), name))).otherwise(true)
    same = F.col("true_class") == F.col("predicted_class")
    predicted = F.when((true == OTHER) & (predicted == OTHER) & ~F.coalesce(same, F.lit(False)), F.lit(None)).otherwise(predicted)
    return counted.select(*by, true.alias("true_class"), predicted.alias("predicted_class"), "n").groupBy(
        *by, "true_class", "predicted_class"
    ).agg(F.sum("n").alias("n"))


def full_grid(counted: DataFrame, by: list[str], classes: list[str], off_list: str = "keep") -> DataFrame:
    """Add the empty cells: one row per system holds its few cells, then the grid is unfolded.

    Cells off the list follow as :func:`fold_cells` names them, only where there are any.
    """
    cell = F.struct(F.coalesce("true_class", F.lit("")).alias("t"), F.coalesce("predicted_class", F.lit("")).alias("p"))
    packed = fold_cells(counted, by, classes, off_list).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(cell.alias("k"), F.col("n").alias("v")))).alias("_cells")
    )
    grid = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t in classes for p in classes])
    more = F.filter(F.map_keys("_cells"), lambda k: (k["t"] == OTHER) | (k["p"] == OTHER))
    return packed.withColumn("_k", F.explode(F.concat(grid, more))).select(
        *by, F.col("_k.t").alias("true_class"), F.nullif(F.col("_k.p"), F.lit("")).alias("predicted_class"),
        F.coalesce(F.try_element_at("_cells", F.col("_k")), F.lit(0)).alias("n"),
    )


def confusion_wide(long: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return long.groupBy(*by, "true_class").pivot("predicted_class", classes).agg(F.sum("n"))


def class_report(grid: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0. Classes off the list share the row OTHER."""
    hit = F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("true_class").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.coalesce("predicted_class", F.lit(OTHER)).alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    sums = (
        grid.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.class").alias("class"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hits").alias("hits"))
    )
    precision = ratio(F.col("hits"), F.col("predicted"))
    recall = ratio(F.col("hits"), F.col("support"))
    return sums.select(
        *by, "class", "support",
        precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), "hits",
    )


def summary_report(report: DataFrame, by: list[str]) -> DataFrame:
    """Samples and accuracy over all rows; macro and support-weighted averages over the listed classes."""
    on_list = F.col("class") != OTHER
    weight = F.when(on_list, F.col("support"))
    aggregates = [F.sum("support").alias("samples"), ratio(F.sum("hits"), F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggregates.append(F.avg(F.when(on_list, F.col(m))).alias(f"macro_{m}"))
    for m in ("precision", "recall", "f1"):
        aggregates.append(ratio(F.sum(F.col(m) * weight), F.sum(weight)).alias(f"weighted_{m}"))
    return report.groupBy(*by).agg(*aggregates)


def evaluate(predictions: DataFrame, by: list[str], classes: list[str], off_list: str = "keep") -> DataFrame:
    return summary_report(class_report(confusion(predictions, by, classes, off_list), by), by)


def semantic_errors(counted: DataFrame, by: list[str]) -> DataFrame:
    """Errors by category with shares of errors and of all predictions (0 without errors)."""
    kind = error_category(F.col("true_class"), F.col("predicted_class"))
    names = ("condition_error", "identity_error", "combined_error")
    sums = counted.withColumn("_kind", kind).groupBy(*by).agg(
        F.sum("n").alias("samples"),
        F.coalesce(F.sum(F.when(F.col("_kind").isNotNull(), F.col("n"))), F.lit(0)).alias("total_errors"),
        *[F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in names],
    )
    entries = F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in names])
    long = sums.select(*by, "samples", "total_errors", F.explode(entries).alias("e"))
    return long.select(
        *by, "total_errors", F.col("e.category").alias("category"), F.col("e.n").alias("n"),
        ratio(F.col("e.n") * 100, F.col("total_errors")).alias("percent_of_errors"),
        ratio(F.col("e.n") * 100, F.col("samples")).alias("percent_of_predictions"),
    )


def confusion_pairs(counted: DataFrame, by: list[str], top: int = 15) -> DataFrame:
    """The most frequent ``true -> predicted`` mistakes per system; ties by name."""
    pairs = counted.where(F.col("true_class") != F.col("predicted_class")).select(
        *by, F.concat_ws(" -> ", "true_class", "predicted_class").alias("pair"), "n"
    )
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("pair"))
    return pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def cross_entropy_summary(scored: DataFrame, by: list[str], loss: Column, correct: Column) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(loss).alias("loss"), F.avg(correct.cast("double")).alias("accuracy")
    )


# --- comparisons between domains -------------------------------------------------------


def gap_retention(
    source: DataFrame, external: DataFrame, on: list[str], metrics: list[str], keep: list[str] = []
) -> DataFrame:
    """external − source and external ÷ source for each metric (negative gap: degradation).

    ``keep`` names further key columns of the external side, such as its domain.
    """
    s = source.select(*on, *[F.col(m).alias(f"source_{m}") for m in metrics])
    e = external.select(*on, *keep, *[F.col(m).alias(f"external_{m}") for m in metrics])
    out = s.join(e, on)
    for m in metrics:
        out = out.withColumn(f"{m}_gap", F.col(f"external_{m}") - F.col(f"source_{m}"))
        out = out.withColumn(f"{m}_retention", F.try_divide(F.col(f"external_{m}"), F.col(f"source_{m}")))
    return out


def recall_shift(source: DataFrame, external: DataFrame, on: list[str], keep: list[str] = []) -> DataFrame:
    return (
        source.select(*on, F.col("recall").alias("source_recall"))
        .join(external.select(*on, *keep, F.col("recall").alias("external_recall")), on)
        .withColumn("shift", F.col("external_recall") - F.col("source_recall"))
    )


def by_domain(metrics: DataFrame, on: list[str], values: list[str], domains: list) -> DataFrame:
    """One row per ``on`` with a column ``<value>_<domain>`` per domain: a pivot in one pass."""
    return metrics.groupBy(*on).agg(
        *[
            F.max(F.when(F.col("domain") == d, F.col(v))).alias(f"{v}_{d}")
            for v in values for d in domains
        ]
    )


def multi_domain_summary(metrics: DataFrame, source, externals: list) -> DataFrame:
    """Mean and worst external accuracy, weighted F1, macro F1 and retention per system."""
    wide = by_domain(metrics, ["system"], ["accuracy", "weighted_f1", "macro_f1"], [source, *externals])

    def cols(v: str) -> list[Column]:
        return [F.col(f"{v}_{d}") for d in externals]

    def mean(xs: list[Column]) -> Column:
        return sum(xs[1:], xs[0]) / len(xs)

    kept = [F.try_divide(c, F.col(f"accuracy_{source}")) for c in cols("accuracy")]
    return wide.select(
        "system",
        F.col(f"accuracy_{source}").alias("source_accuracy"),
        mean(cols("accuracy")).alias("mean_external_accuracy"),
        F.least(*cols("accuracy")).alias("worst_external_accuracy"),
        mean(cols("weighted_f1")).alias("mean_external_weighted_f1"),
        F.least(*cols("weighted_f1")).alias("worst_external_weighted_f1"),
        F.least(*cols("macro_f1")).alias("worst_external_macro_f1"),
        mean(kept).alias("mean_external_retention"),
        F.least(*kept).alias("worst_external_retention"),
    )


def class_robustness(report: DataFrame, externals: list) -> tuple[DataFrame, DataFrame]:
    """(per system and class, per class) recall robustness over two external domains."""
    first, second = externals
    wide = by_domain(report, ["system", "class"], ["recall"], externals)
    a, b = F.col(f"recall_{first}"), F.col(f"recall_{second}")
    per_system = wide.select(
        "system", "class", a.alias("first_recall"), b.alias("second_recall"),
        ((a + b) / 2).alias("mean_external_recall"),
        F.least(a, b).alias("worst_external_recall"),
        F.abs(a - b).alias("external_recall_range"),
    )
    per_class = per_system.groupBy("class").agg(
        F.avg("mean_external_recall").alias("mean_recall"),
        F.min("worst_external_recall").alias("minimum_recall"),
        F.avg("external_recall_range").alias("mean_range"),
        F.max("external_recall_range").alias("maximum_range"),
    )
    return per_system, per_class


def family_delta(metrics: DataFrame, family: Column, kind: Column, left: str, right: str) -> DataFrame:
    """accuracy(left kind) − accuracy(right kind) per family and domain."""
    value = lambda k: F.max(F.when(F.col("_kind") == k, F.col("accuracy")))
    return (
        metrics.withColumn("family", family).withColumn("_kind", kind)
        .groupBy("family", "domain")
        .agg((value(left) - value(right)).alias("delta"))
        .where(F.col("delta").isNotNull())
    )
