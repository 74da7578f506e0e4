"""Published results recomputed from the numbers they were published with."""

import pytest
from pyspark.sql import functions as F

from evidence.operators import metrics, ranking

CLASSES = [f"{c}_{f}" for c in ("fresh", "rotten") for f in ("apple", "banana", "orange")]
# A published confusion matrix, rows true, columns predicted.
MATRIX = [
    [347, 8, 6, 34, 0, 0],
    [9, 352, 4, 0, 8, 8],
    [1, 3, 330, 27, 0, 27],
    [72, 1, 46, 418, 36, 28],
    [3, 1, 0, 4, 518, 4],
    [6, 8, 38, 47, 24, 280],
]
# Its published report in percent.
REPORT = {
    "fresh_apple": (79.22, 87.85, 83.31, 395),
    "fresh_banana": (94.37, 92.39, 93.37, 381),
    "fresh_orange": (77.83, 85.05, 81.28, 388),
    "rotten_apple": (78.87, 69.55, 73.92, 601),
    "rotten_banana": (88.40, 97.74, 92.83, 530),
    "rotten_orange": (80.69, 69.48, 74.67, 403),
}
# Published ranks of nine systems in three domains.
RANKS = {
    "source": [9, 5, 4, 6, 8, 3, 1, 7, 2],
    "first": [9, 5, 6, 4, 7, 8, 2, 3, 1],
    "second": [9, 2, 5, 4, 7, 8, 3, 6, 1],
}
# Published accuracies of five draws per budget of one model.
DRAWS = {
    1: [0.7672349888806523, 0.8888065233506302, 0.7464788732394366, 0.8172720533728688, 0.8372868791697554],
    5: [0.9314306893995552, 0.9399555226093402, 0.9306893995552261, 0.9243884358784284, 0.9221645663454411],
    10: [0.9484803558191253, 0.9329132690882135, 0.9243884358784284, 0.9355077835433655, 0.9284655300222387],
    50: [0.9292068198665678, 0.9058561897702001, 0.8914010378057821, 0.9429206819866568, 0.9414381022979985],
    100: [0.9329132690882135, 0.916234247590808, 0.9154929577464789, 0.9258710155670867, 0.9388435878428466],
}
# Published percent means, deviations and intervals of these draws.
STATISTICS = {
    1: (81.14, 5.67, 74.10, 88.18), 5: (92.97, 0.70, 92.11, 93.84), 10: (93.40, 0.92, 92.26, 94.53),
    50: (92.22, 2.27, 89.40, 95.04), 100: (92.59, 1.02, 91.32, 93.86),
}


def grid(spark):
    cells = [(1, CLASSES[i], CLASSES[j], n) for i, line in enumerate(MATRIX) for j, n in enumerate(line)]
    return spark.createDataFrame(cells, "system int, true_class string, predicted_class string, n bigint")


def test_report_from_matrix(spark):
    report = {r["class"]: r for r in metrics.class_report(grid(spark), ["system"]).collect()}
    for cls, (p, rec, f1, support) in REPORT.items():
        got = report[cls]
        assert (round(got.precision * 100, 2), round(got.recall * 100, 2), round(got.f1 * 100, 2), got.support) == (p, rec, f1, support)
    total = metrics.summary_report(metrics.class_report(grid(spark), ["system"]), ["system"]).first()
    got = [round(total[c] * 100, 2) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")]
    assert got == [83.21, 83.23, 83.68, 83.23, 83.10, 83.21, 82.93]
    assert total.samples == 2698


def test_semantic_errors_from_matrix(spark):
    rows = metrics.semantic_errors(grid(spark), ["system"]).collect()
    assert {r.total_errors for r in rows} == {453}
    assert sum(r.n for r in rows) == 453
    assert sum(r.percent_of_errors for r in rows) == pytest.approx(100)


def test_rank_correlations(spark):
    rows = [(i, d, float(-r)) for d, rs in RANKS.items() for i, r in enumerate(rs)]
    measured = spark.createDataFrame(rows, "unit int, domain string, value double")
    pairs = [("source", "first"), ("source", "second"), ("first", "second")]
    paired = ranking.paired_values(measured, "unit", "domain", "value", pairs)
    rho = {r.pair: round(r.spearman_rho, 4) for r in ranking.spearman(paired, ["pair"]).collect()}
    tau = {r.pair: round(r.kendall_tau_b, 4) for r in ranking.kendall_tau_b(paired, ["pair"]).collect()}
    assert rho == {"source_vs_first": 0.5667, "source_vs_second": 0.6167, "first_vs_second": 0.8333}
    assert tau == {"source_vs_first": 0.3333, "source_vs_second": 0.5, "first_vs_second": 0.7222}


def test_rank_volatility(spark):
    rows = [(i, d, float(-r)) for d, rs in RANKS.items() for i, r in enumerate(rs)]
    ranked = ranking.average_rank(spark.createDataFrame(rows, "unit int, domain string, value double"), ["domain"], "value")
    got = {r.unit: (r.best_rank, r.worst_rank, r.rank_range) for r in ranking.rank_volatility(ranked, "unit").collect()}
    assert got == {0: (9, 9, 0), 1: (2, 5, 3), 2: (4, 6, 2), 3: (4, 6, 2), 4: (7, 8, 1), 5: (3, 8, 5), 6: (1, 3, 2), 7: (3, 7, 4), 8: (1, 2, 1)}


def test_draw_statistics_and_thresholds(spark):
    runs = spark.createDataFrame([("m", b, a) for b, xs in DRAWS.items() for a in xs], "model string, budget int, accuracy double")
    stats = ranking.draw_statistics(runs, ["model", "budget"], "accuracy")
    got = {r.budget: tuple(round(x * 100, 2) for x in (r.mean, r.standard_deviation, r.lower, r.upper)) for r in stats.collect()}
    assert got == STATISTICS
    first = ranking.first_budgets(stats, spark.createDataFrame([("m", 0.8907)], "model string, full_accuracy double"), "model", "budget").first()
    assert (first.within_one_point, first.at_least_95_percent) == ("5", "5")
    unreached = ranking.first_budgets(stats, spark.createDataFrame([("m", 1.5)], "model string, full_accuracy double"), "model", "budget").first()
    assert unreached.within_one_point == "Not reached."


def test_best_epoch(spark):
    # The first epochs of a published history; epoch 2 was selected.
    history = [(1, 0.9666666666666667, 1.516921), (2, 0.9925925925925926, 1.290609), (3, 0.9888888888888889, 1.109164),
               (4, 0.9888888888888889, 0.958999), (5, 0.9888888888888889, 0.83584), (6, 0.9888888888888889, 0.735036)]
    frame = spark.createDataFrame([("r", *h) for h in history], "run string, epoch int, validation_accuracy double, validation_loss double")
    assert ranking.best_epoch(frame, ["run"]).first().epoch == 2
    improved = [r.improved for r in ranking.running_best(frame, ["run"]).orderBy("epoch").collect()]
    assert improved == [True, True, False, False, False, False]


def test_retention(spark):
    # Published source and external accuracy and retention in percent.
    published = {"a": (74.09, 34.58, 46.68), "b": (93.03, 70.75, 76.05), "c": (98.63, 82.75, 83.90), "d": (89.96, 80.75, 89.77)}
    source = spark.createDataFrame([(s, v[0]) for s, v in published.items()], "system string, accuracy double")
    external = spark.createDataFrame([(s, v[1]) for s, v in published.items()], "system string, accuracy double")
    got = {r.system: r.accuracy_retention * 100 for r in metrics.gap_retention(source, external, ["system"], ["accuracy"]).collect()}
    for s, v in published.items():
        assert got[s] == pytest.approx(v[2], abs=0.02)


def test_secondary_fraction_of_published_size(spark):
    # 28 exact pairs among 4,185 records are 0.00669 secondary records.
    from evidence.operators.dedup import duplicate_groups, secondary_fraction

    items = spark.range(4185).select(
        F.col("id").alias("item"), F.when(F.col("id") < 56, F.floor(F.col("id") / 2)).otherwise(F.col("id")).cast("string").alias("h"))
    items = items.withColumn("c", F.col("h"))
    assert duplicate_groups(items, "h", "item").count() == 28
    row = secondary_fraction(items, "item", ["h", "c"]).first()
    assert (row.secondary, round(row.fraction, 5), row.severe) == (28, 0.00669, False)
