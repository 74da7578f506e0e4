"""Classes off the list and nulls are counted, not dropped."""

import pytest
from pyspark.errors import PySparkException

from evidence.operators import bootstrap, metrics, profile

CLASSES = ["a", "b"]


@pytest.fixture()
def rows_off_list(spark):
    pairs = [("a", "a")] * 5 + [("a", "x")] * 3 + [("x", "a")] * 2 + [("x", "x")] * 2 + [("x", "y")] + [("a", None)] * 5 + [(None, None)] * 2
    return spark.createDataFrame([("s", t, p) for t, p in pairs], "system string, true_class string, predicted_class string")


def test_no_row_is_lost(rows_off_list):
    report = {r["class"]: r for r in metrics.class_report(metrics.confusion(rows_off_list, ["system"], CLASSES), ["system"]).collect()}
    assert set(report) == {"a", "b", metrics.OTHER}
    assert (report["a"]["support"], report["a"]["hits"], report[metrics.OTHER]["support"], report[metrics.OTHER]["hits"]) == (13, 5, 7, 2)
    total = metrics.evaluate(rows_off_list, ["system"], CLASSES).first()
    assert total["samples"] == 20 and total["accuracy"] == pytest.approx(7 / 20)
    assert total["macro_recall"] == pytest.approx(5 / 13 / 2) and total["weighted_recall"] == pytest.approx(5 / 13)


def test_callers_may_fail(rows_off_list):
    with pytest.raises(PySparkException, match="class off the list"):
        metrics.evaluate(rows_off_list, ["system"], CLASSES, off_list="fail").collect()
    assert metrics.evaluate(rows_off_list.where("predicted_class = 'a' AND true_class = 'a'"), ["system"], CLASSES, "fail").first()["samples"] == 5


def test_class_counts(rows_off_list):
    got = {r["true_class"]: r["n"] for r in profile.class_counts(rows_off_list, ["system"], "true_class", CLASSES).collect()}
    assert got == {"a": 13, "b": 0, metrics.OTHER: 7}
    listed = profile.class_counts(rows_off_list.where("true_class = 'a'"), ["system"], "true_class", CLASSES)
    assert {r["true_class"] for r in listed.collect()} == set(CLASSES)


def test_bootstrap_draws_all_rows(rows_off_list):
    found = bootstrap.intervals(bootstrap.bootstrap_replicates(rows_off_list, ["system"], CLASSES, 3000, 1), ["system"], ["accuracy", "macro_f1"]).first()
    total = metrics.evaluate(rows_off_list, ["system"], CLASSES).first()
    assert found["accuracy_observed"] == pytest.approx(total["accuracy"]) and found["macro_f1_observed"] == pytest.approx(total["macro_f1"])
    assert found["accuracy_mean"] == pytest.approx(7 / 20, abs=0.02) and found["accuracy_lower"] < 7 / 20 < found["accuracy_upper"]


def test_paired_observed_difference(spark):
    rows = [("a", "a", "b")] * 3 + [("a", None, "a")] + [(None, "a", "b")] * 2
    paired = spark.createDataFrame(rows, "true_class string, left_class string, right_class string")
    found = bootstrap.intervals(bootstrap.paired_replicates(paired, [], 500, 1), [], ["difference"]).first()
    assert found["difference_observed"] == pytest.approx(2 / 6)
