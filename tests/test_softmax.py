"""Regressions fitted together against pyspark.ml fits of one at a time."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evidence.operators import probes, softmax

from tests.test_vectors import CLASSES, frame, points


def one_at_a_time(df, penalty):
    rows = df.select(F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features"))
    fit = LogisticRegression(family="multinomial", regParam=penalty, maxIter=1000, tol=1e-12, standardization=False).fit(rows)
    return fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()


@pytest.fixture(scope="module")
def table(spark):
    x, label = points(400, 6)
    df = frame(spark, x * [1, 3, 0.2, 1, 1, 0] + [0, 5, 0, 0, 0, 2], label)  # scales differ, one feature is constant
    return df.withColumn("y", probes.class_number(F.col("class"), CLASSES)).cache()


def test_coefficients_agree(spark, table):
    train = table.select(F.col("v").alias("x"), "y", F.lit(0).alias("fold")).cache()
    penalties = [0.3, 0.01, 0.001]
    plain = np.zeros(6), np.ones(6)
    models = softmax.fit(softmax.Rows(train), 4, [softmax.Problem(train.count(), p, 1000, *plain) for p in penalties], 1e-7)
    for model, penalty in zip(models, penalties):
        weights, intercept = one_at_a_time(train, penalty)
        assert model.weights == pytest.approx(weights, abs=1e-4) and model.intercept == pytest.approx(intercept, abs=1e-4)


@pytest.mark.parametrize("partitions", [3, 2 * softmax.FAN_IN + 1])
def test_distributed_sums_equal_those_of_a_matrix(spark, table, partitions):
    train = table.select(F.col("v").alias("x"), "y", (F.col("vec_id") % 3).cast("int").alias("fold")).repartition(partitions).cache()
    weights = np.random.default_rng(1).normal(size=(5, 4, 7))
    without = [-1, 0, 1, 2, 9]
    far, near = softmax.Rows(train, 0), softmax.Rows(train)
    assert far.held is None and near.held is not None
    for a, b in zip(far.sums(weights, without), near.sums(weights, without)):
        assert a == pytest.approx(b, rel=1e-9)
    none = softmax.Rows(train.limit(0))
    assert all((x == 0).all() for x in none.sums(weights, without))


def test_passes_do_not_depend_on_the_number_of_candidates(spark, table, monkeypatch):
    train = table.select(F.col("v").alias("x"), "y", F.lit(0).alias("fold")).coalesce(2).cache()
    plain, n, calls, plainly = (np.zeros(6), np.ones(6)), train.count(), [], softmax.Rows._distributed
    monkeypatch.setattr(softmax.Rows, "_distributed", lambda *a: (calls.append(1), plainly(*a))[1])

    def passes(penalties):
        calls.clear()
        softmax.fit(softmax.Rows(train, 0), 4, [softmax.Problem(n, p, 8, *plain) for p in penalties])
        return len(calls)

    penalties = [0.5, 0.1, 0.02, 0.004]
    assert passes(penalties) == max(passes([p]) for p in penalties)


def test_folds_are_scaled_by_their_own_rows(spark, table):
    folded = table.select(F.col("v").alias("x"), "y", (F.col("vec_id") % 3).cast("int").alias("fold")).cache()
    rows = folded.toPandas()
    x, y, fold = np.vstack(rows["x"]), rows["y"].to_numpy(), rows["fold"].to_numpy()
    problems = probes._fold_problems(folded, 3, 1.0, 1000)
    models = softmax.fit(softmax.Rows(folded), 4, problems, 1e-7)
    for p, m in zip(problems, models):
        held = x[fold != p.without]
        sd = held.std(axis=0)  # of the population
        assert p.rows == len(held) and p.mean == pytest.approx(held.mean(axis=0)) and p.scale == pytest.approx(np.where(sd > 1e-12, sd, 1), abs=1e-9)
        scaled = (held - held.mean(axis=0)) / p.scale
        df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y[fold != p.without], scaled)], "y int, x array<double>")
        weights, intercept = one_at_a_time(df, 1 / len(held))
        assert m.weights * p.scale == pytest.approx(weights, abs=1e-4)
        assert m.intercept + m.weights @ p.mean == pytest.approx(intercept, abs=1e-4)


def test_cross_validation_predicts_by_the_model_of_the_fold(spark, table):
    folds = probes.cross_validated_probe(table, "class", "vec_id", "v", k=4).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3] and all(0.5 < r["accuracy"] <= 1 and 0.4 < r["macro_f1"] <= 1 for r in folds)
    again = probes.cross_validated_probe(table.repartition(5), "class", "vec_id", "v", k=4).collect()
    assert {r["fold"]: r["accuracy"] for r in again} == {r["fold"]: r["accuracy"] for r in folds}


def test_rows_without_class_or_vector(spark, table):
    odd = spark.createDataFrame([(900, 0, None, [0.0] * 6), (901, 0, CLASSES[0], None)], "vec_id bigint, domain int, class string, v array<double>")
    more = table.drop("y").unionByName(odd).withColumn("y", probes.class_number(F.col("class"), CLASSES))
    grid = [(0.01, 30), (0.1, 30)]
    want, model = probes.linear_probe(table, table, "y", "v", grid)
    got, same = probes.linear_probe(more, more, "y", "v", grid)
    pick = lambda t: [(r["candidate"], r["validation_accuracy"], r["selected"]) for r in t.collect()]
    assert pick(got) == pick(want) and same.weights == pytest.approx(model.weights, abs=1e-6)
