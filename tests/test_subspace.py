"""Principal components by subspace iteration against full decompositions."""

import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evidence.operators import subspace


def frame(spark, x, parts=7):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(parts)


def decomposed(x, k):
    _, size, turn = np.linalg.svd(x - x.mean(0), full_matrices=False)
    turn = turn[:k] * np.where(turn[np.arange(k), np.abs(turn[:k]).argmax(1)] < 0, -1, 1)[:, None]
    return turn, size[:k] ** 2 / (len(x) - 1), size[:k] ** 2 / (size**2).sum()


def wide(n, d, seed=3):
    draw = np.random.default_rng(seed)
    return draw.standard_normal((n, 6)) * [9, 7, 5, 3, 2, 1] @ draw.standard_normal((6, d)) + 0.3 * draw.standard_normal((n, d)) + 5


@pytest.mark.parametrize("n, d", [(400, 64), (60, 9000), (50, 3)])
def test_axes_equal_the_decomposition(spark, n, d):
    x = wide(n, d)
    found = subspace.principal_axes(frame(spark, x), 3)
    components, variance, ratio = decomposed(x, 3)
    assert np.abs(found.components - components).max() < 1e-5 and found.variance == pytest.approx(variance) and found.ratio == pytest.approx(ratio)
    assert found.passes < 40 and np.abs(found.mean - x.mean(0)).max() < 1e-9


def test_axes_equal_the_built_in_on_64_dimensions(spark):
    rows = frame(spark, wide(500, 64, 9))
    model = PCA(k=4, inputCol="x", outputCol="p").fit(rows.select(array_to_vector("v").alias("x")))
    found = subspace.principal_axes(rows, 4)
    other = model.pc.toArray().T
    assert np.abs(np.abs((found.components * other).sum(1)) - 1).max() < 1e-9
    assert found.ratio == pytest.approx(np.asarray(model.explainedVariance))


def test_external_rows_on_source_axes(spark):
    x, y = wide(300, 40), wide(80, 40, 8)
    axes = subspace.principal_axes(frame(spark, x), 2)
    got = {r["vec_id"]: r["p"] for r in frame(spark, y).select("vec_id", subspace.on_axes(axes, "v").alias("p")).collect()}
    assert np.abs(np.array([got[i] for i in range(80)]) - (y - x.mean(0)) @ decomposed(x, 2)[0].T).max() < 1e-4


def test_odd_rows(spark):
    x = wide(90, 12)
    odd = [(100, None), (101, [None] * 12), (102, [float("nan")] * 12), (103, [float("inf")] + [0.0] * 11)]
    rows = frame(spark, x).unionAll(spark.createDataFrame(odd, "vec_id long, v array<double>"))
    axes = subspace.principal_axes(rows, 2)
    assert axes.variance == pytest.approx(decomposed(x, 2)[1])
    more = rows.unionAll(spark.createDataFrame([(104, [1.0]), (105, [])], "vec_id long, v array<double>"))
    got = {r["vec_id"]: r["p"] for r in more.select("vec_id", subspace.on_axes(axes, F.col("v")).alias("p")).collect()}
    assert [i for i, p in got.items() if p is None and i < 100] == [] and all(got[i] is None for i in range(100, 106))
    equal = subspace.principal_axes(frame(spark, np.ones((5, 4))), 9)
    assert equal.variance == pytest.approx(np.zeros(4)) and equal.ratio == pytest.approx(np.zeros(4))
    for few in (x[:0], x[:1]):
        with pytest.raises(ValueError, match="two vectors"):
            subspace.principal_axes(frame(spark, few, 1))
    with pytest.raises(ValueError, match="one length"):
        subspace.principal_axes(more)
