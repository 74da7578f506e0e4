"""Principal components of wide vectors by randomised subspace iteration; no task and no driver holds a covariance matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

#: Directions beside those asked for, passes at most, and the change of the leading values at which they end.
EXTRA, PASSES, TOLERANCE = 10, 40, 1e-10
#: Columns of a vector whose sums are one row of the reduction, and partial factors that one task joins.
COLUMNS, FAN_IN = 4096, 64


@dataclass
class Axes:
    """Mean (d), components (k, d) with the entry of largest size positive, variance and its share along each, and passes made."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray
    passes: int


def _usable(df: DataFrame, vec: str) -> DataFrame:
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.select(F.col(vec).cast("array<double>").alias(vec)).where(F.coalesce(whole, F.lit(False)))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.vstack(values.to_numpy()).astype(np.float64, copy=False)


def _products(points: DataFrame, vec: str, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Xᵀ X V of the centred rows: (d, l), summed in every task and then by ranges of columns."""
    shared = points.sparkSession.sparkContext.broadcast((mean, basis))
    d, l = basis.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, v = shared.value
        total = np.zeros((d, l))
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf[vec]) - centre
                total += x.T @ (x @ v)
        for at in range(0, d, COLUMNS):
            yield pd.DataFrame({"at": [at], "part": [total[at : at + COLUMNS].ravel()]})

    parts = points.mapInPandas(run, "at int, part array<double>")
    summed = parts.groupBy("at").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    rows = sorted((r["at"], r["part"]) for r in summed.toLocalIterator())
    shared.destroy()
    return np.concatenate([np.asarray(p).reshape(-1, l) for _, p in rows])


def _factor(points: DataFrame, vec: str, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """R of the QR factors of the centred rows times the basis: factors of batches are stacked and factored again, in the task, then 64 tasks at a time."""
    shared = points.sparkSession.sparkContext.broadcast((mean, basis))
    l = basis.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, v = shared.value
        r = np.zeros((0, l))
        for pdf in batches:
            if len(pdf):
                r = np.linalg.qr(np.vstack([r, (_matrix(pdf[vec]) - centre) @ v]), mode="r")
        if len(r):
            yield pd.DataFrame({"at": [TaskContext.get().partitionId() // FAN_IN], "r": [r.ravel()]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        stacked = np.concatenate(pdf["r"].to_list()).reshape(-1, l)
        return pd.DataFrame({"r": [np.linalg.qr(stacked, mode="r").ravel()]})

    parts = points.mapInPandas(run, "at int, r array<double>").groupBy("at").applyInPandas(join, "r array<double>")
    stacked = np.vstack([np.asarray(row["r"]).reshape(-1, l) for row in parts.toLocalIterator()])
    shared.destroy()
    return np.linalg.qr(stacked, mode="r")


def principal_axes(
    df: DataFrame, k: int = 2, vec: str = "v", seed: int = 42, extra: int = EXTRA, passes: int = PASSES, tolerance: float = TOLERANCE
) -> Axes:
    """The first k principal components of the vectors.

    A seeded basis of k + ``extra`` directions is multiplied by the covariance, one pass over the rows each time, and made
    orthonormal again, until the k leading values change by less than ``tolerance`` of the first. The last pass factors the rows in this basis by QR
    over tasks, which does not square small values. Memory is (k + extra) · d numbers in a task and on the driver. The table is
    read once a pass: store what is costly to compute.

    Vectors that are null or hold nulls, NaN or infinite parts take no part, equal rows count each. Less than two vectors, or vectors
    of different lengths, are an error. ``k`` beyond the dimension gives as many components as there are.
    """
    points = _usable(df, vec)
    shape = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("most")).first()
    if shape["n"] < 2 or shape["least"] != shape["most"] or not shape["most"]:
        raise ValueError("needs two vectors or more, all of one length")
    x = array_to_vector(F.col(vec))
    stats = points.agg(vector_to_array(Summarizer.mean(x)).alias("mean"), vector_to_array(Summarizer.variance(x)).alias("variance")).first()
    mean, total, d = np.asarray(stats["mean"]), float(np.sum(stats["variance"])), shape["most"]
    k = min(k, d)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + extra))))[0]
    before, made = np.full(k, np.inf), 0
    while made < passes:
        made += 1
        image = _products(points, vec, mean, basis)
        values = np.linalg.svd(basis.T @ image, compute_uv=False)[:k]
        basis = np.linalg.qr(image)[0]
        if basis.shape[1] == d or np.abs(values - before).max() <= tolerance * values[0]:
            break
        before = values
    _, size, turn = np.linalg.svd(_factor(points, vec, mean, basis))
    size, turn = np.append(size, np.zeros(k))[:k], turn[:k]
    components = turn @ basis.T
    largest = components[np.arange(k), np.abs(components).argmax(axis=1)]
    variance = size**2 / (shape["n"] - 1)
    return Axes(mean, components * np.where(largest < 0, -1, 1)[:, None], variance, variance / total if total else np.zeros(k), made)


def on_axes(axes: Axes, vec: str | Column) -> Column:
    """Coordinates of any vectors, also of other tables, on the axes; null for vectors that are null, not finite or of another length."""
    mean, components = axes.mean, axes.components

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), dtype=object)
        good = [i for i, v in enumerate(values) if v is not None and len(v) == len(mean)]
        if good:
            moved = (np.vstack([values.iloc[i] for i in good]).astype(np.float64) - mean) @ components.T
            for i, p in zip(good, moved):
                out.iloc[i] = p if np.isfinite(p).all() else None
        return out

    return project(F.col(vec) if isinstance(vec, str) else vec)
