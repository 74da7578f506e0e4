"""Softmax regressions fitted together: one pass over the rows serves all candidates and folds."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from evidence.operators.scale import BROADCAST_BYTES

#: Scores that a task holds at once, and partitions whose sums are added in one step.
SCORES, FAN_IN = 4_000_000, 16


@dataclass
class Problem:
    """One regression: mean loss over the rows of all folds but ``without``, plus ``penalty`` / 2 times the squared weights.

    Features count as (x - mean) / scale. The intercept is not penalised.
    """

    rows: int
    penalty: float
    iterations: int
    mean: np.ndarray
    scale: np.ndarray
    without: int = -1


@dataclass
class Model:
    """Weights on the features as given, (classes, dimension), and intercepts."""

    weights: np.ndarray
    intercept: np.ndarray


@dataclass
class Descent:
    """L-BFGS with backtracking for one problem, as a state machine between passes over the data."""

    x: np.ndarray
    most: int
    tolerance: float
    value: float = np.inf
    gradient: np.ndarray | None = None
    step: float = 1.0
    direction: np.ndarray | None = None
    steps: list = field(default_factory=list)
    iterations: int = 0
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.x if self.direction is None or self.done else self.x + self.step * self.direction

    def receive(self, value: float, gradient: np.ndarray) -> None:
        """Take the value and the gradient at the trial point."""
        if self.done:
            return
        if self.direction is not None:
            if not value <= self.value + 1e-4 * self.step * float(self.gradient @ self.direction):
                self.step /= 2
                self.done = self.step < 1e-12
                return
            s, y = self.step * self.direction, gradient - self.gradient
            if s @ y > 1e-14:
                self.steps = [*self.steps[-9:], (s, y, 1 / (s @ y))]
            self.x, self.iterations = self.x + s, self.iterations + 1
        self.value, self.gradient = value, gradient
        if np.abs(gradient).max(initial=0) <= self.tolerance or self.iterations >= self.most:
            self.done = True
            return
        q, kept = gradient.copy(), []
        for s, y, r in reversed(self.steps):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if self.steps:
            s, y, r = self.steps[-1]
            q *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(self.steps, reversed(kept)):
            q += s * (a - r * (y @ q))
        self.direction, self.step = -q, 1.0 if self.steps else min(1.0, 1 / np.linalg.norm(gradient))


def _add(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weights: np.ndarray, without: np.ndarray) -> np.ndarray:
    """Losses, right answers and gradients of all problems over some rows, in one vector; ``x`` ends with a column of ones."""
    problems, classes, width = weights.shape
    w = weights.reshape(problems * classes, width)
    loss, right, gradient = np.zeros(problems), np.zeros(problems), np.zeros((problems * classes, width))
    step = max(1, SCORES // max(1, problems * classes))
    for at in range(0, len(x), step):
        part, label = x[at : at + step], y[at : at + step]
        used = fold[at : at + step, None] != without[None, :]
        z = (part @ w.T).reshape(len(part), problems, classes)
        place = np.arange(len(part))
        right += (used & (z.argmax(axis=2) == label[:, None])).sum(axis=0)
        z -= z.max(axis=2, keepdims=True)
        own = z[place, :, label]
        e = np.exp(z, out=z)
        total = e.sum(axis=2)
        loss += np.where(used, np.log(total) - own, 0).sum(axis=0)
        e /= total[:, :, None]
        e[place, :, label] -= 1
        e *= used[:, :, None]
        gradient += e.reshape(len(part), -1).T @ part
    return np.concatenate([loss, right, gradient.ravel()])


def _rows(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.vstack(frame["x"].to_numpy()).astype(np.float64)
    return np.hstack([x, np.ones((len(x), 1))]), frame["y"].to_numpy(np.int64), frame["fold"].to_numpy(np.int64)


class Rows:
    """Rows (x array, y int, fold int) that sums are taken over; a table of counted size up to ``max_bytes`` is held as a matrix."""

    def __init__(self, points: DataFrame, max_bytes: int = BROADCAST_BYTES):
        self.points = points.select("x", "y", "fold")
        size = points.agg(F.coalesce(F.sum(F.size("x") + 3), F.lit(0)).alias("numbers"), F.count(F.lit(1)).alias("n")).first()
        self.n = size["n"]
        self.held = _rows(self.points.toPandas()) if 0 < size["numbers"] * 8 <= max_bytes else None

    def sums(self, weights: np.ndarray, without: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(loss, right, gradient) of each set of weights (problems, classes, dimension + 1) over the rows of all folds but its own.

        One pass over the table, whatever the number of problems. Every task adds its rows up to one vector; the vectors of FAN_IN
        partitions are added before the last step, so the driver receives one row whatever the number of partitions.
        """
        problems, skipped = len(weights), np.array(without)
        if not self.n:
            found = np.zeros(2 * problems + weights.size)
        elif self.held is not None:
            found = _add(*self.held, weights, skipped)
        else:
            found = self._distributed(weights, skipped)
        return found[:problems], found[problems : 2 * problems], found[2 * problems :].reshape(weights.shape)

    def _distributed(self, weights: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        shared = self.points.sparkSession.sparkContext.broadcast(weights)
        nodes = max(1, -(-self.points.rdd.getNumPartitions() // FAN_IN))

        def add(batches):
            w = shared.value
            total = np.zeros(2 * len(w) + w.size)
            for rows in batches:
                if len(rows):
                    total += _add(*_rows(rows), w, skipped)
            yield pd.DataFrame({"node": [TaskContext.get().partitionId() % nodes], "s": [total]})

        parts = self.points.mapInPandas(add, "node int, s array<double>").withColumn("s", array_to_vector("s"))
        if nodes > 1:
            parts = parts.groupBy("node").agg(Summarizer.sum(F.col("s")).alias("s"))
        found = parts.agg(Summarizer.sum(F.col("s"))).first()[0].toArray()
        shared.unpersist()
        return found


def fit(rows: Rows, classes: int, problems: list[Problem], tolerance: float = 1e-6) -> list[Model]:
    """All problems at once, until no component of a gradient exceeds ``tolerance``. Each iteration is one pass, whatever the number of problems; a problem that has converged, or whose
    step was too long, shares the passes of the others."""
    dimension = len(problems[0].mean)
    descents = [Descent(np.zeros(classes * (dimension + 1)), p.iterations, tolerance) for p in problems]

    def on_rows(p: Problem, flat: np.ndarray) -> np.ndarray:
        """Weights of scaled features, turned to weights of the features as given."""
        w = flat.reshape(classes, dimension + 1).copy()
        w[:, :-1] /= p.scale
        w[:, -1] -= w[:, :-1] @ p.mean
        return w

    while not all(d.done for d in descents):
        open_ = [i for i, d in enumerate(descents) if not d.done]
        trials = [descents[i].trial() for i in open_]
        stacked = np.stack([on_rows(problems[i], t) for i, t in zip(open_, trials)])
        loss, _, raw = rows.sums(stacked, [problems[i].without for i in open_])
        for k, i in enumerate(open_):
            p, w = problems[i], trials[k].reshape(classes, dimension + 1)
            g = raw[k] / p.rows
            g[:, :-1] = (g[:, :-1] - g[:, -1:] * p.mean) / p.scale + p.penalty * w[:, :-1]
            descents[i].receive(loss[k] / p.rows + p.penalty / 2 * float((w[:, :-1] ** 2).sum()), g.ravel())
    found = [on_rows(p, d.x) for p, d in zip(problems, descents)]
    return [Model(w[:, :-1], w[:, -1]) for w in found]
