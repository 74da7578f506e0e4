"""Plug-in scorers: a user function from a batch of vectors to class scores, run inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evidence.functions.vectors import top2

Scorer = Callable[[np.ndarray], np.ndarray]
_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, fn: Scorer) -> None:
    _SCORERS[name] = fn


def scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise KeyError(f"unknown scorer {name!r}; known: {sorted(_SCORERS)}")
    return _SCORERS[name]


def score_items(
    items: DataFrame, fn: Scorer | str, vec: str, keep: list[str], transform: Callable[[np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """(keep…, scores): fn applied to Arrow batches of the vectors, after an optional transform.

    A name is looked up before the plan is built, so a wrong one fails at once.
    """
    run = scorer(fn) if isinstance(fn, str) else fn
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keep).schema.fields)

    def apply(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy())
                scores = np.asarray(run(transform(x) if transform else x), dtype=np.float64)
                if len(scores) != len(pdf):
                    raise ValueError("a scorer must return one row of scores per item")
                yield pd.DataFrame({**{k: pdf[k].to_numpy() for k in keep}, "scores": list(scores)})

    return items.select(*keep, vec).mapInPandas(apply, f"{schema}, scores array<double>")


def predict(scored: DataFrame, classes: list[str], keep: list[str]) -> DataFrame:
    """Predicted class, score and margin from score arrays."""
    names = F.array(*[F.lit(c) for c in classes])
    return scored.withColumn("_t", top2("scores")).select(
        *keep, F.get(names, F.col("_t.predicted")).alias("predicted_class"), F.col("_t.best").alias("score"), F.col("_t.margin").alias("margin")
    )
