"""Linear probes on embedding tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from evidence.operators import softmax
from evidence.operators.metrics import OTHER, class_report, full_grid, ratio, summary_report
from evidence.operators.ranking import draw_statistics
from evidence.operators.sampling import hash_sample, stratified_folds
from evidence.operators.scale import BROADCAST_BYTES, stored


def _points(df: DataFrame, label, vec: str, *more) -> DataFrame:
    """(x, y, fold, …) of the rows with a class number and a vector, kept for the passes of a fit."""
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), label.cast("int").alias("y"), *more)
    return stored(rows.where("x IS NOT NULL AND y >= 0")).persist()


def linear_probe(
    train: DataFrame, validation: DataFrame, label: str, vec: str, grid: list[tuple[float, int]]
) -> tuple[DataFrame, softmax.Model]:
    """Softmax regression per (regularisation, iterations); keeps the best on validation.

    Order: accuracy falling, loss rising, first candidate. ``label`` holds class numbers from 0; rows without one are left out.
    All candidates are fitted together, so the passes over the training rows do not depend on their number, and one pass
    over the validation rows judges them. Returns one row per candidate with a ``selected`` flag, and the chosen model.
    """
    points, held = (_points(df, F.col(label), vec, F.lit(0).alias("fold")) for df in (train, validation))
    known = points.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y"), F.max(F.size("x")).alias("d")).first()
    judged = held.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y")).first()
    classes = 1 + max(known["y"], judged["y"] if judged["n"] else 0)  # a class seen in validation alone is never right, but counted
    plain = np.zeros(known["d"]), np.ones(known["d"])
    models = softmax.fit(softmax.Rows(points), classes, [softmax.Problem(known["n"], reg, steps, *plain) for reg, steps in grid])
    stacked = np.stack([np.column_stack([m.weights, m.intercept]) for m in models])
    loss, right, _ = softmax.Rows(held).sums(stacked, [-1] * len(grid))
    points.unpersist(), held.unpersist()
    n = judged["n"]
    rows = [(i, reg, steps, float(right[i] / n) if n else None, float(loss[i] / n) if n else None) for i, (reg, steps) in enumerate(grid)]
    best = min(rows, key=lambda x: (-(x[3] or 0), x[4] or 0, x[0]))[0]
    table = train.sparkSession.createDataFrame(
        [(*x, x[0] == best) for x in rows],
        "candidate int, regularisation double, iterations int, validation_accuracy double, validation_loss double, selected boolean",
    )
    return table, models[best]


def _fold_problems(points: DataFrame, k: int, c: float, iterations: int) -> list[softmax.Problem]:
    """One problem a fold over the rows of the others; mean and population deviation of those rows from sums per fold."""
    x = array_to_vector("x")
    stats = points.groupBy("fold").agg(
        Summarizer.metrics("count", "mean", "variance").summary(x).alias("s")
    ).select("fold", "s.count", "s.mean", "s.variance").collect()
    # sample variances of the folds turned to sums of squares around the fold's mean, which add up
    held = {r["fold"]: (r["count"], r["mean"].toArray(), r["variance"].toArray() * max(r["count"] - 1, 0)) for r in stats}

    def rest(fold: int) -> softmax.Problem:
        others = [v for f, v in held.items() if f != fold]
        n = sum(m for m, _, _ in others)
        mean = sum(m * mu for m, mu, _ in others) / n
        variance = sum(s + m * (mu - mean) ** 2 for m, mu, s in others) / n
        scale = np.sqrt(variance)
        return softmax.Problem(n, 1 / (c * n), iterations, mean, np.where(scale > 0, scale, 1.0), fold)

    return [rest(f) for f in range(k) if f in held and len(held) > 1]


def cross_validated_probe(
    df: DataFrame, label: str, item: str, vec: str, k: int = 5, c: float = 1.0, seed: int = 42, iterations: int = 100
) -> DataFrame:
    """(fold, accuracy, macro_f1): standardise inside each fold, then logistic regression of strength C.

    Features are scaled by the population deviation of the training folds; a constant feature is left unscaled. All folds are fitted
    together: a row counts in the problems of all folds but its own. One more pass predicts each row by the model of its fold.
    """
    classes = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
    folded = stratified_folds(df.select(item, label, vec), label, item, k, seed)
    points = _points(folded, class_number(F.col(label), classes), vec, F.col("fold").cast("int").alias("fold"))
    problems = _fold_problems(points, k, c, iterations)
    models = softmax.fit(softmax.Rows(points), len(classes), problems) if problems else []
    shared = df.sparkSession.sparkContext.broadcast({p.without: m for p, m in zip(problems, models)})

    def predict(batches):
        for rows in batches:
            for fold, part in rows.groupby("fold"):
                m = shared.value.get(fold)
                if m is not None:
                    best = (np.vstack(part["x"].to_numpy()) @ m.weights.T + m.intercept).argmax(axis=1)
                    yield pd.DataFrame({"fold": fold, "y": part["y"].to_numpy(), "p": best.astype(np.int32)})

    names = F.array(*[F.lit(x) for x in classes])
    found = points.select("x", "y", "fold").mapInPandas(predict, "fold int, y int, p int")
    counted = stored(found.groupBy("fold", "y", "p").agg(F.count(F.lit(1)).alias("n")))
    points.unpersist()
    cells = counted.select("fold", F.get(names, F.col("y")).alias("true_class"), F.get(names, F.col("p")).alias("predicted_class"), "n")
    grid = full_grid(cells, ["fold"], classes)
    return summary_report(class_report(grid, ["fold"]), ["fold"]).select("fold", "accuracy", "macro_f1")


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation over the folds."""
    return folds.agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"),
        F.avg("macro_f1").alias("macro_f1_mean"), F.stddev_samp("macro_f1").alias("macro_f1_std"),
    )


def factor_gap(condition: DataFrame, identity: DataFrame) -> DataFrame:
    """Condition minus identity accuracy and their ratio, from two fold tables."""
    both = condition.agg(F.avg("accuracy").alias("condition_accuracy")).select(
        "condition_accuracy", identity.agg(F.avg("accuracy")).scalar().alias("identity_accuracy")
    )
    c, i = F.col("condition_accuracy"), F.col("identity_accuracy")
    return both.select("*", (c - i).alias("gap"), F.try_divide(c, i).alias("ratio"))


# --- label efficiency -------------------------------------------------------------------


def _fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, epochs: int, rate: float, decay: float) -> list[np.ndarray]:
    """Full-batch gradient descent with momentum; the (classes, dimension + 1) weights after every epoch."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((classes, x.shape[1]))
    step = np.zeros_like(w)
    target = np.eye(classes)[y]
    every = []
    for _ in range(epochs):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = 0.9 * step - rate * ((p - target).T @ x / len(x) + decay * w)
        w = w + step
        every.append(w)
    return every


#: What tells the fits of a label-efficiency study apart.
FIT = ["encoder", "budget", "seed"]


def few_shot_fits(
    train: DataFrame, cls: str, item: str, vec: str, classes: list[str], budgets: list[int], seeds: list[int],
    epochs: int = 50, rate: float = 1.0, decay: float = 1e-4,
) -> DataFrame:
    """(encoder, budget, seed, epoch, weights): the weights after every epoch of a fit per encoder, nested budget and draw.

    ``train`` has a column ``encoder``; all encoders see the same drawn items. A group holds at most max(budgets) × classes
    rows, whatever the size of ``train``. Rows of classes off the list take no part.
    """
    number = {c: i for i, c in enumerate(classes)}
    drawn = train.where(F.col(cls).isin(*classes)).select("encoder", cls, item, vec).withColumn(
        "seed", F.explode(F.array(*[F.lit(x) for x in seeds]))
    )
    picked = hash_sample(drawn, ["encoder", "seed", cls], item, max(budgets), 0, key=["seed", cls, item])
    member = F.filter(F.array(*[F.lit(b) for b in sorted(budgets)]), lambda b: F.col("rank") <= b)
    chosen = picked.select("encoder", "seed", cls, item, vec, F.explode(member).alias("budget"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        x = np.array(pdf[vec].to_list(), dtype=float)
        weights = _fit_softmax(x, pdf[cls].map(number).to_numpy(), len(classes), epochs, rate, decay)
        keys = {k: pdf[k].iloc[0] for k in FIT}
        return pd.DataFrame({**keys, "epoch": np.arange(1, epochs + 1), "weights": [w.ravel() for w in weights]})

    encoder = train.schema["encoder"].dataType.simpleString()
    return chosen.groupBy(*FIT).applyInPandas(fit, f"encoder {encoder}, budget int, seed int, epoch int, weights array<double>")


def few_shot_cells(fits: DataFrame, rows: DataFrame, cls: str, vec: str, classes: list[str], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(encoder, budget, seed, epoch, true_class, predicted_class, n, loss): confusion cells of every set of weights.

    The number of weights follows from the design of the study. Their bytes are measured first, and they go out in as many
    parts of at most ``max_bytes`` as that takes, one pass over ``rows`` each; the rows stay distributed and tasks return
    counts and sums of cross-entropy. A row off the list counts as class OTHER without a loss.
    """
    size = fits.agg(F.coalesce(F.sum(F.size("weights") * 8 + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = max(1, -(-size * 2 // max_bytes))  # hashed parts are uneven: aim at half the bound
    place = {c: i for i, c in enumerate(classes)}
    k = len(classes)
    encoder = fits.schema["encoder"].dataType.simpleString()
    schema = f"encoder {encoder}, budget int, seed int, epoch int, true_class string, predicted_class string, n bigint, loss double"

    def counts(part: int) -> DataFrame:
        models = fits.where(F.pmod(F.xxhash64(*FIT, "epoch"), F.lit(parts)) == part).orderBy(*FIT, "epoch").collect()
        by_encoder: dict = {}
        for m in models:
            by_encoder.setdefault(m["encoder"], []).append(m)
        packed = {
            e: ([(m["budget"], m["seed"], m["epoch"]) for m in ms], np.array([m["weights"] for m in ms], float).reshape(len(ms), k, -1))
            for e, ms in by_encoder.items()
        }
        held = rows.sparkSession.sparkContext.broadcast(packed)

        def count(batches):
            sums: dict = {}
            for pdf in batches:
                for e, group in pdf.groupby("encoder"):
                    if e not in held.value:
                        continue
                    keys, weights = held.value[e]
                    x = np.array(group[vec].to_list(), dtype=float)
                    x = np.hstack([x, np.ones((len(x), 1))])
                    y = group[cls].map(place).fillna(k).to_numpy(int)
                    for key, w in zip(keys, weights):
                        z = x @ w.T
                        top = z.max(axis=1)
                        at = y * k + z.argmax(axis=1)
                        own = np.where(y < k, z[np.arange(len(y)), np.minimum(y, k - 1)], np.nan)
                        loss = np.where(y < k, np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - own, 0.0)
                        n, total = sums.setdefault((e, *key), (np.zeros((k + 1) * k, np.int64), np.zeros((k + 1) * k)))
                        n += np.bincount(at, minlength=len(n))
                        total += np.bincount(at, loss, minlength=len(n))
            names = [*classes, OTHER]
            for key, (n, total) in sums.items():
                hit = np.flatnonzero(n)
                yield pd.DataFrame({
                    **dict(zip([*FIT, "epoch"], key)), "true_class": [names[i // k] for i in hit],
                    "predicted_class": [classes[i % k] for i in hit], "n": n[hit], "loss": total[hit],
                })

        return rows.select("encoder", cls, vec).mapInPandas(count, schema)

    counted = reduce(DataFrame.unionByName, [counts(i) for i in range(parts)])
    return counted.groupBy(*FIT, "epoch", "true_class", "predicted_class").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def epoch_table(counted: DataFrame) -> DataFrame:
    """(encoder, budget, seed, epoch, validation_accuracy, validation_loss) from the cells of a validation table."""
    right = F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0))
    return counted.groupBy(*FIT, "epoch").agg(
        ratio(right, F.sum("n")).alias("validation_accuracy"), ratio(F.sum("loss"), F.sum("n")).alias("validation_loss")
    )


def select_epochs(fits: DataFrame, validation: DataFrame, cls: str, vec: str, classes: list[str], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The weights of the epoch of each fit with the highest validation accuracy; then lowest loss, then the earliest."""
    table = epoch_table(few_shot_cells(fits, validation, cls, vec, classes, max_bytes))
    order = F.struct(-F.col("validation_accuracy"), F.round("validation_loss", 9), "epoch")
    chosen = table.groupBy(*FIT).agg(F.min_by("epoch", order).alias("epoch"))
    return fits.join(chosen, [*FIT, "epoch"])


def few_shot_report(
    fits: DataFrame, test: DataFrame, cls: str, vec: str, classes: list[str], max_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(per class, in total) metrics of every fit on the whole test table: (encoder, budget, seed, epoch, …)."""
    by = [*FIT, "epoch"]
    report = class_report(full_grid(few_shot_cells(fits, test, cls, vec, classes, max_bytes).drop("loss"), by, classes), by)
    return report, summary_report(report, by)


def class_draw_statistics(report: DataFrame, by: list[str]) -> DataFrame:
    """(by…, class, metric, draws, mean, standard_deviation, minimum, maximum) of a class report over its draws."""
    long = report.unpivot([*by, "class"], ["precision", "recall", "f1"], "metric", "value")
    stats = draw_statistics(long, [*by, "class", "metric"], "value")
    return stats.select(*by, "class", "metric", "draws", "mean", "standard_deviation", "minimum", "maximum")


def class_number(cls: Column, classes: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), cls) - 1).cast("double")
