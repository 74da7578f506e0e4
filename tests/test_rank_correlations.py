"""Rank correlations over sliced values against brute force, and how they spread one large group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence.operators import ranking


def plain(x, y):
    """(rho, tau) by ranks and by all pairs; None where a side is constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    rx, ry = rank(x), rank(y)
    a, b = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    down = np.sqrt((a != 0).sum() * float((b != 0).sum()))
    if not down:
        return None, None
    return float(np.corrcoef(rx, ry)[0, 1]), float((a * b).sum() / down)


def near(got, want):
    return got is None if want is None else got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_groups_equal_brute_force(spark, slices):
    draw = np.random.default_rng(slices)
    groups = {
        "few ties": (draw.normal(size=200), draw.normal(size=200)),
        "ties": (draw.integers(0, 6, 150), draw.integers(0, 9, 150)),
        "hot value": (np.where(draw.random(240) < 0.4, 3.0, draw.normal(3, 2, 240)), np.round(draw.normal(size=240), 1)),
        "rising": (np.arange(90), np.arange(90) ** 2),
        "falling": (np.arange(90), -np.arange(90)),
        "constant": (np.ones(30), draw.normal(size=30)),
        "two": ([1, 2], [5, 4]),
        "one": ([1], [5]),
        None: (draw.integers(0, 50, 80), draw.integers(0, 50, 80)),
    }
    rows = [(g, "k", float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)] + [("ties", "k", None, 1.0), ("ties", "k", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, h string, x double, y double").repartition(5)
    got = {r["g"]: r for r in ranking.rank_correlations(df, ["g", "h"], slices, 1).collect()}
    assert got.keys() == groups.keys()
    for g, (x, y) in groups.items():
        rho, tau = plain(x, y)
        assert got[g]["n"] == len(x) and near(got[g]["spearman_rho"], rho) and near(got[g]["kendall_tau_b"], tau), g
    whole = {r["g"]: r for r in ranking.rank_correlations(df, ["g", "h"]).collect()}  # groups of one slice
    assert all(near(whole[g]["kendall_tau_b"], got[g]["kendall_tau_b"]) and near(whole[g]["spearman_rho"], got[g]["spearman_rho"]) for g in groups)
    alone = {r["g"]: r["spearman_rho"] for r in ranking.spearman(df, ["g", "h"], slices, 1).collect()}
    assert all(near(alone[g], got[g]["spearman_rho"]) for g in groups)
    assert ranking.rank_correlations(df.limit(0), ["g", "h"], slices, 1).count() == 0


def test_weighted_concordance():
    draw = np.random.default_rng(1)
    for size in (0, 1, 2, 40):
        a, b, n = draw.integers(0, 7, size), draw.integers(0, 5, size), draw.integers(1, 4, size)
        signs = np.sign(a[:, None] - a[None]) * np.sign(b[:, None] - b[None]) * n[:, None] * n[None]
        assert ranking.concordance(a, b, n) == signs.sum() // 2


def test_one_pair_of_a_million_units_is_spread(spark):
    """A third of the units tie at one value; no slice that is ordered holds more than its share."""
    n, slices = 1_000_000, 64
    df = spark.range(n, numPartitions=8).select(
        F.lit("p").alias("pair"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("x"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)) + F.col("id") / 100).cast("long").alias("y"),
    )
    cells = ranking._cells(df, ["pair"], slices)
    for c in ("xs", "ys"):
        sizes = cells.where(f"{c} % 2 = 0").groupBy(c).agg(F.sum("n").alias("n"))
        assert sizes.agg(F.max("n")).first()[0] <= 1.3 * n / slices and cells.select(c).distinct().count() >= slices // 2
    assert cells.where("xs % 2 = 1 AND x = 0.5").agg(F.sum("n")).first()[0] == -(-n // 3)
    frame = df.toPandas()
    rho = frame["x"].rank().corr(frame["y"].rank())
    got = ranking.rank_correlations(df, ["pair"], slices).first()
    assert got["n"] == n and got["spearman_rho"] == pytest.approx(rho, abs=1e-9)
    x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
    s = ranking.concordance(x, y, np.ones(n, np.int64))  # all rows at once
    pairs = lambda v: n * (n - 1) / 2 - sum(t * (t - 1) / 2 for t in np.unique(v, return_counts=True)[1].tolist())
    assert got["kendall_tau_b"] == pytest.approx(s / np.sqrt(pairs(x) * pairs(y)), abs=1e-12)
