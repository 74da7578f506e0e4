"""Stored profiles merged with new ones against one profile of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence.operators import profile

POINTS = {"q01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}


def test_new_days_merge_with_old_states(spark, tmp_path):
    draw = np.random.default_rng(5)
    days = [(d, draw.normal(1e6 + d, 3, 20000) if d < 3 else np.round(draw.exponential(5, 5000))) for d in range(5)]
    rows = [(int(d), "a" if i % 3 else "b", float(v), None if i % 2 else float(-v)) for d, vs in days for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "day int, source string, v double, w double")
    path = str(tmp_path / "states")
    for d in range(5):  # each day is profiled on its own
        profile.profile_states(df.where(F.col("day") == d), ["day", "source"], ["v", "w"]).write.mode("append").parquet(path)
    merged = profile.merge_states(spark.read.parquet(path), ["source"])
    twice = profile.merge_states(profile.merge_states(spark.read.parquet(path), ["day"]).withColumn("all", F.lit(1)), ["all"])
    for states, key, of in ((merged, "source", lambda r, k: r[1] == k), (twice, "all", lambda r, k: True)):
        found = profile.describe_states(states, [key], POINTS).collect()
        assert len(found) == (4 if key == "source" else 2)
        for r in found:
            x = np.array([row[2 if r["metric"] == "v" else 3] for row in rows if of(row, r[key])], float)
            x = x[~np.isnan(x)]
            assert r["n"] == len(x) and r["minimum"] == x.min() and r["maximum"] == x.max()
            assert r["mean"] == pytest.approx(x.mean()) and r["standard_deviation"] == pytest.approx(x.std(), rel=1e-9)
            for name, p in POINTS.items():
                assert (x <= r[name]).mean() >= p - profile.RANK_ERROR and (x < r[name]).mean() <= p + profile.RANK_ERROR


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), (None, 3.0)], "g string, v double")
    states = profile.profile_states(df, ["g"], ["v"])
    found = {r["g"]: (r["n"], r["median"], r["standard_deviation"]) for r in profile.describe_states(profile.merge_states(states, ["g"]), ["g"], {"median": 0.5}).collect()}
    assert found == {"b": (1, 2.0, 0.0), None: (1, 3.0, 0.0)}
    assert profile.profile_states(df.limit(0), ["g"], ["v"]).count() == 0
