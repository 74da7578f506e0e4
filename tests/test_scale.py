import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from evidence.functions.hashing import stable_key
from evidence.operators import profile, ranking, sampling, scale


def skewed(spark, n=3000, parts=4):
    """One class holds a third of the rows and one value half of those."""
    return spark.range(0, n, 1, parts).select(
        F.col("id").alias("item"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))).alias("cls"),
        F.when(F.col("id") % 6 == 0, 5.0).otherwise(F.pmod(F.hash("id"), F.lit(1000)) / 10.0).alias("x"),
    )


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_rank_equals_row_number(spark, digits):
    df = skewed(spark)
    key = stable_key(1, F.col("cls"), F.col("item"))
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("cls").orderBy(key, "item")).cast("bigint"))
    got = scale.hash_rank(df, ["cls"], key, "item", digits=digits)
    assert got.select("item", "rank").exceptAll(want.select("item", "rank")).count() == 0
    assert got.count() == 3000


@pytest.mark.parametrize("accuracy, small", [(20, False), (200, False), (10_000, False), (200, None)])
def test_exact_quantiles_equal_numpy(spark, accuracy, small):
    df = skewed(spark)
    ps = {f"q{i}": p for i, p in enumerate([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])}
    got = {r.cls: r for r in scale.quantile_summary(df, ["cls"], "x", ps, [F.count(F.lit(1)).alias("n")], accuracy, small).collect()}
    for cls, part in df.toPandas().groupby("cls"):
        assert got[cls].n == len(part)
        for name, p in ps.items():
            assert got[cls][name] == pytest.approx(np.quantile(part["x"], p), abs=1e-9), (cls, p)


@pytest.mark.parametrize("small", [True, False])
def test_exact_quantiles_without_groups_and_with_nulls(spark, small):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, None), (None, 10.0), ("b", None)], "g string, x double")
    assert scale.quantile_summary(df, [], "x", {"m": 0.5}, small=small).first().m == 2.0
    got = {r.g: (r.n, r.m) for r in scale.quantile_summary(df, ["g"], "x", {"m": 0.5}, [F.count("x").alias("n")], small=small).collect()}
    assert got == {"a": (2, 1.5), None: (1, 10.0), "b": (0, None)}


def test_columns_are_described_alike_on_both_paths(spark, monkeypatch):
    df = skewed(spark).withColumn("y", F.when(F.col("item") % 7 > 0, F.col("x") * 2))
    wide = profile.describe_columns(df, ["cls"], ["x", "y"], {"q05": 0.05, "median": 0.5})
    monkeypatch.setattr(profile, "fits_buffers", lambda *_: False)
    long = profile.describe_columns(df, ["cls"], ["x", "y"], {"q05": 0.05, "median": 0.5})
    assert wide.columns == long.columns
    a, b = (sorted(map(tuple, d.collect())) for d in (wide, long))
    assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))


def test_describe_uses_population_deviation(spark):
    row = profile.describe(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, x double"), ["g"], "x", {"median": 0.5}).first()
    assert (row.n, row.mean, row["std"], row.median) == (2, 2.0, 1.0, 2.0)


def test_nested_budgets_nest_and_balance(spark):
    df = skewed(spark)
    got = sampling.nested_budgets(df, "cls", "item", [1, 5, 10], 3).collect()
    sets = {b: {r.item for r in got if b in r.budget_membership} for b in (1, 5, 10)}
    assert sets[1] < sets[5] < sets[10]
    classes = sorted({r.cls for r in got})
    assert {r.status for r in sampling.subset_balance(sampling.nested_budgets(df, "cls", "item", [1, 5, 10], 3), "cls", "item", 5, classes).collect()} == {"PASS"}
    assert sampling.shortfall(df, ["cls"], 500).count() == len(classes) - 1


def test_results_do_not_depend_on_partitions(spark):
    tables = [sampling.ratio_split(skewed(spark, parts=p), "cls", "item", 9).select("item", "split") for p in (1, 4, 16)]
    assert tables[0].exceptAll(tables[1]).count() == 0 and tables[0].exceptAll(tables[2]).count() == 0
    folds = [sampling.stratified_folds(skewed(spark, parts=p), "cls", "item", 5, 9).select("item", "fold") for p in (1, 16)]
    assert folds[0].exceptAll(folds[1]).count() == 0


def test_ratio_split_sizes_and_checks(spark):
    got = sampling.ratio_split(skewed(spark), "cls", "item", 9).groupBy("cls").pivot("split").count().where("cls = 'hot'").first()
    assert (got.train, got.validation, got.test) == (700, 150, 150)
    with pytest.raises(ValueError):
        sampling.ratio_split(skewed(spark), "cls", "item", 9, 0.9, 0.2)
    with pytest.raises(Exception, match="class too small"):
        sampling.ratio_split(skewed(spark, 60), "cls", "item", 9).collect()


def test_folds_are_even(spark):
    counts = sampling.stratified_folds(skewed(spark), "cls", "item", 5, 1).where("cls = 'hot'").groupBy("fold").count().collect()
    assert {r["count"] for r in counts} == {200}


def test_group_split_never_separates_families(spark):
    df = skewed(spark).select("item", F.concat(F.lit("f"), (F.col("item") % 50).cast("string")).alias("family"), (F.col("item") % 50 < 5).alias("is_test"))
    got = sampling.group_split(df, "family", "is_test", 42)
    assert got.groupBy("family").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    families = {r.split: r.n for r in got.groupBy("split").agg(F.count_distinct("family").alias("n")).collect()}
    assert families == {"test": 5, "train": 38, "validation": 7}


def test_hash_sample_beyond_the_group_limit(spark):
    df = skewed(spark)
    small = sampling.hash_sample(df, [], "item", 900, 5)
    large = sampling.hash_sample(df, [], "item", 1500, 5)
    assert small.select("item").exceptAll(large.select("item")).count() == 0 and large.count() == 1500


def test_kendall_with_ties_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    c = d = tx = ty = 0
    for i in range(60):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            c, d = c + (a * b > 0), d + (a * b < 0)
            tx, ty = tx + (a == 0), ty + (b == 0)
    n0 = 60 * 59 / 2
    df = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(x, y)], "pair string, x double, y double")
    got = ranking.kendall_tau_b(df, ["pair"]).first().kendall_tau_b
    assert got == pytest.approx((c - d) / np.sqrt((n0 - tx) * (n0 - ty)))


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("d", "a", 0.9), ("d", "b", 0.5), ("d", "c", 0.5), ("d", "e", 0.1)], "d string, s string, v double")
    assert {r.s: r["rank"] for r in ranking.average_rank(df, ["d"], "v").collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "e": 4.0}
