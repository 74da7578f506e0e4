import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evidence.operators import bootstrap, geometry, probes, retrieval, sampling, scoring

CLASSES = [f"{c}_k{i}" for i in range(2) for c in ("fresh", "stale")]


def points(n=240, d=8, seed=0):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 4, n)
    x = rng.normal(size=(n, d)) + 1.5 * np.eye(4, d)[label]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[3]  # equal vectors tie by id
    label[5] = label[3]
    return x, label


def frame(spark, x, label):
    rows = [(i, i % 3, CLASSES[y], v.tolist()) for i, (v, y) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "vec_id bigint, domain int, class string, v array<double>")


@pytest.mark.parametrize("way", [{}, {"max_bytes": 0, "block_rows": 25}])
def test_nearest_equals_brute_force(spark, way):
    x, label = points()
    df = frame(spark, x, label)
    found = retrieval.nearest(df, df, "vec_id", "vec_id", "v", 10, ["class"], ["class"], **way)
    got = {}
    for r in found.collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour, r.neighbour_class)
    sims = np.round(x @ x.T, 10)
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (-sims[i, j], j))[:10]
        assert [got[i][k + 1] for k in range(10)] == [(j, CLASSES[label[j]]) for j in want]


def test_nearest_with_a_gallery_smaller_than_k(spark):
    x, label = points(12)
    df = frame(spark, x, label)
    assert retrieval.nearest(df, df.where("vec_id < 3"), "vec_id", "vec_id", "v", 10).count() == 36


def test_packed_neighbours_and_consistency(spark):
    x, label = points(60)
    df = frame(spark, x, label)
    found = retrieval.nearest(df, df, "vec_id", "vec_id", "v", 5, ["domain", "class"], ["class"])
    row = retrieval.packed_neighbours(found, ["vec_id"], "neighbour_class").where("vec_id = 0").first()
    assert row.identifiers.startswith("0|") and row.similarities.startswith("1.00000000|") and len(row.classes.split("|")) == 5
    q = retrieval.consistency(found, [], "vec_id", {"class": F.col("class") == F.col("neighbour_class")}, [1, 5]).collect()
    assert {(r.k, r.hit) for r in q} == {(1, 1.0), (5, 1.0)} and {r.consistency for r in q if r.k == 1} == {1.0}


@pytest.mark.parametrize("way", [{}, {"max_bytes": 0}])
def test_silhouette_equals_brute_force_and_evaluator(spark, way):
    x, label = points()
    df = frame(spark, x, label)
    d = 1 - x @ x.T
    values = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        a = d[i, own].mean()
        b = min(d[i, label == c].mean() for c in range(4) if c != label[i])
        values.append((b - a) / max(a, b))
    got = geometry.silhouette_cosine(df, "vec_id", "class", **way).first()
    assert got.silhouette == pytest.approx(np.mean(values)) and (got["items"], got.clusters) == (240, 4)
    ready = df.select(array_to_vector("v").alias("features"), F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("class")).cast("int").alias("prediction"))
    assert got.silhouette == pytest.approx(ClusteringEvaluator(distanceMeasure="cosine").evaluate(ready))


def test_calinski_harabasz(spark):
    x, label = points()
    means = np.stack([x[label == c].mean(0) for c in range(4)])
    n = np.bincount(label)
    between = (n * ((means - x.mean(0)) ** 2).sum(1)).sum() / 3
    within = ((x - means[label]) ** 2).sum() / (len(x) - 4)
    assert geometry.calinski_harabasz(frame(spark, x, label), "class").first().calinski_harabasz == pytest.approx(between / within)


def test_pca_ratio_and_projection(spark):
    x, label = points()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    df = frame(spark, x, label)
    got = [r.ratio for r in geometry.pca_ratio(df, [], "vec_id", 240).orderBy("component").collect()]
    assert got == pytest.approx((values / values.sum())[:2])
    p = np.array([r.projection for r in geometry.pca_project(df).orderBy("vec_id").collect()])
    assert np.abs(p.mean(0)).max() < 1e-9 and p.var(0, ddof=1) == pytest.approx(values[:2])


def test_zero_shot_and_scorer_agree(spark):
    x, label = points()
    df = frame(spark, x, label)
    protos = geometry.prototypes(df, ["class"])
    found = retrieval.winner_and_runner_up(geometry.zero_shot(df, protos, ["vec_id"], "class"), ["vec_id"])
    matrix = np.stack([r.unit for r in protos.orderBy("class").collect()])
    names = [r["class"] for r in protos.orderBy("class").collect()]
    scoring.register_scorer("cosine", lambda v: v @ matrix.T)
    predicted = scoring.predict(scoring.score_items(df, "cosine", "v", ["vec_id"]), names, ["vec_id"])
    both = found.join(predicted.withColumnRenamed("predicted_class", "other").select("vec_id", "other", F.col("margin").alias("m")), "vec_id")
    assert both.where("predicted_class <> other OR abs(margin - m) > 1e-9").count() == 0 and both.count() == 240
    shifted = scoring.score_items(df, lambda v: v[:, :2], "v", ["vec_id"], transform=lambda v: v + 1).first()
    assert len(shifted.scores) == 2
    with pytest.raises(KeyError, match="unknown scorer"):
        scoring.score_items(df, "nobody", "v", ["vec_id"])


def predictions(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 3, n)
    sides = [np.where(rng.random(n) < p, t, rng.integers(0, 3, n)) for p in (0.7, 0.6)]
    rows = [(i, f"c{a}", f"c{b}", f"c{c}") for i, (a, b, c) in enumerate(zip(t, *sides))]
    return spark.createDataFrame(rows, "item int, true_class string, left_class string, right_class string"), t, sides


def test_multinomial_bootstrap_matches_row_resampling(spark):
    df, t, (left, right) = predictions(spark)
    classes = ["c0", "c1", "c2"]
    one = df.select(F.lit("s").alias("system"), "true_class", F.col("left_class").alias("predicted_class"))
    got = bootstrap.intervals(bootstrap.bootstrap_replicates(one, ["system"], classes, 2000, 42), ["system"], ["accuracy", "macro_f1"]).first()
    rng = np.random.default_rng(0)
    draws = np.concatenate([rng.choice(np.flatnonzero(t == c), size=(2000, (t == c).sum())) for c in range(3)], axis=1)
    accuracy = (t[draws] == left[draws]).mean(1)
    assert got.accuracy_mean == pytest.approx(accuracy.mean(), abs=0.003)
    assert got.accuracy_lower == pytest.approx(np.quantile(accuracy, 0.025), abs=0.006)
    assert got.accuracy_upper == pytest.approx(np.quantile(accuracy, 0.975), abs=0.006)
    paired = bootstrap.intervals(bootstrap.paired_replicates(df, [], 2000, 42), [], ["difference"]).first()
    delta = accuracy - (t[draws] == right[draws]).mean(1)
    assert paired.difference_mean == pytest.approx(delta.mean(), abs=0.004)
    assert paired.difference_lower == pytest.approx(np.quantile(delta, 0.025), abs=0.008)
    again = bootstrap.bootstrap_replicates(one.repartition(7), ["system"], classes, 2000, 42)
    assert again.exceptAll(bootstrap.bootstrap_replicates(one, ["system"], classes, 2000, 42)).count() == 0


def test_hash_draws_keep_class_sizes(spark):
    df, t, _ = predictions(spark, 200)
    got = bootstrap.hash_draws(df, "true_class", "item", 4, 42).groupBy("true_class", "replicate").agg(F.sum("times").alias("n")).collect()
    sizes = np.bincount(t)
    assert len(got) == 12 and all(r.n == sizes[int(r.true_class[1])] for r in got)


@pytest.mark.parametrize("block_rows", [4096, 20, 3])
def test_direction_replicates_have_bootstrap_moments(spark, block_rows):
    x, label = points(300, 3)
    df = frame(spark, x, label).where("vec_id < 192").withColumn("class", F.lit("c"))  # one block, 16 and 64 blocks
    held = np.stack([r.v for r in df.collect()])
    got = np.array([r.mean for r in bootstrap.direction_replicates(df, ["class"], "vec_id", "v", 3, 1500, 1, block_rows).collect()])
    assert got.shape == (1500, 3)
    assert got.mean(0) == pytest.approx(held.mean(0), abs=0.01)
    assert got.std(0) == pytest.approx(held.std(0) / np.sqrt(len(held)), rel=0.1)


def test_block_totals_are_a_multinomial():
    sizes = np.array([5, 0, 40, 3, 7, 7, 1, 37])
    at = lambda b: np.array([sizes[(b >> (3 - k)) << (3 - k) : ((b >> (3 - k)) + 1) << (3 - k)].sum() for k in range(4)])
    totals = np.array([bootstrap.block_totals(at(b), b, 4000, 7, ["g"]) for b in range(8) if sizes[b]])
    n, p = sizes.sum(), sizes[sizes > 0] / sizes.sum()
    assert (totals.sum(axis=0) == n).all()  # blocks agree on every split
    assert totals.mean(axis=1) == pytest.approx(n * p, abs=0.5)
    assert np.cov(totals) == pytest.approx(n * (np.diag(p) - np.outer(p, p)), abs=1.5)
    assert (bootstrap.block_totals(np.array([9]), 0, 3, 7, ["g"]) == 9).all()


def test_probes_learn_separable_classes(spark):
    x, label = points(400)
    df = frame(spark, x, label).withColumn("y", probes.class_number(F.col("class"), CLASSES))
    table, model = probes.linear_probe(df.where("domain = 0"), df.where("domain <> 0"), "y", "v", [(10.0, 10), (0.001, 30)])
    chosen = table.where("selected").collect()
    assert len(chosen) == 1 and chosen[0].validation_accuracy == table.agg(F.max("validation_accuracy")).first()[0] > 0.6
    folds = probes.cross_validated_probe(df, "class", "vec_id", "v", k=3, iterations=20)
    assert sorted(r.fold for r in folds.collect()) == [0, 1, 2] and probes.fold_summary(folds).first().accuracy_mean > 0.6


@pytest.mark.parametrize("arrow", ["true", "false"])
@pytest.mark.parametrize("max_bytes", [64 << 20, 4000])
def test_label_efficiency(spark, arrow, max_bytes):
    x, label = points(400)
    df = frame(spark, x, label).withColumn("encoder", F.lit("e"))
    was = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
    try:
        train, test = df.where("domain = 0"), df.where("domain <> 0")
        test = test.unionByName(test.where("vec_id = 1").withColumn("class", F.lit("unknown")))
        fits = probes.few_shot_fits(train, "class", "vec_id", "v", CLASSES, [1, 20], [1, 2], epochs=12).cache()
        assert fits.count() == 2 * 2 * 12
        cells = probes.few_shot_cells(fits, test, "class", "v", CLASSES, max_bytes).collect()
        rows = [(r["class"], np.array(r["v"])) for r in test.collect()]
        for fit in fits.where("epoch IN (1, 12)").collect():
            w = np.array(fit["weights"]).reshape(len(CLASSES), -1)
            z = [w[:, :-1] @ v + w[:, -1] for _, v in rows]
            want_right = sum(c == CLASSES[int(s.argmax())] for (c, _), s in zip(rows, z))
            want_loss = sum(np.log(np.exp(s).sum()) - s[CLASSES.index(c)] for (c, _), s in zip(rows, z) if c in CLASSES)
            mine = [c for c in cells if all(c[k] == fit[k] for k in ("budget", "seed", "epoch"))]
            assert sum(c["n"] for c in mine) == len(rows) and sum(c["n"] for c in mine if c["true_class"] == c["predicted_class"]) == want_right
            assert sum(c["loss"] for c in mine) == pytest.approx(want_loss)
        table = {(r["budget"], r["seed"], r["epoch"]): (-r["validation_accuracy"], round(r["validation_loss"], 9), r["epoch"])
                 for r in probes.epoch_table(probes.few_shot_cells(fits, test, "class", "v", CLASSES)).collect()}
        chosen = probes.select_epochs(fits, test, "class", "v", CLASSES, max_bytes)
        assert {(r["budget"], r["seed"], r["epoch"]) for r in chosen.collect()} == {
            min((k for k in table if k[:2] == g), key=table.get) for g in {k[:2] for k in table}}
        report, total = probes.few_shot_report(chosen, test, "class", "v", CLASSES, max_bytes)
        found = total.collect()
        assert len(found) == 4 and {r["samples"] for r in found} == {len(rows)}
        mean = lambda b: np.mean([r["accuracy"] for r in found if r["budget"] == b])
        assert mean(20) > mean(1)
        stats = probes.class_draw_statistics(report, ["encoder", "budget"]).collect()
        assert all(r["draws"] == 2 for r in stats) and len(stats) == 2 * 3 * (len(CLASSES) + 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", was)


@pytest.mark.parametrize("max_bytes", [64 << 20, 1])
def test_silhouette_of_one_cluster_and_null_labels(spark, max_bytes):
    x, label = points(60)
    df = frame(spark, x, label).select("vec_id", "class", "v")
    both = geometry.silhouette_cosine(df, "vec_id", "class", max_bytes=max_bytes).first()
    with_null = df.unionByName(df.where("vec_id < 3").withColumn("class", F.lit(None).cast("string")).withColumn("vec_id", F.col("vec_id") + 1000))
    again = geometry.silhouette_cosine(with_null, "vec_id", "class", max_bytes=max_bytes).first()
    assert again["items"] == both["items"] == 60 and again["silhouette"] == pytest.approx(both["silhouette"])
    one = geometry.silhouette_cosine(df.withColumn("class", F.lit("c")), "vec_id", "class", max_bytes=max_bytes).first()
    assert (one["items"], one["clusters"], one["silhouette"]) == (60, 1, None)
    assert geometry.silhouette_cosine(df.limit(0), "vec_id", "class", max_bytes=max_bytes).first()["items"] == 0


def test_hash_sample_has_one_type(spark):
    df = spark.range(1500).withColumn("s", F.lit("x"))
    small, large = (sampling.hash_sample(df, ["s"], "id", n, 1) for n in (1000, 1001))
    assert small.schema["rank"].dataType == large.schema["rank"].dataType
    assert small.select("id", "rank").exceptAll(large.select("id", "rank")).count() == 0 and large.count() == 1001


def test_deletion_orders_and_counts(spark):
    from evidence.functions.hashing import stable_key
    from evidence.operators import attribution

    regions = spark.createDataFrame([("s", 0, 1, i, x) for i, x in enumerate([0.5, 2.0, 0.5, -1.0])], "system string, domain int, identifier int, index int, importance double")
    assert [r["index"] for r in attribution.deletion_order(regions).orderBy("order").collect()] == [1, 0, 2, 3]
    shuffled = attribution.random_order(regions, stable_key(1, F.col("index")))
    assert sorted(r.order for r in shuffled.collect()) == [1, 2, 3, 4]
    assert attribution.deletion_counts(49, [0.0, 0.1, 0.5, 1.0]) == [0, 5, 24, 49]


def test_deletion_area_is_the_trapezoid(spark):
    from evidence.operators import attribution

    f = np.linspace(0, 1, 11)
    top, rand = np.exp(-3 * f), 1 - f
    rows = [("s", 0, 1, k, float(a), float(m), -2.0) for k, ms in (("top", top), ("random", rand)) for a, m in zip(f, ms)]
    got = attribution.deletion_areas(spark.createDataFrame(rows, "system string, domain int, identifier int, kind string, fraction double, margin double, base_margin double")).first()
    assert got.top_auc == pytest.approx(np.trapezoid(top / 2, f)) and got.gap == pytest.approx(np.trapezoid((rand - top) / 2, f))


def test_region_shares_are_null_without_positive_importance(spark):
    from evidence.operators import attribution

    rows = [("s", 0, i, k, k // 3, k % 3, float(v) if i else -1.0) for i in (0, 1) for k, v in enumerate([1.0, 0, 0, 0, 3.0, 0, 0, 0, 0])]
    got = {r.identifier: r for r in attribution.region_summary(spark.createDataFrame(rows, "system string, domain int, identifier int, index int, row int, column int, importance double"), 3, 3).collect()}
    assert got[0].edge_share is None and got[1].edge_share == 0.25 and got[1].interior_share == 0.75
    assert got[1].top5_radius == pytest.approx(np.mean([0, 2**0.5, 1, 2**0.5, 1]))
