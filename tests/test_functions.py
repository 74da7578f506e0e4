import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence.functions import grids, hashing, labels, signatures, vectors


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_stable_key_and_number(spark):
    row = one(spark, a="x", b=7).select(hashing.stable_key(42, F.col("a"), F.col("b")).alias("k")).withColumn("n", hashing.hash_number(F.col("k"))).first()
    want = hashlib.sha256(b"42|x|7").hexdigest()
    assert (row.k, row.n) == (want, int(want[:8], 16))


def test_label_factors(spark):
    row = one(spark, c="bad_red_apple").select(labels.label_factors(F.col("c")).alias("f")).first().f
    assert (row.factor_a, row.factor_b, row.display) == ("bad", "red_apple", "Bad Red Apple")
    with pytest.raises(Exception, match="label without two factors"):
        one(spark, c="plain").select(labels.label_factors(F.col("c"))).collect()


@pytest.mark.parametrize("true, predicted, want", [
    ("a_x", "a_x", None), ("a_x", "b_x", "condition_error"), ("a_x", "a_y", "identity_error"), ("a_x", "b_y", "combined_error")])
def test_error_category(spark, true, predicted, want):
    assert one(spark, t=true, p=predicted).select(labels.error_category(F.col("t"), F.col("p"))).first()[0] == want


def test_canonical_class_drops_unmapped(spark):
    df = spark.createDataFrame([("F1",), ("Zz",)], "folder string")
    assert [r["class"] for r in labels.canonical_class(df, "folder", {"F1": "fresh_x"}).collect()] == ["fresh_x"]


@pytest.mark.parametrize("scores, want", [
    ([0.1, 0.7, 0.2], (1, 2, 0.7, 0.2)), ([0.5, 0.5, 0.1], (0, 1, 0.5, 0.5)), ([0.1, 0.4, 0.4], (1, 2, 0.4, 0.4)), ([-3.0, -1.0], (1, 0, -1.0, -3.0))])
def test_top2(spark, scores, want):
    t = one(spark, s=scores).select(vectors.top2("s").alias("t")).first().t
    assert (t.predicted, t.runner_up, t.best, t.second) == want
    assert t.margin == pytest.approx(want[2] - want[3])


def test_scaling_keeps_or_breaks_ranks(spark):
    df = one(spark, s=[0.3, 0.9, 0.5]).withColumn("up", vectors.scaled_logits(F.col("s"), 100.0, 3.0)).withColumn("down", vectors.scaled_logits(F.col("s"), -1))
    assert tuple(df.select(vectors.rank_changed("s", "up"), vectors.rank_changed("s", "down")).first()) == (False, True)


def test_target_margin_and_cross_entropy(spark):
    s = [1.0, 3.0, 2.0]
    row = one(spark, s=s).select(vectors.target_margin(F.col("s"), F.lit(2)).alias("m"), vectors.cross_entropy(F.col("s"), F.lit(2)).alias("l")).first()
    assert row.m == -1.0
    assert row.l == pytest.approx(math.log(sum(math.exp(x) for x in s)) - 2.0)


def test_normalize(spark):
    row = one(spark, v=[3.0, 4.0], z=[0.0, 0.0]).select(vectors.l2_normalize(F.col("v")).alias("v"), vectors.l2_normalize(F.col("z")).alias("z")).first()
    assert row.v == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0]


def test_grid_regions(spark):
    cells = one(spark, h=100, w=70).select(F.explode(grids.grid_regions(F.col("h"), F.col("w"), 7, 7)).alias("c")).select("c.*").collect()
    ys, xs = np.linspace(0, 100, 8, dtype=int), np.linspace(0, 70, 8, dtype=int)
    assert [(c.y0, c.y1, c.x0, c.x1) for c in cells] == [(ys[i], ys[i + 1], xs[j], xs[j + 1]) for i in range(7) for j in range(7)]


def test_signature_from_coefficients(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=64)
    low = values[1:]
    want = int("".join("1" if x > np.median(low) else "0" for x in low), 2)
    df = one(spark, v=values.tolist()).select(signatures.signature_from_coefficients(F.col("v")).alias("h"))
    row = df.select("h", signatures.signature_hex(F.col("h")).alias("x"), F.bit_count("h").alias("ones")).first()
    assert (row.h, row.x, row.ones) == (want, f"{want:016x}", 31)


def test_token_signature_matches_plain_python(spark):
    texts = ["The cat sat, the CAT ran", "", "x y z x", "one two three four five six seven"]

    def plain(text):
        words = dict.fromkeys(__import__("re").findall(r"[a-z0-9_]+", text.lower()))
        votes = [0] * 63
        for w in words:
            t = int(hashlib.sha256(w.encode()).hexdigest()[:16], 16)
            for i in range(63):
                votes[i] += 1 if t >> i & 1 else -1
        return sum(1 << i for i, v in enumerate(votes) if v > 0)

    df = signatures.token_signatures(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], "text")
    assert {r.id: r.h for r in df.collect()} == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("threshold, blocks", [(6, 7), (6, 8), (6, 9), (2, 5)])
def test_block_masks_lose_no_pair(threshold, blocks):
    masks = signatures.block_masks(threshold, blocks)
    rng = np.random.default_rng(0)
    for _ in range(300):
        flips = rng.choice(63, size=threshold, replace=False)
        x = sum(1 << int(i) for i in flips)
        assert any(x & m == 0 for m in masks)
