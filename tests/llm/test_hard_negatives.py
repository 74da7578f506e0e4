"""Packed products and hard negatives against brute force; the SQL twin is compared in test_tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, v string, q string, positives string"


def plain(rows, every=2, positives=5, negatives=3):
    """Brute force with Python integers; rows are (id, label, vector)."""
    seen = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = tuple(int(np.floor(256 * c)) for c in x)
        seen[i] = min(seen.get(i, (label, v)), (label, v))
    out = set()
    for a, (label, x) in seen.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for i, (other, y) in seen.items() if i != a)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fit = [r for r in scored if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit[:negatives])}
    return out


def mined(spark, rows, every=2, **more):
    df = spark.createDataFrame([(i, x, label, "v", "q", "p") for i, label, x in rows], SCHEMA)
    vectors = hn.labelled_vectors(df, "vec_id", "embedding", "label")
    got = hn.mine(vectors, F.expr(f"vec_id % {every} = 0"), **more)
    found = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("largest", [1, 300, 2**20, 2**26, 2**40])
def test_packed_products_are_exact(largest):
    draw = np.random.default_rng(largest)
    a, c = (draw.integers(-largest, largest + 1, (n, 9)) for n in (5, 23))
    packed = hn.Packed(c, int(a.max() - a.min()))
    assert packed.fields > 1 or largest >= 2**20
    want = np.array([[sum(int(p) * int(q) for p, q in zip(x, y)) for y in c] for x in a], object)
    assert (packed.scores(a).astype(object) == want).all()


def test_several_candidates_share_a_word():
    small = hn.Packed(np.arange(-32, 32).reshape(16, 4), 63)
    assert small.fields >= 4 and small.words.shape == (4, -(-16 // small.fields))


@pytest.mark.parametrize("blocks", [{}, {"candidates": 7, "anchors": 3}])
def test_equals_brute_force(spark, blocks):
    draw = np.random.default_rng(3)
    rows = [(int(i), int(draw.integers(3)), [round(float(x), 1) for x in draw.normal(0.4, 0.5, 4)]) for i in range(60)]
    rows += [(i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(60, 90)]  # equal vectors under several labels
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows, **blocks) == want


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 1.0]), (0, 1, [1.0, 0.5]), (2, 1, [1.0, 0.9, 5.0]), (3, 2, [0.8]), (4, 2, [0.7, 0.1]), (5, None, [1.0, 1.0]), (6, 1, None),
        (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [None, 1.0]), (None, 2, [1.0, 1.0]), (10, 3, []), (11, 2, [1e9, 0.0]), (12, 1, [0.0, 0.0]),
        (14, 1, [-1.0, 0.0]), (15, 2, [-0.6, 0.0]),
    ]
    assert mined(spark, rows) == plain(rows) != set()
    assert mined(spark, []) == set()
    assert mined(spark, rows, every=1000) == plain(rows, every=1000)
    assert mined(spark, [(0, 1, [1.0]), (1, 2, [0.7])]) == set()  # no positive
