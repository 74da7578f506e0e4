"""Neighbour search over pivot cells: equal to brute force, with counted visits."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidence.operators import retrieval
from tests.parity import connect, differences

FOLDER = "/root/testdata/sf0.001"


def table(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, vectors)], "id long, v array<double>")


def brute(q_ids, queries, g_ids, gallery, k):
    out = set()
    for i, v in zip(q_ids, queries):
        order = sorted(zip([round(float(v @ g), retrieval.DIGITS) for g in gallery], g_ids), key=lambda x: (-x[0], x[1]))[:k]
        out |= {(int(i), r + 1, int(n)) for r, (_, n) in enumerate(order)}
    return out


def search(monkeypatch, queries, gallery, k, **more):
    """Found rows, and for each round the (query, cell, part) that were visited."""
    seen, plain = [], retrieval.visits

    def counted(rows, vec, cells, k):
        out = plain(rows, vec, cells, k)
        seen.append({(r["id"], r["_cell"], r["_part"]) for r in out.collect()})
        return out

    monkeypatch.setattr(retrieval, "visits", counted)
    found = retrieval.nearest(queries, gallery, "id", "id", "v", k, max_bytes=0, **more)
    return {(r["id"], r["rank"], r["neighbour"]) for r in found.collect()}, seen


@pytest.mark.parametrize("unit", [True, False])
def test_clusters_are_skipped(spark, monkeypatch, unit):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(30, 16))
    vectors = np.repeat(centres, 40, axis=0) + draw.normal(scale=0.05, size=(1200, 16))
    vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None] * (1 if unit else draw.uniform(0.5, 3, (1200, 1)))
    ids = np.arange(1200)
    asked = ids[::11]
    got, seen = search(monkeypatch, table(spark, asked, vectors[asked]), table(spark, ids, vectors), 10, cell_rows=12, block_rows=30)
    assert got == brute(asked, vectors[asked], ids, vectors, 10)
    cells = 100
    copies = sum(map(len, seen))
    assert not seen[0] & seen[1] and {q for q, _, _ in seen[0]} == set(asked.tolist())
    assert copies < (0.3 if unit else 0.8) * cells * len(asked)


def test_one_vector_shared_by_a_third(spark, monkeypatch):
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(300, 4))
    vectors[::3] = vectors[0]
    vectors[5] = 0
    ids = np.arange(300)[::-1]
    got, seen = search(monkeypatch, table(spark, ids, vectors), table(spark, ids, vectors), 7, cell_rows=60, block_rows=20)
    assert got == brute(ids, vectors, ids, vectors, 7)
    assert max(p for _, _, p in seen[0] | seen[1]) >= 4  # the cell of the shared vector has several parts


def test_few_rows_and_none(spark, monkeypatch):
    ids, vectors = np.arange(3), np.eye(3)
    got, _ = search(monkeypatch, table(spark, ids, vectors), table(spark, ids, vectors), 10, cell_rows=1)
    assert got == brute(ids, vectors, ids, vectors, 10) and len(got) == 9
    none = table(spark, [], [])
    assert retrieval.nearest(none, table(spark, ids, vectors), "id", "id", "v", 2, max_bytes=0).count() == 0
    assert retrieval.nearest(table(spark, ids, vectors), none, "id", "id", "v", 2, max_bytes=0).count() == 0


@pytest.mark.parametrize("name", ["knn_topk", "zero_shot_top2"])
def test_queries_are_equal_without_the_small_path(spark, monkeypatch, name):
    plain = retrieval.nearest
    from evidence.operators import geometry

    forced = lambda *a, **o: plain(*a, **(o | {"max_bytes": 0, "cell_rows": 16, "block_rows": 40}))
    monkeypatch.setattr(retrieval, "nearest", forced)
    monkeypatch.setattr(geometry, "nearest", forced)
    assert differences(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) == []


def test_search_holds_one_tile_of_products():
    """Memory of a task must not follow the product of its queries and gallery rows; ties go to the first rows."""
    rng = np.random.default_rng(5)
    gallery = rng.integers(-3, 4, (9_000, 8)).astype(float)
    queries = rng.integers(-3, 4, (3_000, 8)).astype(float)
    tracemalloc.start()
    who, rows, sims = retrieval._search(queries, gallery, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # the products alone are 216 MB, 197 MB of them in one block before
    for q in range(0, 3_000, 300):
        want = np.argsort(-np.round(queries[q] @ gallery.T, retrieval.DIGITS), kind="stable")[:10]
        assert rows[who == q].tolist() == want.tolist()
        assert np.allclose(sims[who == q], queries[q] @ gallery[want].T)
