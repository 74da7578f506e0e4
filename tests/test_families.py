"""Families by components against union-find, and splits that keep rows without a family."""

import random

import pytest
from pyspark.sql import functions as F

from evidence.operators import families, sampling


def plain(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


SHAPES = {
    "random": [(random.Random(i).randrange(300), random.Random(-i - 1).randrange(300)) for i in range(220)],
    "chain": [(i, i + 1) for i in range(100)],
    "star": [(50, i) for i in range(120) if i != 50],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3), (9, 4), (4, 9)],
    "none": [],
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_components_equal_union_find(spark, shape):
    links = SHAPES[shape]
    found = families.components(spark.createDataFrame(links, "a long, b long").repartition(3))
    want = plain(300, links)
    touched = {i for a, b in links if a != b for i in (a, b)}
    assert {r["id"]: r["root"] for r in found.collect()} == {i: want[i] for i in touched} and found.count() == len(touched)


def test_near_families(spark):
    draw = random.Random(3)
    rows = []
    for i in range(150):
        near = draw.choice([0, 0, 1]) and rows
        h = draw.choice(rows)[3] ^ (1 << draw.randrange(63)) ^ (1 << draw.randrange(63)) if near else draw.getrandbits(62)
        rows.append((i, draw.choice([None, "hot", f"f{draw.randrange(400)}"]) if i % 4 == 0 else f"x{i}", None if i % 5 == 0 else f"c{draw.randrange(900)}", h))
    rows[7], rows[9] = (7, None, None, None), (9, None, None, None)
    links = [
        (a, b) for a, fa, ca, ha in rows for b, fb, cb, hb in rows if a < b
        and (fa is not None and fa == fb or ca is not None and ca == cb or None not in (ha, hb) and (ha ^ hb).bit_count() <= 4)
    ]
    df = spark.createDataFrame(rows, "item long, f string, c string, h long").withColumn("extra", F.lit(1))
    got = families.near_families(df, "item", ["f", "c"], "h", 4)
    assert got.columns == [*df.columns, "family"]
    assert {r["item"]: r["family"] for r in got.collect()} == dict(enumerate(plain(150, links)))
    assert families.near_families(df.limit(0), "item", ["f", "c"], "h", 4).count() == 0


def test_group_split_keeps_rows_without_a_family_or_flag(spark):
    rows = [(i, None if i % 7 == 0 else f"f{i % 40}", None if i % 31 == 0 else i % 40 < 4) for i in range(400)]
    df = spark.createDataFrame(rows, "item long, family string, is_test boolean")
    got = {r["item"]: r["split"] for r in sampling.group_split(df, "family", "is_test", 42).collect()}
    touched = {f for _, f, t in rows if t and f}
    for i, f, t in rows:
        if t:
            assert got[i] == "test"
        elif f in touched:
            assert i not in got  # related to test rows
        else:
            assert got[i] in ("train", "validation")
    alone = [got[i] for i, f, t in rows if f is None and not t]
    assert len(alone) > 40 and {"train", "validation"} == set(alone)
    assert sampling.group_split(df.limit(0), "family", "is_test", 42).count() == 0


def test_families_and_splits_do_not_pass_through_the_driver(spark):
    items = spark.createDataFrame([(i, i % 7, i % 11, i << 3) for i in range(60)], "item_id long, first long, second long, h long")
    found = families.near_families(items, "item_id", ["first", "second"], "h", 6)
    split = sampling.group_split(found.selectExpr("item_id", "family", "item_id % 3 = 0 AS is_test"), "family", "is_test", 42)
    joined = [line for line in split._jdf.queryExecution().sparkPlan().toString().splitlines() if "HashJoin" in line]
    assert not [line for line in joined if "item_id" in line or "[_family" in line]
