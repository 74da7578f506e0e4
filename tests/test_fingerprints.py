"""Fingerprints of tables against row by row comparison."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidence.operators import fingerprints

SCHEMA = "k long, name string, x double, v array<int>, s struct<a:string,b:string>"
NAMES = ["k", "name", "x", "v", "s"]
ROWS = [(i, None if i % 7 == 0 else f"n{i % 5}", i / 3, [i, None] if i % 2 else [i], (None, "b") if i % 3 else ("b", None)) for i in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(row):
    return tuple(tuple(x) if isinstance(x, (list, tuple)) else x for x in row)


def compared(spark, left, right, **options):
    found = fingerprints.differing_rows(frame(spark, left), frame(spark, right), NAMES, **options).collect()
    return Counter((plain(r[:-1]), r["side"]) for r in found)


def expected(left, right):
    a, b = Counter(map(plain, left)), Counter(map(plain, right))
    return Counter({(r, "left_only"): n for r, n in (a - b).items()} | {(r, "right_only"): n for r, n in (b - a).items()})


def test_order_and_partitions_do_not_matter(spark):
    one, other = frame(spark, ROWS), frame(spark, ROWS[::-1]).repartition(13)
    a, b = (sorted(map(tuple, fingerprints.fingerprints(x, NAMES, 4).collect())) for x in (one, other))
    assert a == b and len(a) == 16 and sum(r[1] for r in a) == len(ROWS)
    assert fingerprints.equality(one, other, NAMES).first().status == "EQUAL"


@pytest.mark.parametrize("options", [{}, {"levels": (4, 8, 12), "rows": 0}, {"levels": (2,), "rows": 0}])
def test_differences_equal_brute_force(spark, options):
    changed = [r for r in ROWS if r[0] != 11] + [ROWS[4], ROWS[4], (9000, None, None, None, None)]
    changed[20] = (*changed[20][:1], None, *changed[20][2:])
    changed[33] = (*changed[33][:3], [33], *changed[33][4:])
    assert compared(spark, ROWS, changed, **options) == expected(ROWS, changed)


@pytest.mark.parametrize("one, other", [
    ((1, None, 1.0, [1], ("a", None)), (1, None, 1.0, [1], (None, "a"))), ((1, "", 1.0, [], None), (1, None, 1.0, [], None)),
    ((1, "a", 1.0, [1, None], None), (1, "a", 1.0, [1], None)), ((1, "a", 1.0, [], None), (1, "a", 1.0, None, None)),
    ((1, "a", 1.0, [1], (None, None)), (1, "a", 1.0, [1], None)), ((1, "a", 0.0, None, None), (1, "a", None, None, None)),
])
def test_one_value_tells_rows_apart(spark, one, other):
    assert fingerprints.equality(frame(spark, [one]), frame(spark, [other]), NAMES).first().status == "DIFFERENT"
    assert fingerprints.equality(frame(spark, [one, one, other]), frame(spark, [one, other, other]), NAMES).first().status == "DIFFERENT"


def test_empty_tables_signs_of_zero_and_maps(spark):
    none, zero = frame(spark, []), frame(spark, [(1, "a", 0.0, None, None)])
    assert tuple(fingerprints.equality(none, none, NAMES).first()) == (0, 0, "EQUAL")
    assert fingerprints.equality(none, zero, NAMES).first().status == "DIFFERENT"
    assert fingerprints.equality(frame(spark, [(1, "a", -0.0, None, None)]), zero, NAMES).first().status == "EQUAL"
    assert compared(spark, [], []) == Counter() and compared(spark, [], ROWS[:1]) == expected([], ROWS[:1])
    with pytest.raises(TypeError, match="maps"):
        fingerprints.fingerprints(spark.sql("SELECT map(1, 2) AS m"), ["m"])


def test_only_rows_of_unequal_branches_are_compared(spark, monkeypatch):
    seen = []
    compare = fingerprints.multiset_difference
    monkeypatch.setattr(fingerprints, "multiset_difference", lambda l, r: seen.append((l.count(), r.count())) or compare(l, r))
    base = spark.range(200_000).select("id", (F.col("id") % 11).alias("m"))
    other = base.withColumn("m", F.when(F.col("id") == 777, 99).otherwise(F.col("m")))
    found = fingerprints.differing_rows(base, other, ["id", "m"]).collect()
    assert sorted(map(tuple, found)) == [(777, 7, "left_only"), (777, 99, "right_only")] and max(seen[0]) < 400
    assert fingerprints.differing_rows(base, base.orderBy(F.desc("id")), ["id", "m"]).count() == 0 and seen[1] == (0, 0)
