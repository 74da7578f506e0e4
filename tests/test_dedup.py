import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence.operators import dedup, gates


def near_signatures(seed=0, base=120, copies=4, flips=7):
    """Random signatures with neighbours at 0 to ``flips`` bits."""
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(base):
        h = int(rng.integers(0, 1 << 62)) | int(rng.integers(0, 2)) << 62
        out.add(h)
        for _ in range(copies):
            x = h
            for i in rng.choice(63, size=rng.integers(0, flips + 1), replace=False):
                x ^= 1 << int(i)
            out.add(x)
    return sorted(out)


def frame(spark, hs):
    return spark.createDataFrame([(h,) for h in hs], "h bigint")


def brute(left, right, t):
    same = left is right
    return sorted((a, b, bin(a ^ b).count("1")) for a in left for b in right if (not same or a < b) and bin(a ^ b).count("1") <= t)


@pytest.mark.parametrize("blocks, hot", [(7, 4096), (8, 4096), (9, 4096), (7, 2), (8, 3)])
def test_signature_pairs_equal_brute_force(spark, rows, blocks, hot):
    hs = near_signatures()
    got = rows(dedup.signature_pairs(frame(spark, hs), None, 6, blocks=blocks, hot=hot))
    assert got == brute(hs, hs, 6)


@pytest.mark.parametrize("hot", [4096, 2])
def test_signature_pairs_across(spark, rows, hot):
    hs = near_signatures(5)
    left, right = hs[::2], hs[1::2] + hs[:20:2]
    got = rows(dedup.signature_pairs(frame(spark, left), frame(spark, right), 6, hot=hot))
    assert got == brute(left, right, 6)


def test_crowded_buckets_that_share_most_bits(spark, rows):
    """Members that agree on half of the signature meet on the other half."""
    rng = np.random.default_rng(4)
    hs = {int(x) for x in rng.integers(0, 1 << 31, 300)}
    hs |= {h ^ (1 << int(rng.integers(0, 31))) ^ (1 << int(rng.integers(31, 63))) for h in list(hs)[:60]}
    hs = sorted(hs)
    assert rows(dedup.signature_pairs(frame(spark, hs), None, 6, blocks=8, hot=20)) == brute(hs, hs, 6)
    ones = np.array([sum(h >> i & 1 for h in hs) for i in range(63)])
    masks = dedup._informed_masks(len(hs), ones, 6)
    largest = max(max(np.unique([h & m for h in hs], return_counts=True)[1]) for m in masks)
    assert largest < len(hs) / 3


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_rows_by_mask_do_not_pass_through_the_driver(spark):
    """The planner takes a table of a few MB that becomes 28 rows a signature for one that may be sent to all tasks."""
    hs = near_signatures()
    items = frame(spark, hs).selectExpr("h", "h % 5 AS file_hash", "h % 7 AS content_hash")
    left, right = items.where("h % 2 = 0"), items.where("h % 2 = 1")
    assert "BroadcastHashJoin" not in plan(dedup.signature_pairs(left, right, 6, blocks=8))
    assert "BroadcastHashJoin" not in plan(dedup.near_matches(left, right, 6, blocks=8))
    assert "BroadcastHashJoin" not in plan(dedup.near_matches_within(items, 6, ["file_hash", "content_hash"], blocks=8))


def test_block_count_grows_with_the_data():
    assert [dedup.block_count(n, 6) for n in (1000, 10**6, 10**8, 10**12)] == [7, 8, 9, 10]


def copies(spark):
    """A third of all items share one content; some contents share a signature."""
    return spark.range(90).select(
        F.col("id").alias("item"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("content_hash"),
    ).select("item", F.col("content_hash").alias("file_hash"), "content_hash",
             F.when(F.col("content_hash") == "same", 7).otherwise(F.when(F.col("item") < 10, 7).otherwise(F.col("item") * 1_000_003 * 65_537)).cast("bigint").alias("h"))


def test_hot_copies_stay_one_row(spark):
    items = copies(spark)
    got = dedup.near_matches_within(items, 6, ["file_hash", "content_hash"]).collect()
    data = items.toPandas()
    pairs = {}
    for i in range(90):
        for j in range(i):
            a, b = data.iloc[i], data.iloc[j]
            d = bin(int(a.h) ^ int(b.h)).count("1")
            if a.file_hash != b.file_hash and a.content_hash != b.content_hash and d <= 6:
                key = (*sorted((int(a.h), int(b.h))), d)
                pairs[key] = pairs.get(key, 0) + 1
    assert {(r.left_h, r.right_h, r.distance): r.item_pairs for r in got} == pairs
    group = dedup.duplicate_groups(items, "content_hash", "item").collect()
    assert [(r.content_hash, r.n, r["first"]) for r in group] == [("same", 30, 0)]
    row = dedup.secondary_fraction(items, "item", ["file_hash", "content_hash"]).first()
    assert (row.secondary, row.severe) == (29, True)


def test_near_matches_count_item_pairs_and_expand(spark, rows):
    left = spark.createDataFrame([(1, 0), (2, 0), (3, 255)], "item int, h bigint")
    right = spark.createDataFrame([(10, 1), (11, 0)], "item int, h bigint")
    got = dedup.near_matches(left, right, 6)
    assert rows(got, "left_h", "right_h", "distance", "item_pairs") == [(0, 0, 0, 2), (0, 1, 1, 2)]
    assert rows(dedup.expand_pairs(got, left, right, "item")) == [(1, 10, 1), (1, 11, 0), (2, 10, 1), (2, 11, 0)]


def test_exclusion_and_order(spark, rows):
    external = spark.createDataFrame([(1, "a", "x", "p"), (2, "b", "y", "q"), (3, "c", "z", "p")], "item int, f string, c string, cls string")
    source = spark.createDataFrame([("a", "n"), ("m", "y")], "f string, c string")
    out = dedup.contaminated(external, source, ["f", "c"], "item")
    assert rows(out) == [(1,), (2,)]
    assert rows(dedup.exclude(external, out, "item"), "item") == [(3,)]
    ordered = dedup.freeze_order(external.withColumn("profile", F.lit(1)), "cls", "item", ["q", "p"])
    assert [r.item for r in ordered.collect()] == [2, 1, 3] and "profile" not in ordered.columns


def test_reconcile_and_gate(spark):
    c = spark.createDataFrame([(1, 2, 3), (1, 3, 4)], "a int, b int, d int")
    assert dedup.reconcile(c, c, ["a", "b", "d"]).first().status == "PASS_REVIEW_COMPLETE"
    half = dedup.reconcile(c, c.where("b = 2").unionAll(spark.createDataFrame([(9, 9, 9)], "a int, b int, d int")), ["a", "b", "d"]).first()
    assert (half.matched, half.unreviewed, half.stale, half.status) == (1, 1, 1, "REVIEW_INCOMPLETE")
    row = spark.range(1).select(*dedup.gate(F.lit(0), F.lit(True), F.lit(0))).first()
    assert tuple(row) == ("BLOCKED_SEVERE_DUPLICATION", "PASS_NO_CANDIDATES")


def test_embedding_checks_find_each_fault(spark):
    good = [1.0, 0.0]
    data = [(1, good, 0), (1, good, 1), (2, [1.0], 0), (3, [float("nan"), 1.0], 0), (4, [2.0, 0.0], 9)]
    found = {r["check"]: r.violations for r in gates.embedding_checks(
        spark.createDataFrame(data, "id int, v array<double>, y int"), "id", "v", "y", 2, 2).collect()}
    assert found == {"dimension": 1, "finite": 1, "unit_norm": 2, "label_range": 1, "missing_id": 0, "repeated_id": 1}


def test_ledger_states(spark, rows):
    planned = spark.createDataFrame([("s", 1), ("s", 2)], "s string, i int")
    assert rows(gates.remaining(planned, planned.where("i = 1"), ["s", "i"])) == [("s", 2)]
    status = lambda done: gates.ledger_verdict(planned, done, ["s", "i"]).first().status
    assert [status(planned.where("i = 1")), status(planned), status(planned.unionAll(planned.where("i = 1")))] == ["PARTIAL", "COMPLETE", "OVERRUN"]


def test_registry_states(spark, rows):
    recorded = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    actual = spark.createDataFrame([("a", "1"), ("b", "X"), ("d", "4")], "path string, sha256 string")
    checked = gates.registry_check(recorded, actual)
    assert rows(checked) == [("a", "OK"), ("b", "CHANGED"), ("c", "MISSING"), ("d", "UNREGISTERED")]
    verdict = gates.registry_verdict(checked).first()
    assert (verdict.registered, verdict.broken, verdict.status) == (3, 2, "FAIL")


def test_file_validity_order(spark):
    cases = [(0, "txt", False, "zero_byte"), (5, "txt", False, "unexpected_extension"), (5, "PNG", False, "decode_failure"), (5, "png", True, "ok")]
    df = spark.createDataFrame(cases, "n int, e string, d boolean, want string")
    got = df.select((gates.file_validity(F.col("n"), F.col("e"), F.col("d"), ["png"]) == F.col("want")).alias("ok")).collect()
    assert all(r.ok for r in got)
