"""Exact, equivalent and near duplicates, inside one dataset and across two.

Nothing here lists the pairs of a group: a digest or signature shared by a third of all rows
stays one row with a count. :func:`expand_pairs` turns chosen signature pairs into
item pairs for a review.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evidence.functions.signatures import BITS, block_keys, block_masks, first_block, hamming
from evidence.operators.scale import BROADCAST_ROWS, stored


# --- exact and equivalent duplicates ----------------------------------------------------


def duplicate_groups(items: DataFrame, digest: str, item: str) -> DataFrame:
    """One row per digest shared by several items: (digest, n, first)."""
    return (
        items.groupBy(digest)
        .agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first"))
        .where(F.col("n") > 1)
    )


def duplicate_members(items: DataFrame, digest: str, item: str) -> DataFrame:
    """The items of every duplicate group, one row each (sort by digest and item to read them)."""
    groups = duplicate_groups(items, digest, item)
    return items.select(digest, item).join(groups, digest).select(digest, item, "n", (F.col(item) == F.col("first")).alias("is_first"))


def secondary_fraction(items: DataFrame, item: str, digests: list[str], severe: float = 0.10) -> DataFrame:
    """Share of items that are not the first of their group under some digest.

    The first items of each digest are few compared with hot groups and unique, so they are
    intersected instead of joining groups back to rows.
    """
    firsts = None
    for d in digests:
        one = items.groupBy(d).agg(F.min(item).alias(item)).select(item)
        firsts = one if firsts is None else firsts.join(one, item, "left_semi")
    kept = firsts.agg(F.count(F.lit(1)).alias("primary"))
    total = items.agg(F.count(F.lit(1)).alias("items"))
    both = total.select("items", kept.scalar().alias("primary"))
    share = F.coalesce(F.try_divide((F.col("items") - F.col("primary")).cast("double"), F.col("items").cast("double")), F.lit(0.0))
    return both.select(
        "items", (F.col("items") - F.col("primary")).alias("secondary"), share.alias("fraction"), (share > severe).alias("severe")
    )


def hash_matches(left: DataFrame, right: DataFrame, digest: str, item: str) -> DataFrame:
    """Digests found on both sides with the items on each: (digest, left_items, right_items, first…)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(digest).agg(F.count(F.lit(1)).alias(f"{name}_items"), F.min(item).alias(f"{name}_first"))

    return side(left, "left").join(side(right, "right"), digest).withColumn(
        "item_pairs", F.col("left_items") * F.col("right_items")
    )


def contaminated(external: DataFrame, source: DataFrame, digests: list[str], item: str) -> DataFrame:
    """Distinct external items that share any digest with the source."""
    hits = None
    for d in digests:
        one = external.join(source.select(d).distinct(), d, "left_semi").select(item)
        hits = one if hits is None else hits.union(one)
    return hits.distinct()


def exclude(items: DataFrame, excluded: DataFrame, item: str) -> DataFrame:
    return items.join(excluded, item, "left_anti")


def freeze_order(items: DataFrame, cls: str, item: str, classes: list[str], drop: list[str] = ["profile"]) -> DataFrame:
    """Manifest rows without the given columns, sorted by class order and item."""
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(cls))
    kept = [c for c in items.columns if c not in drop]
    return items.select(*kept).orderBy(order, item)


# --- near duplicates --------------------------------------------------------------------


def block_count(signatures: int, threshold: int, most: int = 256) -> int:
    """Blocks so that a bucket of evenly spread signatures holds some 64 of them, with at most
    ``most`` keys per signature."""
    best = threshold + 1
    for blocks in range(threshold + 1, BITS + 1):
        if comb(blocks, threshold) > most:
            break
        best = blocks
        if 2 ** (BITS * (blocks - threshold) / blocks) * 64 >= signatures:
            break
    return best


def _informed_masks(n: int, ones: np.ndarray, threshold: int, most: int = 84) -> list[int]:
    """Masks for one crowded bucket of n signatures, from how many of them have each bit.

    The bits are cut into blocks of equal information (a bit all members share has none), so
    members spread over the keys of every mask although they agree on much of the signature.
    """
    share = ones / n
    information = -np.log2(share**2 + (1 - share) ** 2)
    total = information.sum()
    for blocks in range(threshold + 1, BITS + 1):
        if comb(blocks + 1, threshold) > most or total * (blocks - threshold) / blocks >= np.log2(n / 64):
            break
    before = np.concatenate([[0.0], np.cumsum(information)[:-1]])
    place = np.minimum((before / max(total, 1e-9) * blocks + 1e-9).astype(int), blocks - 1)
    parts = [sum(1 << i for i in range(BITS) if place[i] == b) for b in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - threshold)]


#: Members up to which a bucket is compared pair by pair, whatever the size of the tables.
CROWD = 4096


def _crowded(members: DataFrame, keys: list[str], limit: int, threshold: int) -> DataFrame:
    """(keys…, inner): the buckets with more than ``limit`` members and masks made for those members."""
    heavy = _sent(stored(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)))
    # two bit counts to a sum, as in the token signatures
    ones = [F.expr(f"sum(((h >> {i}) & 1L) | (((h >> {i}) & 2L) << 31))").alias(f"s{i}") for i in range(0, BITS, 2)]
    counted = members.join(heavy, keys).groupBy(*keys, "n").agg(*ones)

    def masks(batches):
        for pdf in batches:
            sums = pdf[[f"s{i}" for i in range(0, BITS, 2)]].to_numpy(dtype=np.int64)
            ones = np.stack([sums & 0xFFFFFFFF, sums >> 32], axis=2).reshape(len(pdf), -1)[:, :BITS]
            inner = [_informed_masks(int(n), o, threshold) for n, o in zip(pdf["n"], ones)]
            yield pdf[[*keys, "n"]].assign(inner=inner)

    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return counted.mapInPandas(masks, f"{schema}, n bigint, inner array<bigint>")


def _sent(table: DataFrame) -> DataFrame:
    """A stored table of buckets, sent to all tasks only if its counted rows (under 1 KB each) stay below the bound."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS // 2 else table.hint("merge")


def _cut(members: DataFrame, crowded: DataFrame, keys: list[str], sub: str, rest: str) -> DataFrame:
    """Members with a row for every mask of their bucket; (-1, 0) where the bucket is not crowded."""
    pieces = F.expr(
        f"IF(inner IS NULL, array(named_struct('{sub}', -1, '{rest}', 0L)),"
        f" transform(inner, (m, i) -> named_struct('{sub}', i, '{rest}', h & m)))"
    )
    marked = members.join(crowded.drop("n"), keys, "left")
    return marked.select(*members.columns, F.explode(pieces).alias("_c")).select(*members.columns, f"_c.{sub}", f"_c.{rest}")


def signature_pairs(
    left: DataFrame, right: DataFrame | None, threshold: int, blocks: int | None = None, hot: int = CROWD
) -> DataFrame:
    """All pairs of distinct signatures within ``threshold`` bits: (left_h, right_h, distance).

    ``left`` and ``right`` have one row per signature ``h``; without ``right`` the pairs lie
    inside ``left`` with left_h < right_h. Signatures meet on equal blocks (exact by the pigeonhole
    rule), and each pair is kept only in the first block it agrees on. A bucket with more
    than ``hot`` members, a fixed number, is cut by masks made for its members, exact by the same
    rule, and what is still crowded is cut again until no bucket is, or until a cut parts nothing.
    """
    itself = right is None
    lefts = stored(left.select("h"))
    rights = lefts if itself else stored(right.select("h"))
    rows = lefts.count() + (0 if itself else rights.count())
    masks = block_masks(threshold, blocks or block_count(rows, threshold))
    sides = lefts.withColumn("side", F.lit(0)) if itself else lefts.withColumn("side", F.lit(0)).unionAll(rights.withColumn("side", F.lit(1)))
    top, second = ["block", "key"], ["block", "key", "sub", "rest"]
    everyone = sides.select("h", "side", F.explode(block_keys("h", masks)).alias("b")).select("h", "side", "b.block", "b.key")
    found_crowded = stored(_crowded(everyone, top, hot, threshold))

    def close(members: DataFrame, keys: list[str]) -> DataFrame:
        """Near pairs that share a bucket, each in the first block it agrees on."""
        a = members.where("side = 0").select(F.col("h").alias("left_h"), *keys)
        b = members.where(f"side = {0 if itself else 1}").select(F.col("h").alias("right_h"), *keys)
        # the planner sizes a table before it is exploded to one row a mask, and would send the whole of it by the driver
        found = a.join(b.hint("merge"), keys)
        if itself:
            found = found.where(F.col("left_h") < F.col("right_h"))
        near = found.withColumn("distance", hamming(F.col("left_h"), F.col("right_h"))).where(F.col("distance") <= threshold)
        return near.where(first_block("left_h", "right_h", masks) == F.col("block"))

    if found_crowded.isEmpty():
        return close(everyone, top).select("left_h", "right_h", "distance")
    crowded = _sent(found_crowded)
    placed = _cut(everyone, crowded, top, "sub", "rest")

    def met(members: DataFrame, keys: list[str]) -> DataFrame:
        """Near pairs in the first mask of a crowded bucket, too."""
        near = close(members, keys)
        first_inner = F.expr("array_position(transform(inner, m -> ((left_h ^ right_h) & m) = 0), true) - 1")
        return near.join(crowded.drop("n"), top, "left").where((F.col("sub") < 0) | (first_inner == F.col("sub"))).select(
            "left_h", "right_h", "distance"
        )

    again = stored(_crowded(placed.where("sub >= 0"), second, hot, threshold))
    if again.isEmpty():
        return met(placed, second)
    # deeper cuts: few members, so a pair that meets twice is dropped by distinct
    deep = [*second, "path"]
    calm = [placed.join(_sent(again).select(*second), second, "left_anti").withColumn("path", F.lit(""))]
    members = placed.join(_sent(again).select(*second), second).withColumn("path", F.lit(""))
    heavy = again.withColumn("path", F.lit(""))
    while True:
        cut = _sent(heavy)
        pieces = _cut(members, cut, deep, "_sub", "_rest")
        longer = F.concat_ws("/", "path", "_sub", F.col("_rest").cast("string"))
        members = stored(pieces.select("h", "side", *second, longer.alias("path"), F.col("path").alias("parent")))
        before = cut.select(*second, F.col("path").alias("parent"), F.col("n").alias("parent_n"))
        found = _sent(stored(_crowded(members, deep, hot, threshold)))
        parents = members.select(*deep, "parent").distinct().join(before, [*second, "parent"]).select(*deep, "parent_n")
        heavy = stored(parents.join(found, deep).where("n < 0.9 * parent_n").select(*deep, "n", "inner"))
        left_over = _sent(heavy).select(*deep)
        calm.append(members.join(left_over, deep, "left_anti").select("h", "side", *deep))
        if heavy.isEmpty():
            break
        members = members.join(left_over, deep).select("h", "side", *deep)
    return met(calm[0], deep).unionAll(reduce(DataFrame.unionAll, [met(c, deep) for c in calm[1:]]).distinct())


def _counts(items: DataFrame, name: str) -> DataFrame:
    return items.groupBy("h").agg(F.count(F.lit(1)).alias(f"{name}_items"))


def near_matches(left: DataFrame, right: DataFrame, threshold: int, **options) -> DataFrame:
    """Signature pairs across two datasets with the number of item pairs behind each."""
    lc, rc = stored(_counts(left, "left")), stored(_counts(right, "right"))
    pairs = signature_pairs(lc, rc, threshold, **options)
    return (
        pairs.join(lc.withColumnRenamed("h", "left_h").hint("merge"), "left_h")
        .join(rc.withColumnRenamed("h", "right_h").hint("merge"), "right_h")
        .withColumn("item_pairs", F.col("left_items") * F.col("right_items"))
    )


def near_matches_within(items: DataFrame, threshold: int, digests: list[str], **options) -> DataFrame:
    """Signature pairs inside one dataset; items already equal by a digest do not count as pairs.

    Different signatures cannot share a digest of the same content, so only items under one
    signature need the correction, and it is done on counts: pairs equal under either digest
    are the pairs equal under each minus those equal under both.
    """
    first, second = digests
    contents = stored(items.groupBy("h", first, second).agg(F.count(F.lit(1)).alias("_n")))
    totals = contents.groupBy("h").agg(F.sum("_n").alias("n"))
    pairs = signature_pairs(totals, None, threshold, **options)
    different = (
        pairs.join(totals.select(F.col("h").alias("left_h"), F.col("n").alias("left_items")).hint("merge"), "left_h")
        .join(totals.select(F.col("h").alias("right_h"), F.col("n").alias("right_items")).hint("merge"), "right_h")
        .withColumn("item_pairs", F.col("left_items") * F.col("right_items"))
    )

    def together(keys: list[str], sign: int) -> DataFrame:
        n = F.col("_m")
        return contents.groupBy("h", *keys).agg(F.sum("_n").alias("_m")).select(
            "h", (n * (n - 1) / 2 * sign).cast("bigint").alias("_p")
        )

    same = (
        together([], 1).unionAll(together([first], -1)).unionAll(together([second], -1)).unionAll(together([first, second], 1))
        .groupBy("h").agg(F.sum("_p").alias("item_pairs")).where(F.col("item_pairs") > 0)
        .join(totals.hint("merge"), "h")
        .select(
            F.col("h").alias("left_h"), F.col("h").alias("right_h"), F.lit(0).alias("distance"),
            F.col("n").alias("left_items"), F.col("n").alias("right_items"), "item_pairs",
        )
    )
    return different.select(*same.columns).unionByName(same)


def distance_histogram(matches: DataFrame) -> DataFrame:
    return matches.groupBy("distance").agg(F.count(F.lit(1)).alias("signature_pairs"), F.sum("item_pairs").alias("item_pairs"))


def expand_pairs(matches: DataFrame, left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    """Item pairs behind chosen signature pairs, nearest first, for a manual review.

    The output is as long as the list to be reviewed; filter ``matches`` before. Pairs with
    equal signatures include items that are exact copies.
    """
    l = left.select(F.col("h").alias("left_h"), F.col(item).alias("left_item"))
    r = right.select(F.col("h").alias("right_h"), F.col(item).alias("right_item"))
    return (
        matches.select("left_h", "right_h", "distance").join(l, "left_h").join(r, "right_h")
        .select("left_item", "right_item", "distance")
        .orderBy("distance", "left_item", "right_item")
    )


# --- reviews and gates ------------------------------------------------------------------


def reconcile(candidates: DataFrame, reviewed: DataFrame, on: list[str]) -> DataFrame:
    """One row: matched, unreviewed and stale reviews, and whether the review is complete."""
    c = candidates.select(*on, F.lit(1).alias("_c"))
    v = reviewed.select(*on, F.lit(1).alias("_v"))
    joined = c.join(v, on, "full_outer")
    counts = joined.agg(
        F.count_if(F.col("_c").isNotNull() & F.col("_v").isNotNull()).alias("matched"),
        F.count_if(F.col("_v").isNull()).alias("unreviewed"),
        F.count_if(F.col("_c").isNull()).alias("stale"),
    )
    complete = (F.col("unreviewed") == 0) & (F.col("stale") == 0)
    return counts.withColumn("status", F.when(complete, "PASS_REVIEW_COMPLETE").otherwise("REVIEW_INCOMPLETE"))


def gate(broken: Column, severe: Column, candidates: Column) -> list[Column]:
    """Status of an audit and of its contamination screen from counts."""
    return [
        F.when(broken > 0, "BLOCKED_BROKEN_FILES").when(severe, "BLOCKED_SEVERE_DUPLICATION").otherwise("PASS").alias("audit_status"),
        F.when(candidates > 0, "REVIEW_REQUIRED").otherwise("PASS_NO_CANDIDATES").alias("contamination_status"),
    ]

