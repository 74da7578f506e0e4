"""Order-free fingerprints of tables: equality of large tables from sums of row hashes, and the rows in which they differ.

The fingerprint of a set of rows is their number and the sums of two 64-bit hashes of each row, so it depends neither on order nor
on partitions and the fingerprints of parts add up. Rows are placed in branches by leading bits of a third hash. Equal
branches are never read again: a difference is found by going down unequal branches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evidence.operators.gates import multiset_difference
from evidence.operators.scale import stored

#: Bits of a branch at each step down, and rows of unequal branches that are compared without another step.
LEVELS, ROWS = (12, 24, 36), 100_000
#: A step down is only worth its pass while at most this share of the branches differs.
SHARE = 0.5


def _plain(column: Column, kind: T.DataType, depth: int = 0) -> Column:
    """The value in a form whose hash tells nulls, lengths and nesting apart; -0.0 counts as 0.0."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = column + F.lit(0.0).cast(kind)
    elif isinstance(kind, T.ArrayType):
        items = F.transform(column, lambda x: _plain(x, kind.elementType, depth + 1))
        value = F.struct(F.size(column).alias("n"), items.alias("items"))
    elif isinstance(kind, T.StructType):
        value = F.struct(*[_plain(column.getField(f.name), f.dataType, depth).alias(f"f{i}") for i, f in enumerate(kind.fields)])
    elif isinstance(kind, T.MapType):
        raise TypeError("maps have no order to hash: turn them into sorted arrays of entries")
    else:
        value = column
    return F.struct(column.isNull().alias("null"), value.alias("value"))


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with ``_a`` and ``_b``, that are added up, and ``_place``, that picks the branch."""
    row = F.struct(*[_plain(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(columns)])
    seeds = {"_a": 1, "_b": 2, "_place": 3}
    return df.select(*[F.col(f"`{c}`") for c in columns], *[F.xxhash64(F.lit(k), row, F.lit(-k)).alias(n) for n, k in seeds.items()])


def _sums(hashed: DataFrame, bits: int) -> DataFrame:
    # 38 digits hold the sum of 10 ** 19 hashes
    total = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    return hashed.groupBy(F.shiftrightunsigned("_place", 64 - bits).alias("branch")).agg(
        F.count(F.lit(1)).alias("n"), total("_a").alias("a"), total("_b").alias("b")
    )


def fingerprints(df: DataFrame, columns: list[str], bits: int = LEVELS[0]) -> DataFrame:
    """(branch, n, a, b) of every branch that has rows: at most ``2 ** bits`` rows whatever the table, pre-aggregated in every task.

    Stored once, it stands for the table in later comparisons. Rows that repeat count as often as they occur, nulls equal nulls,
    column names do not matter, their order and types do. No rows: no branches.
    """
    return _sums(_hashed(df, columns), bits)


def unequal_branches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(branch, left_rows, right_rows) of the branches in which two tables of fingerprints differ; empty for equal tables."""
    l = left.select("branch", F.struct("n", "a", "b").alias("_l"))
    r = right.select("branch", F.struct("n", "a", "b").alias("_r"))
    zero = F.lit(0).cast("bigint")
    return l.join(r, "branch", "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r"))).select(
        "branch", F.coalesce("_l.n", zero).alias("left_rows"), F.coalesce("_r.n", zero).alias("right_rows")
    )


def equality(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """One row (left_rows, right_rows, status): EQUAL if the tables hold the same rows equally often, else DIFFERENT.

    One partial aggregate a table; nothing but one row of sums a task is shuffled.
    """
    side = lambda df, n: _sums(_hashed(df, columns), 1).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias(n), F.sum("a").alias(f"{n}_a"), F.sum("b").alias(f"{n}_b")
    )
    same = [F.col(f"left_rows{s}").eqNullSafe(F.col(f"right_rows{s}")) for s in ("", "_a", "_b")]
    both = side(left, "left_rows").crossJoin(side(right, "right_rows"))  # one row each
    return both.select("left_rows", "right_rows", F.when(same[0] & same[1] & same[2], "EQUAL").otherwise("DIFFERENT").alias("status"))


def differing_rows(
    left: DataFrame, right: DataFrame, columns: list[str], levels: tuple[int, ...] = LEVELS, rows: int = ROWS,
    names: tuple[str, str] = ("left_only", "right_only"),
) -> DataFrame:
    """(columns…, side): rows of one table that the other lacks, as often as it lacks them.

    Equal tables cost one pass with partial aggregates and shuffle at most ``2 ** levels[0]`` sums a task. Otherwise the rows of unequal
    branches are summed again by more bits, until few rows are left or most branches differ; only those rows are
    shuffled and compared value by value. Unequal branches stay in a table, not on the driver. Two different sets of rows pass for equal
    if both sums of 64-bit hashes agree, with a chance of about 2 ** -128 a branch.
    """
    l, r = _hashed(left, columns), _hashed(right, columns)
    for bits in levels:
        pairs = stored(unequal_branches(_sums(l, bits), _sums(r, bits)))
        size = pairs.agg(F.count(F.lit(1)).alias("branches"), F.coalesce(F.sum(F.col("left_rows") + F.col("right_rows")), F.lit(0)).alias("rows")).first()
        chosen = pairs.select("branch")
        inside = F.shiftrightunsigned("_place", 64 - bits)
        l, r = (x.withColumn("branch", inside).join(chosen, "branch", "left_semi").drop("branch") for x in (l, r))
        if size["rows"] <= rows or size["branches"] > SHARE * 2**bits:
            break
    keep = [F.col(f"`{c}`") for c in columns]
    found = multiset_difference(l.select(*keep), r.select(*keep))
    return found.withColumn("side", F.when(F.col("side") == "actual_only", names[0]).otherwise(names[1]))
