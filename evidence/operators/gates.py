"""Integrity checks: each returns a small table of findings instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidence.functions.vectors import norm


def embedding_checks(
    df: DataFrame, item: str, vec: str, label: str, dimension: int, labels: int, tolerance: float = 1e-5
) -> DataFrame:
    """(check, violations, status) for an embedding table, from one aggregate over one scan."""
    v = F.col(vec).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    tests = {
        "dimension": F.size(vec) != dimension,
        "finite": odd,
        "unit_norm": F.coalesce(F.abs(norm(v) - 1.0) > tolerance, F.lit(True)),
        "label_range": F.coalesce((F.col(label) < 0) | (F.col(label) >= labels), F.lit(True)),
        "missing_id": F.col(item).isNull(),
    }
    counts = df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    repeats = df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_id")
    )
    names = list(tests)
    row = counts.select(*names, repeats.scalar().alias("repeated_id"))
    return _findings(row, [*names, "repeated_id"])


def _findings(row: DataFrame, names: list[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("violations")) for n in names])
    return row.select(F.explode(entries).alias("e")).select(
        "e.*", F.when(F.col("e.violations") == 0, "PASS").otherwise("FAIL").alias("status")
    )


def identity_check(recorded: dict, expected: dict) -> list[str]:
    """Names of identity fields that differ (identities are a handful of configuration values)."""
    return sorted(k for k in recorded.keys() | expected.keys() if recorded.get(k) != expected.get(k))


def cache_alignment(left: DataFrame, right: DataFrame, position: list[str], item: str, label: str) -> DataFrame:
    """Compare two caches position by position."""
    l = left.select(*position, F.col(item).alias("_li"), F.col(label).alias("_ll"), F.lit(True).alias("_l"))
    r = right.select(*position, F.col(item).alias("_ri"), F.col(label).alias("_rl"), F.lit(True).alias("_r"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    row = l.join(r, position, "full_outer").agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(both & ~F.col("_li").eqNullSafe(F.col("_ri"))).alias("id_differs"),
        F.count_if(both & ~F.col("_ll").eqNullSafe(F.col("_rl"))).alias("label_differs"),
    )
    return _findings(row, ["only_left", "only_right", "id_differs", "label_differs"])


def overlap(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Validation rows whose key also occurs in training; must be empty."""
    return validation.join(train.select(key).distinct(), key, "left_semi")


def registry_check(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) from two (path, sha256) tables: OK, CHANGED, MISSING or UNREGISTERED."""
    joined = recorded.select("path", F.col("sha256").alias("_want")).join(
        actual.select("path", F.col("sha256").alias("_have")), "path", "full_outer"
    )
    return joined.select(
        "path",
        F.when(F.col("_want").isNull(), "UNREGISTERED").when(F.col("_have").isNull(), "MISSING")
        .when(F.lower("_want") == F.lower("_have"), "OK").otherwise("CHANGED").alias("status"),
    )


def registry_verdict(checked: DataFrame) -> DataFrame:
    broken = F.count_if(F.col("status").isin("MISSING", "CHANGED"))
    return checked.agg(
        F.count_if(F.col("status") != "UNREGISTERED").alias("registered"), broken.alias("broken"),
        F.when(broken == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def remaining(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned keys the ledger does not hold yet."""
    return planned.select(*keys).distinct().join(done.select(*keys), keys, "left_anti")


def ledger_verdict(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """COMPLETE, PARTIAL or OVERRUN (a key scored twice or never planned)."""
    state = planned.select(*keys, F.lit(1).alias("_p"), F.lit(0).alias("_d")).unionAll(
        done.select(*keys, F.lit(0).alias("_p"), F.lit(1).alias("_d"))
    ).groupBy(*keys).agg(F.max("_p").alias("_p"), F.sum("_d").alias("_d"))
    counts = state.agg(
        F.coalesce(F.sum("_p"), F.lit(0)).cast("bigint").alias("planned"),
        F.count_if((F.col("_p") == 1) & (F.col("_d") > 0)).alias("completed"),
        F.count_if(F.col("_d") > F.col("_p")).alias("unexpected"),
    )
    return counts.withColumn(
        "status",
        F.when(F.col("unexpected") > 0, "OVERRUN").when(F.col("completed") < F.col("planned"), "PARTIAL").otherwise("COMPLETE"),
    )


def missing_cells(actual: DataFrame, unit: str, axes: dict[str, list]) -> DataFrame:
    """Cells of the grid (units seen × configured axis values) that never occur."""
    expected = actual.select(unit).distinct()
    for name, values in axes.items():
        expected = expected.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    keys = [unit, *axes]
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")


def set_difference(actual: DataFrame, expected: list[str], column: str) -> DataFrame:
    """(side, value): expected names never seen and names seen but not expected."""
    names = actual.sparkSession.range(1).select(F.explode(F.array(*[F.lit(e) for e in expected])).alias(column))
    seen = actual.select(column).distinct()
    return names.subtract(seen).select(F.lit("missing").alias("side"), F.col(column).alias("value")).unionAll(
        seen.subtract(names).select(F.lit("unexpected"), F.col(column))
    )


def multiset_difference(actual: DataFrame, registered: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with multiplicity; empty when they agree."""
    return actual.exceptAll(registered).withColumn("side", F.lit("actual_only")).unionByName(
        registered.exceptAll(actual).withColumn("side", F.lit("registered_only"))
    )


def file_validity(size: Column, extension: Column, decoded: Column, allowed: list[str]) -> Column:
    """zero_byte, then unexpected_extension, then decode_failure, else ok."""
    return (
        F.when(size == 0, "zero_byte").when(~F.lower(extension).isin(*allowed), "unexpected_extension")
        .when(~F.coalesce(decoded, F.lit(False)), "decode_failure").otherwise("ok")
    )
