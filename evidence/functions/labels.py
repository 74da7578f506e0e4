"""Columns over two-factor class labels such as ``good_en``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def factor_a(label: Column) -> Column:
    """The part before the first underscore (the condition)."""
    return F.split(label, "_", 2).getItem(0)


def factor_b(label: Column) -> Column:
    """The part after the first underscore (the identity)."""
    return F.get(F.split(label, "_", 2), F.lit(1))


def label_factors(label: Column, strict: bool = True) -> Column:
    """struct(factor_a, factor_b, display); a label without underscore is an error."""
    parts = F.split(label, "_", 2)
    found = F.struct(
        parts.getItem(0).alias("factor_a"),
        F.get(parts, F.lit(1)).alias("factor_b"),
        F.initcap(F.translate(label, "_", " ")).alias("display"),
    )
    if not strict:
        return found
    return F.when(F.size(parts) == 2, found).otherwise(
        F.raise_error(F.concat(F.lit("label without two factors: "), F.coalesce(label, F.lit("null"))))
    )


def canonical_class(df: DataFrame, folder: str, mapping: dict[str, str], into: str = "class") -> DataFrame:
    """Rename folders to classes and drop the unmapped ones (mapping is configuration)."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(into, F.try_element_at(pairs, F.col(folder))).where(F.col(into).isNotNull())


def correctness(true: Column, predicted: Column) -> list[Column]:
    """correct, factor_a_correct, factor_b_correct."""
    return [
        (true == predicted).alias("correct"),
        (factor_a(true) == factor_a(predicted)).alias("factor_a_correct"),
        (factor_b(true) == factor_b(predicted)).alias("factor_b_correct"),
    ]


def error_category(true: Column, predicted: Column) -> Column:
    """condition_error, identity_error or combined_error; null for a correct row."""
    return (
        F.when(true == predicted, F.lit(None).cast("string"))
        .when(factor_b(true) == factor_b(predicted), "condition_error")
        .when(factor_a(true) == factor_a(predicted), "identity_error")
        .otherwise("combined_error")
    )


def outcome(left_correct: Column, right_correct: Column) -> Column:
    return (
        F.when(left_correct & right_correct, "both_correct")
        .when(left_correct, "left_only_correct")
        .when(right_correct, "right_only_correct")
        .otherwise("both_wrong")
    )
