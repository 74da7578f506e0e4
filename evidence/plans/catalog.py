"""Registry of queries: a Spark plan per name and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles of a small result: the order of additions differs between engines."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def r(expression: str, alias: str, digits: int = 6) -> str:
    """The SQL twin of :func:`rounded` for one column."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0) AS {alias}"


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
