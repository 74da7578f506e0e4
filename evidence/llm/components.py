"""Connected components of a graph of links, as distributed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidence.operators.scale import stored


#: Rows of two numbers that may go to every task.
SENT_ROWS = 500_000


def sent(table: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A stored table of one or two numbers a row, sent to all tasks if it has at most ``most`` rows by count."""
    return F.broadcast(table) if table.count() <= most else table


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from every id of the links (a, b).

    Each round takes the smallest label of all neighbours (partially aggregated, so a vertex with very many links
    costs one row a task) and then the label of that label. Every round is written to the
    shared folder; the driver sees only how many rows there are and whether labels changed.
    """
    both = stored(
        links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("l"))
        .select("l.*").distinct()
    )
    labels = stored(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")))
    small = labels.count() <= SENT_ROWS
    near = (lambda t: F.broadcast(t)) if small else (lambda t: t)
    while True:
        theirs = near(labels.select(F.col("id").alias("other"), F.col("label").alias("offer")))
        mine = near(labels.withColumnRenamed("label", "was"))
        lower = both.join(theirs, "other").groupBy("id").agg(F.min("offer").alias("offer")).join(mine, "id").select(
            "id", F.least("was", "offer").alias("label"), "was"
        )
        up = near(labels.select(F.col("id").alias("label"), F.col("label").alias("above")))
        moved = stored(lower.join(up, "label", "left").select("id", F.least("label", F.coalesce("above", "label")).alias("label"), "was"))
        labels = moved.select("id", "label")
        if moved.where("label <> was").isEmpty():
            return labels
