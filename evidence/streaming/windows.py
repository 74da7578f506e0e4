"""Running confusion counts over event-time windows of a prediction stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def window_confusion(stream: DataFrame, ts: str, width: str, delay: str, out: str, checkpoint: str):
    """Count (window, true, predicted) and write the changed counts of each batch.

    Rows later than ``delay`` behind the newest event of earlier batches are dropped with their
    closed windows; :func:`dropped_rows` tells how many. Every batch writes its own folder, so a repeated batch replaces itself.
    """
    counted = (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), "true_class", "predicted_class")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "true_class", "predicted_class", "n")
    )

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        counted.writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def dropped_rows(query) -> int:
    """Rows that came too late for their windows, over the batches whose progress the finished or running query still holds."""
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest count of every cell."""
    keys = ["window_start", "true_class", "predicted_class"]
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def window_accuracy(counts: DataFrame) -> DataFrame:
    """Rows and accuracy per window."""
    hit = F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0))
    return counts.groupBy("window_start").agg(F.sum("n").alias("samples"), F.try_divide(hit.cast("double"), F.sum("n")).alias("accuracy"))


def running_accuracy(windows: DataFrame) -> DataFrame:
    """Accuracy of all windows so far (one row per window, so the order fits one task)."""
    so_far = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    hits = F.sum(F.col("accuracy") * F.col("samples")).over(so_far)
    return windows.withColumn("running_accuracy", F.try_divide(hits, F.sum("samples").over(so_far)))
