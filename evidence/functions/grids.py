"""Table functions over region grids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def grid_regions(height: Column, width: Column, rows: int, cols: int) -> Column:
    """Array of struct(index, row, column, y0, y1, x0, x1); bounds are truncated to integers.

    Explode it to get one row per region.
    """

    def bound(size: Column, step: Column, steps: int) -> Column:
        return F.floor(size * step / F.lit(float(steps))).cast("int")

    def region(i: Column) -> Column:
        row = F.floor(i / cols).cast("int")
        col = (i % cols).cast("int")
        return F.struct(
            i.cast("int").alias("index"),
            row.alias("row"),
            col.alias("column"),
            bound(height, row, rows).alias("y0"),
            bound(height, row + 1, rows).alias("y1"),
            bound(width, col, cols).alias("x0"),
            bound(width, col + 1, cols).alias("x1"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), region)


def is_edge(row: Column, col: Column, rows: int, cols: int) -> Column:
    return row.isin(0, rows - 1) | col.isin(0, cols - 1)


def grid_radius(row: Column, col: Column, rows: int, cols: int) -> Column:
    """Distance of a cell from the middle of the grid, in cells."""
    return F.sqrt(F.pow(row - F.lit((rows - 1) / 2), F.lit(2.0)) + F.pow(col - F.lit((cols - 1) / 2), F.lit(2.0)))
