"""Widths of blocks of an order, so that what one task reads stays the same as tables grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paced(df: DataFrame, keys: list[str], order: str, width: int, rows: int) -> int:
    """The width, cut into so many parts that the busiest block of it would leave each about `rows` rows; 1 at least.

    One number reaches the driver.
    """
    sizes = df.groupBy(*keys, F.floor(F.col(order) / width)).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    return max(1, width // max(1, -(-most // rows)))
