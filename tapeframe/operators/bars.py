"""Resampling and bar-series checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import bucket


def resample(trades: DataFrame, width: int, keys: list[str], time: str, price: str, size: str, tie: str) -> DataFrame:
    """Bars of `width` ms: keys, t, open, high, low, close, volume, trades.

    One aggregation with partial sums before the shuffle, so a hot key costs one row
    per bar and task. Open and close are the first and last by (time, tie).
    """
    order = F.struct(time, tie)
    return (
        trades.filter(F.col(price).isNotNull() & F.col(time).isNotNull())
        .groupBy(*keys, bucket(time, width).alias("t"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum(size).alias("volume"),
            F.count("*").alias("trades"),
        )
    )


def roll_up(bars: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Wider bars from narrower ones."""
    return bars.groupBy(*keys, bucket("t", width).alias("b")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("b", "t")


def gaps(bars: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """keys, t, previous_t, missing: bars that follow a hole, and how many are missing in it."""
    before = F.lag("t").over(W.partitionBy(*keys).orderBy("t"))
    return bars.select(*keys, "t", before.alias("previous_t")).withColumn("missing", ((F.col("t") - F.col("previous_t")) / width - 1).cast("long")).filter("missing > 0")


def strictly_increasing(rows: DataFrame, keys: list[str], at: str, tie: Column) -> DataFrame:
    """The first row of each time by `tie`: what is left when a sorted stream drops what does not advance."""
    ranked = rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys, at).orderBy(tie)))
    return ranked.filter("__n = 1").drop("__n")


def sub_bar_volume(sub: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Volume of rising, falling and flat sub-bars of each wider bar, and their balance."""
    grouped = sub.groupBy(*keys, bucket("t", width).alias("b")).agg(
        F.sum(F.when(F.col("close") > F.col("open"), F.col("volume")).otherwise(0.0)).alias("up_volume"),
        F.sum(F.when(F.col("close") < F.col("open"), F.col("volume")).otherwise(0.0)).alias("down_volume"),
        F.sum(F.when(F.col("close") == F.col("open"), F.col("volume")).otherwise(0.0)).alias("flat_volume"),
        F.count("*").alias("n_sub"),
    )
    return grouped.withColumnRenamed("b", "t").withColumn("balance", F.col("up_volume") - F.col("down_volume"))


def integrity(aligned: DataFrame, width: int, observed: str, age: str, stale_ms: int) -> DataFrame:
    """One row: bars, gaps, missing bars, rows without the observation, rows with a stale one."""
    step = (F.col("t") - F.lag("t").over(W.partitionBy("series").orderBy("t"))) / width - 1
    rows = aligned.withColumn("__m", F.when(step > 0, step.cast("long")))
    return rows.groupBy("series").agg(
        F.count("*").alias("n_bars"),
        F.count("__m").alias("n_gaps"),
        F.coalesce(F.sum("__m"), F.lit(0)).alias("n_missing"),
        F.sum(F.when(F.col(observed).isNull(), 1).otherwise(0)).cast("long").alias("n_absent"),
        F.sum(F.when(F.col(age) > stale_ms, 1).otherwise(0)).cast("long").alias("n_stale"),
    )
