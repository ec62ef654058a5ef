"""Joins in time without lookahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import bucket


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], strict: bool = False, block: int = 30 * 86_400_000) -> DataFrame:
    """left with the payload of the last right row at or before (strict: before) its time.

    Both sides are tagged and united, and the last right row is carried forward inside
    blocks of `block` ms; what a block starts with comes from a table of each block's
    last right row, which has one row per key and block. So neither a key's whole history
    nor a hot key meets in one task. Right rows of equal time: the largest payload wins.
    A matched row also yields matched_t.
    """
    value = F.struct(F.col(right_time).alias("matched_t"), *[F.col(c).alias(c) for c in payload])
    rows = right.select(*keys, F.col(right_time).alias("__t"), value.alias("__v"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(left.schema.simpleString()).alias("__row"))
    asks = left.select(*keys, F.col(left_time).alias("__t"), F.lit(None).cast(_type_of(rows, "__v")).alias("__v"), F.lit(0 if strict else 1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    both = rows.unionByName(asks).withColumn("__b", bucket("__t", block))
    ends = rows.groupBy(*keys, bucket("__t", block).alias("__b")).agg(F.max_by("__v", F.struct("__t", "__v")).alias("__end"))
    blocks = both.select(*keys, "__b").distinct().join(ends, [*keys, "__b"], "left")
    before = F.last("__end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    carried = blocks.withColumn("__before", before).drop("__end")
    order = W.partitionBy(*keys, "__b").orderBy("__t", "__side", F.col("__v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    inside = both.withColumn("__own", F.last("__v", ignorenulls=True).over(order)).filter(F.col("__row").isNotNull())
    found = inside.join(carried, [*keys, "__b"]).withColumn("__hit", F.coalesce("__own", "__before"))
    return found.select("__row.*", "__hit.matched_t", *[F.col(f"__hit.{c}").alias(c) for c in payload])


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def completed_context(chart: DataFrame, context: DataFrame, keys: list[str], width: int, payload: list[str]) -> DataFrame:
    """chart with the payload of the last context bar that had closed when the chart bar opened."""
    visible = context.withColumn("__from", F.col("t") + width)
    joined = as_of(chart, visible.select(*keys, "__from", *payload), keys, "t", "__from", payload)
    return joined.withColumnRenamed("matched_t", "visible_from")


def live_context(chart: DataFrame, context: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """chart with the payload of the context bar of the same opening time."""
    return chart.join(context.select(*keys, "t", *payload), [*keys, "t"], "left")


def projected(chart: DataFrame, context: DataFrame, keys: list[str], chart_width: int, context_width: int, payload: list[str]) -> DataFrame:
    """chart with the payload of a timeframe: the bar itself where the widths are equal, else the last one closed."""
    if chart_width == context_width:
        return live_context(chart, context, keys, payload).withColumn("visible_from", F.col("t"))
    return completed_context(chart, context, keys, context_width, payload)


def at_offset(rows: DataFrame, keys: list[str], second: str, offsets: list[int], value: str, same_day: bool = False) -> DataFrame:
    """rows with the value exactly `offset` seconds later (or earlier), null where there is no such row."""
    out = rows
    for h in offsets:
        name = f"{value}_{'p' if h >= 0 else 'm'}{abs(h)}"
        there = rows.select(*keys, (F.col(second) - h).alias(second), F.col(value).alias(name), *([F.floor(F.col(second) / 86400).alias("__d")] if same_day else []))
        out = out.join(there, [*keys, second], "left")
        if same_day:
            out = out.withColumn(name, F.when(F.col("__d") == F.floor(F.col(second) / 86400), F.col(name))).drop("__d")
    return out


def last_per(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each group by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def compared(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """For each column: compared rows, null-against-value mismatches, largest relative difference."""
    left = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = left.join(right, on)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b")) for c in columns]))
    p = joined.select(pairs.alias("p")).select("p.*")
    diff = F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-12))
    return p.groupBy("column").agg(
        F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_compared"),
        F.count(F.when(F.col("a").isNull() != F.col("b").isNull(), 1)).alias("n_structural"),
        F.max(F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(diff)).alias("largest_relative"),
    )


def matched_control(rows: DataFrame, strata: list[str], treated: str, outcome: str) -> DataFrame:
    """One row: the count-weighted mean over strata of treated minus control means, and the treated rows matched."""
    cells = rows.groupBy(*strata).agg(
        F.avg(F.when(F.col(treated), F.col(outcome))).alias("mt"), F.avg(F.when(~F.col(treated), F.col(outcome))).alias("mc"), F.sum(F.when(F.col(treated), 1).otherwise(0)).alias("n")
    )
    usable = cells.filter("mt is not null and mc is not null")
    return usable.agg(F.sum("n").cast("long").alias("n_treated"), (F.sum(F.col("n") * (F.col("mt") - F.col("mc"))) / F.sum("n")).alias("effect"), F.count("*").alias("n_strata"))
