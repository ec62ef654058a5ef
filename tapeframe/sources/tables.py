"""Market-data shapes derived from the driver tables, lazily and with pruned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.columns import DAY, MINUTE, bucket, millis
from tapeframe.operators.bars import resample

#: Widths of the named timeframes in ms.
WIDTHS = {"30m": 30 * MINUTE, "1h": 60 * MINUTE, "4h": 240 * MINUTE, "1d": DAY}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: symbol, t (ms), trade_id, px, qty, aggressive_buy."""
    events = read(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("symbol"),
        millis("ts").alias("t"),
        F.col("event_id").alias("trade_id"),
        F.col("value").alias("px"),
        (1 + F.col("user_id") % 7).cast("double").alias("qty"),
        (F.col("user_id") % 2 == 0).alias("aggressive_buy"),
        F.col("user_id"),
    )


def bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    """OHLCV bars of the tape: symbol, t, open, high, low, close, volume, trades."""
    return resample(tape(spark, sf_dir), WIDTHS[timeframe], keys=["symbol"], time="t", price="px", size="qty", tie="trade_id")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals: t, open, high, low, close, volume."""
    orders = read(spark, sf_dir, "orders").select(millis("o_orderdate").alias("t"), F.col("o_orderkey").alias("trade_id"), F.col("o_totalprice").alias("px"), F.lit(1.0).alias("qty"))
    return resample(orders.withColumn("symbol", F.lit("ORD")), DAY, keys=["symbol"], time="t", price="px", size="qty", tie="trade_id").drop("symbol")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of three legs by return flag: A perp, N spot, R open interest."""
    lines = read(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = lines.select(F.col("l_returnflag").alias("leg"), bucket(millis("l_shipdate"), DAY).alias("t"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"), order.alias("o"))
    return rows.groupBy("leg", "t").agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"), F.sum("qty").alias("volume")
    )


def seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last trade of each second of each symbol: symbol, s, px, qty."""
    rows = tape(spark, sf_dir).withColumn("s", F.floor(F.col("t") / 1000).cast("long"))
    last = F.max_by(F.struct("px", "qty", "aggressive_buy"), F.struct("t", "trade_id"))
    return rows.groupBy("symbol", "s").agg(last.alias("r")).select("symbol", "s", "r.px", "r.qty", "r.aggressive_buy")


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static book from part prices: side, price, qty; below the median price bids, else asks."""
    part = read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("qty"))
    middle = part.agg(F.percentile("price", F.lit(0.5)).alias("m"))
    sided = part.join(F.broadcast(middle)).select(F.when(F.col("price") < F.col("m"), "bid").otherwise("ask").alias("side"), "price", "qty")  # middle is one row
    return sided.groupBy("side", "price").agg(F.sum("qty").alias("qty"))


def depth_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level updates: symbol, seq, t, side, price, qty (0 removes), first_id, last_id, prev_id."""
    e = read(spark, sf_dir, "events")
    bid = F.col("user_id") % 2 == 0
    return e.select(
        F.lit("BOOK").alias("symbol"),
        F.col("event_id").alias("seq"),
        millis("ts").alias("t"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 1000 - F.round("value")).otherwise(1001 + F.round("value")).alias("price"),
        (F.col("user_id") % 5).cast("double").alias("qty"),
        F.col("event_id").alias("first_id"),
        F.col("event_id").alias("last_id"),
        (F.col("event_id") - 1).alias("prev_id"),
    )
