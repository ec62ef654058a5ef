"""Queries on feed and instrument health, guards and non-overlapping positions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import HOUR, rounded
from tapeframe.operators import context, health as ops, state, windows
from tapeframe.plans import sqltext as q
from tapeframe.sources import tables

SYMBOL = partial(windows.by, "symbol")


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of three feeds on every 4h bar, by how busy it was."""
    c = F.col("trades")
    return tables.bars(spark, sf_dir, "4h").select("symbol", "t", "trades", (c % 5).cast("int").alias("price"), (c % 4 + 1).cast("int").alias("spot"), F.when(c % 7 == 0, 2).otherwise(4).alias("interest"))


def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    pairs = [(c("price") < 3, "Reference price stale"), (c("spot") < 3, "Spot stale"), (c("interest") < 3, "Open interest stale")]
    return _feeds(spark, sf_dir).select("symbol", "t", ops.core_ok(c("price"), c("spot"), c("interest")).alias("core_ok"), ops.connected(c("price"), c("spot"), c("interest")).alias("n_connected"), ops.issues(pairs).alias("issues"), ops.first_issue(pairs).alias("warning"))


def instrument_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts would pass as linear instruments of a made-up base, and units of their sizes."""
    part = tables.read(spark, sf_dir, "part")
    value = F.when(F.col("p_size") % 10 == 0, None).when(F.col("p_size") % 3 == 0, 10.0).otherwise(1.0)
    currency = F.when(F.col("p_size") % 4 == 0, "USDT").otherwise("BTC")
    usable = context.usable_interest(F.col("p_retailprice") * F.col("p_size") * 200, currency)
    return part.select("p_partkey", ops.linear_instrument(value, F.col("p_brand"), "BRAND").alias("linear"), rounded(usable, 2).alias("usable"))


def staleness_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars after which the tape was silent for more than an hour."""
    rows = tables.bars(spark, sf_dir, "30m").select("symbol", "t", F.lead("t").over(SYMBOL()).alias("following"))
    return rows.select("symbol", "t", ops.is_stale(F.col("t"), F.col("following"), HOUR).alias("stale"))


def position_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions opened on falls of a tenth, held six bars, never two at a time."""
    rows = tables.bars(spark, sf_dir, "4h").filter("close > 0")
    ahead, exit_t = F.lead("close", 6).over(SYMBOL()), F.lead("t", 6).over(SYMBOL())
    rows = rows.withColumn("signal", F.coalesce(F.col("close") < F.lag("close").over(SYMBOL()) * 0.9, F.lit(False))).withColumn("out", ahead).withColumn("ends", exit_t)
    taken = state.non_overlapping(rows.filter("signal and ends is not null").select("symbol", "t", "ends", "close", "out"), ["symbol"], "t", "ends")
    return taken.select("symbol", "t", "ends", rounded(F.col("out") / F.col("close") - 1).alias("ret"))


QUERIES = {f.__name__: f for f in (feed_health, instrument_guards, staleness_watch, position_walk)}

_F = "f as (select symbol, t, trades % 5 as price, trades % 4 + 1 as spot, case when trades % 7 = 0 then 2 else 4 end as interest from b4h)"
SQL = {
    "feed_health": q.with_(q.TAPE, q.B4H, _F)
    + """select symbol, t, price >= 3 and spot >= 3 and interest >= 3 as core_ok, (price >= 3)::int + (spot >= 3)::int + (interest >= 3)::int as n_connected,
 concat_ws(chr(10), case when price < 3 then 'Reference price stale' end, case when spot < 3 then 'Spot stale' end, case when interest < 3 then 'Open interest stale' end) as issues,
 case when price < 3 then 'Reference price stale' when spot < 3 then 'Spot stale' when interest < 3 then 'Open interest stale' end as warning from f""",
    "instrument_guards": "select p_partkey, (p_size % 10 = 0 or p_size % 3 <> 0) and upper(p_brand) like '%BRAND%' as linear, "
    + q.r("case when p_size % 4 <> 0 and p_retailprice * p_size * 200 > 0 and p_retailprice * p_size * 200 <= 5000000 then p_retailprice * p_size * 200 end", 2)
    + " as usable from part",
    "staleness_watch": q.with_(q.TAPE, q.B30) + "select symbol, t, coalesce(lead(t) over (partition by symbol order by t) - t > 3600000, true) as stale from b30m",
    "position_walk": q.with_(q.TAPE, q.B4H, recursive=True)
    + f""", s as (select symbol, t, lead(t, 6) over w as ends, close, lead(close, 6) over w as o, coalesce(close < lag(close) over w * 0.9, false) as signal from b4h where close > 0 window w as (partition by symbol order by t)), c as (select * from s where signal and ends is not null),
p as (select symbol, min(t) as t from c group by symbol union all select p.symbol, (select min(d.t) from c d where d.symbol = p.symbol and d.t >= (select e.ends from c e where e.symbol = p.symbol and e.t = p.t)) from p
 where exists (select 1 from c d where d.symbol = p.symbol and d.t >= (select e.ends from c e where e.symbol = p.symbol and e.t = p.t))) select c.symbol, c.t, c.ends, {q.r('o / close - 1')} as ret from p join c using (symbol, t)""",
}
