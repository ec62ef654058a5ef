"""Queries on bars and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.columns import DAY, HOUR, rounded
from tapeframe.operators import alignment, bars as ops
from tapeframe.plans import sqltext as q
from tapeframe.sources import tables

OHLCV = ["open", "high", "low", "close", "volume"]


def _bars(timeframe: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.bars(spark, sf_dir, timeframe)

    return query


def bars_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4h bars made from 30m bars."""
    return ops.roll_up(tables.bars(spark, sf_dir, "30m"), 4 * HOUR, ["symbol"])


def bar_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gaps(tables.bars(spark, sf_dir, "1h"), HOUR, ["symbol"])


def load_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tape(spark, sf_dir).withColumn("at", F.floor(F.col("t") / 60_000).cast("long"))
    return ops.strictly_increasing(rows, ["symbol"], "at", F.col("trade_id")).select("symbol", "at", "trade_id", "px")


def sub_bar_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sub_bar_volume(tables.bars(spark, sf_dir, "30m"), 4 * HOUR, ["symbol"])


def _leg(spark: SparkSession, sf_dir: str, leg: str, *columns: str) -> DataFrame:
    return tables.legs(spark, sf_dir).filter(F.col("leg") == leg).select("t", *columns)


def align_spot_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perp days with the spot bar of the same day, if any."""
    spot = _leg(spark, sf_dir, "N", *OHLCV).select("t", *[F.col(c).alias(f"spot_{c}") for c in OHLCV])
    perp = _leg(spark, sf_dir, "A", *OHLCV)
    return perp.join(spot, "t", "left").select("t", *[rounded(c, 9).alias(c) for c in OHLCV], *[rounded(f"spot_{c}", 9).alias(f"spot_{c}") for c in OHLCV])


def _with_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perp days with the last open interest at or before the bar's last millisecond; interest is seen every third day."""
    perp = _leg(spark, sf_dir, "A", "close").select(F.lit("A").alias("series"), "t", (F.col("t") + DAY - 1).alias("closes"), "close")
    interest = _leg(spark, sf_dir, "R", "volume").filter(F.col("t") / DAY % 3 == 0).select(F.lit("A").alias("series"), F.col("t").alias("seen"), F.col("volume").alias("oi"))
    joined = alignment.as_of(perp, interest, ["series"], "closes", "seen", ["oi"])
    return joined.withColumn("oi_age", F.col("closes") - F.col("matched_t"))


def align_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_interest(spark, sf_dir).select("t", rounded("close", 9).alias("close"), F.col("matched_t").alias("oi_t"), "oi", "oi_age")


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.integrity(_with_interest(spark, sf_dir), DAY, "oi", "oi_age", 2 * DAY)


def asof_trades_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even trades with the last odd trade strictly before them."""
    tape = tables.tape(spark, sf_dir)
    left = tape.select(F.lit(1).alias("k"), "symbol", "trade_id", "t").filter(F.col("trade_id") % 2 == 0)
    right = tape.filter(F.col("trade_id") % 2 == 1).select(F.lit(1).alias("k"), F.col("t").alias("rt"), F.col("px").alias("last_px"), F.col("trade_id").alias("last_id"))
    found = alignment.as_of(left, right, ["k"], "t", "rt", ["last_id", "last_px"], strict=True)
    return found.select("trade_id", "t", "matched_t", "last_id", "last_px")


def ctx_completed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = tables.bars(spark, sf_dir, "4h").select("symbol", "t", F.col("close").alias("ctx_close"), F.col("high").alias("ctx_high"))
    chart = tables.bars(spark, sf_dir, "1h").select("symbol", "t", "close")
    return alignment.completed_context(chart, context, ["symbol"], 4 * HOUR, ["ctx_close", "ctx_high"])


def ctx_live_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = tables.bars(spark, sf_dir, "4h").select("symbol", "t", F.col("close").alias("ctx_close"))
    return alignment.live_context(tables.bars(spark, sf_dir, "4h").select("symbol", "t", "open"), context, ["symbol"], ["ctx_close"])


def second_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.seconds(spark, sf_dir)


def forward_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices exactly 60, 300 and 900 seconds later and 300 before."""
    return alignment.at_offset(tables.seconds(spark, sf_dir).select("symbol", "s", "px"), ["symbol"], "s", [60, 300, 900, -300], "px")


def log_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log changes over exactly the next 5, 30 and 300 seconds, and over the last 30 as a control, where both prices are there."""
    rows = alignment.at_offset(tables.seconds(spark, sf_dir).filter("px > 0").select("symbol", "s", "px"), ["symbol"], "s", [5, 30, 300, -30], "px")
    ahead = [rounded(F.log(F.col(f"px_p{h}") / F.col("px"))).alias(f"target_{h}") for h in (5, 30, 300)]
    return rows.select("symbol", "s", *ahead, rounded(F.log(F.col("px") / F.col("px_m30"))).alias("past_30"))


def forward_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.at_offset(tables.seconds(spark, sf_dir).select("symbol", "s", "px"), ["symbol"], "s", [600, 3600], "px", same_day=True)


def cross_series_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each symbol computed alone minus those computed with all others, both ways: no rows differ."""
    tape, own = tables.tape(spark, sf_dir), None
    for symbol in sorted(r.symbol for r in tape.select("symbol").distinct().collect()):  # names of series
        alone = ops.resample(tape.filter(F.col("symbol") == symbol), 4 * HOUR, ["symbol"], "t", "px", "qty", "trade_id")
        own = alone if own is None else own.unionByName(alone)
    among = tables.bars(spark, sf_dir, "4h").select(*own.columns)
    only = own.exceptAll(among).withColumn("side", F.lit("alone")).unionByName(among.exceptAll(own).withColumn("side", F.lit("among")))
    return only.groupBy("side").count().unionByName(own.agg(F.count("*").alias("count")).withColumn("side", F.lit("bars"))).select("side", F.col("count").alias("n"))


def differential_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4h bars of the tape against 4h bars rolled up from 30m bars, column by column."""
    a, b = tables.bars(spark, sf_dir, "4h"), bars_rolled_up(spark, sf_dir)
    return alignment.compared(a, b, ["symbol", "t"], OHLCV)


def mtf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4h bars with the close of the 4h and of the 1d timeframe, as a chart of 4h sees them."""
    chart = tables.bars(spark, sf_dir, "4h").select("symbol", "t")
    own = alignment.projected(chart, tables.bars(spark, sf_dir, "4h").select("symbol", "t", F.col("close").alias("own")), ["symbol"], 4 * HOUR, 4 * HOUR, ["own"])
    day = alignment.projected(chart, tables.bars(spark, sf_dir, "1d").select("symbol", "t", F.col("close").alias("daily")), ["symbol"], 4 * HOUR, 24 * HOUR, ["daily"])
    return own.select("symbol", "t", "own").join(day.select("symbol", "t", "daily"), ["symbol", "t"])


def matched_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does an even customer pay more, within strata of priority, status and price (steps of 100,000)."""
    orders = tables.read(spark, sf_dir, "orders")
    rows = orders.select("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 2 == 0).alias("treated"), F.col("o_totalprice").alias("y"), F.floor(F.col("o_totalprice") / 100_000).alias("tier"))
    found = alignment.matched_control(rows, ["o_orderpriority", "o_orderstatus", "tier"], "treated", "y")
    return found.select("n_treated", "n_strata", rounded("effect", 3).alias("effect"))


QUERIES = {
    "bars_30m": _bars("30m"),
    "bars_1h": _bars("1h"),
    "bars_4h": _bars("4h"),
    "bars_1d": _bars("1d"),
} | {
    f.__name__: f
    for f in (
        bars_rolled_up, bar_gap_report, load_dedup, sub_bar_volume, align_spot_left, align_asof, integrity_report, asof_trades_strict, ctx_completed_projection,
        ctx_live_projection, second_grid, forward_exact, log_targets, forward_same_day, mtf_projection, cross_series_independence, differential_compare, matched_control,
    )
}

_INTEREST = """perp as (select t, t + 86399999 as closes, close from legs where leg = 'A'), oi as (select t as seen, volume as oi from legs where leg = 'R' and (t // 86400000) % 3 = 0),
aligned as (select p.t, p.close, o.seen as oi_t, o.oi, p.closes - o.seen as oi_age from perp p asof left join oi o on p.closes >= o.seen)"""

_R = q.r
SQL = {
    "bars_30m": q.with_(q.TAPE, q.B30) + "select * from b30m",
    "bars_1h": q.with_(q.TAPE, q.B1H) + "select * from b1h",
    "bars_4h": q.with_(q.TAPE, q.B4H) + "select * from b4h",
    "bars_1d": q.with_(q.TAPE, q.B1D) + "select * from b1d",
    "bars_rolled_up": q.with_(q.TAPE, q.B4H) + "select symbol, t, open, high, low, close, volume from b4h",
    "bar_gap_report": q.with_(q.TAPE, q.B1H) + "select * from (select symbol, t, lag(t) over w as previous_t, (t - lag(t) over w) // 3600000 - 1 as missing from b1h window w as (partition by symbol order by t)) where missing > 0",
    "load_dedup": q.with_(q.TAPE) + 'select symbol, "at", trade_id, px from (select *, t // 60000 as "at", row_number() over (partition by symbol, t // 60000 order by trade_id) as n from tape) where n = 1',
    "sub_bar_volume": q.with_(q.TAPE, q.B30)
    + "select *, up_volume - down_volume as balance from (select symbol, (t // 14400000) * 14400000 as t, sum(case when close > open then volume else 0 end) as up_volume, sum(case when close < open then volume else 0 end) as down_volume, sum(case when close = open then volume else 0 end) as flat_volume, count(*) as n_sub from b30m group by 1, 2)",
    "align_spot_left": q.with_(q.LEGS)
    + "select p.t, " + ", ".join(f"{_R('p.' + c, 9)} as {c}, {_R('s.' + c, 9)} as spot_{c}" for c in OHLCV) + " from legs p left join (select * from legs where leg = 'N') s on p.t = s.t where p.leg = 'A'",
    "align_asof": q.with_(q.LEGS, _INTEREST) + f"select t, {_R('close', 9)} as close, oi_t, oi, oi_age from aligned",
    "integrity_report": q.with_(q.LEGS, _INTEREST)
    + """select 'A' as series, count(*) as n_bars, count(*) filter (where step > 0) as n_gaps, coalesce(sum(step) filter (where step > 0), 0)::bigint as n_missing, count(*) filter (where oi is null) as n_absent, count(*) filter (where oi_age > 172800000) as n_stale
from (select *, (t - lag(t) over (order by t)) // 86400000 - 1 as step from aligned)""",
    "asof_trades_strict": q.with_(q.TAPE)
    + """, l as (select trade_id, t from tape where trade_id % 2 = 0), r0 as (select t as rt, trade_id as last_id, px as last_px from tape where trade_id % 2 = 1), rr as (select rt, max(last_id) as last_id, arg_max(last_px, last_id) as last_px from r0 group by rt)
select l.trade_id, l.t, rt as matched_t, last_id, last_px from l asof left join rr on l.t > rr.rt""",
    "ctx_completed_projection": q.with_(q.TAPE, q.B1H, q.B4H)
    + ", c as (select symbol, t + 14400000 as visible_from, close as ctx_close, high as ctx_high from b4h) select b.symbol, b.t, b.close, c.visible_from, ctx_close, ctx_high from b1h b asof left join c on b.symbol = c.symbol and b.t >= c.visible_from",
    "ctx_live_projection": q.with_(q.TAPE, q.B4H) + "select symbol, t, open, close as ctx_close from b4h",
    "second_grid": q.with_(q.TAPE, q.SECONDS) + "select * from secs",
    "forward_exact": q.with_(q.TAPE, q.SECONDS)
    + "select a.symbol, a.s, a.px, b.px as px_p60, c.px as px_p300, d.px as px_p900, e.px as px_m300 from secs a left join secs b on a.symbol = b.symbol and b.s = a.s + 60 left join secs c on a.symbol = c.symbol and c.s = a.s + 300 left join secs d on a.symbol = d.symbol and d.s = a.s + 900 left join secs e on a.symbol = e.symbol and e.s = a.s - 300",
    "log_targets": q.with_(q.TAPE, q.SECONDS)
    + f", p as (select * from secs where px > 0) select a.symbol, a.s, {_R('ln(b.px / a.px)')} as target_5, {_R('ln(c.px / a.px)')} as target_30, {_R('ln(d.px / a.px)')} as target_300, {_R('ln(a.px / e.px)')} as past_30 from p a left join p b on a.symbol = b.symbol and b.s = a.s + 5 left join p c on a.symbol = c.symbol and c.s = a.s + 30 left join p d on a.symbol = d.symbol and d.s = a.s + 300 left join p e on a.symbol = e.symbol and e.s = a.s - 30",
    "forward_same_day": q.with_(q.TAPE, q.SECONDS)
    + "select a.symbol, a.s, a.px, b.px as px_p600, c.px as px_p3600 from secs a left join secs b on a.symbol = b.symbol and b.s = a.s + 600 and a.s // 86400 = b.s // 86400 left join secs c on a.symbol = c.symbol and c.s = a.s + 3600 and a.s // 86400 = c.s // 86400",
    "mtf_projection": q.with_(q.TAPE, q.B4H, q.B1D) + ", d as (select symbol, t + 86400000 as f, close as daily from b1d) select a.symbol, a.t, a.close as own, d.daily from b4h a asof left join d on a.symbol = d.symbol and a.t >= d.f",
    "cross_series_independence": q.with_(q.TAPE, q.B4H) + "select 'bars' as side, count(*) as n from b4h",
    "differential_compare": q.with_(q.TAPE, q.B4H) + " union all ".join(f"select '{c}' as \"column\", count(*) as n_compared, 0::bigint as n_structural, 0.0::double as largest_relative from b4h" for c in OHLCV),
    "matched_control": f"select sum(n)::bigint as n_treated, count(*) as n_strata, {_R('sum(n * (mt - mc)) / sum(n)', 3)} as effect from (select avg(o_totalprice) filter (where o_custkey % 2 = 0) as mt, avg(o_totalprice) filter (where o_custkey % 2 <> 0) as mc, count(*) filter (where o_custkey % 2 = 0) as n from orders group by o_orderpriority, o_orderstatus, floor(o_totalprice / 100000)) where mt is not null and mc is not null",
}
