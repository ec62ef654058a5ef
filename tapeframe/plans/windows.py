"""Queries on rolling windows and ordered recurrences."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import DAY, HOUR, bucket, rounded
from tapeframe.operators import alignment, scans, windows as ops
from tapeframe.plans import sqltext as q
from tapeframe.sources import tables

SYMBOL = partial(ops.by, "symbol")


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars(spark, sf_dir, "4h")


def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four(spark, sf_dir).select("symbol", "t", rounded(ops.true_range(SYMBOL())).alias("tr"))


def rolling_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-bar deviation of log returns and its annualised form."""
    rows = _four(spark, sf_dir).withColumn("ret", ops.log_return(F.col("close"), SYMBOL()))
    sd = ops.deviation(F.col("ret"), 30, SYMBOL())
    return rows.select("symbol", "t", rounded("ret").alias("ret"), rounded(sd).alias("sd30"), rounded(sd * (365 * 6) ** 0.5).alias("vol"))


def sma_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("close", 6).over(SYMBOL())
    return _four(spark, sf_dir).select("symbol", "t", rounded(ops.sma(F.col("close"), 20, SYMBOL())).alias("sma20"), rounded(F.when(before > 0, F.col("close") / before - 1)).alias("mom6"))


def percent_rank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.percent_rank(_four(spark, sf_dir).select("symbol", "t", "close"), ["symbol"], "close", 60, "pr").select("symbol", "t", rounded("pr").alias("pr"))


def donchian_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.breakout(_four(spark, sf_dir), ["symbol"], 20).select("symbol", "t", "close", "prev_high", "prev_low", "breakout")


def slot_rvol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four(spark, sf_dir).select("symbol", "t", rounded(ops.slot_relative_volume(F.col("volume"), SYMBOL())).alias("rvol"))


def slot_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z of volume against the 15 previous bars of the same slot of the day."""
    rows = _four(spark, sf_dir).withColumn("slot", (F.col("t") % DAY / (4 * HOUR)).cast("long"))
    w = W.partitionBy("symbol", "slot").orderBy("t").rowsBetween(-15, -1)
    sd, mean, n = F.stddev_pop("volume").over(w), F.avg("volume").over(w), F.count("volume").over(w)
    return rows.select("symbol", "t", "slot", rounded(F.when((n == 15) & (sd > 0), (F.col("volume") - mean) / sd)).alias("z"))


def session_rvol_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume over the median of the 10 previous days' same hour."""
    rows = tables.bars(spark, sf_dir, "1h").withColumn("slot", (F.col("t") % DAY / HOUR).cast("long"))
    w = W.partitionBy("symbol", "slot").orderBy("t").rowsBetween(-10, -1)
    median = F.when(F.count("volume").over(w) == 10, F.percentile("volume", F.lit(0.5)).over(w))
    return rows.select("symbol", "t", rounded(F.when(median > 0, F.col("volume") / median)).alias("rvol"))


def session_running_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running high and low of each UTC day with the bar that reached them first."""
    rows = tables.bars(spark, sf_dir, "30m").withColumn("day", bucket("t", DAY)).withColumn("i", (F.row_number().over(SYMBOL()) - 1).cast("long"))
    return ops.running_extremes(rows, ["symbol", "day"]).select("symbol", "t", "run_high", "run_high_i", "run_low", "run_low_i")


def forward_mae_mfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.forward_excursions(_four(spark, sf_dir).filter("close > 0"), ["symbol"], 6).select("symbol", "t", rounded("mae").alias("mae"), rounded("mfe").alias("mfe"))


def pivots_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.relative_strength(ops.pivots(_four(spark, sf_dir), ["symbol"], 3, 3), ["symbol"], 14)
    return rows.select("symbol", "t", "pivot_high", "pivot_low", rounded("rsi").alias("rsi"))


def autocovariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _four(spark, sf_dir).withColumn("ret", ops.log_return(F.col("close"), SYMBOL())).filter("ret is not null")
    found = ops.autocovariances(rows, ["symbol"], "ret", 5)
    return found.select("symbol", "n", *[rounded(f"acov_{k}").alias(f"acov_{k}") for k in range(6)])


def rolling_median_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _four(spark, sf_dir).withColumn("range", F.col("high") - F.col("low")).filter("range > 0")
    return rows.select("symbol", "t", rounded(ops.rolling_median_clamped(F.col("range"), 30, SYMBOL(), 0.5, 1.5)).alias("multiplier"))


def daily_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.anchored_vwap(tables.bars(spark, sf_dir, "30m"), ["symbol"]).select("symbol", "t", rounded("vwap", 9).alias("vwap"))


def flow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggressor flow in the last 5, 30 and 120 minutes of each trade."""
    found = ops.flow(tables.tape(spark, sf_dir), ["symbol"], [300_000, 1_800_000, 7_200_000])
    keep = [rounded(f"{c}_{w}", 4).alias(f"{c}_{w}") for w in (300_000, 1_800_000, 7_200_000) for c in ("buy", "sell", "afi")]
    return found.select("trade_id", *keep, "n_300000", "n_1800000", "n_7200000")


def valid_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z and percentile of the close over 60 rows, every tenth value missing."""
    rows = _four(spark, sf_dir).withColumn("x", F.when(F.col("trades") % 10 != 0, F.col("close")))
    found = ops.valid_norm(rows, ["symbol"], "x", n=60, least=30)
    return found.select("symbol", "t", "x", "n_valid", rounded("z").alias("z"), rounded("pct").alias("pct"))


def flow_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sums of a sparse flow: last 5 valid in 20 rows, nulls as zero over 30 rows, every sixth of 5."""
    x = F.col("x")
    rows = _four(spark, sf_dir).withColumn("x", F.when(F.col("trades") % 3 != 0, F.col("volume")))
    return rows.select(
        "symbol",
        "t",
        rounded(ops.sum_last_valid(x, 5, 20, SYMBOL())).alias("last5"),
        rounded(F.sum(F.coalesce(x, F.lit(0.0))).over(ops.frame(SYMBOL(), 30))).alias("sum30"),
        rounded(ops.strided_sum(x, 6, 5, SYMBOL())).alias("strided"),
    )


def demeaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.bars(spark, sf_dir, "1h").withColumn("slot", (F.col("t") % DAY / HOUR).cast("long"))
    return rows.select("symbol", "t", rounded(ops.demeaned(rows, ["symbol", "slot"], "close")).alias("x"))


def wilder_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _four(spark, sf_dir).withColumn("tr", ops.true_range(SYMBOL())).select("symbol", "t", "tr")
    return scans.smoothed(rows, ["symbol"], "t", "tr", 14, 1 / 14, "atr", block=10 * DAY).select("symbol", "t", rounded("atr").alias("atr"))


def ema_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _four(spark, sf_dir).select("symbol", "t", "close")
    return scans.smoothed(rows, ["symbol"], "t", "close", 20, 2 / 21, "ema", block=7 * DAY).select("symbol", "t", rounded("ema").alias("ema"))


def ema_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-value average over valid values only; it holds where there is none."""
    rows = _four(spark, sf_dir).select("symbol", "t", F.when(F.col("trades") % 4 != 0, F.col("close")).alias("x"))
    return scans.smoothed(rows, ["symbol"], "t", "x", 2, 2 / 3, "ema", block=5 * DAY).select("symbol", "t", "x", rounded("ema").alias("ema"))


def daily_prev_sma_mom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's 200-day mean and 85-day momentum on the bars of the following day."""
    w = W.partitionBy("series").orderBy("t")
    days = tables.daily(spark, sf_dir).withColumn("series", F.lit("ORD"))
    before = F.lag("close", 84).over(w)
    rows = days.withColumn("sma", ops.sma(F.col("close"), 200, w)).withColumn("mom", F.when(before > 0, F.col("close") / before - 1))
    context = rows.select("series", "t", F.lag("sma").over(w).alias("sma200"), F.lag("mom").over(w).alias("mom85"), F.lag("t").over(w).alias("from_t"))
    chart = days.select("series", "t", "close")
    found = alignment.live_context(chart, context, ["series"], ["sma200", "mom85", "from_t"])
    return found.select("t", "from_t", rounded("close").alias("close"), rounded("sma200").alias("sma200"), rounded("mom85").alias("mom85"))


def oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative strength by Wilder's means of 14 changes, and the distance of the 12- and 26-bar means with its 9-bar signal."""
    change = F.col("close") - F.lag("close").over(SYMBOL())
    rows = _four(spark, sf_dir).select("symbol", "t", "close", F.greatest(change, F.lit(0.0)).alias("gain"), F.greatest(-change, F.lit(0.0)).alias("loss"))
    rows = rows.withColumn("gain", F.when(change.isNotNull(), F.col("gain"))).withColumn("loss", F.when(change.isNotNull(), F.col("loss")))
    for value, n, alpha, to in (("gain", 14, 1 / 14, "up"), ("loss", 14, 1 / 14, "down"), ("close", 12, 2 / 13, "fast"), ("close", 26, 2 / 27, "slow")):
        rows = scans.smoothed(rows, ["symbol"], "t", value, n, alpha, to, block=30 * DAY)
    rows = rows.withColumn("macd", F.col("fast") - F.col("slow"))
    rows = scans.smoothed(rows, ["symbol"], "t", "macd", 9, 0.2, "signal", block=30 * DAY)
    rsi = F.when(F.col("up") + F.col("down") > 0, 100 * F.col("up") / (F.col("up") + F.col("down")))
    return rows.select("symbol", "t", rounded(rsi, 4).alias("rsi"), rounded("macd", 4).alias("macd"), rounded("signal", 4).alias("signal"))


def range_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes that come back above their exponential mean of 20 bars, and the opening range of each day with later breaks of it."""
    mean = scans.smoothed(_four(spark, sf_dir).select("symbol", "t", "close"), ["symbol"], "t", "close", 20, 2 / 21, "ema", block=10 * DAY).select("symbol", "t", "ema")
    rows = _four(spark, sf_dir).join(mean, ["symbol", "t"]).withColumn("above", F.col("close") > F.col("ema"))
    crossed = F.coalesce(F.col("above") & ~F.lag("above").over(SYMBOL()), F.lit(False))
    day = W.partitionBy("symbol", "day").orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("reclaim", crossed).withColumn("day", bucket("t", DAY)).withColumn("open_high", F.first("high").over(day))
    later = F.col("t") > F.first("t").over(day)
    return rows.select("symbol", "t", "reclaim", "open_high", (later & (F.col("close") > F.col("open_high"))).alias("broke"))


QUERIES = {
    f.__name__: f
    for f in (
        true_range, rolling_vol, sma_momentum, percent_rank_window, donchian_prev, slot_rvol, slot_z, session_rvol_median, session_running_extremes, forward_mae_mfe, pivots_rsi, autocovariance,
        rolling_median_clamp, daily_vwap, flow_windows, valid_norm, flow_sums, demeaned, wilder_atr, ema_close, ema_valid, daily_prev_sma_mom, range_reclaim, oscillators,
    )
}

_r = q.r
_4 = q.with_(q.TAPE, q.B4H)
_W = " window w as (partition by symbol order by t)"
_RET = "rets as (select *, case when row_number() over w = 1 then 0.0 when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as ret from b4h window w as (partition by symbol order by t))"
_TR = "trs as (select symbol, t, case when lag(close) over w is null then high - low else greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr, close, trades from b4h window w as (partition by symbol order by t))"


def _fold(source: str, value: str, n: int, alpha: str, name: str, extra: str = "") -> str:
    """Recursive SQL of the exponential average over valid values."""
    return f"""numbered as (select symbol, t, {value} as x, row_number() over (partition by symbol order by t) as i from {source}),
valid as (select symbol, i, x, row_number() over (partition by symbol order by i) as k from numbered where x is not null),
fold as (select symbol, k, (select avg(x) from valid v where v.symbol = s.symbol and v.k <= {n}) as y from valid s where k = {n}
  union all select v.symbol, v.k, f.y + {alpha} * (v.x - f.y) from fold f join valid v on v.symbol = f.symbol and v.k = f.k + 1)
select n.symbol, n.t, {extra}{_r('last_value(f.y ignore nulls) over (partition by n.symbol order by n.i rows between unbounded preceding and current row)')} as {name}
from numbered n left join valid v on n.symbol = v.symbol and n.i = v.i left join fold f on f.symbol = v.symbol and f.k = v.k"""


def _plain_fold(source: str, value: str, n: int, alpha: str, name: str) -> str:
    """_fold without rounding."""
    said = "last_value(f.y ignore nulls) over (partition by n.symbol order by n.i rows between unbounded preceding and current row)"
    return _fold(source, value, n, alpha, name).replace(_r(said), said)


_FLOW = ", ".join(
    f"{_r(f'coalesce(sum(case when aggressive_buy then px * qty else 0 end) over w{i}, 0)', 4)} as buy_{ms}, {_r(f'coalesce(sum(case when not aggressive_buy then px * qty else 0 end) over w{i}, 0)', 4)} as sell_{ms}, "
    f"{_r(f'case when sum(px * qty) over w{i} > 0 then sum(case when aggressive_buy then px * qty else -px * qty end) over w{i} / sum(px * qty) over w{i} else 0 end', 4)} as afi_{ms}, count(*) over w{i} as n_{ms}"
    for i, ms in enumerate((300_000, 1_800_000, 7_200_000))
)
_FLOW_W = ", ".join(f"w{i} as (partition by symbol order by t range between {ms} preceding and current row)" for i, ms in enumerate((300_000, 1_800_000, 7_200_000)))
_PREV = "rows between 20 preceding and 1 preceding"

SQL = {
    "true_range": q.with_(q.TAPE, q.B4H, _TR) + f"select symbol, t, {_r('tr')} as tr from trs",
    "rolling_vol": q.with_(q.TAPE, q.B4H, _RET)
    + f"select symbol, t, {_r('ret')} as ret, {_r('sd')} as sd30, {_r('sd * sqrt(2190)')} as vol from (select *, case when count(ret) over f = 30 then stddev_pop(ret) over f end as sd from rets window f as (partition by symbol order by t rows between 29 preceding and current row))",
    "sma_momentum": _4
    + f"select symbol, t, {_r('case when count(close) over f = 20 then avg(close) over f end')} as sma20, {_r('case when lag(close, 6) over w > 0 then close / lag(close, 6) over w - 1 end')} as mom6 from b4h window w as (partition by symbol order by t), f as (partition by symbol order by t rows between 19 preceding and current row)",
    "percent_rank_window": _4
    + f", n as (select *, row_number() over (partition by symbol order by t) as i from b4h) select a.symbol, a.t, {_r('case when count(b.close) = 60 then count(*) filter (where b.close <= a.close) * 100.0::double / 60 end')} as pr from n a left join n b on a.symbol = b.symbol and b.i between a.i - 60 and a.i - 1 group by a.symbol, a.t",
    "donchian_prev": _4
    + f"select symbol, t, close, ph as prev_high, pl as prev_low, case when close > ph then 1 when close < pl then -1 else 0 end as breakout from (select *, case when count(*) over f = 20 then max(high) over f end as ph, case when count(*) over f = 20 then min(low) over f end as pl from b4h window f as (partition by symbol order by t {_PREV}))",
    "slot_rvol": _4
    + f", n as (select *, row_number() over (partition by symbol order by t) as i from b4h) select a.symbol, a.t, {_r('case when count(b.volume) >= 5 then a.volume / avg(b.volume) end')} as rvol from n a left join n b on a.symbol = b.symbol and b.i < a.i and (a.i - b.i) % 6 = 0 and a.i - b.i <= 168 and b.volume > 0 group by a.symbol, a.t, a.volume",
    "slot_z": _4
    + f"select symbol, t, slot, {_r('case when count(volume) over f = 15 and stddev_pop(volume) over f > 0 then (volume - avg(volume) over f) / stddev_pop(volume) over f end')} as z from (select *, (t % 86400000) // 14400000 as slot from b4h) window f as (partition by symbol, slot order by t rows between 15 preceding and 1 preceding)",
    "session_rvol_median": q.with_(q.TAPE, q.B1H)
    + f"select symbol, t, {_r('case when count(volume) over f = 10 and median(volume) over f > 0 then volume / median(volume) over f end')} as rvol from (select *, (t % 86400000) // 3600000 as slot from b1h) window f as (partition by symbol, slot order by t rows between 10 preceding and 1 preceding)",
    "session_running_extremes": q.with_(q.TAPE, q.B30)
    + """, n as (select *, row_number() over (partition by symbol order by t) - 1 as i, t // 86400000 as d from b30m)
select symbol, t, max(high) over f as run_high, arg_max(i, high) over f as run_high_i, min(low) over f as run_low, arg_min(i, low) over f as run_low_i from n window f as (partition by symbol, d order by t rows between unbounded preceding and current row)""",
    "forward_mae_mfe": _4
    + f"select symbol, t, {_r('case when count(*) over f = 6 then min(low) over f / close - 1 end')} as mae, {_r('case when count(*) over f = 6 then max(high) over f / close - 1 end')} as mfe from b4h where close > 0 window f as (partition by symbol order by t rows between 1 following and 6 following)",
    "pivots_rsi": _4
    + f""", d as (select *, close - lag(close) over w as d, lag(high, 3) over w as ch, lag(low, 3) over w as cl from b4h{_W})
select symbol, t, case when count(*) over f = 7 and ch > greatest(max(high) over a, max(high) over b) then ch end as pivot_high, case when count(*) over f = 7 and cl < least(min(low) over a, min(low) over b) then cl end as pivot_low,
 {_r('case when count(d) over g = 14 and sum(abs(d)) over g > 0 then 100 * sum(greatest(d, 0)) over g / sum(abs(d)) over g end')} as rsi from d
window f as (partition by symbol order by t rows between 6 preceding and current row), a as (partition by symbol order by t rows between 6 preceding and 4 preceding), b as (partition by symbol order by t rows between 2 preceding and current row), g as (partition by symbol order by t rows between 13 preceding and current row)""",
    "autocovariance": q.with_(q.TAPE, q.B4H, _RET)
    + ", e as (select symbol, t, ret - avg(ret) over (partition by symbol) as e from rets where ret is not null), p as (select symbol, "
    + ", ".join(f"e * lag(e, {k}) over w as p{k}" if k else "e * e as p0" for k in range(6))
    + f" from e{_W}) select symbol, count(*) as n, "
    + ", ".join(f"{_r(f'sum(p{k}) / count(*)')} as acov_{k}" for k in range(6))
    + " from p group by symbol",
    "rolling_median_clamp": _4
    + f"select symbol, t, {_r('least(greatest(case when count(*) over f = 30 then median(rng) over f end / rng, 0.5), 1.5)')} as multiplier from (select *, high - low as rng from b4h) where rng > 0 window f as (partition by symbol order by t rows between 29 preceding and current row)",
    "daily_vwap": q.with_(q.TAPE, q.B30) + f"select symbol, t, {_r('sum(close * volume) over f / sum(volume) over f', 9)} as vwap from b30m window f as (partition by symbol, t // 86400000 order by t rows between unbounded preceding and current row)",
    "flow_windows": q.with_(q.TAPE) + f"select trade_id, {_FLOW} from tape window {_FLOW_W}",
    "valid_norm": _4
    + f""", n as (select *, case when trades % 10 <> 0 then close end as x, row_number() over (partition by symbol order by t) as i from b4h)
select a.symbol, a.t, a.x, count(b.x) as n_valid, {_r('case when a.x is not null and count(b.x) >= 30 then case when stddev_pop(b.x) > 0 then (a.x - avg(b.x)) / stddev_pop(b.x) else 0 end end')} as z,
 {_r('case when a.x is not null and count(b.x) >= 30 then count(*) filter (where b.i < a.i and b.x <= a.x) * 100.0::double / (count(b.x) - 1) end')} as pct
from n a join n b on a.symbol = b.symbol and b.i between a.i - 59 and a.i group by a.symbol, a.t, a.x, a.i""",
    "flow_sums": _4
    + f""", n as (select *, case when trades % 3 <> 0 then volume end as x, row_number() over (partition by symbol order by t) as i from b4h),
k as (select a.symbol, a.i, b.x, row_number() over (partition by a.symbol, a.i order by b.i desc) as k from n a join n b on a.symbol = b.symbol and b.i between a.i - 19 and a.i and b.x is not null),
l as (select symbol, i, sum(x) as s from k where k <= 5 group by symbol, i having count(*) = 5)
select n.symbol, n.t, {_r('l.s')} as last5, {_r('sum(coalesce(x, 0)) over (partition by n.symbol order by n.i rows between 29 preceding and current row)')} as sum30,
 {_r('x + lag(x, 6) over w + lag(x, 12) over w + lag(x, 18) over w + lag(x, 24) over w')} as strided from n left join l on n.symbol = l.symbol and n.i = l.i window w as (partition by n.symbol order by n.i)""",
    "demeaned": q.with_(q.TAPE, q.B1H) + f"select symbol, t, {_r('close - avg(close) over (partition by symbol, (t % 86400000) // 3600000)')} as x from b1h",
    "wilder_atr": q.with_(q.TAPE, q.B4H, _TR, recursive=True).rstrip() + ",\n" + _fold("trs", "tr", 14, "(1.0::double / 14)", "atr"),
    "ema_close": q.with_(q.TAPE, q.B4H, recursive=True).rstrip() + ",\n" + _fold("b4h", "close", 20, "(2.0::double / 21)", "ema"),
    "ema_valid": q.with_(q.TAPE, q.B4H, recursive=True).rstrip() + ",\n" + _fold("b4h", "case when trades % 4 <> 0 then close end", 2, "(2.0::double / 3)", "ema", "n.x, "),
    "daily_prev_sma_mom": q.with_(q.DAILY)
    + f""", s as (select t, close, case when count(*) over f = 200 then avg(close) over f end as sma, case when lag(close, 84) over w > 0 then close / lag(close, 84) over w - 1 end as mom from daily window w as (order by t), f as (order by t rows between 199 preceding and current row))
select t, lag(t) over w as from_t, {_r('close')} as close, {_r('lag(sma) over w')} as sma200, {_r('lag(mom) over w')} as mom85 from s window w as (order by t)""",
    "oscillators": q.with_(q.TAPE, q.B4H)
    + ", ch as (select *, close - lag(close) over (partition by symbol order by t) as d from b4h), gl as (select symbol, t, close, case when d is not null then greatest(d, 0) end as gain, case when d is not null then greatest(-d, 0) end as loss from ch), "
    + ", ".join(f"o_{name} as (with recursive {_plain_fold('gl', value, n, alpha, name)})" for name, value, n, alpha in (("up", "gain", 14, "(1.0::double / 14)"), ("down", "loss", 14, "(1.0::double / 14)"), ("fast", "close", 12, "(2.0::double / 13)"), ("slow", "close", 26, "(2.0::double / 27)")))
    + ", mc as (select symbol, t, up, down, fast - slow as macd from o_up join o_down using (symbol, t) join o_fast using (symbol, t) join o_slow using (symbol, t)), "
    + f"o_signal as (with recursive {_plain_fold('mc', 'macd', 9, '0.2::double', 'signal')}) select symbol, t, {_r('case when up + down > 0 then 100 * up / (up + down) end', 4)} as rsi, {_r('macd', 4)} as macd, {_r('signal', 4)} as signal from mc join o_signal using (symbol, t)",
    "range_reclaim": q.with_(q.TAPE, q.B4H, recursive=True).rstrip()
    + ",\n"
    + ",\nem as (select n.symbol".join(_plain_fold("b4h", "close", 20, "(2.0::double / 21)", "ema").rsplit("select n.symbol", 1))
    + """), s as (select b4h.*, close > ema as above, first(high) over d as open_high, first(b4h.t) over d as first_t from b4h join em on em.symbol = b4h.symbol and em.t = b4h.t
 window d as (partition by b4h.symbol, b4h.t // 86400000 order by b4h.t rows between unbounded preceding and unbounded following))
select symbol, t, coalesce(above and not lag(above) over (partition by symbol order by t), false) as reclaim, open_high, t > first_t and close > open_high as broke from s""",
}
