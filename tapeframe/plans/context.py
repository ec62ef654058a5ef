"""Queries on market context: measures, rarity, anomalies, mechanics, texts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions import text
from tapeframe.functions.columns import DAY, rounded
from tapeframe.operators import context as ops, scans, state, windows
from tapeframe.plans import sqltext as q
from tapeframe.sources import tables

SERIES = partial(windows.by, "k")
MEASURES = list(ops.NAMES)
#: Rows that a measure is compared with, and the fewest of them.
NORM = (180, 45)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perp days with spot, open interest and the measures derived from them."""
    named = {"A": "perp", "N": "spot", "R": "oi"}
    leg = [F.max(F.when(F.col("leg") == code, F.col(c))).alias(f"{name}_{c}") for code, name in named.items() for c in ("close", "volume", "high", "low")]
    rows = tables.legs(spark, sf_dir).groupBy("t").agg(*leg).filter("perp_volume is not null").withColumn("k", F.lit(1))  # one scan for all legs
    currency = F.when(F.col("t") / 86_400_000 % 11 == 0, "USDT").otherwise("BTC")
    c = F.col
    rows = rows.withColumn("oi", ops.usable_interest(c("oi_volume"), currency))
    rows = rows.withColumn("spot_rvol", windows.slot_relative_volume(c("spot_volume"), SERIES(), step=1, slots=10)).withColumn("perp_rvol", windows.slot_relative_volume(c("perp_volume"), SERIES(), step=1, slots=10))
    unit = F.when(c("t") / 86_400_000 % 3 == 0, "fraction").when(c("t") / 86_400_000 % 3 == 1, "percent").otherwise("bp")
    scaled = (c("perp_close") / c("spot_close") - 1) / F.element_at(F.create_map(*[F.lit(x) for p in ops.FUNDING_UNITS.items() for x in p]), unit)
    return rows.select(
        "k", "t", "perp_close", "spot_close", "oi", "spot_rvol", "perp_rvol",
        rounded(ops.change(c("oi"), 1, SERIES())).alias("oi1"), rounded(ops.change(c("oi"), 6, SERIES())).alias("oi6"), rounded(ops.change(c("perp_close"), 6, SERIES())).alias("px6"),
        rounded(ops.premium(c("perp_close"), c("spot_close"))).alias("premium"), rounded(ops.participation(c("spot_rvol"), c("perp_rvol"))).alias("participation"),
        rounded(ops.canonical_funding(scaled, unit)).alias("funding"),
        rounded(windows.sum_last_valid(F.when(c("oi_volume") % 2 == 0, c("perp_volume") - c("spot_volume")), 5, 90, SERIES())).alias("etf"),
        rounded(ops.liquidation_balance(c("perp_high") - c("perp_close"), c("perp_close") - c("perp_low"), F.lit(True))).alias("liquidations"),
        rounded(c("perp_high") - c("perp_close"), 3).alias("long_liq"), rounded(c("perp_close") - c("perp_low"), 3).alias("short_liq"),
    )


def context_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).drop("k").withColumns({c: rounded(c, 7) for c in ("perp_close", "spot_close", "spot_rvol", "perp_rvol")})


def _normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = ops.stacked(_measured(spark, sf_dir).withColumns({c: rounded(c) for c in ("spot_rvol", "perp_rvol")}), ["t"], MEASURES)
    found = ops.normed(long, *NORM)
    return found.select("t", "measure", "x", "n_valid", rounded("z", 4).alias("z"), rounded("pct", 4).alias("pct"))


def context_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normed(spark, sf_dir)


def _by_measure(values: dict, k: int | None = None):
    pairs = [F.lit(x) for m, v in values.items() for x in (m, v if k is None else v[k])]
    return F.element_at(F.create_map(*pairs), F.col("measure"))


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level (of a ladder or an impulse), direction, extremeness, priority and words of each measure."""
    rows = state.ladder(_normed(spark, sf_dir), ["measure"], "z", *[_by_measure(ops.LADDERS, k) for k in range(4)], to="rung")
    impulse = state.impulse(F.col("z"), _by_measure(ops.IMPULSES, 0), _by_measure(ops.IMPULSES, 1))
    level = F.when(F.col("measure").isin(*ops.IMPULSES), impulse).otherwise(F.col("rung"))
    upper = F.col("measure").isin("long_liq", "short_liq") & ~F.coalesce(F.col("z") > 0, F.lit(False))  # liquidations end at zero: only many are an event
    sign = F.when(F.col("measure").isin("participation", "spot_rvol", "perp_rvol"), ops.direction(F.col("z"))).otherwise(ops.direction(F.col("x")))
    rows = rows.withColumn("level", F.when(upper, 0).otherwise(level)).withColumn("sign", sign).withColumn("ext", ops.extremeness(F.col("pct"), F.col("z"))).withColumn("key", ops.priority_key(_by_measure(ops.PRIORITY), F.col("pct")))
    words = (F.col("measure"), F.col("level"), F.col("sign"))
    place = F.array_position(F.array(*map(F.lit, MEASURES)), F.col("measure"))
    return rows.withColumn("phrase", ops.phrase(*words)).withColumn("sentence", ops.sentence(*words)).withColumn("place", place).withColumn("name", _by_measure(ops.NAMES)).drop("rung", "rung_before")


def context_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levelled(spark, sf_dir).select("t", "measure", "level", "sign", "phrase", "sentence", rounded("ext", 4).alias("ext"))


def anomalies_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most extreme engaged measures of each day, five at most, and the day's count."""
    rows = _levelled(spark, sf_dir).filter("level > 0 and z is not null")
    w = W.partitionBy("t")
    nth = F.row_number().over(w.orderBy(F.desc("ext"), "place"))
    return rows.withColumn("n", F.count("*").over(w)).withColumn("nth", nth).filter("nth <= 5").select("t", "nth", "n", F.concat_ws(" ", "name", "phrase").alias("line"), rounded("ext", 4).alias("ext"))


def trend_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each day's close from its 200-day mean in average true ranges, the state it holds, and the trend word."""
    rows = tables.legs(spark, sf_dir).filter("leg = 'A'").withColumn("k", F.lit(1)).withColumn("tr", windows.true_range(SERIES()))
    rows = scans.smoothed(rows.select("k", "t", "close", "tr"), ["k"], "t", "tr", 14, 1 / 14, "atr", block=200 * DAY)
    mean, mom = windows.sma(F.col("close"), 200, SERIES()), ops.change(F.col("close"), 84, SERIES())
    rows = rows.withColumn("dist", F.when(F.col("atr") > 0, rounded((F.col("close") - mean) / F.col("atr"), 4))).withColumn("mom", rounded(mom))
    held = scans.automaton(rows.select("k", "t", "dist"), ["k"], "t", "dist", [-1, 0, 1], 0, state.schmitt_step(*ops.TREND), "state", block=200 * DAY)
    rows = rows.select("t", "mom").join(held, "t")
    score = ops.trend_score(F.col("state"), F.col("mom"))
    return rows.select("t", "dist", "mom", "state", "state_before", ops.trend_phrase(F.col("state")).alias("phrase"), score.alias("score"), ops.trend_word(score, F.col("dist").isNotNull() & F.col("mom").isNotNull()).alias("word"))


def watch_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of the smallest priority key of each day; a change of the trend state competes at 5900."""
    best = _levelled(spark, sf_dir).filter("level > 0 and z is not null").groupBy("t").agg(F.min(F.struct("key", "place", "sentence")).alias("best"))
    days = trend_states(spark, sf_dir).join(best, "t", "left")
    trend = (F.col("state") != F.col("state_before")) & (F.coalesce(F.col("best.key"), F.lit(99_000.0)) > 5900)
    line = F.when(trend & (F.col("word") != "No data"), ops.trend_sentence(F.col("word"))).otherwise(F.col("best.sentence"))
    return days.select("t", F.coalesce(line, F.lit("")).alias("line"), F.col("word").alias("trend"))


def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positioning word of each day's open interest, and the number beside it."""
    rows = _levelled(spark, sf_dir).filter("measure = 'oi6'")
    word = ops.positioning_word(F.col("x").isNotNull(), F.col("level"), F.col("sign"))
    return rows.select("t", word.alias("word"), F.when(F.col("x").isNull(), "").otherwise(F.concat(F.lit("OI "), text.percent(F.col("x"), 4), F.lit(" / 24H"))).alias("number"))


def mechanics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against open interest: label, sentence, and what stood beside it."""
    rows = _measured(spark, sf_dir).select("t", "px6", "oi6")
    beside = ("funding", "premium", "perp_rvol")
    wide = _levelled(spark, sf_dir).filter(F.col("measure").isin(*beside)).groupBy("t").pivot("measure", list(beside)).agg(F.first(F.struct("x", "z", "level", "sign")))
    triple = lambda m, value: (F.col(m)[value], F.col(m)["level"], F.col(m)["sign"])
    note = ops.mechanics_note(triple("funding", "x"), triple("premium", "x"), triple("perp_rvol", "z"))
    return rows.join(wide, "t").select("t", ops.mechanics(F.col("px6"), F.col("oi6")).alias("label"), ops.mechanics_sentence(F.col("px6"), F.col("oi6")).alias("sentence"), note.alias("note"))


def _volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, close, the average true range, it in parts of the close, the 30-day deviation of returns, and its percentile among 365 days before."""
    rows = tables.legs(spark, sf_dir).filter("leg = 'A'").withColumn("k", F.lit(1)).withColumn("tr", windows.true_range(SERIES()))
    rows = scans.smoothed(rows.select("k", "t", "close", "tr"), ["k"], "t", "tr", 14, 1 / 14, "atr", block=200 * DAY).withColumn("atr", rounded("atr", 9))
    rows = rows.withColumn("sd", rounded(windows.deviation(windows.log_return(F.col("close"), SERIES()), 30, SERIES())))
    rows = windows.percent_rank(rows.select("k", "t", "close", "atr", "sd"), ["k"], "sd", 365, "pct")
    return rows.select("t", "close", "atr", rounded(F.col("atr") / F.col("close")).alias("atr_pct"), "sd", rounded("pct", 4).alias("pct")).withColumn("word", ops.volatility_word(F.col("pct")))


def volatility_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volatility word of the percentile of the 30-day deviation in a year, and the average true range in parts of the price."""
    return _volatility(spark, sf_dir).select("t", "atr_pct", "sd", "pct", "word")


def measure_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change kinds of each measure and their texts."""
    rows = _levelled(spark, sf_dir)
    w = W.partitionBy("measure").orderBy("t")
    rows = rows.withColumn("pl", F.coalesce(F.lag("level").over(w), F.lit(0))).withColumn("pd", F.coalesce(F.lag("sign").over(w), F.lit(0)))
    kind = state.change_kind(F.col("level"), F.col("sign"), F.col("pl"), F.col("pd"))
    said = F.when(kind == 1, F.concat("name", F.lit(" entered "), F.lower("phrase"))).when(kind == 2, F.concat("name", F.lit(" returned to normal"))).when(kind == 3, F.concat("name", F.lit(" changed to "), F.lower("phrase")))
    return rows.select("t", "measure", kind.alias("kind"), said.alias("said")).filter("kind > 0")


def state_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels and signs of a day in one number."""
    rows = _levelled(spark, sf_dir)
    wide = rows.groupBy("t").pivot("measure", MEASURES).agg(F.first(F.col("level") * 3 + F.col("sign") + 1))
    return wide.select("t", ops.packed([(F.col(m), 9) for m in MEASURES]).alias("pack"))


def gated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open interest as an observation only on days it changed, and its deviation from the mean of the last 7 of them."""
    rows = _measured(spark, sf_dir).withColumn("seen", F.when(~F.col("oi").eqNullSafe(F.lag("oi").over(SERIES())), F.col("oi")))
    mean = windows.sum_last_valid(F.col("seen"), 7, 30, SERIES()) / 7
    return rows.select("t", "seen", rounded(F.when(mean > 0, F.col("seen") / mean - 1)).alias("deviation"))


def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of prices and changes."""
    rows = tables.read(spark, sf_dir, "orders")
    x = (F.col("o_totalprice") - 150_000).alias("x")
    y = F.round(F.col("o_totalprice") / 1000) / 64
    return rows.select(
        "o_orderkey", text.number(y).alias("two"), text.signed(x).alias("signed"), text.percent(y / 100, 4).alias("percent"), text.compact(F.col("o_totalprice") * 37).alias("compact"),
        text.grouped(F.col("o_totalprice")).alias("grouped"), text.dollars(F.round(x), sign=True).alias("dollars"), text.r_units(y).alias("r"), text.rank(F.when(F.col("o_orderkey") % 20 == 0, y)).alias("rank"),
    )


def colour_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _levelled(spark, sf_dir).withColumn("said", F.concat("phrase", F.lit(" [σ]")))
    return rows.groupBy(text.colour_class(F.col("said")).alias("class"), "said").agg(F.count("*").alias("n"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last day's panel at each of three details; a row is there only if its detail asks for it."""
    rows = _levelled(spark, sf_dir)
    last = rows.agg(F.max("t").alias("t"))
    rows = rows.join(F.broadcast(last), "t")  # last is one row
    details = F.explode(F.array(*[F.struct(F.lit(d).alias("detail"), F.lit(least).alias("least")) for d, least in (("compact", 2), ("standard", 1), ("full", 0))]))
    shown = rows.select(details.alias("d"), "measure", "level", "phrase", "x").filter("level >= d.least")
    position = F.row_number().over(W.partitionBy("d.detail").orderBy(F.desc("level"), "measure"))
    return shown.select(F.col("d.detail").alias("detail"), position.alias("row"), "measure", "phrase", text.signed(F.col("x"), 4).alias("value")).filter("row <= 76")


QUERIES = {
    f.__name__: f
    for f in (
        context_measures, context_norms, context_levels, anomalies_ranked, trend_states, watch_line, positioning, mechanics, volatility_words, measure_changes, state_packs, gated_observations, formatted_numbers, colour_classes, dashboard,
    )
}

_r = q.r
_RV = lambda c: f"case when count(case when {c} > 0 then 1 end) over f >= 5 then {c} / avg(case when {c} > 0 then {c} end) over f end"
_M = f"""w0 as (select a.t, a.close as perp_close, a.volume as pv, a.high as ph, a.low as pl, n.close as spot_close, n.volume as sv, case when r.volume > 0 and r.volume <= 5000000 and a.t // 86400000 % 11 <> 0 then r.volume end as oi, r.volume as ov
 from (select * from legs where leg = 'A') a left join (select * from legs where leg = 'N') n on a.t = n.t left join (select * from legs where leg = 'R') r on a.t = r.t),
w1 as (select *, row_number() over (order by t) as i, {_RV('sv')} as spot_rvol, {_RV('pv')} as perp_rvol from w0 window f as (order by t rows between 10 preceding and 1 preceding)),
ek as (select a.i, b.x, row_number() over (partition by a.i order by b.i desc) as n from w1 a join (select i, case when ov % 2 = 0 then pv - sv end as x from w1) b on b.i between a.i - 89 and a.i and b.x is not null),
es as (select i, sum(x) as etf from ek where n <= 5 group by i having count(*) = 5),
m as (select t, i, perp_close, spot_close, oi, spot_rvol, perp_rvol, {_r('case when lag(oi, 1) over w > 0 then oi / lag(oi, 1) over w - 1 end')} as oi1, {_r('case when lag(oi, 6) over w > 0 then oi / lag(oi, 6) over w - 1 end')} as oi6,
 {_r('case when lag(perp_close, 6) over w > 0 then perp_close / lag(perp_close, 6) over w - 1 end')} as px6, {_r('case when spot_close > 0 then perp_close / spot_close - 1 end')} as premium, {_r('case when spot_rvol > 0 and perp_rvol > 0 then ln(spot_rvol / perp_rvol) end')} as participation,
 {_r('perp_close / spot_close - 1')} as funding, {_r('etf')} as etf, {_r('case when ph - pl > 0 then ((ph - perp_close) - (perp_close - pl)) / (ph - pl) end')} as liquidations, {_r('ph - perp_close', 3)} as long_liq, {_r('perp_close - pl', 3)} as short_liq from w1 left join es using (i) window w as (order by t))"""
_N = f"""lg as (select t, i, unnest([{', '.join(repr(x) for x in MEASURES)}]) as measure, unnest([{', '.join(_r(x) if x.endswith('rvol') else x for x in MEASURES)}]) as x from m),
nz as (select a.t, a.i, a.measure, a.x, count(b.x) as n_valid, {_r(f'case when a.x is not null and count(b.x) >= {NORM[1]} then case when stddev_pop(b.x) > 0 then (a.x - avg(b.x)) / stddev_pop(b.x) else 0 end end', 4)} as z,
 {_r(f'case when a.x is not null and count(b.x) >= {NORM[1]} then count(*) filter (where b.i < a.i and b.x <= a.x) * 100.0::double / (count(b.x) - 1) end', 4)} as pct
 from lg a join lg b on a.measure = b.measure and b.i between a.i - {NORM[0] - 1} and a.i group by a.t, a.i, a.measure, a.x)"""
_PRIO = "case measure " + " ".join(f"when '{m}' then {p}" for m, p in ops.PRIORITY.items()) + " end"
_CASE = lambda values, k=None: "case measure " + " ".join(f"when '{m}' then {v if k is None else v[k]}" for m, v in values.items()) + " end"
_UP = lambda up, down, flat: f"case when sign > 0 then '{up}' when sign < 0 then '{down}' else '{flat}' end"
_WORD = "case when level >= 2 then 'EXTREME' else 'UNUSUAL' end"
_RUNGS = ", ".join(f"{_CASE(ops.LADDERS, k)} as {n}" for k, n in enumerate(("e1", "x1", "e2", "x2")))
_L = f"""lt as (select *, abs(z) as a, {_RUNGS} from nz where measure in ({', '.join(repr(m) for m in ops.LADDERS)})),
ld as (select measure, i, case when a is null then 0 when a >= e2 then 2 when a >= e1 then 1 else 0 end as rung from lt where i = 1
 union all select n.measure, n.i, case when n.a is null then 0 when l.rung = 0 then case when n.a >= e2 then 2 when n.a >= e1 then 1 else 0 end when n.a < x1 then 0 when l.rung = 2 and n.a < x2 then 1 when l.rung = 1 and n.a >= e2 then 2 else l.rung end
 from ld l join lt n on n.measure = l.measure and n.i = l.i + 1),
l0 as (select nz.*, case when nz.measure like '%_liq' and not coalesce(z > 0, false) then 0 when rung is not null then rung when abs(z) >= {_CASE({m: f'{v[1]}' for m, v in ops.IMPULSES.items()}).replace('case measure', 'case nz.measure')} then 2 when abs(z) >= {_CASE({m: f'{v[0]}' for m, v in ops.IMPULSES.items()}).replace('case measure', 'case nz.measure')} then 1 else 0 end as level,
 coalesce(sign(case when nz.measure in ('participation', 'spot_rvol', 'perp_rvol') then z else x end), 0)::int as sign, case when pct is null then 50 + least(10 * abs(z), 49) else greatest(pct, 100 - pct) end as ext, {_PRIO.replace('case measure', 'case nz.measure')} * 1000.0::double - case when pct is null then 50 else greatest(pct, 100 - pct) end as key from nz left join ld on nz.measure = ld.measure and nz.i = ld.i),
ll as (select *, list_position([{', '.join(repr(m) for m in MEASURES)}], measure) as place, {_CASE({m: repr(n) for m, n in ops.NAMES.items()})} as name,
 case when measure = 'participation' then case when level = 0 or sign = 0 then 'NORMAL RELATIVE ACTIVITY' else case when level >= 2 then 'EXTREME ' else '' end || {_UP('RELATIVE SPOT SURGE', 'RELATIVE PERP SURGE', '')} end when level = 0 then 'NORMAL'
 when measure in ('oi1', 'oi6') then {_WORD} || {_UP(' EXPANSION', ' REDUCTION', ' FLAT')} when measure = 'funding' then case when level >= 2 then 'EXTREME' else 'ELEVATED' end || {_UP(' LONG FUNDING', ' SHORT FUNDING', ' FLAT FUNDING')}
 when measure = 'etf' then {_WORD} || {_UP(' INFLOW', ' OUTFLOW', ' FLAT')} when measure = 'premium' then {_WORD} || {_UP(' POSITIVE PREMIUM', ' NEGATIVE PREMIUM', ' FLAT PREMIUM')}
 when measure like '%_rvol' then case when sign = 0 then 'NORMAL' else {_WORD} || {_UP(' HIGH VOLUME', ' LOW VOLUME', '')} end
 else case when level >= 2 then 'EXTREME ' else '' end || case measure when 'long_liq' then 'LONG' else 'SHORT' end || ' LIQUIDATION SPIKE' end as phrase,
 case when measure in ('oi1', 'oi6') then case when level >= 2 then 'Extreme' else 'Unusual' end || ' open interest ' || {_UP('increase', 'reduction', 'move')} || ' over the last ' || case measure when 'oi6' then '24' else '4' end || ' hours.'
 when measure = 'funding' then 'Funding is ' || case when level >= 2 then 'extremely ' else 'unusually ' end || {_UP('positive — longs are paying shorts.', 'negative — shorts are paying longs.', 'flat.')}
 when measure = 'premium' then 'Perpetual is trading at ' || case when level >= 2 then 'an extreme ' else 'an unusual ' end || {_UP('premium to spot.', 'discount to spot.', 'level against spot.')}
 when measure = 'participation' then case when sign > 0 then 'Spot' else 'Perpetual' end || ' activity spike relative to the other venue.'
 when measure like '%_rvol' then case measure when 'spot_rvol' then 'Spot' else 'Perpetual' end || ' volume is unusually ' || case when sign > 0 then 'high' else 'low' end || ' for this time of day.'
 when measure like '%_liq' then 'Large ' || case measure when 'long_liq' then 'long' else 'short' end || '-liquidation spike detected.'
 else case when level >= 2 then 'Extreme' else 'Unusual' end || ' ETF net ' || {_UP('inflow.', 'outflow.', 'flow.')} end as sentence from l0)"""
_TREND = f"""ta as (select t, close, row_number() over w as i, case when lag(close) over w is null then high - low else greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr,
 case when count(*) over f = 200 then avg(close) over f end as sma, {_r('case when lag(close, 84) over w > 0 then close / lag(close, 84) over w - 1 end')} as mom from legs where leg = 'A' window w as (order by t), f as (order by t rows between 199 preceding and current row)),
tw as (select i, (select avg(tr) from ta where i <= 14) as atr from ta where i = 14 union all select ta.i, w.atr + (1.0::double / 14) * (ta.tr - w.atr) from tw w join ta on ta.i = w.i + 1),
td as (select t, i, mom, {_r('case when atr > 0 then (close - sma) / atr end', 4)} as dist from ta left join tw using (i)),
ts as (select i, case when dist >= 0.5 then 1 when dist <= -0.5 then -1 else 0 end as state, 0 as state_before from td where i = 1
 union all select n.i, case when n.dist is null then 0 when s.state = 0 then case when n.dist >= 0.5 then 1 when n.dist <= -0.5 then -1 else 0 end when s.state * n.dist < 0.2 then 0 else s.state end, s.state from ts s join td n on n.i = s.i + 1),
tn as (select t, dist, mom, state, state_before, case when state > 0 then 'ABOVE 200D' when state < 0 then 'BELOW 200D' else 'NEAR 200D' end as phrase, (sign(state) + coalesce(sign(mom), 0))::int as score from td join ts using (i)),
tt as (select *, case when dist is null or mom is null then 'No data' when score >= 2 then 'Strong uptrend' when score = 1 then 'Uptrend' when score = 0 then 'Neutral' when score = -1 then 'Downtrend' else 'Strong downtrend' end as word from tn)"""
_VOL = f"""rt as (select t, i, close, case when i = 1 then 0.0 else ln(close / lag(close) over (order by t)) end as ret from ta), sd as (select t, i, close, {_r('case when count(ret) over f = 30 then stddev_pop(ret) over f end')} as sd from rt window f as (order by t rows between 29 preceding and current row)),
vp as (select a.t, a.i, a.close, a.sd, {_r('case when a.sd is not null and count(b.sd) = 365 then count(*) filter (where b.sd <= a.sd) * 100.0::double / 365 end', 4)} as pct from sd a left join sd b on b.i between a.i - 365 and a.i - 1 group by a.t, a.i, a.close, a.sd),
vw as (select t, i, close, {_r('atr', 9)} as atr, {_r('(round(atr, 9) + 0.0) / close')} as atr_pct, sd, pct, case when pct is null then 'No data' when pct > 80 then 'High' when pct > 55 then 'Elevated' when pct < 20 then 'Low' else 'Normal' end as word from vp left join tw using (i))"""
_MS, _NS, _LS = q.with_(q.LEGS, _M), q.with_(q.LEGS, _M, _N), q.with_(q.LEGS, _M, _N, _L, recursive=True)


def _half_up(x: str, d: int) -> str:
    """x rounded as the query rounds: halves of its shortest decimal text go away from zero; DuckDB's round() scales the double, which puts 2.135 on either side."""
    return f"coalesce(round(try_cast(({x})::double::varchar as decimal(38, 18)), {d})::double, {x})"


def _trim(x: str, d: int) -> str:
    return f"regexp_replace(regexp_replace(printf('%.{d}f', {_half_up(x, d)}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def _sg(x: str, t: str) -> str:
    return f"case when {x} is null then 'n/a' else case when {x} >= 0 then '+' else '' end || {t} end"


_KIND = "case when level > 0 and pl = 0 then 1 when level = 0 and pl > 0 then 2 when level > 0 and (level <> pl or sign <> pd) then 3 else 0 end"

SQL = {
    "context_measures": _MS + f"select t, {_r('perp_close', 7)} as perp_close, {_r('spot_close', 7)} as spot_close, oi, {_r('spot_rvol', 7)} as spot_rvol, {_r('perp_rvol', 7)} as perp_rvol, oi1, oi6, px6, premium, participation, funding, etf, liquidations, long_liq, short_liq from m",
    "context_norms": _NS + "select t, measure, x, n_valid, z, pct from nz",
    "context_levels": _LS + f"select t, measure, level, sign, phrase, sentence, {_r('ext', 4)} as ext from ll",
    "anomalies_ranked": _LS + f"select t, nth, n, concat_ws(' ', name, phrase) as line, {_r('ext', 4)} as ext from (select *, count(*) over (partition by t) as n, row_number() over (partition by t order by ext desc, place) as nth from ll where level > 0 and z is not null) where nth <= 5",
    "trend_states": q.with_(q.LEGS, _TREND, recursive=True) + "select * from tt",
    "watch_line": q.with_(q.LEGS, _M, _N, _L, _TREND, recursive=True)
    + """, b as (select t, key, sentence from (select *, row_number() over (partition by t order by key, place) as n from ll where level > 0 and z is not null) where n = 1)
select tt.t, coalesce(case when state <> state_before and coalesce(key, 99000) > 5900 and word <> 'No data' then 'Trend state changed to ' || lower(word) || ' — price moved relative to the 200-day average.' else sentence end, '') as line, word as trend from tt left join b using (t)""",
    "positioning": _LS
    + f"""select t, case when x is null then 'No data' when level = 0 then 'Normal' else case when level >= 2 then 'Extreme ' else 'Unusual ' end || {_UP('build', 'reduction', 'flat')} end as word,
 case when x is null then '' else 'OI ' || {_sg('x', _trim('x * 100', 4))} || '% / 24H' end as number from ll where measure = 'oi6'""",
    "mechanics": _LS
    + """, d as (select t, px6, oi6, coalesce(sign(px6), 0) as p, coalesce(sign(oi6), 0) as o from m),
w as (select t, max(case measure when 'funding' then case when x is null then 'funding n/a' else 'funding ' || case when sign > 0 then 'positive' when sign < 0 then 'negative' else 'flat' end || case when level > 0 then case when level >= 2 then ' (extreme)' else ' (elevated)' end else '' end end end) as a,
 max(case measure when 'premium' then case when x is null then 'premium n/a' else 'premium ' || case when sign > 0 then 'positive' when sign < 0 then 'negative' else 'flat' end || case when level > 0 then case when level >= 2 then ' (extreme)' else ' (unusual)' end else '' end end end) as b,
 max(case measure when 'perp_rvol' then case when z is null then 'perp RVOL n/a' else 'perp RVOL ' || case when level > 0 and sign > 0 then 'high' when level > 0 and sign < 0 then 'low' else 'normal' end end end) as c from ll group by t)
select t, case when px6 is null or oi6 is null then 'INSUFFICIENT DATA' when p = 0 or o = 0 then 'FLAT' else case when p > 0 then 'PRICE UP' else 'PRICE DOWN' end || ' + ' || case when o > 0 then 'POSITION BUILD' else 'POSITION REDUCTION' end end as label,
 case when p = 0 or o = 0 then '' else case when p > 0 then 'Price rose' else 'Price fell' end || ' while open interest ' || case when o > 0 then 'rose' else 'fell' end || '. Positions were ' || case when o > 0 then 'added to' else 'reduced' end || ' during the ' || case when p > 0 then 'rise' else 'fall' end || '.' end as sentence,
 a || ' · ' || b || ' · ' || c as note from d join w using (t)""",
    "volatility_words": q.with_(q.LEGS, _TREND, _VOL, recursive=True) + "select t, atr_pct, sd, pct, word from vw",
    "measure_changes": _LS
    + f""", p as (select *, coalesce(lag(level) over w, 0) as pl, coalesce(lag(sign) over w, 0) as pd from ll window w as (partition by measure order by t)), k as (select *, {_KIND} as kind from p)
select t, measure, kind, case kind when 1 then name || ' entered ' || lower(phrase) when 2 then name || ' returned to normal' else name || ' changed to ' || lower(phrase) end as said from k where kind > 0""",
    "state_packs": _LS + "select t, sum((level * 3 + sign + 1) * pow(9, list_position([" + ", ".join(repr(x) for x in MEASURES) + "], measure) - 1))::bigint as pack from ll group by t",
    "gated_observations": _MS
    + f""", s as (select t, i, case when oi is distinct from lag(oi) over (order by t) then oi end as seen from m), k as (select a.i, b.seen as x, row_number() over (partition by a.i order by b.i desc) as n from s a join s b on b.i between a.i - 29 and a.i and b.seen is not null), e as (select i, sum(x) / 7 as mean from k where n <= 7 group by i having count(*) = 7)
select t, seen, {_r('case when mean > 0 then seen / mean - 1 end')} as deviation from s left join e using (i)""",
    "formatted_numbers": f"""with o as (select o_orderkey, o_totalprice as p, o_totalprice - 150000 as x, round(o_totalprice / 1000) / 64 as y from orders)
select o_orderkey, {_trim('y', 2)} as two, {_sg('x', _trim('x', 2))} as signed, {_sg('y', _trim('y / 100 * 100', 4))} || '%' as percent,
 case when p * 37 >= 1e6 then {_trim('p * 37 / 1e6', 2)} || 'M' when p * 37 >= 1e3 then {_trim('p * 37 / 1e3', 2)} || 'K' else {_trim('p * 37', 2)} end as compact,
 format('{{:,}}', floor(round(p, 2))::bigint) || regexp_extract({_trim('p', 2)}, '(\\.\\d+)$', 1) as grouped, case when round(x) >= 0 then '+$' else '-$' end || format('{{:,}}', abs(round(x))::bigint) as dollars, {_sg('y', _trim('y', 2))} || 'R' as r,
 case when o_orderkey % 20 = 0 then {_trim('y', 1)} || 'p' else '—' end as rank from o""",
    "colour_classes": _LS + "select case when phrase like 'EXTREME%' then 'extreme' when phrase like 'UNUSUAL%' or phrase like 'ELEVATED%' or phrase like '%SPIKE%' or phrase like '%SURGE%' then 'unusual' when phrase like 'NORMAL%' then 'normal' else 'plain' end as class, phrase || ' [σ]' as said, count(*) as n from ll group by 1, 2",
    "dashboard": _LS + f"select detail, row_number() over (partition by detail order by level desc, measure) as row, measure, phrase, {_sg('x', _trim('x', 4))} as value from ll, (values ('compact', 2), ('standard', 1), ('full', 0)) d(detail, least) where t = (select max(t) from ll) and level >= least",
}
