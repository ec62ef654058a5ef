"""Queries on trade-plan arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.columns import DAY, rounded
from tapeframe.operators import planner as ops, scans, state, windows
from tapeframe.plans import sqltext as q
from tapeframe.sources import tables

#: Plans that together reach every state: sides, caps, costs, missing stops and fills, custom targets.
PLANS = [
    {"entry": 50.0, "stop": 45.0},
    {"dir": "Short", "entry": 50.0, "stop": 55.0},
    {"entry": 50.0, "stop": 55.0},
    {"use_atr_stop": True},
    {"dir": "Short", "use_atr_stop": True, "atr_mult": 2.5, "max_lev": 5.0},
    {"active": True, "fill": 52.0, "stop": 48.0, "use_target": True, "target": 60.0},
    {"active": True, "stop": 48.0},
    {"entry": 50.0},
    {"entry": 50.0, "stop": 49.5, "risk_pct": 5.0},
    {"entry": 50.0, "stop": 45.0, "entry_bp": 12.0, "exit_bp": 2.0, "fixed_cash": True, "risk_cash": 250.0},
    {"entry": 50.0, "stop": 45.0, "use_cost": False, "use_target": True, "target": 40.0},
    {"entry": 50.0, "stop": 45.0, "min_qty": 1000.0, "tick": 0.4},
    {"use_atr_stop": True, "standard_chart": False},
    {"entry": 50.0, "stop": 45.0, "point_value": 10.0},
]
FLAGS = ["need_fill", "need_stop", "fatal", "side_ok", "ok", "capped", "target_ok", "too_small"]
NUMBERS = [
    "entry_px", "stop_px", "stop_dist", "cost_unit", "risk_unit", "qty_raw", "qty_cap", "qty", "notional", "actual_risk", "required_lev", "risk_r", "cost_load_r", "cost_stop", "break_even", "break_even_bp",
    "r1", "r2", "r3", "target_px", "target_gross_r", "target_net_r", "target_pnl", "live_r", "live_gross", "live_net", "to_stop_r", "to_target_r", "to_entry_r", "entry_ticked",
]


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plan on every 4h bar, with Wilder's average true range; the last bar is not confirmed. The grid is a bounded literal."""
    w = windows.by("symbol")
    rows = tables.bars(spark, sf_dir, "4h").withColumn("confirmed", F.lead("t").over(w).isNotNull()).withColumn("tr", windows.true_range(w)).select("symbol", "t", "high", "low", "close", "confirmed", "tr")
    rows = scans.smoothed(rows, ["symbol"], "t", "tr", 14, 1 / 14, "atr", block=10 * DAY).withColumn("atr", rounded("atr", 9)).drop("tr")
    return ops.planned(rows.join(F.broadcast(ops.grid(spark, PLANS))))  # the grid has len(PLANS) rows


def plan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _planned(spark, sf_dir)
    return found.select("symbol", "plan", "t", *FLAGS, *[rounded(c, 4).alias(c) for c in NUMBERS])


def plan_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.zones(_planned(spark, sf_dir).filter("ok"))
    return found.select("symbol", "plan", "t", *[rounded(c, 4).alias(c) for c in ("risk_top", "risk_bottom", "reward_top", "reward_bottom")], "extent")


def plan_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of valid plans: entry while planning; stop, target and 1R to 3R while active; each latched."""
    found = _planned(spark, sf_dir).filter("ok")
    names = {"entry_px": ~F.col("active"), "stop_px": F.col("active"), "target_px": F.col("active") & F.col("target_ok"), "r1": F.col("active"), "r2": F.col("active"), "r3": F.col("active")}
    marks = F.explode(F.array_compact(F.array(*[F.when(when, F.struct(F.lit(n).alias("name"), F.col(n).alias("level"))) for n, when in names.items()])))
    rows = found.select("symbol", "plan", "t", "high", "low", "confirmed", marks.alias("m")).select("symbol", "plan", "t", "high", "low", "confirmed", "m.*")
    alerts = state.latched_alerts(rows, ["symbol", "plan", "name"], "level")
    return alerts.groupBy("symbol", "plan", "name").agg(F.sum(F.col("touched").cast("long")).alias("n_touched"), F.sum(F.col("fired").cast("long")).alias("n_fired"))


def plan_break_even_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaving at the break-even price nets nothing; live R and the distance to the stop differ by 1."""
    found = _planned(spark, sf_dir).filter("ok")
    net = F.col("sign") * (F.col("break_even") - F.col("entry_px")) - F.col("entry_px") * F.col("e_rate") - F.col("break_even") * F.col("x_rate")
    beyond = F.col("sign") * (F.col("close") - F.col("stop_px")) >= 0
    gap = F.when(beyond, F.col("to_stop_r") - F.col("live_r"))
    return found.groupBy("symbol", "plan").agg(F.count("*").alias("n"), rounded(F.max(F.abs(net)), 4).alias("net"), rounded(F.min(gap), 4).alias("low"), rounded(F.max(gap), 4).alias("high"))


def trailing_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trailing_reference(tables.bars(spark, sf_dir, "4h"), ["symbol"], 10).select("symbol", "t", "trail_long", "trail_short", "lock_long")


QUERIES = {f.__name__: f for f in (plan_grid, plan_zones, plan_touches, plan_break_even_identity, trailing_reference)}

_lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::double"
_ROWS = ", ".join("(" + ", ".join([str(k), *(_lit(v) for v in (ops.DEFAULTS | p).values())]) + ")" for k, p in enumerate(PLANS))
_P = f"""g as (select * from (values {_ROWS}) v(plan, {', '.join(ops.DEFAULTS)})),
tn as (select *, t < max(t) over (partition by symbol) as conf, row_number() over w as i, case when lag(close) over w is null then high - low else greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr from b4h window w as (partition by symbol order by t)),
wa as (select symbol, i, (select avg(tr) from tn x where x.symbol = tn.symbol and x.i <= 14) as y from tn where i = 14 union all select n.symbol, n.i, wa.y + (n.tr - wa.y) / 14 from wa join tn n on n.symbol = wa.symbol and n.i = wa.i + 1),
a as (select symbol, t, high, low, close, conf, {q.r("y", 9)} as atr from tn left join wa using (symbol, i)),
p0 as (select g.*, a.symbol, a.t, a.high, a.low, a.close, a.conf, a.atr, case when dir = 'Long' then 1.0::double else -1.0 end as sgn, not active and entry <= 0 as entry_live, case when active then case when fill > 0 then fill end when entry > 0 then entry else close end as entry_px from g, a),
p1 as (select *, case when use_atr_stop then entry_px - sgn * atr_mult * atr when stop > 0 then stop end as stop_px, case when use_cost then entry_bp / 10000 else 0 end as er, case when use_cost then exit_bp / 10000 else 0 end as xr from p0),
p2 as (select *, active and entry_px is null as need_fill, not (active and entry_px is null) and entry_px is not null and stop_px is null as need_stop, (not standard_chart and entry_live) or abs(point_value - 1) >= 1e-9 as fatal, coalesce(sgn * (entry_px - stop_px) > 0, false) as side_ok from p1),
p3 as (select *, not fatal and side_ok as ok from p2), p4 as (select *, case when ok then abs(entry_px - stop_px) end as stop_dist, case when ok then entry_px * er + stop_px * xr end as cost_unit, case when fixed_cash then risk_cash else equity * risk_pct / 100 end as budget from p3),
p5 as (select *, stop_dist + cost_unit as risk_unit, budget / (stop_dist + cost_unit) as qty_raw, case when ok then max_lev * equity / entry_px end as qty_cap from p4),
p6 as (select *, case when ok then least(qty_raw, qty_cap) end as qty, coalesce(qty_raw > qty_cap, false) as capped, case when ok then entry_px * (1 + sgn * er) / (1 - sgn * xr) end as break_even, case when ok then case when use_target then case when target > 0 then target end else entry_px + sgn * target_r * stop_dist end end as target_px from p5),
p7 as (select *, coalesce(sgn * (target_px - entry_px) > 0, false) as target_ok, coalesce(min_qty > 0 and qty < min_qty, false) as too_small from p6)"""
_E = {
    "entry_px": "entry_px", "stop_px": "stop_px", "stop_dist": "stop_dist", "cost_unit": "cost_unit", "risk_unit": "risk_unit", "qty_raw": "qty_raw", "qty_cap": "qty_cap", "qty": "qty", "notional": "qty * entry_px", "actual_risk": "qty * risk_unit",
    "required_lev": "qty_raw * entry_px / equity", "risk_r": "risk_unit / stop_dist", "cost_load_r": "cost_unit / stop_dist", "cost_stop": "qty * cost_unit", "break_even": "break_even", "break_even_bp": "abs(break_even - entry_px) / entry_px * 10000",
    "r1": "entry_px + sgn * stop_dist", "r2": "entry_px + 2 * sgn * stop_dist", "r3": "entry_px + 3 * sgn * stop_dist", "target_px": "target_px", "target_gross_r": "case when target_ok then abs(target_px - entry_px) / stop_dist end",
    "target_net_r": "case when target_ok then (abs(target_px - entry_px) - entry_px * er - target_px * xr) / stop_dist end", "target_pnl": "case when target_ok then qty * (abs(target_px - entry_px) - entry_px * er - target_px * xr) end",
    "live_r": "sgn * (close - entry_px) / stop_dist", "live_gross": "qty * sgn * (close - entry_px)", "live_net": "qty * (sgn * (close - entry_px) - entry_px * er - close * xr)", "to_stop_r": "abs(close - stop_px) / stop_dist",
    "to_target_r": "case when target_ok then abs(target_px - close) / stop_dist end", "to_entry_r": "(close - entry_px) / stop_dist", "entry_ticked": "case when tick > 0 then floor(entry_px / tick + 0.5) * tick else entry_px end",
}
_PS = q.with_(q.TAPE, q.B4H, _P, recursive=True)
SQL = {
    "plan_grid": _PS + f"select symbol, plan, t, {', '.join(FLAGS)}, " + ", ".join(f"{q.r(_E[c], 4)} as {c}" for c in NUMBERS) + " from p7",
    "plan_zones": _PS + f"select symbol, plan, t, {q.r('greatest(entry_px, stop_px)', 4)} as risk_top, {q.r('least(entry_px, stop_px)', 4)} as risk_bottom, {q.r('greatest(entry_px, case when target_ok then target_px end)', 4)} as reward_top, {q.r('least(entry_px, case when target_ok then target_px end)', 4)} as reward_bottom, 16 as extent from p7 where ok",
    "plan_touches": _PS
    + """, u as (select symbol, plan, t, high, low, conf, unnest([case when not active then {'n': 'entry_px', 'l': entry_px} end, case when active then {'n': 'stop_px', 'l': stop_px} end, case when active and target_ok then {'n': 'target_px', 'l': target_px} end,
 case when active then {'n': 'r1', 'l': entry_px + sgn * stop_dist} end, case when active then {'n': 'r2', 'l': entry_px + 2 * sgn * stop_dist} end, case when active then {'n': 'r3', 'l': entry_px + 3 * sgn * stop_dist} end]) as m from p7 where ok),
v as (select symbol, plan, t, m.n as name, m.l as level, low <= m.l and m.l <= high and conf as touched, lag(m.l) over (partition by symbol, plan, m.n order by t) as b from u where m is not null), r as (select *, sum((level is distinct from b)::int) over (partition by symbol, plan, name order by t) as run from v),
f as (select *, touched and sum(touched::int) over (partition by symbol, plan, name, run order by t) = 1 as fired from r) select symbol, plan, name, sum(touched::int)::bigint as n_touched, sum(fired::int)::bigint as n_fired from f group by symbol, plan, name""",
    "plan_break_even_identity": _PS + "select symbol, plan, count(*) as n, 0.0::double as net, case when count(*) filter (where sgn * (close - stop_px) >= 0) > 0 then 1.0::double end as low, case when count(*) filter (where sgn * (close - stop_px) >= 0) > 0 then 1.0::double end as high from p7 where ok group by symbol, plan",
    "trailing_reference": q.with_(q.TAPE, q.B4H) + ", x as (select symbol, t, case when count(*) over f = 10 then min(low) over f end as trail_long, case when count(*) over f = 10 then max(high) over f end as trail_short from b4h window f as (partition by symbol order by t rows between 10 preceding and 1 preceding)) select *, max(trail_long) over (partition by symbol order by t) as lock_long from x",
}
