"""Panels of every day, in all stages of a plan, at three details; and the small table of plans alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import DAY, HOUR, rounded
from tapeframe.operators import context as words, panel as ops, planner as plan_ops, state, windows
from tapeframe.plans import context, planner, sqltext as q
from tapeframe.sources import shared, tables

MEASURES = context.MEASURES
#: Prices of the plans in parts of the close of the day before; together they reach every stage.
PLANS = [
    {"entry": 0.98, "stop": 0.9},
    {"dir": "Short", "entry": 1.02, "stop": 1.1},
    {"entry": 0.9, "stop": 0.98},
    {"use_atr_stop": True},
    {"dir": "Short", "use_atr_stop": True, "atr_mult": 0.5, "max_lev": 5.0},
    {"active": True, "fill": 0.97, "stop": 0.8, "use_target": True, "target": 1.2},
    {"active": True, "stop": 0.9},
    {"active": True},
    {"entry": 1.0},
    {"active": True, "dir": "Short", "fill": 1.0, "stop": 1.05, "risk_pct": 5.0},
    {"entry": 1.0, "stop": 0.99, "risk_pct": 5.0},
    {"entry": 1.0, "stop": 0.9, "entry_bp": 60.0, "exit_bp": 20.0, "fixed_cash": True, "risk_cash": 250.0},
    {"entry": 1.0, "stop": 0.9, "use_cost": False, "use_target": True, "target": 0.8},
    {"entry": 1.0, "stop": 0.9, "min_qty": 1000.0, "tick": 0.4},
    {"use_atr_stop": True, "standard_chart": False},
    {"entry": 1.0, "stop": 0.9, "point_value": 10.0},
]
PRICES = ("entry", "stop", "fill", "target")
SHAPE = ("ETF LAST 5 OBS", "na-gated observations")


def _seen(when, t: str = "t"):
    return F.max(F.when(when, F.col(t))).over(windows.by("k").rowsBetween(W.unboundedPreceding, 0))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the panels of each day show.

    Feeds are dated by the last day that had a reading; an adapter has none before its first reading and
    is not wired before it can be ranked; the ETF's age, the chart's asset, pairing and the minutes since
    the close are told by the number of the day. The plan in force goes round through PLANS and none.
    """
    c = F.col
    levels = context._levelled(spark, sf_dir)
    w = W.partitionBy("measure").orderBy("t")
    kind = state.change_kind(c("level"), c("sign"), F.coalesce(F.lag("level").over(w), F.lit(0)), F.coalesce(F.lag("sign").over(w), F.lit(0)))
    levels = shared.cut(levels.withColumn("kind", kind))
    verb = F.when(c("kind") == 1, F.concat(F.lit(" entered "), F.lower("phrase"))).when(c("kind") == 2, F.lit(" returned to normal")).otherwise(F.concat(F.lit(" changed to "), F.lower("phrase")))
    levels = levels.withColumn("said", F.when(c("kind") > 0, F.concat("name", verb)))
    odd = (c("level") > 0) & c("z").isNotNull()
    named = [F.first(F.when(c("measure") == m, F.struct("x", "z", "pct", "n_valid", "level", "sign", "phrase")), ignorenulls=True).alias(m) for m in MEASURES]
    days = levels.groupBy("t").agg(
        *named, F.min(F.when(odd, F.struct("key", "place", "sentence"))).alias("best"),
        F.array_sort(F.collect_list(F.when(odd, F.struct((-c("ext")).alias("ext"), "place", "name", "pct", "z")))).alias("anomalies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("kind") > 0, F.struct("kind", "place", "said")))), lambda x: x["said"]), "\n").alias("changes"),
    )
    shown = F.explode(F.sequence(c("t"), c("t") + 6 * DAY, F.lit(DAY))).alias("day")
    lines = levels.filter("kind > 0").select(shown, "measure", "place", "t", "said", words.event_priority(c("said")).alias("priority"))
    lines = lines.groupBy(c("day").alias("t"), "measure", "place").agg(F.count("*").alias("n"), F.min("t").alias("oldest"), F.max(F.struct("t", "said", "priority")).alias("last"))
    hours = F.floor((c("t") - c("oldest")) / HOUR)
    age = F.when(hours < 1, "now").when(hours < 48, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))
    line = F.concat(c("last.said"), F.when(c("n") > 1, F.concat(F.lit("  — repeated "), c("n").cast("string"), F.lit("x over "), age)).otherwise(""))
    events = lines.select("t", F.struct(c("last.priority").alias("priority"), (-c("last.t")).alias("newest"), "place", age.alias("age"), line.alias("line")).alias("e")).groupBy("t").agg(F.array_sort(F.collect_list("e")).alias("events"))
    trend = context.trend_states(spark, sf_dir).select("t", c("dist").alias("trend_dist"), c("mom").alias("momentum"), c("state").alias("trend_state"), "state_before", c("phrase").alias("trend_phrase"), c("word").alias("trend_word"))
    vol = context._volatility(spark, sf_dir).select("t", "close", "atr", "atr_pct", c("pct").alias("vol_pct"), c("word").alias("vol_word"))
    rows = days.join(events, "t", "left").join(trend, "t").join(vol, "t").withColumn("k", F.lit(1))
    day = (c("t") / DAY).cast("long")
    moved = (c("trend_state") != c("state_before")) & (F.coalesce(c("best.key"), F.lit(99_000.0)) > 5900) & (c("trend_word") != "No data")
    rows = rows.withColumn("sentence", F.when(moved, words.trend_sentence(c("trend_word"))).otherwise(c("best.sentence"))).withColumn("n_anomalies", F.size("anomalies"))
    rows = rows.withColumn("trend_known", c("trend_dist").isNotNull()).withColumn("px6", rounded(words.change(c("close"), 6, windows.by("k")))).withColumn("base_px", F.floor(F.lag("close").over(windows.by("k"))))
    rows = rows.withColumn("pos_word", words.positioning_word(c("oi6.x").isNotNull(), c("oi6.level"), c("oi6.sign")))
    triple = lambda m, v: (c(m)[v], c(m)["level"], c(m)["sign"])
    rows = rows.withColumns({"mech_label": words.mechanics(c("px6"), c("oi6.x")), "mech_sentence": words.mechanics_sentence(c("px6"), c("oi6.x")), "mech_note": words.mechanics_note(triple("funding", "x"), triple("premium", "x"), triple("perp_rvol", "z"))})
    fresh = lambda when, four, three: state.freshness(c("t"), _seen(when), DAY, four, three)
    rows = rows.withColumns({"s_reference": F.lit(4), "s_spot": fresh(c("premium.x").isNotNull(), 0, 1), "s_interest": fresh(c("oi6.x").isNotNull(), 0, 1), "s_daily": fresh(c("trend_known"), 2, 3)})
    ranked = lambda m: F.when(c(m)["x"].isNull(), 0).when(c(m)["z"].isNull(), 1)
    rows = rows.withColumns({"on_funding": F.lit(True), "on_long_liq": F.lit(True), "on_short_liq": day % 5 != 0, "n_on": F.when(day % 5 != 0, 4).otherwise(3), "paired": day % 3 != 0, "same_asset": day % 4 != 0, "notional": day % 11 == 0})
    rows = rows.withColumns({
        "a_funding": ranked("funding").otherwise(4), "a_long_liq": ranked("long_liq").otherwise(4), "a_short_liq": F.when(~c("on_short_liq"), 0).otherwise(ranked("short_liq").otherwise(4)),
        "a_etf": F.when(c("etf.x").isNull(), 0).when(day % 9 == 0, 2).when(day % 4 == 0, 3).otherwise(4), "currency": F.when(c("notional"), "USDT"), "age": ops.age_text(day % 5 * 3_000_000 - 3_000_000),
        "balance": words.liquidation_balance(c("long_liq.x"), c("short_liq.x"), F.lit(True)), "reference": F.lit("LEG A"), "spot_name": F.lit("LEG N"), "oi_name": F.lit("LEG R"), "etf_label": F.lit(SHAPE[0]), "etf_shape": F.lit(SHAPE[1]), "funding_unit": F.lit("fraction"), "base": F.lit("UNIT"),
    })
    rows = rows.withColumn("core_ok", (c("s_spot") >= 3) & (c("s_interest") >= 3) & (c("s_daily") >= 3)).withColumn("plan", (day % (len(PLANS) + 1)).cast("int"))
    grid = plan_ops.grid(spark, PLANS)
    rows = shared.cut(rows).join(F.broadcast(grid), "plan", "left").withColumns({p: c(p) * c("base_px") for p in PRICES})  # the grid has len(PLANS) rows
    planned = plan_ops.planned(rows.withColumn("is_notional", c("notional")))
    return planned.withColumn("notional_usd", c("notional")).withColumn("notional", c("is_notional")).withColumn("has_plan", c("plan") < len(PLANS))


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the panel of every day, at each detail."""
    return ops.panels(_states(spark, sf_dir), ["t"])


def _alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans on every 4h bar with the extreme of the ten bars before on the side of the stop."""
    w = windows.by("symbol", "plan").rowsBetween(-10, -1)
    full = F.count("*").over(w) == 10
    rows = planner._planned(spark, sf_dir)
    return rows.withColumn("trail", F.when(full, F.when(F.col("sign") > 0, F.min("low").over(w)).otherwise(F.max("high").over(w))))


def plan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small table of each plan at the last bar of each symbol."""
    return ops.plain(_alone(spark, sf_dir).filter("not confirmed and atr > 0"), ["symbol", "plan"])


def plan_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many confirmed bars meet each of the three alert conditions of a plan alone: stop touched, pinned entry touched, trail past the entry."""
    c = F.col
    up = c("sign") > 0
    stop = F.when(up, c("low") <= c("stop_px")).otherwise(c("high") >= c("stop_px"))
    entry = (c("entry") > 0) & (c("low") <= c("entry_px")) & (c("high") >= c("entry_px"))
    lock = F.when(up, c("trail") > c("entry_px")).otherwise(c("trail") < c("entry_px"))
    n = lambda when: F.sum(F.coalesce(when, F.lit(False)).cast("long"))
    return _alone(spark, sf_dir).filter("confirmed and ok").groupBy("symbol", "plan").agg(n(stop).alias("n_stop"), n(entry).alias("n_entry"), n(lock).alias("n_lock"))


QUERIES = {f.__name__: f for f in (panel_rows, plan_table, plan_conditions)}

# ------------------------------------------------------------------------ SQL

_lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::double"
_GRID = "g as (select * from (values {}) v(plan, {}))".format(", ".join("(" + ", ".join([str(k), *(_lit(v) for v in (plan_ops.DEFAULTS | x).values())]) + ")" for k, x in enumerate(PLANS)), ", ".join(plan_ops.DEFAULTS))
_STEPS = "p1 as (" + planner._P.split("p1 as (", 1)[1]
_trim = context._trim
_q = lambda x, d: f"(sign({x}) * floor(abs({x}) * {10**d}.0::double + 0.5) / {10**d}.0::double + 0.0)"
_num = lambda x, d=2: f"case when ({x}) is null then 'n/a' else {_trim(_q(f'({x})', d), d)} end"
_sig = lambda x, d=2: f"case when ({x}) is null then 'n/a' else case when {_q(f'({x})', d)} >= 0 then '+' else '' end || {_trim(_q(f'({x})', d), d)} end"
_pct = lambda x, d=2: f"case when ({x}) is null then 'n/a' else {_sig(f'({x}) * 100', d)} || '%' end"
_px = lambda x: f"case when ({x}) is null then 'n/a' else case when {_q(f'({x})', 2)} < 0 then '-' else '' end || format('{{:,}}', floor(abs({_q(f'({x})', 2)}))::bigint) || regexp_extract({_trim(f'abs({_q(f"({x})", 2)})', 2)}, '(\\.\\d+)$', 1) end"
_usd = lambda x: f"case when ({x}) is null then 'n/a' else case when {_q(f'({x})', 0)} < 0 then '-$' else '$' end || format('{{:,}}', abs({_q(f'({x})', 0)})::bigint) end"
_susd = lambda x: f"case when ({x}) is null then 'n/a' else case when {_q(f'({x})', 0)} >= 0 then '+$' else '-$' end || format('{{:,}}', abs({_q(f'({x})', 0)})::bigint) end"
_rr = lambda x: f"case when ({x}) is null then 'n/a' else {_num(x)} || 'R' end"
_rs = lambda x: f"case when ({x}) is null then 'n/a' else {_sig(x)} || 'R' end"
_rank = lambda x: f"case when ({x}) is null then '—' else {_trim(_q(f'({x})', 1), 1)} || 'p' end"
_big = lambda x: f"case when {_q(x, 2)} is null then 'n/a' when abs({_q(x, 2)}) >= 1e9 then {_trim(f'({_q(x, 2)}) / 1e9', 2)} || 'B' when abs({_q(x, 2)}) >= 1e6 then {_trim(f'({_q(x, 2)}) / 1e6', 2)} || 'M' when abs({_q(x, 2)}) >= 1e3 then {_trim(f'({_q(x, 2)}) / 1e3', 2)} || 'K' else {_trim(_q(x, 2), 2)} end"
_tick = lambda x: _px(f"case when tick > 0 then floor(({x}) / tick + 0.5) * tick else {x} end")
_is = lambda s, words: "case " + s + " " + " ".join(f"when {k} then '{v}'" for k, v in words.items()) + " end"
_feed, _day, _ad = (lambda s: _is(s, state.FEED_WORDS)), (lambda s: _is(s, state.DAILY_WORDS)), (lambda s: _is(s, state.ADAPTER_WORDS))
_E = {k: f"({v})" for k, v in planner._E.items()}
_M3 = "".join(f", max(case when measure = '{m}' then {s} end) as {m}_{n}" for m in MEASURES for n, s in (("x", "x"), ("z", "z"), ("p", "pct"), ("n", "n_valid"), ("l", "level"), ("s", "sign"), ("h", "phrase")))
#: The sentence of the smallest key, of equal keys the first place, as watch_line has it; keys may lie closer than any multiple of them keeps from a place.
_BEST = "(list(sentence order by key, place) filter (where level > 0 and z is not null))[1]"
_ST = f"""kd as (select *, case when kind = 1 then name || ' entered ' || lower(phrase) when kind = 2 then name || ' returned to normal' when kind = 3 then name || ' changed to ' || lower(phrase) end as said
 from (select *, {context._KIND} as kind from (select *, coalesce(lag(level) over w, 0) as pl, coalesce(lag(sign) over w, 0) as pd from ll window w as (partition by measure order by t)))),
pv as (select t{_M3}, {_BEST} as best_s, min(key) filter (where level > 0 and z is not null) as best_k, count(*) filter (where level > 0 and z is not null) as n_anomalies,
 list({{'name': name, 'p': pct, 'z': z}} order by ext desc, place) filter (where level > 0 and z is not null) as anomalies, coalesce(string_agg(said, chr(10) order by kind, place) filter (where kind > 0), '') as changes from kd group by t),
ex as (select t + k * 86400000 as day, measure, place, t, said, case when starts_with(said, 'OI ') then 2 when starts_with(said, 'Funding') then 3 when starts_with(said, 'Premium') then 4 when starts_with(said, 'Slow trend') then 6 when contains(said, 'liquidation spike') then 5 when contains(said, 'ETF') then 7 else 8 end as prio
 from kd, range(7) r(k) where kind > 0),
ey as (select day, measure, place, count(*) as n, floor((day - min(t)) / 3600000) as h, max(t) as newest, arg_max(said, t) as said, arg_max(prio, t) as prio from ex group by day, measure, place),
ez as (select *, case when h < 1 then 'now' when h < 48 then h::bigint || 'h' else floor(h / 24)::bigint || 'd' end as age from ey),
ee as (select day as t, list({{'age': age, 'line': said || case when n > 1 then '  — repeated ' || n || 'x over ' || age else '' end}} order by prio, newest desc, place) as events from ez group by day),
s0 as (select pv.*, coalesce(events, []) as events, dist as trend_dist, tt.mom as momentum, state as trend_state, state_before, tt.phrase as trend_phrase, tt.word as trend_word, vw.close, vw.atr, vw.atr_pct, vw.pct as vol_pct, vw.word as vol_word, t // 86400000 as day,
 {q.r("case when lag(vw.close, 6) over w > 0 then vw.close / lag(vw.close, 6) over w - 1 end")} as px6, floor(lag(vw.close) over w) as base_px,
 max(case when premium_x is not null then t end) over w as seen_spot, max(case when oi6_x is not null then t end) over w as seen_oi, max(case when dist is not null then t end) over w as seen_day
 from pv join tt using (t) join ta using (t) join vw on vw.i = ta.i left join ee using (t) window w as (order by t)),
s1 as (select *, case when seen_spot is null then 0 when t - seen_spot < 86400000 then 4 when t - seen_spot < 2 * 86400000 then 3 else 2 end as s_spot, case when seen_oi is null then 0 when t - seen_oi < 86400000 then 4 when t - seen_oi < 2 * 86400000 then 3 else 2 end as s_interest,
 case when seen_day is null then 0 when t - seen_day < 3 * 86400000 then 4 when t - seen_day < 4 * 86400000 then 3 else 2 end as s_daily, day % 11 = 0 as feed_notional, day % 5 <> 0 as on_short, day % 3 <> 0 as paired, day % 4 <> 0 as same_asset,
 case when funding_x is null then 0 when funding_z is null then 1 else 4 end as a_funding, case when long_liq_x is null then 0 when long_liq_z is null then 1 else 4 end as a_long, case when day % 5 = 0 or short_liq_x is null then 0 when short_liq_z is null then 1 else 4 end as a_short,
 case when etf_x is null then 0 when day % 9 = 0 then 2 when day % 4 = 0 then 3 else 4 end as a_etf, day % {len(PLANS) + 1} as plan,
 case day % 5 when 0 then 'live bar' when 1 then 'closed 0m ago' when 2 then 'closed 50m ago' when 3 then 'closed 1h 40m ago' else 'closed 2h 30m ago' end as age,
 case when coalesce(long_liq_x, 0) + coalesce(short_liq_x, 0) > 0 and long_liq_x is not null and short_liq_x is not null then (long_liq_x - short_liq_x) / (long_liq_x + short_liq_x) end as balance,
 case when oi6_x is null then 'No data' when oi6_l = 0 then 'Normal' else case when oi6_l >= 2 then 'Extreme ' else 'Unusual ' end || case when oi6_s > 0 then 'build' when oi6_s < 0 then 'reduction' else 'flat' end end as pos_word from s0),
s2 as (select *, s_spot >= 3 and s_interest >= 3 and s_daily >= 3 as core, case when trend_state <> state_before and coalesce(best_k, 99000) > 5900 and trend_word <> 'No data' then 'Trend state changed to ' || lower(trend_word) || ' — price moved relative to the 200-day average.' else coalesce(best_s, '') end as sentence from s1),
s3 as (select *, case when feed_notional then 'Open interest feed looks USD-denominated. Positioning readings are switched off — point the OI input at a base-unit symbol.' when not core then 'A core data feed is missing or stale. Readings from it are suppressed.' else sentence end as watch,
 case when core and not feed_notional then 'DATA OK' else 'DATA ISSUE' end as health,
 concat_ws(chr(10), case when feed_notional then '⚠ Open interest feed looks USD-denominated — OI readings off' end, case when s_spot < 3 then '⚠ Spot price ' || lower({_feed('s_spot')}) end, case when s_interest < 3 and not feed_notional then '⚠ Open interest ' || lower({_feed('s_interest')}) end,
  case when s_daily < 3 then '⚠ Daily 200MA ' || lower({_day('s_daily')}) end, case when a_etf = 2 then '⚠ ETF source may be stale' end, case when a_long >= 3 and a_short >= 3 and not paired then '⚠ Liquidation pairing not declared — balance withheld' end) as issue,
 concat_ws(chr(10), case when a_funding = 1 then 'Funding source not connected' end, case when a_long = 1 then 'Long liquidation source not connected' end, case when a_short = 1 then 'Short liquidation source not connected' end) as unwired from s2),
g2 as (select g.* replace (g.entry * base_px as entry, g.stop * base_px as stop, g.fill * base_px as fill, g.target * base_px as target), t, close, atr from g join s3 using (plan)),
p0 as (select *, case when dir = 'Long' then 1.0::double else -1.0 end as sgn, not active and coalesce(entry <= 0, null) as entry_live, case when active then case when fill > 0 then fill end when entry > 0 then entry else close end as entry_px from g2),
{_STEPS},
st as (select s3.*, p7.* exclude (plan, t, close, atr), s3.plan < {len(PLANS)} as has from s3 left join p7 on p7.t = s3.t)"""


def _row(kind: str, label: str, value: str = "''", note: str = "''", when: str = "true", details: str = "all") -> str:
    seen = {"all": "true", "dec": "detail = 'decision'", "det": "detail <> 'decision'", "dbg": "detail = 'debug'"}[details]
    return f"[case when {seen} and ({when}) then {{'kind': '{kind}', 'label': {label}, 'value': {value}, 'note': {note}}} end]"


def _rows() -> list[str]:
    """The panel's rows in their order, each with the condition that it is there."""
    dec = lambda label, value, note, when: _row("row", f"'{label}'", value, note, when, "dec")
    wide = lambda label, when, d="det": _row("wide", label, when=when, details=d)
    m = lambda label, value, note="''", when="true", d="det": _row("measure", label if label.startswith(("'", "case")) else f"'{label}'", value, note, when, d)
    e, ok, plan = _E, "has and ok", "has"
    blocked = f"case when abs(point_value - 1) >= 1e-9 then 'Non-linear instrument — sizing assumes one quote unit per unit of price. Point value ' || {_num('point_value', 4)} || '.' else 'Non-standard chart type. Its prices are synthetic — switch on Use manual entry to size from a real price.' end"
    share = f"{_num(e['actual_risk'] + ' / equity * 100')} || '%'"
    away = f"{_num('stop_dist / entry_px * 100')} || '%'"
    net = f"case when {e['target_net_r']} is null or {e['target_gross_r']} - {e['target_net_r']} < 0.10 then '' else ' · net ' || {_rr(e['target_net_r'])} end"
    v3 = lambda raw, k: f"{raw} || '  ' || {_rank(k + '_p')} || '  ' || case when {k}_z is null then '' else {_sig(k + '_z')} || 'σ' end"
    feed = lambda label, raw, k, lack, known: m(label, f"case when {k}_x is null then '{lack}' else {v3(raw, k)} end", f"case when {known} then {k}_h || ' [σ]' else 'DATA UNAVAILABLE' end")
    adapter = lambda label, raw, k, a, on: m(label, f"case when {a} >= 3 then {v3(raw, k)} when {on} then 'check adapter' else 'adapter off' end", f"case when {a} >= 3 then {k}_h || ' [σ]' else {_ad(a)} end")
    oi_note = "case when oi6_x is null then 'DATA UNAVAILABLE' else oi6_h || ' [σ]' end"
    grade = lambda k, one: f"case when {k}_x is null then '{k} n/a' else '{k} ' || case when {k}_s > 0 then 'positive' when {k}_s < 0 then 'negative' else 'flat' end || case when {k}_l >= 2 then ' (extreme)' when {k}_l = 1 then ' ({one})' else '' end end"
    p, o = "coalesce(sign(px6), 0)", "coalesce(sign(oi6_x), 0)"
    up = lambda x, a, b: f"case when {x} > 0 then '{a}' else '{b}' end"
    codes = lambda pairs: " || ' · ' || ".join(f"'{k} ' || {v}" for k, v in pairs.items())
    both = "a_long >= 3 and a_short >= 3"
    out = [
        wide("'MARKET CONTEXT'", "not has", "dec"), wide("'4H CONTEXT · ' || health || ' · ' || age", "not has", "dec"),
        _row("state", "'MARKET'", "trend_word", "case when trend_dist is null then '' else lower(trend_phrase) end", "not has", "dec"),
        _row("state", "'VOLATILITY'", "vol_word", f"case when atr_pct is null then '' else 'ATR ' || {_num('atr_pct * 100')} || '%' end", "not has", "dec"),
        _row("state", "'POSITIONING'", "pos_word", f"case when oi6_x is null then '' else 'OI ' || {_pct('oi6_x')} || ' / 24H' end", "not has", "dec"),
        dec("WATCH", "''", "watch", "not has and watch <> ''"), wide("'Chart is not the reference asset. Market context is always LEG A.'", "not has and not same_asset", "dec"),
        dec("SET A PLAN", "''", "'Enable Trade plan to size a trade'", "not has"),
        wide("'TRADE PLAN'", plan, "dec"), wide("upper(dir) || ' · ' || case when active then 'ACTIVE' else 'PLANNING' end", plan, "dec"), wide(blocked, "has and fatal", "dec"),
        wide("'SET ACTUAL FILL PRICE · the price you actually got, in Advanced — plan'", "has and not fatal and need_fill", "dec"), wide("'SET STOP · enter your invalidation price in the settings'", "has and not fatal and need_stop", "dec"),
        wide("case when entry_px is null then 'Set a manual entry price.' else 'The stop is on the wrong side of entry for a ' || lower(dir) || '.' end", "has and not fatal and not need_fill and not need_stop and not side_ok", "dec"),
        dec("LIVE", _rs(e["live_r"]), "''", f"{ok} and active"), dec("NET P&L", _susd(e["live_net"]), f"'gross ' || {_susd(e['live_gross'])}", f"{ok} and active"),
        dec("ENTRY", _tick("entry_px"), "case when entry_live then 'live' when active then 'filled' else 'planned' end", ok), dec("STOP", _tick("stop_px"), away, ok),
        dec("TARGET", f"case when target_ok then {_tick('target_px')} else 'not set' end", f"case when target_ok then {_rr(e['target_gross_r'])} || {net} when use_target then 'set a custom target price' else '' end", ok),
        dec("TO STOP", _rr(e["to_stop_r"]), "''", f"{ok} and active"), dec("TO TARGET", _rr(e["to_target_r"]), "''", f"{ok} and active and target_ok"),
        dec("PRICE→ENTRY", _rs(e["to_entry_r"]), f"{_susd('close - entry_px')} || ' · ' || {_num('(close / entry_px - 1) * 100')} || '%'", f"{ok} and not active and not entry_live"),
        dec("POSITION", _usd(e["notional"]), f"{_num('qty', 4)} || ' UNIT'", ok), dec("MAX LOSS", _usd(e["actual_risk"]), f"{share} || case when capped then '  ·  SIZE CAPPED' else '' end", ok),
        dec("", f"'requested ' || {_usd('budget')}", f"'capped at ' || {_num('max_lev', 1)} || 'x equity'", f"{ok} and capped"),
        dec("COST", _usd(e["cost_stop"]), f"{_rr(e['cost_load_r'])} || case when use_cost then '  ·  in sizing' else '  ·  not in sizing' end", ok),
        dec("BREAKEVEN", _tick("break_even"), f"{_num(e['break_even_bp'], 1)} || ' bp'", ok), wide(f"'Size is below this instrument''s minimum order of ' || {_num('min_qty', 8)} || '.'", f"{ok} and too_small", "dec"),
        wide("'Chart is not the reference asset. Market context is always LEG A; the plan uses this chart''s price.'", f"{ok} and not same_asset", "dec"),
        dec("4H CONTEXT", "''", "trend_word || ' · ' || case when vol_pct is null then 'vol n/a' else lower(vol_word) || ' vol' end || ' · OI ' || lower(pos_word)", plan), dec("DATA", "''", "watch", "has and (not core or feed_notional)"),
        wide("'DISCRETIONARY MODE · NO AUTO ENTRIES'", "true", "dec"),
        wide("'MARKET CONTEXT — DETAILED'", "true"), wide("'4H CONTEXT · ' || health || ' · ' || age", "true"), wide("'RECENT EVENTS'", "len(events) > 0"),
        "case when detail <> 'decision' then list_transform(events[1:5], lambda e: {'kind': 'wide', 'label': e.age, 'value': e.line, 'note': ''}) else [] end",
        wide("'WHAT CHANGED — since the last confirmed 4H bar'", "changes <> ''"), wide("changes", "changes <> ''"), wide("'CURRENT ANOMALIES: ' || n_anomalies", "n_anomalies > 0"),
        f"case when detail <> 'decision' and n_anomalies > 0 then list_transform(anomalies[1:5], lambda e: {{'kind': 'measure', 'label': e.name, 'value': {_rank('e.p')} || '  ' || {_sig('e.z')} || 'σ', 'note': ''}}) else [] end",
        wide("'SETUP REQUIRED'", "unwired <> ''"), wide("unwired", "unwired <> ''"), wide("'MARKET MECHANICS — description, not implication'", "true"),
        m("PRICE 24H", _pct("px6"), f"case when {p} > 0 then 'UP' when {p} < 0 then 'DOWN' else 'FLAT' end"), m("OI 24H", v3(_pct("oi6_x"), "oi6"), oi_note),
        wide(f"case when px6 is null or oi6_x is null then 'INSUFFICIENT DATA' when {p} = 0 or {o} = 0 then 'FLAT' else {up(p, 'PRICE UP', 'PRICE DOWN')} || ' + ' || {up(o, 'POSITION BUILD', 'POSITION REDUCTION')} end", "true"),
        wide(f"{up(p, 'Price rose', 'Price fell')} || ' while open interest ' || {up(o, 'rose', 'fell')} || '. Positions were ' || {up(o, 'added to', 'reduced')} || ' during the ' || {up(p, 'rise', 'fall')} || '.'", f"{p} <> 0 and {o} <> 0"),
        wide(f"{grade('funding', 'elevated')} || ' · ' || {grade('premium', 'unusual')} || ' · ' || case when perp_rvol_z is null then 'perp RVOL n/a' else 'perp RVOL ' || case when perp_rvol_l > 0 and perp_rvol_s > 0 then 'high' when perp_rvol_l > 0 and perp_rvol_s < 0 then 'low' else 'normal' end end", "true"),
        wide("'TREND / VOLATILITY — persistent regime'", "true"),
        m("TREND", f"case when trend_dist is null then 'no daily' else {_sig('trend_dist')} || ' ATR from 200D' end", "case when trend_dist is null then 'DATA UNAVAILABLE' else trend_phrase end"),
        m("VOLATILITY", f"'ATR ' || {_pct('atr_pct')} || '  ' || {_rank('vol_pct')}", "case when vol_pct is null then 'DATA UNAVAILABLE' when vol_pct > 80 then 'HIGH' when vol_pct > 55 then 'ELEVATED' when vol_pct < 20 then 'COMPRESSED' else 'NORMAL' end"),
        m("MOMENTUM 12W", f"case when momentum is null then 'no daily' else {_pct('momentum')} end", "case when momentum is null then 'DATA UNAVAILABLE' when momentum > 0 then 'UP OVER 12 WEEKS' when momentum < 0 then 'DOWN OVER 12 WEEKS' else 'FLAT' end"),
        m("MARKET (combined)", "'200D ' || case when trend_state > 0 then 'above' when trend_state < 0 then 'below' else 'near' end || ' + 12W ' || case when momentum is null then 'n/a' when momentum > 0 then 'up' when momentum < 0 then 'down' else 'flat' end", "trend_word"),
        wide("'DERIVATIVES'", "true"),
        m("OI 24H", f"case when feed_notional then 'REJECTED [USDT]' when oi6_x is null then 'no OI' else {v3(_pct('oi6_x'), 'oi6')} end", oi_note), feed("OI 4H *", _pct("oi1_x"), "oi1", "no OI", "oi1_x is not null"),
        adapter("FUNDING", _pct("funding_x", 4), "funding", "a_funding", "true"), feed("PREMIUM *", _pct("premium_x", 4), "premium", "no spot/ref", "premium_x is not null"),
        adapter("LONG LIQ *", _big("long_liq_x"), "long_liq", "a_long", "true"), adapter("SHORT LIQ *", _big("short_liq_x"), "short_liq", "a_short", "on_short"),
        m("LIQ BALANCE", f"case when not ({both}) then 'both sides needed' when paired then {_sig('balance')} else 'declare shared unit' end", f"case when not ({both}) then 'DATA UNAVAILABLE' when not paired then 'DATA INCOMPARABLE' when balance > 0 then 'MORE LONG LIQUIDATIONS' when balance < 0 then 'MORE SHORT LIQUIDATIONS' else 'BALANCED' end"),
        adapter("ETF LAST 5 OBS", _big("etf_x"), "etf", "a_etf", "true"), wide("'PARTICIPATION — volume vs the same UTC slot on prior days'", "true"),
        feed("SPOT RVOL *", _num("spot_rvol_x") + " || 'x'", "spot_rvol", "no volume", "spot_rvol_z is not null"), feed("PERP RVOL *", _num("perp_rvol_x") + " || 'x'", "perp_rvol", "no volume", "perp_rvol_z is not null"),
        feed("RELATIVE", _sig("participation_x"), "participation", "no volume", "participation_x is not null"), wide("'TRADE PLAN — mechanical arithmetic, not a signal'", "true"),
        m("PLAN", "'enable it in Trade plan'", "'NOT SET'", "not has"), m("PLAN", blocked, "'BLOCKED'", "has and fatal"), m("PLAN", "'entry and stop disagree with the direction'", "'INVALID'", "has and not fatal and not side_ok"),
        m("STAGE", "case when active then 'ACTIVE' else 'PLANNING' end || case when entry_live then '  ·  live entry' when active then '  ·  actual fill' else '  ·  manual entry' end", "upper(dir)", ok), m("ENTRY", _tick("entry_px"), "''", ok),
        m("INVALIDATION", f"{_tick('stop_px')} || '  (' || {away} || ' · ' || {_num('stop_dist / atr')} || ' ATR)'", "case when use_atr_stop then 'ATR STOP' else 'MANUAL STOP' end", ok),
        m("TARGET", f"case when target_ok then {_tick('target_px')} || '  (Gross ' || {_rr(e['target_gross_r'])} || ' · Net ' || {_rr(e['target_net_r'])} || ')' else 'not set' end", "case when use_target then 'CUSTOM TARGET' else 'R MULTIPLE' end", ok),
        m("RISK PER UNIT", f"{_num('risk_unit')} || '  = stop ' || {_num('stop_dist')} || ' + cost ' || {_num('cost_unit')}", "case when use_cost then 'COSTS IN SIZING' else 'COSTS EXCLUDED' end", ok),
        m("SIZE", f"{_num('qty', 4)} || ' UNIT  (' || {_usd(e['notional'])} || ')'", "case when too_small then 'BELOW MIN ORDER' else '' end", ok),
        m("RISK", f"{_usd(e['actual_risk'])} || ' = ' || {share} || ' · ' || {_rr(e['risk_r'])} || '  (asked ' || {_usd('budget')} || ')'", "case when capped then 'SIZE CAPPED' else 'FULL BUDGET' end", ok),
        m("COST IF STOPPED", f"{_usd(e['cost_stop'])} || '  (' || {_rr(e['cost_load_r'])} || ')'", "''", ok), m("BREAK-EVEN", f"{_tick('break_even')} || '  (' || {_num(e['break_even_bp'], 1)} || ' bp)'", "''", ok),
        m("REQUIRED LEVERAGE", f"{_num(e['required_lev'])} || 'x  (cap ' || {_num('max_lev', 1)} || 'x)'", "case when capped then 'CAPPED' else 'WITHIN CAP' end", ok), m("1R / 2R / 3R", " || ' / ' || ".join(_tick(e[f"r{k}"]) for k in (1, 2, 3)), "''", ok),
        m("LIVE", f"{_rs(e['live_r'])} || '  ·  net ' || {_susd(e['live_net'])} || '  ·  gross ' || {_susd(e['live_gross'])}", "case when active then 'ACTIVE' else 'PLANNING' end", ok),
        m("DISTANCE", f"'stop ' || {_rr(e['to_stop_r'])} || case when target_ok then '  ·  target ' || {_rr(e['to_target_r'])} else '' end || '  ·  entry ' || {_rs(e['to_entry_r'])}", "''", ok),
        wide("'DATA HEALTH — timestamp-verified (lag is measured)'", "true"), m("Reference", "'LEG A'", "'FRESH'"), m("Spot", "'LEG N'", _feed("s_spot")),
        m("Open interest", "case when feed_notional then 'REJECTED — looks USD' else 'LEG R' end", f"case when feed_notional then 'UNAVAILABLE' else {_feed('s_interest')} end"), m("Daily 200MA", "'1D on reference'", _day("s_daily")),
        wide("'DATA HEALTH — external adapters (update activity only, no upstream timestamp)'", "true"),
        m("External context", "((a_funding >= 3)::int + (a_etf >= 3)::int + (a_long >= 3)::int + (a_short >= 3)::int) || ' of ' || case when on_short then 4 else 3 end || ' connected'", "'ENABLED'"), m("Funding", "'fraction'", _ad("a_funding")), m("ETF flow", "'na-gated observations'", _ad("a_etf")),
        m("Long liquidations", "'adapter'", _ad("a_long")), m("Short liquidations", "case when on_short then 'adapter' else 'off' end", _ad("a_short")),
        m("Liq pairing", "case when paired then 'declared same unit' else 'not declared' end", "case when paired then 'BALANCE ENABLED' else 'BALANCE WITHHELD' end"), wide("issue", "issue <> ''"),
        wide("'DEBUG — internals; not a reading'", "true", "dbg"), m("Valid samples", codes({"oi4": "oi1_n", "oi24": "oi6_n", "prem": "premium_n", "part": "participation_n"}), "'n IN WINDOW'", d="dbg"),
        m("Feed status codes", codes({"ref": "4", "spot": "s_spot", "oi": "s_interest", "daily": "s_daily"}), "'0..4'", d="dbg"), m("Adapter status codes", codes({"fd": "a_funding", "etf": "a_etf", "liqL": "a_long", "liqS": "a_short"}), "'0..4'", d="dbg"),
        m("Intensity levels", codes({"oi24": "oi6_l", "oi4": "oi1_l", "prem": "premium_l", "fund": "funding_l", "etf": "etf_l", "part": "participation_l"}), "'0/1/2'", d="dbg"), m("Regime codes", codes({"trSt": "trend_state", "oi24St": "(oi6_l * oi6_s)"}), "'signed'", d="dbg"),
        m("Exact z", codes({"oi24": _sig("oi6_z"), "prem": _sig("premium_z"), "part": _sig("participation_z")}), "'σ, unrounded'", d="dbg"),
        wide("'CONTEXT IS DESCRIPTIVE   PLAN IS ARITHMETIC   NEITHER IS A SIGNAL'", "true"), wide("'DISCRETIONARY MODE · NO AUTO ENTRIES · Direction from raw values, abnormality from percentiles.'", "true"),
    ]
    return out


_SHADE = """case when s is null then null when contains(s, 'UNAVAILABLE') or contains(s, 'MISCONFIGURED') or s in ('INSUFFICIENT DATA', 'NO DATA', 'NOT SET', 'NONE ENABLED') then 'muted' when contains(s, 'STALE') or contains(s, 'BLOCKED') or s in ('DATA INCOMPARABLE', 'ISSUE', 'CHECK') then 'bad'
 when s in ('NORMAL', 'FRESH', 'ACTIVE', 'BALANCED', 'FLAT', 'NEAR 200D', 'NORMAL RELATIVE ACTIVITY', 'OK', 'NEUTRAL') then 'normal' when s = 'LONG' or contains(s, 'UPTREND') then 'up' when s = 'SHORT' or contains(s, 'DOWNTREND') then 'down' when starts_with(s, 'EXTREME') then 'extreme'
 when starts_with(s, 'UNUSUAL') or starts_with(s, 'ELEVATED') or contains(s, 'SPIKE') or contains(s, 'SURGE') or s = 'HIGH' then 'unusual' else 'plain' end"""
_SQL = q.with_(q.LEGS, context._M, context._N, context._L, context._TREND, context._VOL, _GRID, _ST, recursive=True) + f""",
dr as (select t, plan, detail, list_filter(flatten([{', '.join(_rows())}]), lambda x: x is not null)[1:76] as rs from st, (values ('decision'), ('detailed'), ('debug')) v(detail)),
du as (select t, plan, detail, unnest(range(1, len(rs) + 1)) as row, unnest(rs) as r from dr),
ds as (select t, plan, detail, row, r.kind as kind, r.label as label, r.value as value, r.note as note, case when r.kind = 'state' then upper(trim(replace(r.value, '[σ]', ''))) when r.kind = 'measure' then upper(trim(replace(r.note, '[σ]', ''))) end as s from du)
"""
_PT = planner._PS + """, al as (select *, case when count(*) over f = 10 then case when sgn > 0 then min(low) over f else max(high) over f end end as trail from p7 window f as (partition by symbol, plan order by t rows between 10 preceding and 1 preceding))"""
_PCT = lambda x: f"{_num(f'({x}) * 100')} || '%'"
_TABLE = [
    _row("row", "'PLAN AND RISK'", "upper(dir)"), _row("row", "'PLAN'", "'INVALID — stop is on the wrong side of entry'", when="not ok"),
    _row("row", "'ENTRY'", f"{_num('entry_px')} || case when entry > 0 then '  (pinned)' else '  (live)' end", when="ok"),
    _row("row", "'INVALIDATION'", f"{_num('stop_px')} || '  (' || {_PCT('stop_dist / entry_px')} || ', ' || {_num('stop_dist / atr', 1)} || ' ATR)'", when="ok"),
    _row("row", "'RISK'", f"{_PCT('qty * risk_unit / equity')} || ' = ' || {_num('qty * risk_unit')}", when="ok"), _row("row", "'SIZE'", f"{_num('qty', 6)} || '  (' || {_num('qty * entry_px', 0)} || ')'", when="ok"),
    _row("row", "'EXPOSURE'", f"{_num('qty * entry_px / equity')} || 'x equity' || case when capped then '  CAPPED' else '' end", when="ok"),
    _row("row", "''", f"'size capped at ' || {_num('max_lev', 1)} || 'x — actual risk ' || {_PCT('qty * risk_unit / equity')} || ' < ' || {_PCT('risk_pct / 100')}", when="ok and capped"),
    _row("row", "'1R / 2R / 3R'", " || ' / ' || ".join(_num(_E[f"r{k}"]) for k in (1, 2, 3)), when="ok"),
    _row("row", "'TRAIL REF (10)'", f"{_num('trail')} || case when sgn * (trail - entry_px) > 0 then '  past entry' else '' end", when="ok"), _row("row", "'PRICE VS ENTRY'", _PCT("(close - entry_px) / entry_px"), when="ok and entry > 0"),
    _row("row", "'BAR RANGE'", f"{_num('(high - low) / atr', 1)} || 'x ATR14'"), _row("row", "'EVIDENCE'", "'96 entry rules tested, 0 validated'"), _row("row", "''", "'sizes risk — does not predict'"),
]
SQL = {
    "panel_rows": _SQL + f"select t, detail, row, kind, label, value, note, {_SHADE} as class from ds",
    "plan_table": _PT + f", pr as (select symbol, plan, list_filter(flatten([{', '.join(_TABLE)}]), lambda x: x is not null)[1:14] as rs from al where not conf and atr > 0), pu as (select symbol, plan, unnest(range(1, len(rs) + 1)) as row, unnest(rs) as r from pr) select symbol, plan, row, r.label as label, r.value as value from pu",
    "plan_conditions": _PT
    + """ select symbol, plan, sum(coalesce(case when sgn > 0 then low <= stop_px else high >= stop_px end, false)::int)::bigint as n_stop, sum(coalesce(entry > 0 and low <= entry_px and high >= entry_px, false)::int)::bigint as n_entry, sum(coalesce(sgn * (trail - entry_px) > 0, false)::int)::bigint as n_lock from al where conf and ok group by symbol, plan""",
}
