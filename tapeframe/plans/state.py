"""Queries on sessions, hysteresis, counters and events."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import DAY, HOUR, bucket, rounded
from tapeframe.operators import alignment, context, scans, sessions, state as ops, windows
from tapeframe.plans import sqltext as q
from tapeframe.sources import tables

SYMBOL = partial(windows.by, "symbol")
NY = sessions.SESSIONS[2]


def session_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New York morning levels on 30m bars: running inside the session, held after it."""
    found = sessions.track(tables.bars(spark, sf_dir, "30m"), ["symbol"], NY)
    return found.select("symbol", "t", "inside", "edge", "run_high", "run_high_i", "run_low", "run_low_i", "held_high", "held_low")


def session_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of all four sessions."""
    rows = tables.bars(spark, sf_dir, "30m")
    found = [sessions.instances(sessions.track(rows, ["symbol"], s), ["symbol"]).withColumn("session", F.lit(s.name)) for s in sessions.SESSIONS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("session", "symbol", "started", "ended", "high", "low", "n_bars", "high_i", "low_i")


def session_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plotted series of every 30m bar: the mean of 200 closes, and of each session the running and the held levels."""
    bars = tables.bars(spark, sf_dir, "30m")
    out = bars.select("symbol", "t", rounded(windows.sma(F.col("close"), 200, SYMBOL())).alias("sma200"))
    for s in sessions.SESSIONS:
        found = sessions.track(bars, ["symbol"], s)
        out = out.join(found.select("symbol", "t", *[F.col(c).alias(f"{s.name}_{c}") for c in ("run_high", "run_low", "held_high", "held_low")]), ["symbol", "t"])
    return out


def session_silent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each symbol on which a session had no bar."""
    rows = tables.bars(spark, sf_dir, "30m").withColumn("day", bucket("t", DAY))
    marks = [F.max(s.holds("t").cast("int")).alias(s.name) for s in sessions.SESSIONS]
    days = rows.groupBy("symbol", "day").agg(*marks)
    pairs = F.explode(F.array(*[F.struct(F.lit(s.name).alias("session"), F.col(s.name).alias("seen")) for s in sessions.SESSIONS]))
    return days.select("symbol", "day", pairs.alias("p")).filter("p.seen = 0").groupBy("symbol", "p.session").agg(F.count("*").alias("n_silent"))


def context_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1h bars with the 4h context they may see, whether it is new, and its age."""
    rows = tables.bars(spark, sf_dir, "1h").select("symbol", "t", (F.col("t") - F.col("t") % (4 * HOUR) - 4 * HOUR).alias("ctx_t"))
    found = ops.context_clock(rows, ["symbol"], "ctx_t").withColumn("age_ms", F.col("t") - (F.col("ctx_t") + 4 * HOUR))
    text = F.when(F.col("age_ms") < 0, "live bar").otherwise(F.format_string("%dh %02dm", F.floor(F.col("age_ms") / HOUR), F.floor(F.col("age_ms") % HOUR / 60_000)))
    return found.withColumn("age_text", text)


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4h bars with a value that repeats often and is missing at times."""
    x = F.when(F.col("trades") % 7 != 0, F.floor(F.col("close") / 40))
    return tables.bars(spark, sf_dir, "4h").select("symbol", "t", x.alias("x"))


def unchanged_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unchanged(_held(spark, sf_dir), ["symbol"], "x")


def since_value_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.since_value(_held(spark, sf_dir).withColumn("x", F.when(F.col("x") > 1, F.col("x"))), ["symbol"], "x")


def _z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4h bars with the rounded z of their close over 40 rows, every ninth missing."""
    found = windows.valid_norm(tables.bars(spark, sf_dir, "4h"), ["symbol"], "close", n=40, least=10)
    return found.select("symbol", "t", "high", "low", "close", F.when(F.col("trades") % 9 != 0, rounded("z", 4)).alias("z"))


def ladder_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ladder(_z(spark, sf_dir), ["symbol"], "z", 1.0, 0.6, 2.0, 1.25).select("symbol", "t", "z", "level", "level_before")


def schmitt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.automaton(_z(spark, sf_dir).select("symbol", "t", "z"), ["symbol"], "t", "z", [-1, 0, 1], 0, ops.schmitt_step(0.5, 0.2), "state", block=6 * DAY)


def impulses_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memoryless impulse levels and where they fire."""
    rows = _z(spark, sf_dir).withColumn("level", ops.impulse(F.col("z"), 1.0, 2.0))
    fired = (F.col("level") != 0) & (F.coalesce(F.lag("level").over(SYMBOL()), F.lit(0)) == 0)
    return rows.select("symbol", "t", "level", fired.alias("fired"))


def change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.ladder(_z(spark, sf_dir), ["symbol"], "z", 1.0, 0.6, 2.0, 1.25).withColumn("dir", F.coalesce(F.signum("z"), F.lit(0.0)).cast("int"))
    before = F.coalesce(F.lag("dir").over(SYMBOL()), F.lit(0))
    return rows.select("symbol", "t", "level", "dir", ops.change_kind(F.col("level"), F.col("dir"), F.col("level_before"), before).alias("kind"))


def feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of a feed seen on busy 4h bars, words, usability, and transitions."""
    grid = tables.bars(spark, sf_dir, "4h").select("symbol", "t", "trades")
    feed = grid.filter("trades >= 11").select("symbol", F.col("t").alias("seen"))
    rows = alignment.as_of(grid, feed, ["symbol"], "t", "seen", [])
    rows = rows.withColumn("status", ops.freshness(F.col("t"), F.col("matched_t"), 4 * HOUR, 0, 1))
    rows = ops.status_transitions(rows, ["symbol"], "status")
    return rows.select("symbol", "t", "matched_t", "status", ops.feed_word(F.col("status")).alias("word"), (F.col("status") >= 3).alias("usable"), "moved")


def daily_feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of a daily feed, seen on some days of the perp leg: fresh for two days, usable for three."""
    days = tables.legs(spark, sf_dir).filter("leg = 'A'").select(F.lit(1).alias("k"), "t", "volume")
    feed = days.filter("volume % 6 = 0").select("k", F.col("t").alias("seen"))
    rows = alignment.as_of(days.select("k", "t"), feed, ["k"], "t", "seen", [])
    rows = rows.withColumn("status", ops.freshness(F.col("t"), F.col("matched_t"), DAY, 2, 3))
    return ops.status_transitions(rows, ["k"], "status").select("t", "matched_t", "status", ops.feed_word(F.col("status"), ops.DAILY_WORDS).alias("word"), "moved")


def adapters_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiring and status of an adapter that repeats its value, and of one that is missing but on new observations.

    The first is wired if it left the close in the last 50 rows, held while unchanged; the second
    also if it was missing in one of the last 200.
    """
    w = SYMBOL()
    rows = tables.bars(spark, sf_dir, "1h")
    view = F.col("symbol") == "view"
    source = F.when(view, F.col("close")).otherwise(F.when(F.col("trades") % 5 != 0, F.floor(F.col("close") / 60) * 60))
    gated = F.when(view, F.col("close")).otherwise(F.when(F.floor(F.col("close")) % 4 == 0, F.col("close") + 1))
    rows = rows.withColumn("src", source).withColumn("gated", gated)
    off = lambda c: F.coalesce(F.abs(F.col(c) - F.col("close")) > 0, F.lit(False))
    rows = rows.withColumn("wired", ops.ever(off("src"), 50, w)).withColumn("gated_wired", ops.ever(off("gated"), 50, w) | ops.ever(F.col("gated").isNull(), 200, w))
    rows = ops.since_value(ops.unchanged(rows, ["symbol"], "src", "held"), ["symbol"], "gated", "age")
    status = ops.adapter_status(F.lit(True), F.col("src"), F.col("wired"), F.col("held"), 6)
    by_arrival = ops.gated_status(F.lit(True), F.col("gated_wired"), F.col("age"), 12)
    out = rows.select("symbol", "t", "wired", "held", status.alias("status"), "gated_wired", "age", by_arrival.alias("gated_status"))
    return out.withColumn("word", ops.feed_word(F.col("status"), ops.ADAPTER_WORDS)).withColumn("gated_word", ops.feed_word(F.col("gated_status"), ops.ADAPTER_WORDS))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each 4h bar, in the fixed order of their sites.

    The bar's z stands for every measure of the sites: open interest and trend by their own
    ladders, funding and ETF by the sign, impulses by their thresholds; feeds go down and come
    back as busy bars are seen.
    """
    rows = ops.ladder(_z(spark, sf_dir), ["symbol"], "z", 1.0, 0.6, 2.0, 1.25)
    fund = ops.ladder(_z(spark, sf_dir), ["symbol"], "z", 1.5, 1.0, 2.5, 1.75, to="fund").select("symbol", "t", "fund", "fund_before")
    trend = schmitt_states(spark, sf_dir).select("symbol", "t", "state", "state_before")
    feed = feed_status(spark, sf_dir).select("symbol", "t", "moved")
    rows = rows.join(fund, ["symbol", "t"]).join(trend, ["symbol", "t"]).join(feed, ["symbol", "t"])
    rows = rows.withColumn("dir", F.coalesce(F.signum("z"), F.lit(0.0)).cast("int")).withColumn("dir_before", F.coalesce(F.lag("dir").over(SYMBOL()), F.lit(0)))
    rows = rows.withColumn("spike", ops.impulse(F.col("z"), 2.0, 2.75)).withColumn("spike_before", F.coalesce(F.lag("spike").over(SYMBOL()), F.lit(0)))
    message = lambda site, when, text: F.when(when, F.struct(F.lit(site).alias("site"), text.alias("text")))
    c, said = F.col, lambda measure, level, sign: F.lower(context.phrase(F.lit(measure), level, sign))
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    oi, fd = ops.change_kind(c("level"), c("dir"), c("level_before"), c("dir_before")), ops.change_kind(c("fund"), c("dir"), c("fund_before"), c("dir_before"))
    etf = said("etf", c("level"), c("dir"))
    fired = (c("spike") != 0) & (c("spike_before") == 0)
    sites = F.array_compact(
        F.array(
            message(1, (oi != 0) & (c("level") != 0), line("OI 24H ", said("oi6", c("level"), c("dir")))),
            message(2, oi == 2, F.lit("OI 24H returned to normal")),
            message(3, (fd != 0) & (c("fund") != 0), line("Funding ", said("funding", c("fund"), c("dir")))),
            message(4, oi == 3, line("ETF 5D ", said("etf", c("level_before"), c("dir_before")), " → ", etf)),
            message(5, (oi == 1) & (c("level") != 0), line("ETF 5D ", etf)),
            message(6, c("state") != c("state_before"), line("Slow trend → ", F.lower(context.trend_phrase(c("state"))))),
            message(7, fired, line("OI 4H ", said("oi1", c("spike"), c("dir")))),
            message(8, fired, line("Premium ", said("premium", c("spike"), c("dir")))),
            message(9, fired, line("Participation: ", said("participation", c("spike"), c("dir")))),
            message(10, fired & (c("dir") > 0), F.lit("Long liquidation spike")),
            message(11, fired & (c("dir") < 0), F.lit("Short liquidation spike")),
            message(12, c("moved") == "down", F.lit("Reference feed STALE")),
            message(13, c("moved") == "up", F.lit("Reference data available again")),
        )
    )
    return rows.select("symbol", "t", F.explode(sites).alias("e")).select("symbol", "t", "e.site", "e.text")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.deduplicated_events(_events(spark, sf_dir), ["symbol"], ["t", "site"], "text")


def events_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five accepted lines of each symbol."""
    rows = ops.deduplicated_events(_events(spark, sf_dir), ["symbol"], ["t", "site"], "text").filter("accepted")
    nth = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("t"), F.desc("site")))
    return rows.withColumn("nth", nth).filter("nth <= 5").select("symbol", "nth", "t", "site", "text")


def events_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted lines merged by what they are about: the newest line, how many, oldest and newest time, priority, and the text shown."""
    rows = ops.deduplicated_events(_events(spark, sf_dir), ["symbol"], ["t", "site"], "text").filter("accepted")
    rows = rows.withColumn("key", context.event_key(F.col("text"))).withColumn("priority", context.event_priority(F.col("text")))
    merged = rows.groupBy("symbol", "priority", "key").agg(F.count("*").alias("n"), F.min("t").alias("oldest"), F.max("t").alias("newest"), F.max_by("text", F.struct("t", "site")).alias("text"))
    now = F.max("newest").over(W.partitionBy("symbol"))
    hours = F.floor((now - F.col("oldest")) / HOUR + 0.5)
    age = F.when(hours < 1, "now").when(hours < 48, F.format_string("%dh", hours)).otherwise(F.format_string("%dd", F.floor(hours / 24 + 0.5)))
    shown = F.when(F.col("n") <= 1, F.col("text")).otherwise(F.concat("text", F.lit("  — repeated "), F.col("n").cast("string"), F.lit("x over "), age))
    return merged.withColumn("shown", shown).withColumn("rank_key", F.col("priority") * 10_000_000_000_000 - F.col("newest"))


def plan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches of a level that changes daily and is missing on some days; the last bar of a symbol is not confirmed yet."""
    rows = tables.bars(spark, sf_dir, "4h").withColumn("day", bucket("t", DAY))
    level = F.when(F.col("day") / DAY % 5 != 0, F.round(F.first("close").over(W.partitionBy("symbol", "day").orderBy("t"))))
    rows = rows.withColumn("level", level).withColumn("confirmed", F.col("t") < F.max("t").over(W.partitionBy("symbol")))
    return ops.latched_alerts(rows, ["symbol"], "level").select("symbol", "t", "level", "touched", "fired")


def drawdown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawdowns of half and more from the 30-bar high, at least 30 bars apart."""
    rows = tables.bars(spark, sf_dir, "4h")
    top = F.max("high").over(windows.frame(SYMBOL(), 30))
    rows = rows.withColumn("dd", F.when(top > 0, F.col("close") / top - 1))
    return ops.spaced_drawdowns(rows, ["symbol"], "dd", 0.5, 30).select("symbol", "i", "t", rounded("dd").alias("dd"))


QUERIES = {
    f.__name__: f
    for f in (
        session_levels, session_instances, session_series, session_silent_report, context_clock, unchanged_counter, since_value_counter, ladder_levels, schmitt_states, impulses_fired, change_kinds, feed_status, daily_feed_status,
        adapters_status, events_log, events_tail, events_grouped, plan_alerts, drawdown_events,
    )
}

_MIN = "(extract(hour from lt) * 60 + extract(minute from lt))"
_LOCAL = "loc as (select *, row_number() over (partition by symbol order by t) - 1 as i, timezone('America/New_York', make_timestamptz(t * 1000)) as lt from b30m)"
_INSIDE = {"asia": f"{_MIN} >= 1200", "london": f"{_MIN} >= 180 and {_MIN} < 300", "ny_am": f"{_MIN} >= 510 and {_MIN} < 660", "london_close": f"{_MIN} >= 600 and {_MIN} < 720"}


def _tracked(name: str) -> str:
    return f"""e_{name} as (select *, inside and not coalesce(lag(inside) over (partition by symbol order by t), false) as edge from (select *, {_INSIDE[name]} as inside from loc)),
i_{name} as (select *, sum(edge::int) over (partition by symbol order by t) as inst from e_{name})"""


def _held_levels(name: str) -> str:
    return f"""r_{name} as (select *, case when inside then max(high) over p end as run_high, case when inside then min(low) over p end as run_low from i_{name} window p as (partition by symbol, inst, inside order by t rows between unbounded preceding and current row)),
h_{name} as (select symbol, t, run_high, run_low, last_value(run_high ignore nulls) over w as held_high, last_value(run_low ignore nulls) over w as held_low from r_{name} window w as (partition by symbol order by t rows between unbounded preceding and current row))"""


_Z = f"""zn as (select *, row_number() over (partition by symbol order by t) as i from b4h), zz as (select a.symbol, a.t, a.high, a.low, a.close, a.i,
 case when a.trades % 9 <> 0 and count(b.close) >= 10 then {q.r('case when stddev_pop(b.close) > 0 then (a.close - avg(b.close)) / stddev_pop(b.close) else 0 end', 4)} end as z
 from zn a join zn b on a.symbol = b.symbol and b.i between a.i - 39 and a.i group by a.symbol, a.t, a.high, a.low, a.close, a.i, a.trades)"""
_LADDER = """lad as (select symbol, i, z, case when z is null then 0 when abs(z) >= 2.0 then 2 when abs(z) >= 1.0 then 1 else 0 end as level, 0 as level_before from zz where i = 1
 union all select z.symbol, z.i, z.z, case when z.z is null or abs(z.z) < 0.6 then 0 when abs(z.z) >= 2.0 then 2 when l.level = 2 then case when abs(z.z) < 1.25 then 1 else 2 end
 when l.level = 1 then 1 when abs(z.z) >= 1.0 then 1 else 0 end, l.level from lad l join zz z on z.symbol = l.symbol and z.i = l.i + 1),
lv as (select l.*, z.t, z.close from lad l join zz z using (symbol, i))"""
_UP = lambda up, down, flat, sign="dir": f"case when {sign} > 0 then '{up}' when {sign} < 0 then '{down}' else '{flat}' end"
_INT = lambda level: f"case when {level} >= 2 then 'extreme' else 'unusual' end"
_ETF = lambda level, sign: f"case when {level} = 0 then 'normal' else {_INT(level)} || {_UP(' inflow', ' outflow', ' flat', sign)} end"
_KINDS = lambda l, b: f"case when {l} > 0 and {b} = 0 then 1 when {l} = 0 and {b} > 0 then 2 when {l} > 0 and ({l} <> {b} or dir <> dir_before) then 3 else 0 end"
_FUND = _LADDER.split("lv as")[0].replace("lad as", "fl as").replace("from lad l", "from fl l").replace("2.0", "2.5").replace("1.0 then", "1.5 then").replace("0.6", "1.0").replace("1.25", "1.75")
_SCHMITT = """sm as (select symbol, i, z, case when z >= 0.5 then 1 when z <= -0.5 then -1 else 0 end as state, 0 as state_before from zz where i = 1
 union all select z.symbol, z.i, z.z, case when z.z is null then 0 when s.state = 0 then case when z.z >= 0.5 then 1 when z.z <= -0.5 then -1 else 0 end when s.state * z.z < 0.2 then 0 else s.state end, s.state from sm s join zz z on z.symbol = s.symbol and z.i = s.i + 1)"""
_FEED = """fd as (select symbol, t as seen from b4h where trades >= 11), fj as (select b.symbol, b.t, f.seen from b4h b asof left join fd f on b.symbol = f.symbol and b.t >= f.seen),
fs as (select symbol, t, case when seen is null then 0 when (t - seen) // 14400000 <= 0 then 4 when (t - seen) // 14400000 <= 1 then 3 else 2 end as status from fj),
fm as (select symbol, t, case when status = 2 and b <> 2 then 'down' when status >= 3 and b < 3 then 'up' end as moved from (select *, lag(status) over (partition by symbol order by t) as b from fs))"""
_EV = f"""e0 as (select v.symbol, v.t, v.i, v.z, v.level, v.level_before, fl.level as fund, fl.level_before as fund_before, sm.state, sm.state_before, moved, coalesce(sign(v.z), 0)::int as dir, case when abs(v.z) >= 2.75 then 2 when abs(v.z) >= 2 then 1 else 0 end as spike
 from lv v join fl using (symbol, i) join sm using (symbol, i) join fm on fm.symbol = v.symbol and fm.t = v.t),
e1 as (select *, coalesce(lag(dir) over w, 0) as dir_before, spike <> 0 and coalesce(lag(spike) over w, 0) = 0 as fired from e0 window w as (partition by symbol order by t)),
e2 as (select *, {_KINDS('level', 'level_before')} as oi, {_KINDS('fund', 'fund_before')} as fk from e1),
ev as (select symbol, t, unnest([case when oi <> 0 and level <> 0 then {{'site': 1, 'text': 'OI 24H ' || {_INT('level')} || {_UP(' expansion', ' reduction', ' flat')}}} end, case when oi = 2 then {{'site': 2, 'text': 'OI 24H returned to normal'}} end,
 case when fk <> 0 and fund <> 0 then {{'site': 3, 'text': 'Funding ' || case when fund >= 2 then 'extreme' else 'elevated' end || {_UP(' long funding', ' short funding', ' flat funding')}}} end,
 case when oi = 3 then {{'site': 4, 'text': 'ETF 5D ' || {_ETF('level_before', 'dir_before')} || ' → ' || {_ETF('level', 'dir')}}} end, case when oi = 1 then {{'site': 5, 'text': 'ETF 5D ' || {_ETF('level', 'dir')}}} end,
 case when state <> state_before then {{'site': 6, 'text': 'Slow trend → ' || {_UP('above 200d', 'below 200d', 'near 200d', 'state')}}} end, case when fired then {{'site': 7, 'text': 'OI 4H ' || {_INT('spike')} || {_UP(' expansion', ' reduction', ' flat')}}} end,
 case when fired then {{'site': 8, 'text': 'Premium ' || {_INT('spike')} || {_UP(' positive premium', ' negative premium', ' flat premium')}}} end,
 case when fired then {{'site': 9, 'text': 'Participation: ' || case when spike >= 2 then 'extreme ' else '' end || {_UP('relative spot surge', 'relative perp surge', '')}}} end,
 case when fired and dir > 0 then {{'site': 10, 'text': 'Long liquidation spike'}} end, case when fired and dir < 0 then {{'site': 11, 'text': 'Short liquidation spike'}} end,
 case when moved = 'down' then {{'site': 12, 'text': 'Reference feed STALE'}} end, case when moved = 'up' then {{'site': 13, 'text': 'Reference data available again'}} end]) as e from e2),
evs as (select symbol, t, e.site as site, e.text as text from ev where e is not null),
acc as (select *, text is distinct from lag(text) over (partition by symbol order by t, site) as accepted from evs)"""
_GROUPS = """pr as (select *, case when contains(text, 'STALE') or contains(text, 'data available again') or contains(text, 'updating') then 1 when starts_with(text, 'OI ') then 2 when starts_with(text, 'Funding') then 3 when starts_with(text, 'Premium') then 4
 when contains(text, 'liquidation spike') then 5 when starts_with(text, 'Slow trend') then 6 when contains(text, 'ETF') then 7 else 8 end as priority from acc where accepted),
ky as (select *, case priority when 2 then 'OI ' || case when contains(text, 'reduction') then 'down' when contains(text, 'expansion') then 'up' else 'flat' end when 5 then case when starts_with(text, 'Long') then 'LIQ long' else 'LIQ short' end when 1 then 'FEED ' || text else priority::varchar end as key from pr),
gr as (select symbol, priority, key, count(*) as n, min(t) as oldest, max(t) as newest, last(text order by t, site) as text from ky group by all),
ag as (select *, floor((max(newest) over (partition by symbol) - oldest) / 3600000.0 + 0.5)::bigint as h from gr)"""
_HELD = "h as (select symbol, t, row_number() over (partition by symbol order by t) as i, case when trades % 7 <> 0 then floor(close / 40)::bigint end as x from b4h)"
_LADSQL = q.with_(q.TAPE, q.B4H, _Z, _LADDER, recursive=True)
_EVSQL = q.with_(q.TAPE, q.B4H, _Z, _LADDER, _FUND.rstrip().rstrip(","), _SCHMITT, _FEED, _EV, recursive=True)

SQL = {
    "session_levels": q.with_(q.TAPE, q.B30, _LOCAL, _tracked("ny_am"))
    + """, r as (select *, case when inside then max(high) over p end as run_high, case when inside then arg_max(i, high) over p end as run_high_i, case when inside then min(low) over p end as run_low, case when inside then arg_min(i, low) over p end as run_low_i
 from i_ny_am window p as (partition by symbol, inst, inside order by t rows between unbounded preceding and current row))
select symbol, t, inside, edge, run_high, run_high_i, run_low, run_low_i, last_value(run_high ignore nulls) over w as held_high, last_value(run_low ignore nulls) over w as held_low from r window w as (partition by symbol order by t rows between unbounded preceding and current row)""",
    "session_instances": q.with_(q.TAPE, q.B30, _LOCAL, *[_tracked(n) for n in _INSIDE])
    + " union all ".join(f"select '{n}' as session, symbol, min(t) as started, max(t) as ended, max(high) as high, min(low) as low, count(*) as n_bars, arg_max(i, high order by t) as high_i, arg_min(i, low order by t) as low_i from i_{n} where inside group by symbol, inst" for n in _INSIDE),
    "session_series": q.with_(q.TAPE, q.B30, _LOCAL, *[_tracked(n) for n in _INSIDE], *[_held_levels(n) for n in _INSIDE])
    + f"select l.symbol, l.t, {q.r('case when count(*) over f = 200 then avg(close) over f end')} as sma200, "
    + ", ".join(f"h_{n}.{c} as {n}_{c}" for n in _INSIDE for c in ("run_high", "run_low", "held_high", "held_low"))
    + " from loc l "
    + " ".join(f"join h_{n} on h_{n}.symbol = l.symbol and h_{n}.t = l.t" for n in _INSIDE)
    + " window f as (partition by l.symbol order by l.t rows between 199 preceding and current row)",
    "session_silent_report": q.with_(q.TAPE, q.B30, _LOCAL)
    + ", d as (select symbol, t // 86400000 as day, "
    + ", ".join(f"max(({c})::int) as {n}" for n, c in _INSIDE.items())
    + " from loc group by 1, 2) select * from ("
    + " union all ".join(f"select symbol, '{n}' as session, count(*) as n_silent from d where {n} = 0 group by symbol" for n in _INSIDE)
    + ")",
    "context_clock": q.with_(q.TAPE, q.B1H)
    + """, c as (select symbol, t, t - t % 14400000 - 14400000 as ctx_t from b1h) select symbol, t, ctx_t, ctx_t is distinct from lag(ctx_t) over (partition by symbol order by t) as new_context, t - (ctx_t + 14400000) as age_ms,
 printf('%dh %02dm', (t - (ctx_t + 14400000)) // 3600000, (t - (ctx_t + 14400000)) % 3600000 // 60000) as age_text from c""",
    "unchanged_counter": q.with_(q.TAPE, q.B4H, _HELD, recursive=True)
    + """, f as (select symbol, t, i, x, 999::bigint as unchanged from h where i = 1 union all select h.symbol, h.t, h.i, h.x, case when h.x is null or f.x is null then f.unchanged when h.x <> f.x then 0 else f.unchanged + 1 end from f join h on h.symbol = f.symbol and h.i = f.i + 1)
select symbol, t, x, unchanged from f""",
    "since_value_counter": q.with_(q.TAPE, q.B4H, _HELD, recursive=True)
    + """, g as (select symbol, t, i, case when x > 1 then x end as x from h), f as (select symbol, t, i, x, case when x is null then 1000::bigint else 0 end as since from g where i = 1
 union all select g.symbol, g.t, g.i, g.x, case when g.x is not null then 0 else f.since + 1 end from f join g on g.symbol = f.symbol and g.i = f.i + 1) select symbol, t, x, since from f""",
    "ladder_levels": _LADSQL + "select symbol, t, z, level, level_before from lv",
    "schmitt_states": q.with_(q.TAPE, q.B4H, _Z, recursive=True)
    + """, s as (select symbol, t, i, z, case when z >= 0.5 then 1 when z <= -0.5 then -1 else 0 end as state, 0 as state_before from zz where i = 1
 union all select z.symbol, z.t, z.i, z.z, case when z.z is null then 0 when s.state = 0 then case when z.z >= 0.5 then 1 when z.z <= -0.5 then -1 else 0 end when s.state * z.z < 0.2 then 0 else s.state end, s.state from s join zz z on z.symbol = s.symbol and z.i = s.i + 1)
select symbol, t, z, state, state_before from s""",
    "impulses_fired": q.with_(q.TAPE, q.B4H, _Z)
    + ", l as (select symbol, t, case when abs(z) >= 2 then 2 when abs(z) >= 1 then 1 else 0 end as level from zz) select symbol, t, level, level <> 0 and coalesce(lag(level) over (partition by symbol order by t), 0) = 0 as fired from l",
    "change_kinds": _LADSQL
    + """, d as (select symbol, t, level, level_before, coalesce(sign(z), 0)::int as dir from lv), e as (select *, coalesce(lag(dir) over (partition by symbol order by t), 0) as pd from d)
select symbol, t, level, dir, case when level > 0 and level_before = 0 then 1 when level = 0 and level_before > 0 then 2 when level > 0 and (level <> level_before or dir <> pd) then 3 else 0 end as kind from e""",
    "feed_status": q.with_(q.TAPE, q.B4H)
    + """, f as (select symbol, t as seen from b4h where trades >= 11), j as (select b.symbol, b.t, f.seen as matched_t from b4h b asof left join f on b.symbol = f.symbol and b.t >= f.seen),
s as (select *, case when matched_t is null then 0 when (t - matched_t) // 14400000 <= 0 then 4 when (t - matched_t) // 14400000 <= 1 then 3 else 2 end as status from j), p as (select *, lag(status) over (partition by symbol order by t) as b from s)
select symbol, t, matched_t, status, case status when 0 then 'UNAVAILABLE' when 2 then 'STALE' when 3 then '1 BAR OLD' when 4 then 'FRESH' end as word, status >= 3 as usable, case when status = 2 and b <> 2 then 'down' when status >= 3 and b < 3 then 'up' end as moved from p""",
    "daily_feed_status": q.with_(q.LEGS)
    + """, d as (select t, volume from legs where leg = 'A'), f as (select t as seen from d where volume % 6 = 0), j as (select d.t, f.seen as matched_t from d asof left join f on d.t >= f.seen),
s as (select *, case when matched_t is null then 0 when (t - matched_t) // 86400000 <= 2 then 4 when (t - matched_t) // 86400000 <= 3 then 3 else 2 end as status from j), p as (select *, lag(status) over (order by t) as b from s)
select t, matched_t, status, case status when 0 then 'UNAVAILABLE' when 2 then 'STALE' when 3 then '1D OLD' when 4 then 'FRESH' end as word, case when status = 2 and b <> 2 then 'down' when status >= 3 and b < 3 then 'up' end as moved from p""",
    "adapters_status": q.with_(q.TAPE, q.B1H, recursive=True)
    + """, a as (select symbol, t, close, row_number() over (partition by symbol order by t) as i, case when symbol = 'view' then close when trades % 5 <> 0 then floor(close / 60) * 60 end as src, case when symbol = 'view' then close when floor(close) % 4 = 0 then close + 1 end as gated from b1h),
f as (select symbol, t, i, src, 999::bigint as held from a where i = 1 union all select a.symbol, a.t, a.i, a.src, case when a.src is null or f.src is null then f.held when a.src <> f.src then 0 else f.held + 1 end from f join a on a.symbol = f.symbol and a.i = f.i + 1),
g as (select f.*, count(*) over c = 50 and coalesce(max(abs(a.src - a.close)) over c, 0) > 0 as wired, count(*) over c = 50 and coalesce(max(abs(gated - close)) over c, 0) > 0 or count(*) over d = 200 and max((gated is null)::int) over d = 1 as gated_wired, coalesce(a.i - max(case when gated is not null then a.i end) over (partition by a.symbol order by a.t), 999 + a.i) as age
 from f join a using (symbol, i) window c as (partition by a.symbol order by a.t rows between 49 preceding and current row), d as (partition by a.symbol order by a.t rows between 199 preceding and current row)),
s as (select symbol, t, wired, held, case when src is null then 0 when not wired then 1 when held > 6 then 2 when held > 0 then 3 else 4 end as status, gated_wired, age, case when not gated_wired then 1 when age > 12 then 2 when age >= 1 then 3 else 4 end as gated_status from g)
select *, case status when 4 then 'ACTIVE' when 3 then 'UNCHANGED 1 BAR' when 2 then 'LIKELY STALE' when 1 then 'MISCONFIGURED' else 'UNAVAILABLE' end as word, case gated_status when 4 then 'ACTIVE' when 3 then 'UNCHANGED 1 BAR' when 2 then 'LIKELY STALE' when 1 then 'MISCONFIGURED' else 'UNAVAILABLE' end as gated_word from s""",
    "events_log": _EVSQL + "select *, sum(accepted::int) over w as n_accepted, sum((not accepted)::int) over w as n_suppressed from acc window w as (partition by symbol order by t, site rows between unbounded preceding and current row)",
    "events_tail": _EVSQL + "select symbol, nth, t, site, text from (select *, row_number() over (partition by symbol order by t desc, site desc) as nth from acc where accepted) where nth <= 5",
    "events_grouped": q.with_(q.TAPE, q.B4H, _Z, _LADDER, _FUND.rstrip().rstrip(","), _SCHMITT, _FEED, _EV, _GROUPS, recursive=True)
    + """select symbol, priority, key, n, oldest, newest, text, case when n <= 1 then text else text || '  — repeated ' || n || 'x over ' || case when h < 1 then 'now' when h < 48 then h || 'h' else floor(h / 24.0 + 0.5)::bigint || 'd' end end as shown,
 priority * 10000000000000 - newest as rank_key from ag""",
    "plan_alerts": q.with_(q.TAPE, q.B4H)
    + """, l as (select symbol, t, high, low, case when (t // 86400000) % 5 <> 0 then round(first(close) over (partition by symbol, t // 86400000 order by t)) end as level from b4h),
p as (select *, coalesce(low <= level and level <= high and t < max(t) over (partition by symbol), false) as touched, last_value(level ignore nulls) over (partition by symbol order by t rows between unbounded preceding and 1 preceding) as b from l),
r as (select *, sum((level is not null and level is distinct from b)::int) over (partition by symbol order by t) as run from p)
select symbol, t, level, touched, touched and sum(touched::int) over (partition by symbol, run order by t) = 1 as fired from r""",
    "drawdown_events": q.with_(q.TAPE, q.B4H, recursive=True)
    + f""", d as (select symbol, t, row_number() over (partition by symbol order by t) as i, close / max(high) over (partition by symbol order by t rows between 29 preceding and current row) - 1 as dd from b4h), c as (select * from d where dd <= -0.5),
f as (select symbol, min(i) as i from c group by symbol union all select f.symbol, (select min(i) from c where c.symbol = f.symbol and c.i >= f.i + 30) from f where exists (select 1 from c where c.symbol = f.symbol and c.i >= f.i + 30))
select c.symbol, c.i, c.t, {q.r('dd')} as dd from f join c using (symbol, i)""",
}
