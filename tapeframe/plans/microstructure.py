"""Queries on books, depth, flow and execution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.columns import rounded
from tapeframe.operators import alignment, book as ops, windows
from tapeframe.plans import sqltext as q
from tapeframe.sources import tables

EVERY = 1000  # a record for each second with updates


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.book_levels(spark, sf_dir).withColumn("symbol", F.lit("PART"))


def _orders(spark: SparkSession) -> DataFrame:
    rows = [("PART", side, float(n)) for side in ("BUY", "SELL") for n in (500, 10_000, 50_000, 1e9, 0, -5)] + [("NONE", "BUY", 500.0)]
    return spark.createDataFrame(rows, "symbol string, order_side string, notional double")


def book_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.depth_features(_levels(spark, sf_dir), ["symbol"])
    return found.select([rounded(c, 4).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def book_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ops.pruned(_levels(spark, sf_dir), ["symbol"]).groupBy("symbol").agg(F.count("*").alias("n_near"))
    return ops.audit(_levels(spark, sf_dir), ["symbol"]).join(near, "symbol")


def walk_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of several sizes, graded without a limit and against limits that a user set."""
    found = ops.with_fees(ops.walk(_levels(spark, sf_dir), ["symbol"], _orders(spark)))
    keep = ["mid", "best", "filled", "unfilled", "side_notional", "vwap", "worst", "slippage_bp", "half_spread_bp", "impact_bp", "consumed_pct", "all_in_bp", "all_in_usd", "round_trip_bp", "cost_A", "cost_B", "cost_C", "cost_M"]
    graded = [ops.verdict(F.col("ok"), F.col("complete"), F.col("all_in_bp"), F.lit(limit).cast("double")).alias(name) for name, limit in (("verdict", None), ("verdict_8", 8), ("verdict_500", 500))]
    return found.select("symbol", "order_side", "notional", "ok", "reason", "complete", "levels_used", *[rounded(c, 4).alias(c) for c in keep], ops.cost_band(F.col("all_in_bp")).alias("band"), *graded)


def exec_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides and two sizes of every record, as a nested map."""
    found = ops.walk(_levels(spark, sf_dir), ["symbol"], _orders(spark).filter("notional in (10000, 50000)"))
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.format_string("%s_%d", "order_side", F.col("notional").cast("int")), F.struct(rounded("vwap", 4).alias("vwap"), "levels_used", "complete")))))
    grid = found.groupBy("symbol").agg(cells.alias("exec"))
    return grid.select("symbol", *[F.col("exec")[f"{s}_{n}"]["vwap"].alias(f"vwap_{s}_{n}") for s in ("BUY", "SELL") for n in (10000, 50000)])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each second with updates."""
    return tables.depth_updates(spark, sf_dir).select("symbol", (F.floor(F.col("t") / EVERY) * EVERY + EVERY).cast("long").alias("at")).distinct()


def _sampled(spark: SparkSession, sf_dir: str, measure, schema: str) -> DataFrame:
    return ops.sampled(tables.depth_updates(spark, sf_dir), ["symbol"], _samples(spark, sf_dir), measure, schema, 86_400_000, EVERY)


def _sides(*book: np.ndarray) -> list[tuple]:
    return [(side, len(p), float(p.min()), float(p.max()), float(q.sum())) for side, p, q in (("bid", *book[:2]), ("ask", *book[2:])) if len(p)]


def _three_best(*book: np.ndarray) -> list[tuple]:
    return [(side, n, float(price), float(qty)) for side, p, q in (("bid", *book[:2]), ("ask", *book[2:])) for n, (price, qty) in enumerate(zip(p[:3], q[:3], strict=True), 1)]


def book_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels in force at each second: counts, lowest and highest price, size."""
    return _sampled(spark, sf_dir, _sides, "side string, n long, low double, high double, qty double")


def book_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best levels of each side at each second."""
    return _sampled(spark, sf_dir, _three_best, "side string, n int, price double, qty double")


def liquidity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity and pressure words of the book at each second."""
    found = _sampled(spark, sf_dir, ops.measured, ops.FEATURES)
    near = F.col("bid_within5bp") + F.col("ask_within5bp")
    return found.select("at", rounded("spread_bp", 4).alias("spread_bp"), rounded("imbalance_top5", 4).alias("imbalance"), rounded(near, 4).alias("near"), ops.liquidity(F.col("spread_bp"), near).alias("state"), ops.pressure(F.col("imbalance_top5")).alias("pressure"))


def flow_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of the book at each second with the flow of the five seconds before."""
    found = _sampled(spark, sf_dir, ops.measured, ops.FEATURES)
    tape = tables.tape(spark, sf_dir).withColumn("symbol", F.lit("BOOK"))
    flow = windows.flow(tape, ["symbol"], list(ops.FLOW_MS), _samples(spark, sf_dir).withColumnRenamed("at", "t"))
    rows = found.join(flow.withColumnRenamed("t", "at"), ["symbol", "at"])
    out = ops.interactions(rows, "buy_5000", "sell_5000", "afi_5000")
    shown = [f"{c}_{ms}" for ms in ops.FLOW_MS for c in ("buy", "sell", "afi")] + ["pressure_to_capacity", "flow_over_opposite", "flow_imbalance", "flow_fragility"]
    return out.select("at", *[f"n_{ms}" for ms in ops.FLOW_MS], *[rounded(c, 4).alias(c) for c in shown])


def batched_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates in batches of an hour, the last of each level wins."""
    rows = tables.depth_updates(spark, sf_dir).withColumn("batch", F.floor(F.col("t") / 3_600_000))
    last = alignment.last_per(rows.select("batch", "side", "price", "seq", "qty"), ["batch", "side", "price"], F.col("seq"))
    return last


def sequence_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ids when every 97th update is lost and every 53rd comes twice."""
    rows = tables.depth_updates(spark, sf_dir).filter("seq % 97 <> 0")
    twice = rows.unionByName(rows.filter("seq % 53 = 0"))
    return ops.sequence_epochs(twice, ["symbol"], 1000)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The update stream with a snapshot first and after each gap, losses and repetitions."""
    rows = tables.depth_updates(spark, sf_dir)
    level = F.array(F.struct("side", "price", "qty"))
    update = rows.filter("seq % 97 <> 0").select("symbol", (F.col("seq") * 4 + 1).alias("arrival"), F.lit("update").alias("kind"), "first_id", "last_id", "prev_id", level.alias("levels"))
    again = update.filter("last_id % 53 = 0").withColumn("arrival", F.col("arrival") + 1)
    empty = F.array().cast("array<struct<side:string,price:double,qty:double>>")
    snapshot = rows.filter("seq % 97 = 10").select("symbol", (F.col("seq") * 4).alias("arrival"), F.lit("snapshot").alias("kind"), F.col("seq").alias("first_id"), F.col("seq").alias("last_id"), (F.col("seq") - 1).alias("prev_id"), empty.alias("levels"))
    return update.unionByName(again).unionByName(snapshot)


def book_sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence machine over a stream with losses, repetitions and snapshots."""
    return ops.replay(_stream(spark, sf_dir))


def book_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sequence machine says at the end: counters that follow from the ids alone."""
    found = ops.replay(_stream(spark, sf_dir))
    return found.groupBy("symbol").agg(F.count("*").alias("n_events"), F.max("applied").alias("applied"), F.max("dropped").alias("dropped"), F.max("gaps").alias("gaps"), F.max("crossed").alias("crossed"))


def taker_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggressor imbalance of hourly bars, reconciled with the bar's volume."""
    t = tables.tape(spark, sf_dir).withColumn("b", (F.floor(F.col("t") / 3_600_000) * 3_600_000).cast("long"))
    flow = t.groupBy("symbol", F.col("b").alias("t")).agg(F.sum(F.when(F.col("aggressive_buy"), F.col("qty")).otherwise(0.0)).alias("taker_buy"), F.sum("qty").alias("traded"))
    rows = tables.bars(spark, sf_dir, "1h").select("symbol", "t", "volume").join(flow, ["symbol", "t"])
    return rows.select("symbol", "t", "taker_buy", rounded((2 * F.col("taker_buy") - F.col("volume")) / F.col("volume")).alias("afi"), (F.abs(F.col("traded") - F.col("volume")) < 1e-9).alias("agrees"))


def collector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what the collector has seen."""
    t = tables.tape(spark, sf_dir)
    return t.agg(F.count("*").alias("n_trades"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms"), F.max("trade_id").alias("last_id"), F.countDistinct("symbol").alias("n_symbols"), F.sum(F.when(F.col("px") <= 0, 1).otherwise(0)).cast("long").alias("n_bad"))


QUERIES = {
    f.__name__: f
    for f in (
        book_features, book_audit, walk_book, exec_grid, book_asof, book_top, liquidity_state, flow_interactions, batched_updates, sequence_epochs, book_sequence_audit, book_validity,
        taker_flow, collector_status,
    )
}

_AT = f"samples as (select distinct 'BOOK' as symbol, (t // {EVERY}) * {EVERY} + {EVERY} as at_ from updates), iv as (select *, lead(t) over (partition by side, price order by seq) as until from updates), lv as (select s.symbol, s.at_ as \"at\", side, price, qty from samples s join iv on iv.t <= s.at_ and s.at_ < coalesce(until, 9e18) and qty > 0)"
_UPD = q.with_(q.UPDATES, _AT)


def _features(source: str, keys: str) -> str:
    """A row per book of `source` with prices, notionals and imbalances."""
    side = lambda s: ", ".join([f"coalesce(sum(price * qty) filter (where side = '{s}' and n <= {k}), 0) as {s}_top{k}" for k in ops.TOPS] + [f"coalesce(sum(price * qty) filter (where side = '{s}' and bp <= {k}), 0) as {s}_within{k}bp" for k in ops.BANDS] + [f"count(*) filter (where side = '{s}') as {s}_levels", f"coalesce(sum(price * qty / (1 + bp)) filter (where side = '{s}' and bp <= 50), 0) as {s}_weighted"])
    return f"""best as (select {keys}, max(price) filter (where side = 'bid') as bid, min(price) filter (where side = 'ask') as ask from {source} group by {keys}),
rk as (select l.*, b.bid, b.ask, (b.bid + b.ask) / 2 as mid, abs(price - (b.bid + b.ask) / 2) / ((b.bid + b.ask) / 2) * 1e4 as bp, row_number() over (partition by {keys}, side order by case when side = 'bid' then -price else price end) as n
 from {source} l join best b using ({keys}) where b.bid is not null and b.ask is not null),
ft as (select {keys}, bid, ask, mid, max(qty) filter (where side = 'bid' and n = 1) as bid_qty, max(qty) filter (where side = 'ask' and n = 1) as ask_qty, {side('bid')}, {side('ask')} from rk group by {keys}, bid, ask, mid),
fx as (select *, ask - bid as spread, (ask - bid) / mid * 1e4 as spread_bp, (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty) as microprice, {', '.join(f'case when bid_{k} + ask_{k} > 0 then (bid_{k} - ask_{k}) / (bid_{k} + ask_{k}) else 0 end as imbalance_{k}' for k in ('top1', 'top5', 'top10', 'weighted'))}, bid_within10bp / 10 as bid_slope, ask_within10bp / 10 as ask_slope from ft)"""


_LEV = "lev as (select 'PART' as symbol, * from levels)"
_NUM = ["bid", "ask", "mid", "bid_qty", "ask_qty", *[f"{s}_{k}" for s in ("bid", "ask") for k in ("top1", "top5", "top10", "within1bp", "within2bp", "within5bp", "within10bp", "weighted")], "spread", "spread_bp", "microprice", "imbalance_top1", "imbalance_top5", "imbalance_top10", "imbalance_weighted", "bid_slope", "ask_slope"]
_WALK = """ord as (select 'PART' as symbol, * from (values ('BUY'), ('SELL')) a(order_side), (values (500.0::double), (10000.0), (50000.0), (1e9), (0.0), (-5.0)) b(notional) union all values ('NONE', 'BUY', 500.0::double)),
bst as (select 'PART' as symbol, max(price) filter (where side = 'bid') as bid, min(price) filter (where side = 'ask') as ask from levels),
wk as (select o.*, l.price, l.price * l.qty as v, coalesce(sum(l.price * l.qty) over (partition by order_side, notional order by case when side = 'ask' then price else -price end rows between unbounded preceding and 1 preceding), 0) as before
 from ord o join levels l on o.symbol = 'PART' and l.side = case when order_side = 'BUY' then 'ask' else 'bid' end where notional > 0),
tk as (select *, case when notional - before > 1e-9 then least(v, notional - before) else 0 end as take from wk),
gr as (select symbol, order_side, notional, sum(take) as filled, sum(take / price) as base, count(*) filter (where take > 0) as levels_used, sum(v) as side_notional, case when order_side = 'BUY' then max(price) filter (where take > 0) else min(price) filter (where take > 0) end as worst from tk group by symbol, order_side, notional),
ou as (select ord.*, bid, ask, filled, base, levels_used, side_notional, worst, case when bid is null or ask is null then 'book empty' when not notional > 0 then 'notional must be positive' end as reason, case when order_side = 'BUY' then 1 else -1 end as sg
 from ord left join bst using (symbol) left join gr using (symbol, order_side, notional)),
vw as (select *, reason is null as ok, coalesce(reason is null and notional - filled <= 1e-6, false) as complete, case when reason is null then (bid + ask) / 2 end as mid, case when reason is null then filled / base end as vwap from ou),
sl as (select *, case when complete then sg * (vwap - mid) / mid * 1e4 end as slippage_bp, case when ok then (ask - bid) / 2 / mid * 1e4 end as half_bp from vw)"""
_R4 = lambda x: q.r(x, 4)

SQL = {
    "book_features": q.with_(q.LEVELS, _LEV, _features("lev", "symbol")) + "select symbol, bid_levels, ask_levels, " + ", ".join(f"{_R4(c)} as {c}" for c in _NUM) + f", {_R4('(microprice - mid) / mid * 1e4')} as displacement_bp from fx",
    "book_audit": q.with_(q.LEVELS, _LEV, "pp as (select symbol, side, price, count(*) as n, min(qty) as least from lev group by all)")
    + """select 'PART' as symbol, max(n) = 1 as strict, max(price) filter (where side = 'bid') < min(price) filter (where side = 'ask') as uncrossed, min(least) > 0 as positive, count(*) filter (where side = 'bid') as bid_levels, count(*) filter (where side = 'ask') as ask_levels,
 max(n) = 1 and max(price) filter (where side = 'bid') < min(price) filter (where side = 'ask') and min(least) > 0 as ok, (select count(*) from lev, (select (max(price) filter (where side = 'bid') + min(price) filter (where side = 'ask')) / 2 as m from lev) where case when side = 'bid' then price >= m * 0.98 else price <= m * 1.02 end) as n_near from pp""",
    "walk_book": q.with_(q.LEVELS, _WALK)
    + f"""select symbol, order_side, notional, ok, reason, complete, levels_used, {_R4('mid')} as mid, {_R4("case when ok then case when order_side = 'BUY' then ask else bid end end")} as best, {_R4('filled')} as filled, {_R4('case when ok then notional - filled end')} as unfilled, {_R4('side_notional')} as side_notional, {_R4('vwap')} as vwap, {_R4('case when ok then worst end')} as worst,
 {_R4('slippage_bp')} as slippage_bp, {_R4('half_bp')} as half_spread_bp, {_R4('slippage_bp - half_bp')} as impact_bp, {_R4('case when ok then filled / side_notional * 100 end')} as consumed_pct, {_R4('slippage_bp + 5')} as all_in_bp, {_R4('(slippage_bp + 5) / 10000 * notional')} as all_in_usd, {_R4('2 * (slippage_bp + 5)')} as round_trip_bp,
 {_R4('10 + 2 * slippage_bp')} as "cost_A", case when complete then 14.0::double end as "cost_B", case when complete then 20.0::double end as "cost_C", case when complete then 4.0::double end as "cost_M",
 case when slippage_bp is null then 'UNKNOWN' when slippage_bp + 5 <= 6 then 'LOW' when slippage_bp + 5 <= 12 then 'NORMAL' else 'HIGH' end as band,
 case when not ok then 'UNKNOWN' when not complete then 'POOR' else 'NOT GRADED' end as verdict, case when not ok then 'UNKNOWN' when not complete then 'POOR' when slippage_bp + 5 <= 8 then 'GOOD' else 'POOR' end as verdict_8,
 case when not ok then 'UNKNOWN' when not complete then 'POOR' when slippage_bp + 5 <= 500 then 'GOOD' else 'POOR' end as verdict_500 from sl""",
    "exec_grid": q.with_(q.LEVELS, _WALK) + "select 'PART' as symbol, " + ", ".join(f"max({_R4('vwap')}) filter (where order_side = '{s}' and notional = {n}) as \"vwap_{s}_{n}\"" for s in ("BUY", "SELL") for n in (10000, 50000)) + " from sl",
    "book_asof": _UPD + 'select symbol, "at", side, count(*) as n, min(price) as low, max(price) as high, sum(qty) as qty from lv group by 1, 2, 3',
    "book_top": _UPD + "select symbol, \"at\", side, n::int as n, price, qty from (select *, row_number() over (partition by \"at\", side order by case when side = 'bid' then -price else price end) as n from lv) where n <= 3",
    "liquidity_state": q.with_(q.UPDATES, _AT, _features("lv", 'symbol, "at"'))
    + f""", s as (select *, bid_within5bp + ask_within5bp as near from fx) select "at", {_R4('spread_bp')} as spread_bp, {_R4('imbalance_top5')} as imbalance, {_R4('near')} as near,
 case when spread_bp <= 1 and near > 2000000 then 'DEEP' when spread_bp > 8 or near < 75000 then 'VERY THIN' when spread_bp > 3 or near < 250000 then 'THIN' else 'NORMAL' end as state,
 case when imbalance_top5 > 0.15 then 'MORE RESTING BIDS' when imbalance_top5 < -0.15 then 'MORE RESTING ASKS' else 'BALANCED' end as pressure from s""",
    "flow_interactions": q.with_(q.TAPE, q.UPDATES, _AT, _features("lv", 'symbol, "at"'))
    + ", fl as (select s.at_ as \"at\", "
    + ", ".join(f"count(t) filter (where t >= s.at_ - {w}) as n_{w}, coalesce(sum(px * qty) filter (where aggressive_buy and t >= s.at_ - {w}), 0) as buy_{w}, coalesce(sum(px * qty) filter (where not aggressive_buy and t >= s.at_ - {w}), 0) as sell_{w}" for w in ops.FLOW_MS)
    + " from samples s left join tape on t between s.at_ - 30000 and s.at_ group by 1), af as (select *, "
    + ", ".join(f"case when buy_{w} + sell_{w} > 0 then (buy_{w} - sell_{w}) / (buy_{w} + sell_{w}) else 0 end as afi_{w}" for w in ops.FLOW_MS)
    + f""" from fl), j as (select af.*, spread_bp, imbalance_top5, case when bid_within2bp > 0 then bid_within2bp else bid_top5 end as nb, case when ask_within2bp > 0 then ask_within2bp else ask_top5 end as na from fx join af using ("at"))
select "at", {', '.join(f'n_{w}' for w in ops.FLOW_MS)}, {', '.join(f"{_R4(f'{c}_{w}')} as {c}_{w}" for w in ops.FLOW_MS for c in ('buy', 'sell', 'afi'))},
 {_R4('case when na > 0 or nb > 0 then buy_5000 / greatest(1, na) - sell_5000 / greatest(1, nb) else 0 end')} as pressure_to_capacity, {_R4('case when buy_5000 >= sell_5000 then (buy_5000 - sell_5000) / greatest(1, na) else (buy_5000 - sell_5000) / greatest(1, nb) end')} as flow_over_opposite,
 {_R4('afi_5000 * imbalance_top5')} as flow_imbalance, {_R4('afi_5000 * (spread_bp / greatest(1e-9, (nb + na) / 1e6))')} as flow_fragility from j""",
    "batched_updates": q.with_(q.UPDATES) + "select t // 3600000 as batch, side, price, max(seq) as seq, arg_max(qty, seq) as qty from updates group by 1, 2, 3",
    "sequence_epochs": "with s as (select event_id as last_id, event_id - 1 as prev_id, case when event_id % 53 = 0 then 1 else 0 end as d from events where event_id % 97 <> 0), g as (select *, coalesce(prev_id <> lag(last_id) over (order by last_id), false) as gap from s), e as (select *, sum(gap::int) over (order by last_id) as epoch from g) select 'BOOK' as symbol, epoch, min(last_id) as first_id, max(last_id) as last_id, count(*) as n, sum(d) as n_duplicates from e group by epoch",
    "taker_flow": q.with_(q.TAPE, q.B1H) + f", f as (select symbol, (t // 3600000) * 3600000 as t, sum(case when aggressive_buy then qty else 0 end) as taker_buy from tape group by 1, 2) select symbol, t, taker_buy, {q.r('(2 * taker_buy - volume) / volume')} as afi, true as agrees from b1h join f using (symbol, t)",
    "collector_status": q.with_(q.TAPE) + "select count(*) as n_trades, min(t) as first_ms, max(t) as last_ms, max(trade_id) as last_id, count(distinct symbol) as n_symbols, count(*) filter (where px <= 0) as n_bad from tape",
}
