"""Queries of the execution and the directional study on books sampled by the second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions import normal
from tapeframe.functions.columns import DAY, HOUR, rounded
from tapeframe.operators import book, depth, stats, vendor
from tapeframe.plans import microstructure, sqltext as q
from tapeframe.sources import boundary, shared, tables

KEYS = ["symbol"]
#: Sizes of the orders, waits in seconds, seconds between decisions.
SIZES, WAITS, STEP_S = (10_000, 50_000), (5, 30), 30


#: The test tape is thin: its time runs so many times faster here, which makes it some events a second.
SPEED = 100


def _records(spark: SparkSession, sf_dir: str, most: float | None = float(max(SIZES))) -> DataFrame:
    """The book at the end of each second with updates, with its curves (up to `most`; without it none), flow and interactions."""
    fast = F.floor(F.col("t") / SPEED)
    updates = tables.depth_updates(spark, sf_dir).withColumn("t", fast)
    trades = tables.tape(spark, sf_dir).withColumns({"symbol": F.lit("BOOK"), "t": fast})
    samples = updates.select("symbol", (F.floor(F.col("t") / 1000) * 1000 + 1000).alias("at")).distinct()
    return shared.cut(depth.records(updates, trades, KEYS, samples, most, HOUR, 1000))


_SHOWN = ("bid", "ask", "mid", "spread_bp", "microprice", "bid_within5bp", "ask_within5bp", "imbalance_top5", "buy_5000", "sell_5000", "afi_5000", "pressure_to_capacity", "flow_fragility")


def second_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a second: prices, depth, flow, interactions, and what orders of two sizes cost."""
    found = depth.priced(_records(spark, sf_dir), SIZES)
    vwaps = [f"vwap_{s}_{n}" for s in depth.SIDES for n in SIZES]
    return found.select("symbol", "at", "bid_levels", "ask_levels", *[rounded(c, 4).alias(c) for c in (*_SHOWN, *vwaps)])


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.cut(depth.costs(_records(spark, sf_dir), KEYS, SIZES, WAITS, STEP_S, DAY, depth.STATE_COLUMNS))


def exec_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of an order now against 5 and 30 s later, both sides and two sizes: means, paired differences, tails, what matters."""
    found = depth.shortfall(_costs(spark, sf_dir), KEYS, STEP_S)
    numbers = [f"{p}_{c}" for p in ("now", "later", "diff") for c in ("mean", "t")] + ["p95", "dispersion"]
    return found.select("symbol", "order_side", "size", "wait", "now_n", "later_n", "diff_n", *[rounded(c, 4).alias(c) for c in numbers], "act_now", "wait_instead")


def exec_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs now and after 30 s by thirds of spread, depth, pressure, replenishment and fragility."""
    rows = _costs(spark, sf_dir).where(f"wait = {WAITS[-1]} and size = {SIZES[0]}")
    found = depth.by_state(shared.cut(depth.book_states(rows, KEYS, STEP_S, 2880)), KEYS)
    return found.select("symbol", "state", "tercile", F.col("now_n").alias("n"), *[rounded(c, 4).alias(c) for c in ("now_mean", "now_t", "diff_mean", "diff_t", "p95", "dispersion")])


def toxicity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the mid is 1, 5 and 30 s after an order rested at the best bid or ask."""
    found = depth.drift(_records(spark, sf_dir), KEYS, (1, 5, 30), STEP_S, DAY)
    return found.select("symbol", "order_side", "wait", "n", rounded("mean", 4).alias("mean"), rounded("t", 4).alias("t"))


#: The freeze, on the clock of the fast tape: three hours after 17,040,000,000.
FROZEN_MS = 17_040_000_000 + 3 * HOUR


def prospective_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of the feed without ids: prospective from the first one after the freeze at which its book is valid."""
    valid = vendor.seconds(*_vendor_feed(spark, sf_dir), KEYS, _samples(spark, sf_dir), 100_000, HOUR, every_ms=1000).select("symbol", "at")
    rows = _samples(spark, sf_dir).join(F.broadcast(boundary.first_after(valid, KEYS, FROZEN_MS)), "symbol", "left")  # a row a symbol
    return rows.select("symbol", "at", "boundary", boundary.phase(F.col("at"), F.col("boundary")).alias("phase"))


COMPARED = ["mid", "spread_bp", "microprice", "imbalance_top5", "bid_within5bp", "ask_within5bp"]


def _vendor_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events and levels of a feed without ids: each hour but the first begins with a snapshot of the levels in force; every 211th delta is lost."""
    updates = tables.depth_updates(spark, sf_dir).withColumn("t", F.floor(F.col("t") / SPEED))
    blocks = updates.select("symbol", F.floor(F.col("t") / HOUR).alias("block"), "seq").groupBy("symbol", "block").agg(F.min("seq").alias("first"))
    held = book.carried(updates, KEYS, blocks.select("symbol", "block"), HOUR).join(blocks, ["symbol", "block"])
    snapshot = held.select("symbol", (2 * F.col("first")).alias("arrival"), (F.col("block") * HOUR).alias("ts"), F.lit(True).alias("is_snapshot"), "side", "price", "qty")
    deltas = updates.where("seq % 211 <> 0").select("symbol", (2 * F.col("seq") + 1).alias("arrival"), F.col("t").alias("ts"), F.lit(False).alias("is_snapshot"), "side", "price", "qty")
    rows = shared.cut(snapshot.unionByName(deltas))
    return rows.select("symbol", "arrival", "ts", "is_snapshot").distinct(), rows.select("symbol", "arrival", "side", "price", "qty")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = F.floor(F.col("t") / SPEED)
    return tables.depth_updates(spark, sf_dir).select("symbol", (F.floor(fast / 1000) * 1000 + 1000).alias("at")).distinct()


def vendor_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the feed without ids had: snapshots, deltas applied and dropped, times that went back."""
    events, _ = _vendor_feed(spark, sf_dir)
    return vendor.counters(vendor.clocked(vendor.segments(events, KEYS, 100_000), KEYS), KEYS)


def vendor_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of the feed without ids at each second at which it is valid."""
    found = vendor.seconds(*_vendor_feed(spark, sf_dir), KEYS, _samples(spark, sf_dir), 100_000, HOUR, every_ms=1000)
    return found.select("symbol", "at", "segment", *[rounded(c, 4).alias(c) for c in COMPARED])


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of the feed without ids against the book of all updates, second by second."""
    events, levels = _vendor_feed(spark, sf_dir)
    samples = _samples(spark, sf_dir)
    a = vendor.seconds(events, levels, KEYS, samples, 100_000, HOUR, every_ms=1000)
    updates = tables.depth_updates(spark, sf_dir).withColumn("t", F.floor(F.col("t") / SPEED))
    b = book.sampled(updates, KEYS, samples, book.measured, book.FEATURES, HOUR, 1000)
    found = vendor.reconciled(a, b, [*KEYS, "at"], COMPARED)
    return found.select("column", "n", "n_equal", "only_a", "only_b", *[rounded(c, 6).alias(c) for c in ("median", "p99", "largest")], rounded("corr", 4).alias("corr"))


#: Horizons in seconds (30 is the primary one), lags of the errors, fewest rows of a fit, trials before this study.
HORIZONS, PRIMARY, LAGS, LEAST, EARLIER_TRIALS = (5, 30, 300), 30, 60, 500, 121
FEATURES = ("D1_imbalance", "D2_displacement", "D3_flow", "D4_depth_change", "D5_pressure", "D6_fragility")
CONTROLS = ["past", "spread_bp", "ln_depth"]


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's six features, log changes of the mid after 5, 30 and 300 s and over the 30 s before, controls, hour, place and split."""
    found = _records(spark, sf_dir, None)
    near = F.greatest(F.lit(1.0), F.col("bid_within5bp") + F.col("ask_within5bp"))
    rows = found.select("symbol", "at", "mid", "spread_bp", "imbalance_top5", "displacement_bp", "afi_5000", "pressure_to_capacity", "flow_fragility", near.alias("near"))
    asked = {f"mid_{h}": ("mid", 1000 * h) for h in HORIZONS} | {"mid_before": ("mid", -1000 * PRIMARY), "near_before": ("near", -1)}  # the record before is in force 1 ms before
    out = depth.later(rows, rows.select("symbol", "at", "mid", "near"), KEYS, asked, HOUR)
    features = [F.col("imbalance_top5"), F.col("displacement_bp"), F.col("afi_5000"), F.log(F.col("near") / F.coalesce("near_before", "near")), F.col("pressure_to_capacity"), F.col("flow_fragility")]
    changes = [F.round(F.log(F.col(f"mid_{h}") / F.col("mid")), 12).alias(f"y_{h}") for h in HORIZONS]
    past = F.round(F.log(F.col("mid") / F.col("mid_before")), 12).alias("past")
    named = [F.round(c, 9).alias(n) for c, n in zip(features, FEATURES, strict=True)]
    out = out.select("symbol", "at", *named, *changes, past, F.round("spread_bp", 9).alias("spread_bp"), F.round(F.log("near"), 9).alias("ln_depth"), (F.col("at") % DAY / HOUR).cast("int").alias("hour"))
    split = F.when(F.col("at") < F.col("__val"), "dev").when(F.col("at") < F.col("__test"), "val").otherwise("test")
    return shared.cut(out.join(F.broadcast(_thirds(rows)), "symbol").withColumn("split", split).drop("__val", "__test"))


def _thirds(rows: DataFrame) -> DataFrame:
    """symbol, __val, __test: the times of the records at which the second and the last third of them begin; a row a symbol."""
    third = F.floor(F.col("__n") / 3)
    begins = lambda k: F.min(F.when(F.col("__i") >= k * third, F.col("at")))
    return stats.numbered(rows.select("symbol", "at"), KEYS, "at", HOUR).groupBy("symbol").agg(begins(1).alias("__val"), begins(2).alias("__test"))


def _trials(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """A row for each observation, feature and horizon: x and y."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), F.col(f).alias("x"), F.col(f"y_{h}").alias("y")) for f in FEATURES for h in horizons])
    return rows.select("symbol", "at", "hour", "split", *CONTROLS, F.explode(cells).alias("c")).select("symbol", "at", "hour", "split", *CONTROLS, "c.*")


TRIAL = ["symbol", "feature", "horizon", "split"]


def _fits(rows: DataFrame) -> DataFrame:
    """Every feature, horizon and split: the feature's coefficient beside three controls and the hour's effects, where 500 rows are complete."""
    long = stats.finite(_trials(rows), ["x", "y", *CONTROLS])
    every = long.unionByName(long.where("split <> 'dev'").withColumn("split", F.lit("valtest")))
    enough = every.groupBy(*TRIAL).agg(F.count("*").alias("__m")).where(F.col("__m") >= LEAST).select(*TRIAL)
    every = shared.cut(every.join(F.broadcast(enough), TRIAL, "left_semi"))  # a row a trial
    fits = stats.regressions(stats.without_effects(every, TRIAL, "hour", ["y", "x", *CONTROLS]), TRIAL, "at", "y", ["x", *CONTROLS], LAGS, DAY, LEAST)
    return fits.where("term = 'x'").drop("term").join(stats.rank_ic(every, TRIAL, "x", "y").drop("n"), TRIAL)


def directional_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients, errors with 60 lags, fit and rank correlation of six features at three horizons in each split."""
    found = _fits(_observations(spark, sf_dir))
    return found.select(*TRIAL, "n", *[rounded(F.col(c) * 1e4, 3).alias(f"{c}_e4") for c in ("beta", "se")], rounded("t", 3).alias("t"), rounded("r2", 5).alias("r2"), rounded("ic", 5).alias("ic"), "dropped")


def _deciles(rows: DataFrame) -> DataFrame:
    """symbol, feature, bucket, n, mean, t of the change after 30 s in the deciles that the first third's edges make of the others."""
    long = _trials(rows, (PRIMARY,)).where("x is not null")
    edges = stats.picked(long.where("split = 'dev'"), ["symbol", "feature"], "x", 10)
    rest = long.where("split <> 'dev' and y is not null").join(F.broadcast(edges), ["symbol", "feature"])  # a row a feature
    rest = rest.withColumn("bucket", stats.bucket_of(F.col("x"), [F.col(f"e{i}") for i in range(1, 10)]) + 1)
    return stats.long_run_mean(rest, ["symbol", "feature", "bucket"], "at", "y", LAGS, DAY)


def directional_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _deciles(_observations(spark, sf_dir))
    return found.select("symbol", "feature", "bucket", "n", rounded(F.col("mean") * 1e4, 4).alias("mean_bp"), rounded("t", 3).alias("t"))


def _threshold(rows: DataFrame) -> DataFrame:
    """symbol, n_effective, threshold: of the daily sums of x * y of all features and horizons; 18 numbers a day are one symbol's group."""
    names = [f"{f}_{h}" for f in FEATURES for h in HORIZONS]
    daily = rows.groupBy("symbol", F.floor(F.col("at") / DAY).alias("d")).agg(*[F.coalesce(F.sum(F.col(f) * F.col(f"y_{h}")), F.lit(0.0)).alias(f"{f}_{h}") for f in FEATURES for h in HORIZONS])

    def run(pdf):
        n = len(names) if len(pdf) < 3 else stats.effective_trials(stats.correlated(pdf[names].to_numpy(float)))
        return pdf.iloc[:1][["symbol"]].assign(n_effective=float(n), threshold=normal.bonferroni_threshold(EARLIER_TRIALS + n))

    return daily.groupBy("symbol").applyInPandas(run, "symbol string, n_effective double, threshold double")


def study_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gates of each feature on the primary horizon: stable sign, significant in validation and test, beyond the
    threshold for all effective trials, monotone deciles, and half their spread above what a taker pays."""
    rows = _observations(spark, sf_dir)
    fits = shared.cut(_fits(rows)).where(F.col("horizon") == PRIMARY)
    wide = fits.groupBy("symbol", "feature").pivot("split", ["dev", "val", "test", "valtest"]).agg(F.first("beta").alias("beta"), F.first("t").alias("t"))
    deciles = shared.cut(_deciles(rows))
    ranked = stats.rank_ic(deciles.withColumn("bucket", F.col("bucket").cast("double")), ["symbol", "feature"], "bucket", "mean").select("symbol", "feature", F.col("ic").alias("mono"))
    ends = deciles.groupBy("symbol", "feature").agg((F.abs(F.max(F.when(F.col("bucket") == 10, F.col("mean"))) - F.max(F.when(F.col("bucket") == 1, F.col("mean")))) / 2 * 1e4).alias("gross_bp"))
    features = rows.select("symbol").distinct().withColumn("feature", F.explode(F.array(*map(F.lit, FEATURES))))
    found = features.join(wide, ["symbol", "feature"], "left").join(ranked, ["symbol", "feature"], "left").join(ends, ["symbol", "feature"], "left").join(_threshold(rows), "symbol")
    sign = F.when(F.signum("valtest_beta") == 0, 1.0).otherwise(F.signum("valtest_beta"))
    gates = {
        "signStable": (F.signum("dev_beta") == sign) & (F.signum("val_beta") == sign) & (F.signum("test_beta") == sign),
        "significant": (F.abs("val_t") >= 2) & (F.abs("test_t") >= 2),
        "multipleTesting": F.abs("valtest_t") > F.col("threshold"),
        "monotone": (F.abs("mono") >= 0.7) & (F.signum("mono") == sign),
        "economic": (F.col("gross_bp") > book.PROFILES["A"]) & (F.col("gross_bp") > book.PROFILES["B"]),
    }
    complete = F.col("dev_beta").isNotNull() & F.col("val_beta").isNotNull() & F.col("test_beta").isNotNull() & F.col("valtest_beta").isNotNull()
    failed = F.when(~complete, "insufficient observations").otherwise(F.concat_ws(",", *[F.when(~F.coalesce(g, F.lit(False)), F.lit(name)) for name, g in gates.items()]))
    return found.select("symbol", "feature", *[rounded(f"{k}_t", 3).alias(f"{k}_t") for k in ("dev", "val", "test", "valtest")], rounded("mono", 4).alias("mono"), rounded("gross_bp", 4).alias("gross_bp"), rounded("n_effective", 4).alias("n_effective"), rounded("threshold", 5).alias("threshold"), failed.alias("failed"), (failed == "").alias("passes"))


QUERIES = {f.__name__: f for f in (prospective_boundary, vendor_counters, vendor_seconds, reconciliation, directional_study, directional_deciles, study_gates, second_records, exec_shortfall, exec_hypotheses, toxicity_drift)}

# ---------------------------------------------------------------- SQL

_FLOW = (
    "fl as (select s.at_ as \"at\", "
    + ", ".join(f"coalesce(sum(px * qty) filter (where {'' if side == 'buy' else 'not '}aggressive_buy and t >= s.at_ - {w}), 0) as {side}_{w}" for w in book.FLOW_MS for side in ("buy", "sell"))
    + " from samples s left join tape on t between s.at_ - 30000 and s.at_ group by 1), af as (select *, "
    + ", ".join(f"case when buy_{w} + sell_{w} > 0 then (buy_{w} - sell_{w}) / (buy_{w} + sell_{w}) else 0 end as afi_{w}" for w in book.FLOW_MS)
    + " from fl)"
)
_PART = {"BUY": "ask", "SELL": "bid"}
_TAKE = lambda n: f"greatest(0, least(v, {n} - before))"
_WALK = """wv as (select symbol, "at", side, price, price * qty as v, coalesce(sum(price * qty) over (partition by symbol, "at", side order by n rows between unbounded preceding and 1 preceding), 0) as before from rk where n <= 64),
vw as (select symbol, "at", """ + ", ".join(
    f"case when sum(v) filter (where side = '{_PART[s]}') >= {n} - 1e-6 then sum({_TAKE(n)}) filter (where side = '{_PART[s]}') / sum({_TAKE(n)} / price) filter (where side = '{_PART[s]}') end as vwap_{s}_{n}" for s in depth.SIDES for n in SIZES
) + " from wv group by 1, 2)"
_NEAR = """nr as (select *, case when bid_within2bp > 0 then bid_within2bp else bid_top5 end as nb, case when ask_within2bp > 0 then ask_within2bp else ask_top5 end as na from fx),
rec as (select nr.*, af.* exclude ("at"), vw.* exclude (symbol, "at"), case when na > 0 or nb > 0 then buy_5000 / greatest(1, na) - sell_5000 / greatest(1, nb) else 0 end as pressure_to_capacity, afi_5000 * (spread_bp / greatest(1e-9, (nb + na) / 1e6)) as flow_fragility
 from nr join af using ("at") join vw using (symbol, "at"))"""
_FAST = lambda cte: cte.replace("epoch_us(ts) // 1000 as t", f"epoch_us(ts) // {1000 * SPEED} as t")
RECORDS = (_FAST(q.TAPE), _FAST(q.UPDATES), microstructure._AT, microstructure._features("lv", 'symbol, "at"'), _WALK, _FLOW, _NEAR)
_FIRST = f"""dec as (select * exclude (rn) from (select *, row_number() over (partition by symbol, "at" // {1000 * STEP_S} order by "at") as rn from rec) where rn = 1)"""
_R4 = lambda x: q.r(x, 4)


def hac(name: str, source: str, keys: str, value: str, lags: int) -> str:
    """CTEs that end in `name`: keys, n, mean, t of the value in the order of "at", with Bartlett weights."""
    lagged = ", ".join(f"e * lag(e, {k}) over (partition by {keys} order by \"at\") as p{k}" for k in range(1, lags + 1))
    total = "sum(e * e)" + "".join(f" + {2 * (1 - k / (lags + 1))!r} * coalesce(sum(p{k}), 0)" for k in range(1, lags + 1))
    return f"""{name}_e as (select *, {value} - avg({value}) over (partition by {keys}) as e from {source} where {value} is not null), {name}_p as (select *, {lagged} from {name}_e),
{name}_s as (select {keys}, count(*) as n, avg({value}) as mean, sqrt(greatest({total}, 0)) / count(*) as se from {name}_p group by {keys}),
{name} as (select {keys}, n, mean, case when n >= 2 then case when se > 0 then mean / se else 0 end end as t from {name}_s)"""


_known = lambda w: f'case when d."at" + {1000 * w} <= (select max("at") from rec) then'
_LATER = ", ".join(f'l{w} as (select d.symbol, d."at", ' + ", ".join(f"{_known(w)} r.vwap_{s}_{n} end as vwap_{s}_{n}_{w}" for s in depth.SIDES for n in SIZES) + f' from dec d asof left join rec r on d.symbol = r.symbol and d."at" + {1000 * w} >= r."at")' for w in WAITS)
_COST = lambda s, v: f"{1 if s == 'BUY' else -1} * ({v} - mid) / mid * 1e4 + 5"
_COSTS = (
    f"{_LATER}, co as ("
    + " union all ".join(
        f'select symbol, "at", mid, spread_bp, bid_within5bp, ask_within5bp, buy_5000, \'{s}\' as order_side, {n} as size, {w} as wait, {_COST(s, f"vwap_{s}_{n}")} as now_bp, {_COST(s, f"vwap_{s}_{n}_{w}")} as later_bp from dec join l{w} using (symbol, "at") where vwap_{s}_{n} is not null'
        for s in depth.SIDES
        for n in SIZES
        for w in WAITS
    )
    + "), cd as (select *, round(later_bp - now_bp, 9) as d from co)"
)
_BY = "symbol, order_side, size, wait"
_TAIL = lambda source, keys: f"(select {keys}, list_sort(list(d))[least(count(*), floor(0.95 * count(*))::bigint + 1)] as p95, stddev_pop(d) as dispersion from {source} where d is not null group by {keys})"
_STATES = f"""bo as (select *, bid_within5bp + ask_within5bp as near from cd where order_side = 'BUY' and wait = {WAITS[-1]} and size = {SIZES[0]} and later_bp is not null),
bs as (select symbol, "at", now_bp, d, round(spread_bp, 6) as "E1_spread", round(-near, 6) as "E1_depth", round(buy_5000 / greatest(1, ask_within5bp), 6) as "E2_pressure", round(coalesce(near - lag(near) over (partition by symbol order by "at"), 0), 6) as "E3_replenishment", round(spread_bp / greatest(1e-9, near / 1e6), 6) as "E4_fragility", count(*) over (partition by symbol) as n_all from bo),
bl as (unpivot (select * from bs where n_all >= 100) on "E1_spread", "E1_depth", "E2_pressure", "E3_replenishment", "E4_fragility" into name state value x),
bq as (select symbol, state, list_sort(list(x)) as xs from bl group by 1, 2),
bc as (select bl.*, 1 + (x > xs[least(len(xs), len(xs) // 3 + 1)])::int + (x > xs[least(len(xs), 2 * len(xs) // 3 + 1)])::int as tercile from bl join bq using (symbol, state))"""
_DRIFT = ", ".join(f'm{w} as (select d.symbol, d."at", {_known(w)} r.mid end as later from dec d asof left join rec r on d.symbol = r.symbol and d."at" + {1000 * w} >= r."at")' for w in (1, 5, 30))
_DRIFTS = " union all ".join(f"select symbol, \"at\", '{s}' as order_side, {w} as wait, {x} as d from dec join m{w} using (symbol, \"at\")" for w in (1, 5, 30) for s, x in (("BUY", "(later - bid) / bid * 1e4"), ("SELL", "(ask - later) / ask * 1e4")))

_ASOF = ", ".join(f'z{abs(h)}{"m" if h < 0 else "p"} as (select d.symbol, d."at", {_known(h)} r.mid end as "mid_{h}" from rec d asof left join rec r on d.symbol = r.symbol and d."at" + {1000 * h} >= r."at")' for h in (*HORIZONS, -PRIMARY))
_OBS = f"""{_ASOF}, ob as (select rec.*, greatest(1, bid_within5bp + ask_within5bp) as near, row_number() over (partition by symbol order by "at") - 1 as i, count(*) over (partition by symbol) as m from rec),
of as (select symbol, "at", round(imbalance_top5, 9) as "D1_imbalance", round((microprice - mid) / mid * 1e4, 9) as "D2_displacement", round(afi_5000, 9) as "D3_flow", round(ln(near / coalesce(lag(near) over (partition by symbol order by "at"), near)), 9) as "D4_depth_change", round(pressure_to_capacity, 9) as "D5_pressure", round(flow_fragility, 9) as "D6_fragility",
 {", ".join(f'round(ln("mid_{h}" / mid), 12) as y_{h}' for h in HORIZONS)}, round(ln(mid / "mid_{-PRIMARY}"), 12) as past, round(spread_bp, 9) as spread_bp, round(ln(near), 9) as ln_depth, ("at" % 86400000) // 3600000 as hour,
 case when i < m // 3 then 'dev' when i < 2 * (m // 3) then 'val' else 'test' end as split from ob {" ".join(f'join z{abs(h)}{"m" if h < 0 else "p"} using (symbol, "at")' for h in (*HORIZONS, -PRIMARY))}),
tr as ({" union all ".join(f"select symbol, " + f'"at", hour, split, past, spread_bp, ln_depth, ' + f"'{f}' as feature, {h} as horizon, " + f'"{f}" as x, y_{h} as y from of' for f in FEATURES for h in HORIZONS)})"""
_K = "partition by symbol, feature, horizon, split"
_SUM = lambda a, b: f"sum({a} * {b}) over ({_K})"
_OFF = lambda v, on: f"coalesce({_SUM(v, on)} / nullif({_SUM(on, on)}, 0), 0) * {on}"
_VARIES = lambda c: f"stddev_pop({c}) over ({_K}) > 1e-12 * greatest(1, max(abs({c})) over ({_K}))"
_FIT = f"""ev as (select *, count(*) over ({_K}) as n from (select * from tr where x is not null and y is not null and past is not null union all select * replace ('valtest' as split) from tr where x is not null and y is not null and past is not null and split <> 'dev')),
dm as (select symbol, feature, horizon, split, "at", n, x as x0, y as y0, {", ".join(f"{c} - avg({c}) over ({_K}, hour) as {a}" for c, a in (("x", "x"), ("y", "y"), ("past", "p"), ("spread_bp", "s"), ("ln_depth", "d")))} from ev where n >= {LEAST}),
v0 as (select *, {_VARIES("x")} as vx, {_VARIES("p")} as vp, {_VARIES("s")} as vs, {_VARIES("d")} as vd from dm),
o0 as (select * replace (case when vp then p else 0 end as p, case when vs then s else 0 end as s, case when vd then d else 0 end as d) from v0 where vx),
o1 as (select * replace (d - {_OFF("d", "s")} as d, p - {_OFF("p", "s")} as p, x - {_OFF("x", "s")} as x, y - {_OFF("y", "s")} as y), y as y1 from o0),
o2 as (select * replace (p - {_OFF("p", "d")} as p, x - {_OFF("x", "d")} as x, y - {_OFF("y", "d")} as y) from o1),
o3 as (select * replace (x - {_OFF("x", "p")} as x, y - {_OFF("y", "p")} as y) from o2),
o4 as (select *, {_SUM("x", "y")} / {_SUM("x", "x")} as b from o3),
o5 as (select *, y - b * x as u, x * (y - b * x) as g from o4),
o6 as (select *, {", ".join(f'g * lag(g, {k}) over ({_K} order by "at") as g{k}' for k in range(1, LAGS + 1))}, rank() over ({_K} order by x0) as rx, count(*) over ({_K}, x0) as cx, rank() over ({_K} order by y0) as ry, count(*) over ({_K}, y0) as cy from o5),
fit as (select symbol, feature, horizon, split, count(*) as n, any_value(b) as beta, sqrt(greatest(sum(g * g){"".join(f" + {2 * (1 - k / (LAGS + 1))!r} * coalesce(sum(g{k}), 0)" for k in range(1, LAGS + 1))}, 0)) / sum(x * x) as se, 1 - sum(u * u) / nullif(sum(y1 * y1), 0) as r2,
 case when count(distinct rx) > 1 and count(distinct ry) > 1 then corr(rx + (cx - 1) / 2.0, ry + (cy - 1) / 2.0) else 0 end as ic, concat_ws(',', case when not bool_or(vp) then 'past' end, case when not bool_or(vs) then 'spread_bp' end, case when not bool_or(vd) then 'ln_depth' end) as dropped from o6 group by 1, 2, 3, 4)"""
_EDGES = f"""eg as (select symbol, feature, list_sort(list(x)) as xs from tr where horizon = {PRIMARY} and split = 'dev' and x is not null group by 1, 2),
bk as (select tr.symbol, tr.feature, "at", y, 1 + {" + ".join(f"(x > xs[least(len(xs), {i} * len(xs) // 10 + 1)])::int" for i in range(1, 10))} as bucket from tr join eg using (symbol, feature) where horizon = {PRIMARY} and split <> 'dev' and x is not null and y is not null)"""

_H = 3_600_000
_FEED = f"""fb as (select symbol, t // {_H} as block, min(seq) as first from updates group by 1, 2),
ci as (select *, lead(t) over (partition by side, price order by seq) as until from updates),
sn as (select fb.block, side, price, qty from fb join ci on ci.t < fb.block * {_H} and coalesce(until, 9e18) >= fb.block * {_H} and qty > 0),
sb as (select distinct block from sn),
de as (select seq, t, t // {_H} as block, side, price, qty from updates where seq % 211 <> 0)"""
_VENDOR = f"""{_FEED},
vu as (select block, -1 as seq, block * {_H} as t, side, price, qty from sn union all select block, seq, t, side, price, qty from de where block in (select block from sb)),
vi as (select *, lead(t) over (partition by block, side, price order by seq) as until, lead(seq) over (partition by block, side, price order by seq) as after from vu),
ev as (select block, t, seq, true as delta from de where block >= (select min(block) from sb) union all select block, block * {_H}, (select min(seq) from updates u where u.t // {_H} = sb.block) - 0.5, false from sb),
es as (select *, bool_or(delta) over (partition by block order by seq) as valid from ev),
el as (select t, max_by(block, seq) as block, max_by(valid, seq) as valid from es group by t),
ss as (select s.symbol, s.at_, el.block from samples s asof join el on s.at_ >= el.t where el.valid),
vl as (select ss.symbol, ss.at_ as "at", side, price, qty, block from ss join vi using (block) where vi.t <= ss.at_ and ss.at_ < coalesce(until, 9e18) and qty > 0),
vm as (select symbol, "at", (max(price) filter (where side = 'bid') + min(price) filter (where side = 'ask')) / 2 as m from vl group by 1, 2),
vn as (select symbol, "at", side, price, qty from vl join vm using (symbol, "at") where case when side = 'bid' then price >= m * 0.98 else price <= m * 1.02 end)"""
_VFX = microstructure._features("vn", 'symbol, "at"').replace("best as", "vbest as").replace("best b", "vbest b").replace("rk as", "vrk as").replace("from rk", "from vrk").replace("ft as", "vft as").replace("from ft", "from vft").replace("fx as", "vfx as")
_SEG = f"""sg as (select block, row_number() over (order by block) as segment from sb)"""
_BOOKS = (_FAST(q.UPDATES), microstructure._AT)

SQL = {
    "prospective_boundary": q.with_(*_BOOKS, _VENDOR) + f""", tw as (select "at" from vm where m is not null), bo as (select min("at") as boundary from tw where "at" > {FROZEN_MS}) select symbol, at_ as "at", boundary, case when coalesce(at_ >= boundary, false) then 'prospective' else 'warmup' end as phase from samples, bo""",
    "vendor_counters": q.with_(*_BOOKS, _FEED) + "select 'BOOK' as symbol, (select count(*) from sb where block in (select block from de)) as snapshots, count(*) filter (where block >= (select min(block) from sb)) as applied, count(*) filter (where block < (select min(block) from sb)) as dropped, 0::bigint as regressions from de",
    "vendor_seconds": q.with_(*_BOOKS, _VENDOR, _VFX, _SEG) + 'select vfx.symbol, "at", segment, ' + ", ".join(f"{_R4(c)} as {c}" for c in COMPARED) + ' from vfx join ss on ss.at_ = vfx."at" join sg using (block)',
    "reconciliation": q.with_(*_BOOKS, microstructure._features("lv", 'symbol, "at"'), _VENDOR, _VFX)
    + f""", jo as (select {", ".join(f"a.{c} as a_{c}, b.{c} as b_{c}" for c in COMPARED)}, a."at" as at_a, b."at" as at_b from vfx a full join fx b on a."at" = b."at"),
lo as ({" union all ".join(f"select '{c}' as col, a_{c} as x, b_{c} as y from jo where at_a is not null and at_b is not null" for c in COMPARED)}), rl as (select *, case when x = y then 0 else round(abs(x - y) / greatest(abs(x), abs(y), 1e-12), 9) end as rel from lo)
select col as "column", count(*) as n, count(*) filter (where rel = 0) as n_equal, (select count(*) from jo where at_b is null) as only_a, (select count(*) from jo where at_a is null) as only_b, {q.r('list_sort(list(rel))[least(count(*), floor(0.5 * count(*))::bigint + 1)]')} as median, {q.r('list_sort(list(rel))[least(count(*), floor(0.99 * count(*))::bigint + 1)]')} as p99, {q.r('max(rel)')} as largest, {_R4('corr(x, y)')} as corr from rl group by 1""",
    "directional_study": q.with_(*RECORDS, _OBS, _FIT) + f"select symbol, feature, horizon, split, n, {q.r('beta * 1e4', 3)} as beta_e4, {q.r('se * 1e4', 3)} as se_e4, {q.r('case when se > 0 then beta / se else 0 end', 3)} as t, {q.r('coalesce(r2, 0)', 5)} as r2, {q.r('ic', 5)} as ic, dropped from fit",
    "directional_deciles": q.with_(*RECORDS, _OBS, _EDGES, hac("hd", "bk", "symbol, feature, bucket", "y", LAGS)) + f"select symbol, feature, bucket, n, {_R4('mean * 1e4')} as mean_bp, {q.r('t', 3)} as t from hd",
    "second_records": q.with_(*RECORDS) + 'select symbol, "at", bid_levels::int as bid_levels, ask_levels::int as ask_levels, ' + ", ".join(f'{_R4(c)} as "{c}"' for c in (*_SHOWN, *(f"vwap_{s}_{n}" for s in depth.SIDES for n in SIZES))) + " from rec",
    "exec_shortfall": q.with_(*RECORDS, _FIRST, _COSTS, hac("hn", "cd", _BY, "now_bp", 2), hac("hl", "cd", _BY, "later_bp", 2), hac("hd", "cd", _BY, "d", 2))
    + f"""select hn.*exclude (n, mean, t), hn.n as now_n, hl.n as later_n, hd.n as diff_n, {", ".join(f"{_R4(f'{h}.{c}')} as {p}_{c}" for h, p in (("hn", "now"), ("hl", "later"), ("hd", "diff")) for c in ("mean", "t"))}, {_R4('p95')} as p95, {_R4('dispersion')} as dispersion,
 coalesce(hd.mean > 0.5 and hd.t > 2, false) as act_now, coalesce(hd.mean < -0.5 and hd.t < -2, false) as wait_instead
 from hn left join hl using ({_BY}) left join hd using ({_BY}) left join {_TAIL('cd', _BY)} using ({_BY})""",
    "exec_hypotheses": q.with_(*RECORDS, _FIRST, _COSTS, _STATES, hac("hn", "bc", "symbol, state, tercile", "now_bp", 2), hac("hd", "bc", "symbol, state, tercile", "d", 2))
    + f"""select symbol, state, tercile, hn.n as n, {_R4('hn.mean')} as now_mean, {_R4('hn.t')} as now_t, {_R4('hd.mean')} as diff_mean, {_R4('hd.t')} as diff_t, {_R4('p95')} as p95, {_R4('dispersion')} as dispersion
 from hn join hd using (symbol, state, tercile) join {_TAIL('bc', 'symbol, state, tercile')} using (symbol, state, tercile)""",
    "toxicity_drift": q.with_(*RECORDS, _FIRST, _DRIFT, f"dr as ({_DRIFTS})", hac("hd", "dr", "symbol, order_side, wait", "d", 2)) + f"select symbol, order_side, wait, n, {_R4('mean')} as mean, {_R4('t')} as t from hd",
}
