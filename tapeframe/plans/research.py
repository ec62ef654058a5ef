"""Queries on statistics and research verdicts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions import normal
from tapeframe.functions.columns import DAY, HOUR, rounded
from tapeframe.operators import alignment, scans, state, stats, windows
from tapeframe.plans import sqltext as q
from tapeframe.sources import tables

SYMBOL = partial(windows.by, "symbol")
R6 = lambda c: rounded(c, 6).alias(c if isinstance(c, str) else "")


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4h bars with features and the next bar's return."""
    rows = tables.bars(spark, sf_dir, "4h").filter("close > 0")
    before, after = F.lag("close").over(SYMBOL()), F.lead("close").over(SYMBOL())
    rows = rows.withColumn("i", F.row_number().over(SYMBOL())).withColumn("x1", rounded(F.log(F.col("close") / before), 9)).withColumn("x2", rounded(F.log(F.col("volume") / F.lag("volume").over(SYMBOL())), 9))
    return rows.withColumn("y", rounded(F.log(after / F.col("close")), 9)).withColumn("hour", (F.col("t") % DAY / HOUR).cast("long"))


def split_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological thirds by row index; the remainder belongs to the last."""
    rows = _returns(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    third = F.floor(F.col("n") / 3)
    return rows.select("symbol", "t", F.when(F.col("i") <= third, "dev").when(F.col("i") <= 2 * third, "val").otherwise("test").alias("split"))


def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.picked(_returns(spark, sf_dir), ["symbol"], "x1", 10)


def decile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next returns by decile of x1, edges from the first third, rows from the others, with HAC t."""
    rows = _returns(spark, sf_dir).withColumn("third", F.floor(F.count("*").over(W.partitionBy("symbol")) / 3))
    edges = stats.picked(rows.filter("i <= third"), ["symbol"], "x1", 10)
    later = rows.filter("i > third and x1 is not null and y is not null").join(edges, "symbol")
    later = later.withColumn("bucket", stats.bucket_of(F.col("x1"), [F.col(f"e{i}") for i in range(1, 10)]))
    found = stats.hac_mean(later, ["symbol", "bucket"], "t", "y", 3)
    return found.select("symbol", "bucket", "n", rounded("mean").alias("mean"), rounded("t", 4).alias("t"))


def hac_mean_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.hac_mean(_returns(spark, sf_dir), ["symbol"], "t", "y", 12)
    return found.select("symbol", "n", rounded("mean").alias("mean"), rounded("se").alias("se"), rounded("t", 4).alias("t"))


def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.rank_ic(_returns(spark, sf_dir), ["symbol"], "x2", "y")
    return found.select("symbol", "n", rounded("ic").alias("ic"))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.average_ranks(tables.bars(spark, sf_dir, "4h"), ["symbol"], "trades", "rank").select("symbol", "t", "trades", "rank")


def hourly_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the closes above 50 of each symbol and hour of the day; 0 where there are none, or one."""
    rows = tables.bars(spark, sf_dir, "1h").select("symbol", F.floor(F.col("t") % DAY / 3_600_000).alias("hour"), F.when(F.col("close") > 50, F.col("close")).alias("x"))
    return stats.moments(rows, ["symbol", "hour"], "x").select("symbol", "hour", "n", rounded("mean").alias("mean"), rounded("sd").alias("sd"))


def load_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, weekdays, weekend days, hours of covered seconds, and whether all requirements are met."""
    days = tables.seconds(spark, sf_dir).groupBy("symbol", F.floor(F.col("s") / 86400).alias("d")).agg(F.count("*").alias("seconds"))
    weekend = (F.col("d") % 7).isin(2, 3)  # day 0 was a Thursday
    found = days.groupBy("symbol").agg(F.count("*").alias("n_days"), F.sum((~weekend).cast("long")).alias("n_weekdays"), F.sum(weekend.cast("long")).alias("n_weekend"), (F.sum("seconds") / 3600).alias("hours"))
    met = (F.col("n_days") >= 30) & (F.col("n_weekdays") >= 20) & (F.col("n_weekend") >= 8) & (F.col("hours") >= 600)
    return found.withColumn("hours", rounded("hours")).withColumn("met", met)


def hourly_vol_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of the changes between seconds of each hour, in bp an hour: quantiles and their spread.

    Hours need 60 seconds and the spread 24 hours; the tape of the tests is too thin for both, so
    days of five 30-minute bars are measured beside them.
    """
    secs = tables.seconds(spark, sf_dir).filter("px > 0").withColumn("t", F.col("s") * 1000)
    bars = tables.bars(spark, sf_dir, "30m").filter("close > 0")
    found = [("hour", stats.volatility_coverage(secs, ["symbol"], "t", "px", 3_600_000, 60, 24, 60 * 1e4)), ("day", stats.volatility_coverage(bars, ["symbol"], "t", "close", DAY, 5, 10, 1.0))]
    rows = [f.select(F.lit(name).alias("span"), "symbol", "periods", *[rounded(c).alias(c) for c in ("p10", "p50", "p90")], rounded(F.col("spread")).alias("spread")) for name, f in found]
    return rows[0].unionByName(rows[1]).withColumn("met", F.coalesce(F.col("spread") >= 2, F.lit(False)))


def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by tercile of volume; fewer than 100 observations are insufficient."""
    rows = _returns(spark, sf_dir).filter("y is not null")
    edges = stats.picked(rows, ["symbol"], "volume", 3)
    rows = rows.join(edges, "symbol").withColumn("tercile", stats.bucket_of(F.col("volume"), [F.col("e1"), F.col("e2")]))
    found = rows.groupBy("symbol", "tercile").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    total = F.sum("n").over(W.partitionBy("symbol"))
    return found.select("symbol", "tercile", "n", F.when(total >= 100, rounded("mean")).alias("mean"), F.when(total < 100, "insufficient").otherwise("ok").alias("status"))


def ols_fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next return on both features with hour-of-day effects taken out, per symbol, as moments."""
    rows = _returns(spark, sf_dir).filter("x1 is not null and x2 is not null and y is not null")
    for c in ("x1", "x2", "y"):
        rows = rows.withColumn(f"d_{c}", windows.demeaned(rows, ["symbol", "hour"], c))
    s = lambda a, b: F.sum(F.col(f"d_{a}") * F.col(f"d_{b}"))
    m = rows.groupBy("symbol").agg(F.count("*").alias("n"), s("x1", "x1").alias("a"), s("x1", "x2").alias("b"), s("x2", "x2").alias("c"), s("x1", "y").alias("p"), s("x2", "y").alias("r"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return m.select("symbol", "n", rounded((F.col("c") * F.col("p") - F.col("b") * F.col("r")) / det).alias("beta1"), rounded((F.col("a") * F.col("r") - F.col("b") * F.col("p")) / det).alias("beta2"))


def ols_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Univariate and bivariate regressions of the next return with Newey-West errors, for each symbol."""
    rows = _returns(spark, sf_dir).select("symbol", "t", "y", "x1", "x2").filter("x1 is not null and y is not null")
    one = rows.withColumns({"model": F.lit("one"), "x2": F.lit(0.0)})  # a regressor that doesn't vary is dropped
    found = stats.regressions(one.unionByName(rows.withColumn("model", F.lit("two"))), ["symbol", "model"], "t", "y", ["x1", "x2"], 6, DAY)
    return found.select("symbol", "model", "term", "n", *[rounded(c, 5).alias(c) for c in ("beta", "se", "t", "r2")])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily scores x*y of each symbol and feature, missing days 0."""
    rows = _returns(spark, sf_dir).withColumn("d", F.floor(F.col("t") / DAY))
    pairs = F.explode(F.array(*[F.struct(F.concat_ws("_", F.lit(f), "symbol").alias("config"), (F.col(f) * F.col("y")).alias("v")) for f in ("x1", "x2")]))
    long = rows.select("d", pairs.alias("p")).select("d", "p.config", "p.v")
    return long.groupBy("d", "config").agg(F.sum("v").alias("v"))


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of daily scores, configurations pairwise."""
    names = sorted(r.config for r in _scores(spark, sf_dir).select("config").distinct().collect())  # features times symbols of the study
    wide = _scores(spark, sf_dir).groupBy("d").pivot("config", names).agg(F.first("v"))
    rho = stats.correlations(wide, names)
    return spark.createDataFrame([(a, b, round(float(rho[i, j]), 5)) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, rho double")


def effective_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective number of trials of the configurations and the threshold it implies."""
    names = sorted(r.config for r in _scores(spark, sf_dir).select("config").distinct().collect())
    wide = _scores(spark, sf_dir).groupBy("d").pivot("config", names).agg(F.first("v"))
    n = stats.effective_trials(stats.correlations(wide, names))
    return spark.createDataFrame([(len(names), round(n, 6), round(normal.bonferroni_threshold(121 + round(n)), 6))], "n_configs long, n_effective double, threshold double")


def economic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the spread of the extreme deciles against each profile's cost; both A and B have to be beaten."""
    rows = decile_table(spark, sf_dir)
    found = rows.groupBy("symbol").agg(F.max_by("mean", "bucket").alias("top"), F.min_by("mean", "bucket").alias("bottom")).withColumn("gross_bp", rounded(F.abs(F.col("top") - F.col("bottom")) / 2 * 1e4, 2))
    return found.select("symbol", "gross_bp", *[(F.col("gross_bp") > cost).alias(f"beats_{p}") for p, cost in (("A", 10.0), ("B", 14.0), ("C", 20.0))], ((F.col("gross_bp") > 10) & (F.col("gross_bp") > 14)).alias("passes"))


def directional_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gates of each symbol and feature: stable sign, significant in validation and test, beyond the
    threshold for all trials, monotone deciles, and economic; what the study would say if the sample sufficed."""
    rows = _returns(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    third = F.floor(F.col("n") / 3)
    split = F.when(F.col("i") <= third, "dev").when(F.col("i") <= 2 * third, "val").otherwise("test")
    long = rows.select("symbol", "t", "y", split.alias("split"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in ("x1", "x2")])).alias("p")).select("symbol", "t", "y", "split", "p.*").filter("x is not null and y is not null")
    every = long.unionByName(long.filter("split <> 'dev'").withColumn("split", F.lit("valtest")))
    fits = stats.slope(every, ["symbol", "feature", "split"], "t", "x", "y", 3)
    wide = fits.groupBy("symbol", "feature").pivot("split", ["dev", "val", "test", "valtest"]).agg(F.first(rounded("beta")).alias("beta"), F.first(rounded("t", 4)).alias("t"))
    edges = stats.picked(long.filter("split = 'dev'"), ["symbol", "feature"], "x", 10)
    ranked = long.filter("split <> 'dev'").join(edges, ["symbol", "feature"]).withColumn("bucket", stats.bucket_of(F.col("x"), [F.col(f"e{i}") for i in range(1, 10)]) + 1)
    deciles = ranked.groupBy("symbol", "feature", "bucket").agg(rounded(F.avg("y"), 9).alias("mean"))
    deciles = deciles.withColumn("rank", F.rank().over(W.partitionBy("symbol", "feature").orderBy("mean")) + (F.count("*").over(W.partitionBy("symbol", "feature", "mean")) - 1) / 2)
    shape = deciles.groupBy("symbol", "feature").agg(rounded(F.corr("bucket", "rank"), 4).alias("mono"), rounded(F.abs(F.max(F.when(F.col("bucket") == 10, F.col("mean"))) - F.max(F.when(F.col("bucket") == 1, F.col("mean")))) / 2 * 1e4, 2).alias("gross_bp"))
    found = wide.join(shape, ["symbol", "feature"])
    sign = F.when(F.signum("valtest_beta") == 0, 1.0).otherwise(F.signum("valtest_beta"))
    threshold = normal.bonferroni_threshold(131)
    gates = {
        "g1": (F.signum("dev_beta") == sign) & (F.signum("val_beta") == sign) & (F.signum("test_beta") == sign),
        "g2": (F.abs("val_t") >= 2) & (F.abs("test_t") >= 2),
        "g3": F.abs("valtest_t") > threshold,
        "g4": (F.abs("mono") >= 0.7) & (F.signum("mono") == sign),
        "g5": (F.col("gross_bp") > 10) & (F.col("gross_bp") > 14),
    }
    complete = F.col("dev_beta").isNotNull() & F.col("val_beta").isNotNull() & F.col("test_beta").isNotNull()
    failed = F.when(~complete, "insufficient observations").otherwise(F.concat_ws(",", *[F.when(~F.coalesce(g, F.lit(False)), F.lit(name)) for name, g in gates.items()]))
    return found.select("symbol", "feature", *[f"{k}_{c}" for k in ("dev", "val", "test", "valtest") for c in ("beta", "t")], "mono", "gross_bp", failed.alias("failed"), (failed == "").alias("passes"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each symbol: the sample, with its volatility states, comes first; without it nothing else is said."""
    sample = load_coverage(spark, sf_dir).select("symbol", F.col("met").alias("covered"))
    states = hourly_vol_spread(spark, sf_dir).filter("span = 'hour'").select("symbol", F.col("met").alias("states"))
    passed = directional_gates(spark, sf_dir).groupBy("symbol").agg(F.max("passes").alias("passes"))
    rows = sample.join(states, "symbol", "left").join(passed, "symbol", "left").na.fill(False)
    met = F.col("covered") & F.col("states")
    status = F.when(~met, "COLLECTING — INSUFFICIENT").when(F.col("passes"), "DIRECTIONAL MODEL VALIDATED").otherwise("REJECT — NOT TRADABLE")
    return rows.select("symbol", "covered", "states", met.alias("met"), rounded(F.lit(normal.bonferroni_threshold(131)), 4).alias("threshold"), status.alias("status"))


def drawdown_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the return series of each symbol."""
    found = stats.curve_metrics(_returns(spark, sf_dir).filter("y is not null").select("symbol", "t", "y"), ["symbol"], "t", "y")
    return found.select("symbol", "n", "losing_streak", *[rounded(c, 5).alias(c) for c in ("expectancy", "win_rate", "profit_factor", "profit_factor_ex_best", "sharpe", "sortino", "max_drawdown", "ulcer", "largest_share", "calmar")])


def return_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population skewness and (not excess) kurtosis."""
    rows = _returns(spark, sf_dir).filter("y is not null")
    return rows.groupBy("symbol").agg(rounded(F.skewness("y"), 5).alias("skew"), rounded(F.kurtosis("y") + 3, 5).alias("kurt"))


def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe of the pooled returns, what the best of 20 trials would show, and the probability of beating it."""
    y = _returns(spark, sf_dir).filter("y is not null").agg((F.avg("y") / F.stddev_pop("y")).alias("sr"), F.count("*").alias("n"), F.skewness("y").alias("s"), (F.kurtosis("y") + 3).alias("k")).first()
    best, p = stats.deflated_sharpe(y.sr, y.n, y.s, y.k, 20, 1 / y.n)
    return spark.createDataFrame([(y.n, round(y.sr, 6), round(best, 6), round(p, 6))], "n long, sharpe double, best_expected double, probability double")


def seeded_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate means of blocks of six rows, drawn by a seeded hash of replicate and position; 20 replicates."""
    rows = _returns(spark, sf_dir).filter("y is not null").withColumn("n", F.row_number().over(SYMBOL()) - 1)
    blocks = rows.groupBy("symbol", F.floor(F.col("n") / 6).alias("block")).agg(F.sum("y").alias("sum"), F.count("*").alias("m"))
    size = blocks.groupBy("symbol").agg(F.count("*").alias("n_blocks"))
    drawn = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    seed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = drawn.withColumn("block", seed % F.col("n_blocks"))
    found = drawn.join(blocks, ["symbol", "block"]).groupBy("symbol", "rep").agg((F.sum("sum") / F.sum("m")).alias("mean"))
    return found.select("symbol", "rep", rounded("mean").alias("mean"))


def shuffled_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with the signs of the feature shuffled by a seeded hash: what noise gives."""
    rows = _returns(spark, sf_dir).filter("x1 is not null and y is not null")
    bit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("sign"), F.col("symbol"), F.col("t").cast("string"))), 1, 1), 16, 10).cast("long") % 2
    rows = rows.withColumn("flipped", F.col("x1") * (1 - 2 * bit))
    return rows.groupBy("symbol").agg(rounded(F.corr("x1", "y"), 5).alias("real"), rounded(F.corr("flipped", "y"), 5).alias("shuffled"))


def session_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median volume and realised volatility of each New York hour."""
    rows = tables.bars(spark, sf_dir, "1h").withColumn("hour", F.hour(F.from_utc_timestamp(F.timestamp_millis("t"), "America/New_York"))).withColumn("r", windows.log_return(F.col("close"), SYMBOL()))
    return rows.groupBy("symbol", "hour").agg(F.count("*").alias("n"), F.percentile("volume", F.lit(0.5)).alias("median_volume"), rounded(F.stddev_pop("r"), 5).alias("vol"))


def smoothing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a sign: how many, how long, and flips that reverse within two bars."""
    rows = _returns(spark, sf_dir).filter("x1 is not null").withColumn("sign", F.signum("x1").cast("int"))
    new = F.coalesce((F.col("sign") != F.lag("sign").over(SYMBOL())).cast("long"), F.lit(1))
    rows = rows.withColumn("run", F.sum(new).over(SYMBOL().rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("symbol", "run").agg(F.count("*").alias("len"))
    return runs.groupBy("symbol").agg(F.count("*").alias("n_runs"), rounded(F.avg("len"), 5).alias("mean_length"), F.max("len").alias("longest"), F.sum((F.col("len") <= 2).cast("long")).alias("false_flips"))


def tier_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by deviations against tiers by percentile."""
    rows = windows.valid_norm(tables.bars(spark, sf_dir, "4h"), ["symbol"], "close", n=40, least=20).filter("z is not null")
    z, p = rounded("z", 4), rounded("pct", 4)
    a = F.when(F.abs(z) >= 2, 2).when(F.abs(z) >= 1, 1).otherwise(0)
    b = F.when(F.greatest(p, 100 - p) >= 97.5, 2).when(F.greatest(p, 100 - p) >= 84, 1).otherwise(0)
    return rows.groupBy(a.alias("sigma_tier"), b.alias("percentile_tier")).agg(F.count("*").alias("n"))


def exposure_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's mean return against the same exposure held always, and scaled by past volatility."""
    rows = _returns(spark, sf_dir).withColumn("vol", rounded(windows.deviation(F.col("x1"), 10, SYMBOL()))).filter("vol > 0 and y is not null")
    on = F.when(F.col("x1") > 0, 1.0).otherwise(0.0)
    return rows.groupBy("symbol").agg(rounded(F.avg(on), 5).alias("exposure"), rounded(F.avg(on * F.col("y")), 5).alias("rule"), rounded(F.avg(on) * F.avg("y"), 5).alias("matched"), rounded(F.avg(F.least(0.5 / F.col("vol"), F.lit(2.0)) * F.col("y")), 5).alias("scaled"))


def risk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the median-clamped risk multiplier would cut, keep or raise the budget."""
    rows = tables.bars(spark, sf_dir, "4h").withColumn("range", F.col("high") - F.col("low")).filter("range > 0")
    rows = rows.withColumn("m", rounded(windows.rolling_median_clamped(F.col("range"), 30, SYMBOL(), 0.5, 1.5)))
    word = F.when(F.col("m").isNull(), "unknown").when(F.col("m") < 0.8, "cut").when(F.col("m") > 1.2, "raise").otherwise("keep")
    return rows.groupBy("symbol", word.alias("action")).agg(F.count("*").alias("n"))


def overnight_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-slot return on the overnight return of the same New York day: slope and correlation."""
    local = F.from_utc_timestamp(F.timestamp_millis("t"), "America/New_York")
    rows = tables.bars(spark, sf_dir, "1h").filter("close > 0 and open > 0").withColumn("d", F.to_date(local)).withColumn("h", F.hour(local))
    days = rows.groupBy("symbol", "d").agg(F.max(F.when(F.col("h") == 9, F.col("close"))).alias("morning"), F.max(F.when(F.col("h") == 15, F.col("open"))).alias("late"), F.max(F.when(F.col("h") == 15, F.col("close"))).alias("close"))
    days = days.withColumn("x", F.log(F.col("morning") / F.lag("close").over(W.partitionBy("symbol").orderBy("d")))).withColumn("y", F.log(F.col("close") / F.col("late"))).filter("x is not null and y is not null")
    return days.groupBy("symbol").agg(F.count("*").alias("n"), rounded(F.regr_slope("y", "x"), 4).alias("slope"), rounded(F.corr("x", "y"), 4).alias("corr"))


def trial_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per study: feature, split, n, mean score."""
    rows = _returns(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("symbol"))).withColumn("split", F.when(F.col("i") <= F.floor(F.col("n") / 3), "dev").otherwise("rest"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in ("x1", "x2")]))
    long = rows.select("symbol", "split", "y", pairs.alias("p")).select("symbol", "split", "p.feature", "p.x", "y").filter("x is not null and y is not null")
    return long.groupBy("symbol", "split", "feature").agg(F.count("*").alias("n"), rounded(F.regr_slope("y", "x"), 5).alias("beta"))


def trade_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of one position at a time: after a fall of a fifth, with a stop of 1.5 ranges below the signal's
    close and a trail at the lowest low of the ten bars before."""
    w = SYMBOL()
    rows = tables.bars(spark, sf_dir, "4h").filter("close > 0 and open > 0").withColumn("tr", windows.true_range(w))
    rows = scans.smoothed(rows, ["symbol"], "t", "tr", 14, 1 / 14, "atr", block=10 * DAY)
    rows = rows.withColumn("signal", F.coalesce(F.col("close") < F.lag("close").over(w) * 0.8, F.lit(False)) & F.col("atr").isNotNull())
    lows = w.rowsBetween(-10, -1)
    rows = rows.withColumn("stop", rounded(F.col("close") - 1.5 * F.col("atr"))).withColumn("trail", F.when(F.count("low").over(lows) == 10, F.min("low").over(lows)))
    found = state.simulated(rows.select("symbol", "t", "open", "high", "low", "close", "signal", "stop", "trail"), ["symbol"])
    return found.select("symbol", "signal_t", "entry_t", "exit_t", "entry", rounded("exit").alias("exit"), "initial_stop", "how", *[rounded(c, 5).alias(c) for c in ("r", "mae", "mfe")])


QUERIES = {
    f.__name__: f
    for f in (
        split_thirds, quantile_edges, decile_table, hac_mean_t, rank_ic, average_ranks, hourly_moments, load_coverage, hourly_vol_spread, terciles, ols_fe, ols_hac, correlation_matrix,
        effective_trials, economic_gate, directional_gates, gates, drawdown_curve, return_moments, deflated_sharpe, seeded_bootstrap, shuffled_baseline, session_seasonality, smoothing_audit, tier_confusion, exposure_control,
        risk_budget, overnight_replication, trial_registry, trade_simulation,
    )
}

_r = q.r
_RET = f"""rt as (select *, row_number() over w as i, {_r('ln(close / lag(close) over w)', 9)} as x1, {_r('ln(volume / lag(volume) over w)', 9)} as x2, {_r('ln(lead(close) over w / close)', 9)} as y, (t % 86400000) // 3600000 as hour from b4h where close > 0 window w as (partition by symbol order by t))"""
_RS = q.with_(q.TAPE, q.B4H, _RET)


def _edges(source: str, value: str, k: int, name: str) -> str:
    return f"{name}0 as (select symbol, {value} as v, row_number() over (partition by symbol order by {value}) - 1 as rn, count(*) over (partition by symbol) as n from {source} where {value} is not null), {name} as (select symbol, " + ", ".join(f"max(v) filter (where rn = least(n - 1, floor({i} * n / {k})))  as e{i}" for i in range(1, k)) + f" from {name}0 group by symbol)"


def _hac(source: str, keys: str, order: str, value: str, lags: int, name: str) -> str:
    lagged = ", ".join(f"e * lag(e, {k}) over w as p{k}" for k in range(1, lags + 1))
    total = "sum(e * e)" + "".join(f" + 2 * (1 - {k}::double / {lags + 1}) * coalesce(sum(p{k}), 0)" for k in range(1, lags + 1))
    return f"""{name}e as (select *, {value} - avg({value}) over (partition by {keys}) as e from {source} where {value} is not null), {name}l as (select *, {lagged} from {name}e window w as (partition by {keys} order by {order})),
{name}s as (select {keys}, count(*) as n, avg({value}) as mean, sqrt(greatest({total}, 0)) / count(*) as se from {name}l group by {keys}), {name} as (select *, case when n >= 2 then case when se > 0 then mean / se else 0 end end as t from {name}s)"""


_CNT = "ct as (select *, count(*) over (partition by symbol) as cn from rt)"
_DEC = ", ".join([_CNT, "dv as (select * from ct where i <= floor(cn / 3))", _edges("dv", "x1", 10, "ed"), "lt as (select c.*, " + " + ".join(f"(x1 > e{i})::int" for i in range(1, 10)) + " as bucket from ct c join ed using (symbol) where i > floor(cn / 3) and x1 is not null and y is not null)", _hac("lt", "symbol, bucket", "t", "y", 3, "hm")])
_LATE = """bb as (select symbol, t // 1000 as s, close, trades % 2 = 0 as bought from b30m where close > 0)"""
_COV = f"cv as (select symbol, count(*) as n_days, count(*) filter (where d % 7 not in (2, 3)) as n_weekdays, count(*) filter (where d % 7 in (2, 3)) as n_weekend, {_r('sum(n) / 3600.0::double')} as hours from (select symbol, s // 86400 as d, count(*) as n from secs group by 1, 2) group by symbol)"
_ECO = f"eg as (select symbol, {_r('abs(arg_max(m, bucket) - arg_min(m, bucket)) / 2 * 1e4', 2)} as gross_bp from (select symbol, bucket, {_r('mean')} as m from hm) group by symbol)"
_MET = "n_days >= 30 and n_weekdays >= 20 and n_weekend >= 8 and hours >= 600"
_SPREAD = f"""vr as (select 'hour' as span, symbol, s // 3600 as p, ln(px / lag(px) over (partition by symbol, s // 3600 order by s)) as r, 60 as least, 24 as many, 600000.0::double as scale from secs where px > 0
 union all select 'day', symbol, t // 86400000, ln(close / lag(close) over (partition by symbol, t // 86400000 order by t)), 5, 10, 1.0 from b30m where close > 0),
vp as (select span, symbol, many, stddev_pop(r) * scale as vol from vr group by span, symbol, p, least, many, scale having count(*) >= least),
vk as (select *, row_number() over (partition by span, symbol order by vol) - 1 as k, count(*) over (partition by span, symbol) as n from vp),
vq as (select span, symbol, max(n) as periods, {', '.join(f"max(vol) filter (where n >= many and k = least(n - 1, floor(n * {x})::bigint)) as {c}" for c, x in (('p10', 0.1), ('p50', 0.5), ('p90', 0.9)))} from vk group by 1, 2),
vs as (select span, symbol, periods, {_r('p10')} as p10, {_r('p50')} as p50, {_r('p90')} as p90, {_r("case when p10 > 0 then p90 / p10 when p10 is not null then 'inf'::double end")} as spread from vq)"""
_THR = normal.bonferroni_threshold(131)
_GATES = f"""g0 as (select symbol, t, y, case when i <= floor(cn / 3) then 'dev' when i <= 2 * floor(cn / 3) then 'val' else 'test' end as split, unnest(['x1', 'x2']) as feature, unnest([x1, x2]) as x from (select *, count(*) over (partition by symbol) as cn from rt)),
g1 as (select * from g0 where x is not null and y is not null), g2 as (select * from g1 union all by name select * replace ('valtest' as split) from g1 where split <> 'dev'),
g3 as (select *, x - avg(x) over k as dx, y - avg(y) over k as dy from g2 window k as (partition by symbol, feature, split)), g4 as (select *, sum(dx * dy) over k / nullif(sum(dx * dx) over k, 0) as b from g3 window k as (partition by symbol, feature, split)),
g5 as (select *, dx * (dy - b * dx) as g from g4), g6 as (select *, g * lag(g, 1) over w as p1, g * lag(g, 2) over w as p2, g * lag(g, 3) over w as p3 from g5 window w as (partition by symbol, feature, split order by t)),
g7 as (select symbol, feature, split, max(b) as beta, sqrt(greatest(sum(g * g) + 1.5 * coalesce(sum(p1), 0) + coalesce(sum(p2), 0) + 0.5 * coalesce(sum(p3), 0), 0)) / sum(dx * dx) as se from g6 group by all),
g8 as (select symbol, feature, split, {_r('beta')} as beta, {_r('case when se > 0 then beta / se else 0 end', 4)} as t from g7),
g9 as (select symbol, feature, {', '.join(f"max(beta) filter (where split = '{k}') as {k}_beta, max(t) filter (where split = '{k}') as {k}_t" for k in ('dev', 'val', 'test', 'valtest'))} from g8 group by all),
h1 as (select symbol, feature, bucket, {_r('avg(y)', 9)} as mean from (select g1.*, 1 + {' + '.join(f"(x > xs[least(len(xs), {i} * len(xs) // 10 + 1)])::int" for i in range(1, 10))} as bucket from g1 join (select symbol, feature, list_sort(list(x)) as xs from g1 where split = 'dev' group by all) using (symbol, feature) where split <> 'dev') group by all),
h2 as (select *, rank() over (partition by symbol, feature order by mean) + (count(*) over (partition by symbol, feature, mean) - 1) / 2.0 as rk from h1),
h3 as (select symbol, feature, {_r('corr(bucket, rk)', 4)} as mono, {_r('abs(max(mean) filter (where bucket = 10) - max(mean) filter (where bucket = 1)) / 2 * 1e4', 2)} as gross_bp from h2 group by all),
h4 as (select *, case when sign(valtest_beta) = 0 then 1 else sign(valtest_beta) end as sg from g9 join h3 using (symbol, feature)),
h5 as (select *, case when dev_beta is null or val_beta is null or test_beta is null then 'insufficient observations' else concat_ws(',', case when not coalesce(sign(dev_beta) = sg and sign(val_beta) = sg and sign(test_beta) = sg, false) then 'g1' end, case when not coalesce(abs(val_t) >= 2 and abs(test_t) >= 2, false) then 'g2' end,
 case when not coalesce(abs(valtest_t) > {_THR}, false) then 'g3' end, case when not coalesce(abs(mono) >= 0.7 and sign(mono) = sg, false) then 'g4' end, case when not coalesce(gross_bp > 14, false) then 'g5' end) end as failed from h4),
gt as (select * exclude (sg), failed = '' as passes from h5)"""
_DM = ", ".join(f"{c} - avg({c}) over (partition by symbol, hour) as d{c}" for c in ("x1", "x2", "y"))
_NY = "timezone('America/New_York', make_timestamptz(t * 1000))"

SQL = {
    "split_thirds": _RS + "select symbol, t, case when i <= floor(cn / 3) then 'dev' when i <= 2 * floor(cn / 3) then 'val' else 'test' end as split from (select *, count(*) over (partition by symbol) as cn from rt)",
    "quantile_edges": q.with_(q.TAPE, q.B4H, _RET, _edges("rt", "x1", 10, "ed")) + "select * from ed",
    "decile_table": q.with_(q.TAPE, q.B4H, _RET, _DEC) + f"select symbol, bucket, n, {_r('mean')} as mean, {_r('t', 4)} as t from hm",
    "hac_mean_t": q.with_(q.TAPE, q.B4H, _RET, _hac("rt", "symbol", "t", "y", 12, "hm")) + f"select symbol, n, {_r('mean')} as mean, {_r('se')} as se, {_r('t', 4)} as t from hm",
    "rank_ic": _RS + f"select symbol, count(*) as n, {_r('coalesce(corr(rx, ry), 0)')} as ic from (select symbol, rank() over (partition by symbol order by x2) + (count(*) over (partition by symbol, x2) - 1) / 2.0 as rx, rank() over (partition by symbol order by y) + (count(*) over (partition by symbol, y) - 1) / 2.0 as ry from rt where x2 is not null and y is not null) group by symbol",
    "average_ranks": q.with_(q.TAPE, q.B4H) + "select symbol, t, trades, (rank() over (partition by symbol order by trades) + (count(*) over (partition by symbol, trades) - 1) / 2.0)::double as rank from b4h",
    "hourly_moments": q.with_(q.TAPE, q.B1H)
    + f"select symbol, (t % 86400000) // 3600000 as hour, count(x) as n, {_r('coalesce(avg(x), 0)')} as mean, {_r('case when count(x) < 2 then 0 else stddev_pop(x) end')} as sd from (select symbol, t, case when close > 50 then close end as x from b1h) group by 1, 2",
    "load_coverage": q.with_(q.TAPE, q.SECONDS, _COV) + f"select *, {_MET} as met from cv",
    "hourly_vol_spread": q.with_(q.TAPE, q.SECONDS, q.B30, _SPREAD) + "select span, symbol, periods, p10, p50, p90, spread, coalesce(spread >= 2, false) as met from vs",
    "terciles": q.with_(q.TAPE, q.B4H, _RET, "ok as (select * from rt where y is not null)", _edges("ok", "volume", 3, "ed"))
    + f", g as (select symbol, (volume > e1)::int + (volume > e2)::int as tercile, count(*) as n, avg(y) as mean from ok join ed using (symbol) group by 1, 2) select symbol, tercile, n, case when sum(n) over (partition by symbol) >= 100 then {_r('mean')} end as mean, case when sum(n) over (partition by symbol) < 100 then 'insufficient' else 'ok' end as status from g",
    "ols_fe": _RS
    + f", d as (select symbol, {_DM} from rt where x1 is not null and x2 is not null and y is not null), m as (select symbol, count(*) as n, sum(dx1 * dx1) as a, sum(dx1 * dx2) as b, sum(dx2 * dx2) as c, sum(dx1 * dy) as p, sum(dx2 * dy) as r from d group by symbol) select symbol, n, {_r('(c * p - b * r) / (a * c - b * b)')} as beta1, {_r('(a * r - b * p) / (a * c - b * b)')} as beta2 from m",
    "correlation_matrix": _RS
    + """, l as (select t // 86400000 as d, unnest(['x1_' || symbol, 'x2_' || symbol]) as config, unnest([x1 * y, x2 * y]) as v from rt), s as (select d, config, sum(v) as v from l group by 1, 2), f as (select d, config, coalesce(v, 0) as v from (select distinct d from s) cross join (select distinct config from s) left join s using (d, config))
select a.config as a, b.config as b, round(corr(a.v, b.v), 5) as rho from f a join f b using (d) group by 1, 2""",
    "economic_gate": q.with_(q.TAPE, q.B4H, _RET, _DEC, _ECO) + 'select symbol, gross_bp, gross_bp > 10 as "beats_A", gross_bp > 14 as "beats_B", gross_bp > 20 as "beats_C", gross_bp > 14 as passes from eg',
    "directional_gates": q.with_(q.TAPE, q.B4H, _RET, _GATES) + "select * from gt",
    "gates": q.with_(q.TAPE, q.SECONDS, q.B30, q.B4H, _COV, _SPREAD, _RET, _GATES)
    + f""", ps as (select symbol, bool_or(passes) as passes from gt group by 1), j as (select symbol, {_MET} as covered, coalesce(vs.spread >= 2, false) as states, coalesce(passes, false) as passes from cv left join (select * from vs where span = 'hour') vs using (symbol) left join ps using (symbol))
select symbol, covered, states, covered and states as met, {_r(str(normal.bonferroni_threshold(131)), 4)} as threshold, case when not (covered and states) then 'COLLECTING — INSUFFICIENT' when passes then 'DIRECTIONAL MODEL VALIDATED' else 'REJECT — NOT TRADABLE' end as status from j""",
    "drawdown_curve": _RS
    + f""", e as (select symbol, t, y, sum(y) over w as eq from rt where y is not null window w as (partition by symbol order by t)), d as (select *, eq - greatest(max(eq) over w, 0) as dd, sum((y >= 0)::int) over w as run, row_number() over (partition by symbol order by y desc, t) as best, count(*) over (partition by symbol) as n from e window w as (partition by symbol order by t)),
s as (select symbol, max(l)::bigint as losing_streak from (select symbol, run, sum((y < 0)::int) as l from d group by 1, 2) group by symbol),
m as (select symbol, count(*) as n, avg(y) as ex, avg((y > 0)::int) as wr, sum(case when y > 0 then y else 0 end) as g, sum(case when y > 0 and best > ceil(n * 0.05) then y else 0 end) as gx, sum(case when y < 0 then -y else 0 end) as l, stddev_pop(y) as sd, sqrt(avg(pow(least(y, 0), 2))) as down, min(dd) as dd, sqrt(avg(pow(dd, 2))) as ul, max(y) as top from d group by symbol)
select symbol, n, losing_streak, {_r('ex', 5)} as expectancy, {_r('wr', 5)} as win_rate, {_r('g / l', 5)} as profit_factor, {_r('gx / l', 5)} as profit_factor_ex_best, {_r('ex / sd', 5)} as sharpe, {_r('ex / down', 5)} as sortino, {_r('dd', 5)} as max_drawdown, {_r('ul', 5)} as ulcer, {_r('greatest(top, 0) / g', 5)} as largest_share, {_r('ex * n / -dd', 5)} as calmar from m join s using (symbol)""",
    "return_moments": _RS + f"select symbol, {_r('avg(pow(e, 3)) / pow(avg(e * e), 1.5)', 5)} as skew, {_r('avg(pow(e, 4)) / pow(avg(e * e), 2)', 5)} as kurt from (select symbol, y - avg(y) over (partition by symbol) as e from rt where y is not null) group by symbol",
    "seeded_bootstrap": _RS
    + f""", n as (select symbol, y, row_number() over (partition by symbol order by t) - 1 as k from rt where y is not null), b as (select symbol, k // 6 as block, sum(y) as s, count(*) as m from n group by 1, 2), z as (select symbol, count(*) as nb from b group by 1),
d as (select symbol, rep, ('0x' || substr(md5(rep || ':' || k), 1, 8))::bigint % nb as block from z, range(20) r(rep), lateral (select unnest(range(nb)) as k)) select symbol, rep::int as rep, {_r('sum(s) / sum(m)')} as mean from d join b using (symbol, block) group by 1, 2""",
    "shuffled_baseline": _RS + f"select symbol, {_r('corr(x1, y)', 5)} as real, {_r('corr(f, y)', 5)} as shuffled from (select symbol, x1, y, x1 * (1 - 2 * (('0x' || substr(md5('sign:' || symbol || ':' || t), 1, 1))::bigint % 2)) as f from rt where x1 is not null and y is not null) group by symbol",
    "session_seasonality": q.with_(q.TAPE, q.B1H)
    + f"select symbol, extract(hour from {_NY})::int as hour, count(*) as n, median(volume) as median_volume, {_r('stddev_pop(r)', 5)} as vol from (select *, case when row_number() over w = 1 then 0.0 when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as r from b1h window w as (partition by symbol order by t)) group by 1, 2",
    "smoothing_audit": _RS
    + f", s as (select symbol, t, sign(x1) as sg from rt where x1 is not null), f as (select *, coalesce((sg <> lag(sg) over w)::int, 1) as new from s window w as (partition by symbol order by t)), r as (select symbol, sum(new) over (partition by symbol order by t) as run from f), l as (select symbol, run, count(*) as len from r group by 1, 2) select symbol, count(*) as n_runs, {_r('avg(len)', 5)} as mean_length, max(len) as longest, count(*) filter (where len <= 2) as false_flips from l group by symbol",
    "tier_confusion": q.with_(q.TAPE, q.B4H)
    + f""", n as (select *, row_number() over (partition by symbol order by t) as i from b4h), z as (select {_r('case when stddev_pop(b.close) > 0 then (a.close - avg(b.close)) / stddev_pop(b.close) else 0 end', 4)} as z, {_r('count(*) filter (where b.i < a.i and b.close <= a.close) * 100.0::double / (count(*) - 1)', 4)} as p
 from n a join n b on a.symbol = b.symbol and b.i between a.i - 39 and a.i group by a.symbol, a.t, a.close having count(*) >= 20) select case when abs(z) >= 2 then 2 when abs(z) >= 1 then 1 else 0 end as sigma_tier, case when greatest(p, 100 - p) >= 97.5 then 2 when greatest(p, 100 - p) >= 84 then 1 else 0 end as percentile_tier, count(*) as n from z group by 1, 2""",
    "exposure_control": _RS
    + f", v as (select *, {_r('case when count(x1) over f = 10 then stddev_pop(x1) over f end')} as vol from rt window f as (partition by symbol order by t rows between 9 preceding and current row)) select symbol, {_r('avg((x1 > 0)::int)', 5)} as exposure, {_r('avg(case when x1 > 0 then y else 0 end)', 5)} as rule, {_r('avg((x1 > 0)::int) * avg(y)', 5)} as matched, {_r('avg(least(0.5 / vol, 2.0) * y)', 5)} as scaled from v where vol > 0 and y is not null group by symbol",
    "risk_budget": q.with_(q.TAPE, q.B4H)
    + f", m as (select symbol, {_r('least(greatest(case when count(*) over f = 30 then median(rng) over f end / rng, 0.5), 1.5)')} as mm, count(*) over f as c from (select *, high - low as rng from b4h) where rng > 0 window f as (partition by symbol order by t rows between 29 preceding and current row)) select symbol, case when mm is null then 'unknown' when mm < 0.8 then 'cut' when mm > 1.2 then 'raise' else 'keep' end as action, count(*) as n from m group by 1, 2",
    "overnight_replication": q.with_(q.TAPE, q.B1H)
    + f""", l as (select *, cast({_NY} as date) as d, extract(hour from {_NY}) as h from b1h where close > 0 and open > 0), g as (select symbol, d, max(close) filter (where h = 9) as morning, max(open) filter (where h = 15) as late, max(close) filter (where h = 15) as close from l group by 1, 2),
x as (select symbol, ln(morning / lag(close) over (partition by symbol order by d)) as x, ln(close / late) as y from g) select symbol, count(*) as n, {_r('regr_slope(y, x)', 4)} as slope, {_r('corr(x, y)', 4)} as corr from x where x is not null and y is not null group by symbol""",
    "trial_registry": _RS + f", c as (select *, count(*) over (partition by symbol) as cn from rt), l as (select symbol, case when i <= floor(cn / 3) then 'dev' else 'rest' end as split, y, unnest(['x1', 'x2']) as feature, unnest([x1, x2]) as x from c) select symbol, split, feature, count(*) as n, {_r('regr_slope(y, x)', 5)} as beta from l where x is not null and y is not null group by 1, 2, 3",
    "trade_simulation": q.with_(q.TAPE, q.B4H, recursive=True)
    + f""", b0 as (select *, row_number() over w as i, case when lag(close) over w is null then high - low else greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr, lag(close) over w as before, case when count(low) over l = 10 then min(low) over l end as trail
 from b4h where close > 0 and open > 0 window w as (partition by symbol order by t), l as (partition by symbol order by t rows between 10 preceding and 1 preceding)),
wa as (select symbol, i, (select avg(tr) from b0 x where x.symbol = b0.symbol and x.i <= 14) as atr from b0 where i = 14 union all select n.symbol, n.i, wa.atr + (n.tr - wa.atr) / 14 from wa join b0 n on n.symbol = wa.symbol and n.i = wa.i + 1),
b1 as (select b0.*, wa.atr, i = max(i) over (partition by symbol) as is_last from b0 left join wa using (symbol, i)),
b2 as (select *, {_r('close - 1.5 * atr')} as stop0, coalesce(close < before * 0.8, false) and atr is not null as signal from b1),
st as (select symbol, i, false as held, signal and stop0 < close as waits, t as wt, close as wc, stop0 as ws, t as st, close as sc, stop0 as s0, 0.0::double as entry, 0::bigint as et, 0.0::double as stop, 0.0::double as mae, 0.0::double as mfe, null::varchar as how, 0.0::double as px from b2 where i = 1
 union all select symbol, i, held_now and how is null, not (held_now and how is null) and signal and stop0 < close, t, close, stop0, st, sc, s0, entry, et, case when how is null then greatest(stop, coalesce(trail, stop)) else stop end,
  case when how is null or how = 'end' then least(mae, low / nullif(entry, 0) - 1) else mae end, case when how is null or how = 'end' then greatest(mfe, high / nullif(entry, 0) - 1) else mfe end, how, case how when 'gap' then open when 'stop' then stop when 'end' then close end
 from (select *, case when held_now then case when open <= stop then 'gap' when low <= stop then 'stop' when is_last then 'end' end end as how
  from (select b.symbol, b.i, b.t, b.open, b.high, b.low, b.close, b.signal, b.stop0, b.trail, b.is_last, s.held or s.waits as held_now, case when s.waits then s.wt else s.st end as st, case when s.waits then s.wc else s.sc end as sc, case when s.waits then s.ws else s.s0 end as s0,
   case when s.waits then b.open else s.entry end as entry, case when s.waits then b.t else s.et end as et, case when s.waits then s.ws else s.stop end as stop, case when s.waits then 0.0 else s.mae end as mae, case when s.waits then 0.0 else s.mfe end as mfe
   from st s join b2 b on b.symbol = s.symbol and b.i = s.i + 1)))
select s.symbol, s.st as signal_t, s.et as entry_t, b.t as exit_t, s.entry, {_r('s.px')} as exit, s.s0 as initial_stop, s.how, {_r('(s.px - s.entry) / (s.sc - s.s0)', 5)} as r, {_r('s.mae', 5)} as mae, {_r('s.mfe', 5)} as mfe from st s join b2 b using (symbol, i) where s.how is not null""",
}
