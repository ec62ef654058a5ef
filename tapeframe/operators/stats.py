"""Statistics as aggregates; only small matrices of sums reach the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.sources.shared import cut


def picked(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """keys and e1 .. e<k-1>: sorted values at min(n-1, floor(i*n/k)).

    Ranks come from counts of distinct values, so ties and hot keys are summed before the
    shuffle and no list of all values is built.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("__to", F.sum("__c").over(w)).withColumn("__n", F.sum("__c").over(W.partitionBy(*keys)))
    at = lambda i: F.least(F.col("__n") - 1, F.floor(i * F.col("__n") / k))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("__to") > at(i), F.col(value))).alias(f"e{i}") for i in range(1, k)])


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float, to: str) -> DataFrame:
    """keys and the value at min(n-1, floor(p*n)) of the sorted values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    ranked = counts.withColumn("__to", F.sum("__c").over(W.partitionBy(*keys).orderBy(value))).withColumn("__n", F.sum("__c").over(W.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(F.min(F.when(F.col("__to") > F.least(F.col("__n") - 1, F.floor(p * F.col("__n"))), F.col(value))).alias(to))


def bucket_of(value: Column, edges: list[Column]) -> Column:
    """How many edges lie strictly below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value > e, 1).otherwise(0)
    return out


def hac_mean(df: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """keys, n, mean, se, t of the mean with a Bartlett kernel; se floors a negative variance at 0, t is 0 without one, null below 2."""
    everything = W.partitionBy(*keys)
    w = everything.orderBy(order)
    rows = df.filter(F.col(value).isNotNull()).withColumn("__e", F.col(value) - F.avg(value).over(everything))
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"__p{k}", F.col("__e") * F.lag("__e", k).over(w))
    total = F.sum(F.col("__e") * F.col("__e"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__p{k}"), F.lit(0.0))
    n = F.count("*")
    out = rows.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), (F.sqrt(F.greatest(total, F.lit(0.0))) / n).alias("se"))
    return out.withColumn("t", F.when(F.col("n") >= 2, F.when(F.col("se") > 0, F.col("mean") / F.col("se")).otherwise(0.0)))


def gram(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """Sums of products of the columns with a leading 1, in one aggregation, and the row count."""
    names = ["__one", *columns]
    rows = df.withColumn("__one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
    return out, int(out[0, 0])


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all the columns are finite numbers."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")))
    return df


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean and population deviation of the values there are: the mean of none is 0, the deviation of fewer than two 0."""
    found = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return found.withColumn("mean", F.coalesce("mean", F.lit(0.0))).withColumn("sd", F.when(F.col("n") < 2, 0.0).otherwise(F.col("sd")))


#: Rows of a run: what one task reads in order.
RUN = 50_000


def numbered(df: DataFrame, keys: list[str], order: str, block: int) -> DataFrame:
    """df with __i, its place in the order within its keys, and __n, the rows of its keys.

    Places come from counts of blocks of the order and places within them, so no window holds all rows.
    """
    rows = df.withColumn("__block", F.floor(F.col(order) / block))
    counts = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__c"))
    upto = W.partitionBy(*keys).orderBy("__block")  # a row a block
    before = F.coalesce(F.sum("__c").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    places = counts.select(*keys, "__block", before, F.sum("__c").over(W.partitionBy(*keys)).alias("__n"))
    rows = rows.join(places, [*keys, "__block"])
    return rows.withColumn("__i", F.col("__before") + F.row_number().over(W.partitionBy(*keys, "__block").orderBy(order)) - 1).drop("__block", "__before")


def in_runs(df: DataFrame, halo: int, run: int = RUN) -> DataFrame:
    """df of numbered() with __run and __own: runs of `run` rows, each with the last `halo` rows before it."""
    own = F.floor(F.col("__i") / run)
    rows = df.withColumn("__run", F.explode(F.array_compact(F.array(own, F.when(F.col("__i") % run >= run - halo, own + 1)))))
    return rows.withColumn("__own", F.col("__run") == own)


def without_effects(df: DataFrame, keys: list[str], effect: str, columns: list[str]) -> DataFrame:
    """df with the columns less their means within keys and effect, as fixed effects of it do."""
    means = df.groupBy(*keys, effect).agg(*[F.avg(c).alias(f"__mean_{c}") for c in columns])
    rows = df.join(means, [*keys, effect])
    return rows.withColumns({c: F.col(c) - F.col(f"__mean_{c}") for c in columns}).drop(*[f"__mean_{c}" for c in columns])


def _solved(frames, k: int):
    """Adds to each group's sums: what is kept, the coefficients, and the inverse of the kept sums."""
    for pdf in frames:
        betas, inverses, kept = [], [], []
        for row in pdf.itertuples():
            sums, use = np.array(row.sums, float).reshape(k + 1, k + 1), np.array([True, *row.varies])
            at = np.flatnonzero(use)
            beta, inverse = np.zeros(k), np.zeros((k, k))
            if sums[0, 0] > len(at) and len(at) > 1:
                inverse[np.ix_(at, at)] = np.linalg.inv(sums[np.ix_(at, at)])
                beta = inverse @ sums[:k, k]
            betas.append(beta)
            inverses.append(inverse.ravel())
            kept.append(use)
        yield pdf.assign(beta=betas, inverse=inverses, kept=kept)


def _judged(frames, terms: list[str], lags: int, names: list[str]):
    k = len(terms)
    for pdf in frames:
        out = []
        for row in pdf.itertuples(index=False):
            group = list(row[: len(names)])
            beta, kept = np.array(row.beta, float), np.array(row.kept, bool)
            if kept.sum() < 2 or not np.array(row.inverse).any():
                continue
            inverse, meat = np.array(row.inverse, float).reshape(k, k), np.array(row.meat, float).reshape(k, k) / (lags + 1)
            se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
            sums = np.array(row.sums, float).reshape(k + 1, k + 1)
            n, tss = int(sums[0, 0]), sums[k, k] - sums[0, k] ** 2 / sums[0, 0]
            dropped = ",".join(t for t, use in zip(terms, kept, strict=True) if not use)
            for i in np.flatnonzero(kept):
                out.append((*group, terms[i], n, float(beta[i]), float(se[i]), float(beta[i] / se[i]) if se[i] > 0 else 0.0, float(1 - row.rss / tss) if tss > 0 else 0.0, dropped))
        yield pd.DataFrame(out, columns=[*names, "term", "n", "beta", "se", "t", "r2", "dropped"])


def moving_sums(values: np.ndarray, n: int) -> np.ndarray:
    """The sum of each value and the n - 1 before it, fewer at the start, from sums of 1, 2, 4, .. neighbours; nothing is subtracted."""
    out, taken, width, sums = np.zeros(len(values)), 0, 1, np.asarray(values, float)
    while taken < n:
        if n & width:
            out[taken:] += sums[: max(len(values) - taken, 0)]
            taken += width
        wider = sums.copy()
        wider[width:] += sums[: max(len(values) - width, 0)]
        sums, width = wider, 2 * width
    return out


def _moved(runs: DataFrame, keys: list[str], columns: list[str], n: int) -> DataFrame:
    """keys, meat (sums of products of the columns' moving sums of n rows) and square (of the first column's squares) of rows of in_runs(): a row for each run, and those added."""
    schema = T.StructType([*runs.select(*keys).schema.fields, T.StructField("meat", T.ArrayType(T.DoubleType())), T.StructField("square", T.DoubleType())])

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        own, first = table.column("__own").to_numpy(), table.column(columns[0]).to_numpy()
        moved = np.stack([moving_sums(table.column(c).to_numpy(), n)[own] for c in columns])
        return pa.table([*table.select(keys).slice(0, 1).columns, pa.array([(moved @ moved.T).ravel().tolist()]), pa.array([float(first[own] @ first[own])])], names=schema.names)

    parts = runs.select(*keys, "__run", "__i", "__own", *columns).groupBy(*keys, "__run").applyInArrow(summed, schema)
    return parts.groupBy(*keys).agg(F.array(*[F.sum(F.get("meat", i)) for i in range(len(columns) ** 2)]).alias("meat"), F.sum("square").alias("square"))


def regressions(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str], lags: int, block: int, least: int = 0, run: int = RUN) -> DataFrame:
    """keys, term, n, beta, se, t, r2, dropped: least squares of y on xs with an intercept in each group, Newey-West errors.

    Rows with a number missing or not finite are left out, regressors that don't vary in a
    group are dropped there (their names, comma-joined, in `dropped`), and groups of fewer
    than `least` rows have no result, nor have those without a regressor. Two aggregations
    and three joins do all groups: sums of products, solved a row a group; then, with the
    residuals, sums of products of moving sums of the scores. A Bartlett kernel of `lags` is
    a moving sum of lags + 1 rows taken twice, so no lagged products are formed: zeros stand
    behind each group for the sums that reach beyond its end. Moving sums are taken in runs
    with a halo, so a group may have any number of rows, and a row costs a logarithm of the lags.
    """
    terms, k = ["intercept", *xs], len(xs) + 1
    rows = finite(df.select(*keys, order, y, *xs), [y, *xs])
    cells = [F.lit(1.0), *map(F.col, xs), F.col(y)]
    varies = [F.stddev_pop(x) > 1e-12 * F.greatest(F.lit(1.0), F.max(F.abs(F.col(x)))) for x in xs]
    sums = F.array(*[F.sum(a * b) for a in cells for b in cells])
    grams = rows.groupBy(*keys).agg(F.count("*").alias("n"), sums.alias("sums"), F.array(*varies).alias("varies")).where(F.col("n") >= least)
    schema = T.StructType([*grams.schema.fields, *T._parse_datatype_string("beta array<double>, inverse array<double>, kept array<boolean>").fields])
    solved = cut(grams.mapInPandas(lambda frames: _solved(frames, k), schema))  # a row a group
    placed = numbered(rows, keys, order, block).join(solved.select(*keys, "beta", "kept"), keys)
    residual = F.col(y) - F.get("beta", 0)
    for i, x in enumerate(xs, 1):
        residual = residual - F.get("beta", i) * F.col(x)
    scored = placed.withColumn("u", residual)
    scores = [F.when(F.get("kept", i), F.col("u") * c).otherwise(0.0).alias(f"g{i}") for i, c in enumerate(cells[:k])]
    tail = solved.select(*keys, F.explode(F.sequence(F.col("n"), F.col("n") + lags - 1)).alias("__i"), *[F.lit(0.0).alias(f"g{i}") for i in range(k)]) if lags else None
    scored = scored.select(*keys, "__i", *scores)
    found = _moved(in_runs(scored.unionByName(tail) if lags else scored, lags, run), keys, [f"g{i}" for i in range(k)], lags + 1).withColumnRenamed("square", "rss")  # the intercept's scores are the residuals
    whole = found.join(solved, keys).select(*keys, "sums", "beta", "inverse", "kept", "meat", "rss")
    out = T.StructType([*df.select(*keys).schema.fields, *T._parse_datatype_string("term string, n long, beta double, se double, t double, r2 double, dropped string").fields])
    return whole.mapInPandas(lambda frames: _judged(frames, terms, lags, keys), out)


def long_run_mean(df: DataFrame, keys: list[str], order: str, value: str, lags: int, block: int, run: int = RUN) -> DataFrame:
    """keys, n, mean, se, t as hac_mean() has them, for many lags: a Bartlett kernel as moving sums taken twice, in runs with a halo."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, order, value)
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")))
    placed = numbered(rows, keys, order, block).join(sizes.select(*keys, "mean"), keys).select(*keys, "__i", (F.col(value) - F.col("mean")).alias("e"))
    tail = sizes.select(*keys, F.explode(F.sequence(F.col("n"), F.col("n") + lags - 1)).alias("__i"), F.lit(0.0).alias("e"))
    moved = _moved(in_runs(placed.unionByName(tail), lags, run), keys, ["e"], lags + 1)
    found = moved.select(*keys, (F.get("meat", 0) / (lags + 1)).alias("__s")).join(sizes, keys)
    out = found.withColumn("se", F.sqrt(F.greatest("__s", F.lit(0.0))) / F.col("n"))
    return out.select(*keys, "n", "mean", "se", F.when(F.col("n") >= 2, F.when(F.col("se") > 0, F.col("mean") / F.col("se")).otherwise(0.0)).alias("t"))


def average_ranks(df: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """df with ranks from 1, ties sharing their mean: that of the first and the last rank of a value, of one sort."""
    w = W.partitionBy(*keys).orderBy(value)
    return df.withColumn(to, (F.rank().over(w) + F.count("*").over(w)) / 2.0)


def rank_ic(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n and the correlation of average ranks; 0 where a side does not vary."""
    rows = average_ranks(average_ranks(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "__rx"), keys, y, "__ry")
    spread = F.stddev_pop("__rx") * F.stddev_pop("__ry")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(spread > 0, F.covar_pop("__rx", "__ry") / spread).otherwise(0.0).alias("ic"))


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Population correlation matrix; a column of no variation correlates with itself only."""
    sums, n = gram(df.na.fill(0.0, columns), columns)
    mean = sums[0, 1:] / max(n, 1)
    return _scaled(sums[1:, 1:] / max(n, 1) - np.outer(mean, mean))


def correlated(rows: np.ndarray) -> np.ndarray:
    """correlations() of the columns of a matrix."""
    centred = rows - rows.mean(axis=0)
    return _scaled(centred.T @ centred / len(rows))


def _scaled(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-15] = 1.0
    out = cov / np.outer(sd, sd)
    np.fill_diagonal(out, 1.0)
    return out


def effective_trials(rho: np.ndarray, threshold: float = 0.5) -> float:
    """The larger of the eigenvalue estimate and the number of single-link clusters at |rho| >= threshold."""
    values = np.maximum(np.linalg.eigvalsh(rho), 0.0)
    by_eigen = float(np.sum((values >= 1).astype(float) + (values - np.floor(values))))
    group = list(range(len(rho)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rho)):
        for j in range(i):
            if abs(rho[i, j]) >= threshold:
                group[root(i)] = root(j)
    return max(by_eigen, float(len({root(i) for i in range(len(rho))})))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: float, variance: float) -> tuple[float, float]:
    """The Sharpe ratio expected of the best of so many trials, and the probability of beating it.

    kurtosis is not excess; all per observation.
    """
    from tapeframe.functions.normal import cdf, inverse

    euler = 0.5772156649015329
    if trials <= 1:
        best = 0.0
    else:
        best = variance**0.5 * ((1 - euler) * inverse(1 - 1 / trials) + euler * inverse(1 - 1 / (trials * np.e)))
    spread = (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) ** 0.5
    return best, cdf((sharpe - best) * (n - 1) ** 0.5 / spread)


def curve_metrics(df: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    """Metrics of a return series: expectancy, win rate, profit factor with and without the best twentieth, Sharpe, Sortino, drawdown, ulcer, longest losing streak, share of the largest winner."""
    w = W.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("__eq", F.sum(ret).over(upto)).withColumn("__dd", F.col("__eq") - F.greatest(F.max("__eq").over(upto), F.lit(0.0)))
    rows = rows.withColumn("__r", F.col(ret)).withColumn("__win", (F.col(ret) >= 0).cast("long")).withColumn("__run", F.sum("__win").over(upto))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ret), order))
    rows = rows.withColumn("__best", best).withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    streaks = rows.groupBy(*keys, "__run").agg(F.sum(1 - F.col("__win")).alias("__losses")).groupBy(*keys).agg(F.max("__losses").alias("losing_streak"))
    gain = lambda when: F.sum(F.when((F.col("__r") > 0) & when, F.col("__r")).otherwise(0.0))
    loss = F.sum(F.when(F.col("__r") < 0, -F.col("__r")).otherwise(0.0))
    kept = F.col("__best") > F.ceil(F.col("__n") * 0.05)
    down = F.sqrt(F.avg(F.pow(F.least(F.col("__r"), F.lit(0.0)), 2)))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("__r").alias("expectancy"), F.avg((F.col("__r") > 0).cast("double")).alias("win_rate"), F.when(loss > 0, gain(F.lit(True)) / loss).alias("profit_factor"), F.when(loss > 0, gain(kept) / loss).alias("profit_factor_ex_best"),
        F.when(F.stddev_pop("__r") > 0, F.avg("__r") / F.stddev_pop("__r")).alias("sharpe"), F.when(down > 0, F.avg("__r") / down).alias("sortino"), F.min("__dd").alias("max_drawdown"), F.sqrt(F.avg(F.pow("__dd", 2))).alias("ulcer"),
        F.when(gain(F.lit(True)) > 0, F.greatest(F.max("__r"), F.lit(0.0)) / gain(F.lit(True))).alias("largest_share"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("expectancy") * F.col("n") / -F.col("max_drawdown"))).join(streaks, keys)


def volatility_coverage(rows: DataFrame, keys: list[str], order: str, value: str, period_ms: int, least: int, periods: int, scale: float) -> DataFrame:
    """keys, periods, p10, p50, p90 and spread of the volatility of log changes within periods of at least `least` rows.

    Nearest-rank quantiles; null where there are fewer than `periods` of them.
    """
    span = W.partitionBy(*keys, "__p").orderBy(order)
    found = rows.withColumn("__p", F.floor(F.col(order) / period_ms)).withColumn("__r", F.log(F.col(value) / F.lag(value).over(span)))
    vols = found.groupBy(*keys, "__p").agg(F.count(value).alias("n"), (F.stddev_pop("__r") * scale).alias("vol")).filter(F.col("n") >= least)
    ranked = vols.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("vol")) - 1).withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    at = lambda q: F.max(F.when((F.col("__n") >= periods) & (F.col("__k") == F.least(F.col("__n") - 1, F.floor(F.col("__n") * q))), F.col("vol")))
    out = ranked.groupBy(*keys).agg(F.max("__n").alias("periods"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))
    # without any volatility in the tenth the spread is infinite
    return out.withColumn("spread", F.when(F.col("p10") > 0, F.col("p90") / F.col("p10")).when(F.col("p10").isNotNull(), float("inf")))


def slope(rows: DataFrame, keys: list[str], order: str, x: str, y: str, lags: int) -> DataFrame:
    """keys, n, beta and HAC t of y on x with an intercept, of each group, by sums of products."""
    whole, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(order)
    dx, dy = F.col(x) - F.avg(x).over(whole), F.col(y) - F.avg(y).over(whole)
    found = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__x", dx).withColumn("__y", dy)
    found = found.withColumn("__b", F.sum(F.col("__x") * F.col("__y")).over(whole) / F.nullif(F.sum(F.col("__x") * F.col("__x")).over(whole), F.lit(0.0)))
    found = found.withColumn("__g", F.col("__x") * (F.col("__y") - F.col("__b") * F.col("__x")))
    for k in range(1, lags + 1):
        found = found.withColumn(f"__g{k}", F.col("__g") * F.lag("__g", k).over(w))
    long_run = F.sum(F.col("__g") * F.col("__g"))
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__g{k}"), F.lit(0.0))
    out = found.groupBy(*keys).agg(F.count("*").alias("n"), F.max("__b").alias("beta"), (F.sqrt(F.greatest(long_run, F.lit(0.0))) / F.sum(F.col("__x") * F.col("__x"))).alias("__se"))
    return out.withColumn("t", F.when(F.col("__se") > 0, F.col("beta") / F.col("__se")).otherwise(0.0)).drop("__se")
