"""Market-context measures, their rarity, and what is said about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.operators import windows


def usable_interest(value: Column, currency: Column) -> Column:
    """Open interest where it is positive and in base units."""
    notional = currency.isin("USD", "USDT", "USDC") | (value > 5_000_000)
    return F.when((value > 0) & ~F.coalesce(notional, F.lit(False)), value)


def change(value: Column, k: int, w) -> Column:
    """Relative change over k rows, both ends there and the older one positive."""
    old = F.lag(value, k).over(w)
    return F.when(value.isNotNull() & (old > 0), value / old - 1)


def premium(perp: Column, spot: Column) -> Column:
    return F.when(spot > 0, perp / spot - 1)


def participation(spot_rvol: Column, perp_rvol: Column) -> Column:
    return F.when((spot_rvol > 0) & (perp_rvol > 0), F.log(spot_rvol / perp_rvol))


def liquidation_balance(long: Column, short: Column, paired: Column) -> Column:
    """(L - S) / (L + S), missing sides as 0; only of feeds declared to be a pair."""
    a, b = F.coalesce(long, F.lit(0.0)), F.coalesce(short, F.lit(0.0))
    return F.when(paired & long.isNotNull() & short.isNotNull() & (a + b > 0), (a - b) / (a + b))


# Declared units of a funding feed and their scale.
FUNDING_UNITS = {"fraction": 1.0, "percent": 0.01, "bp": 0.0001}


def canonical_funding(value: Column, unit: Column) -> Column:
    return value * F.element_at(F.create_map(*[F.lit(x) for p in FUNDING_UNITS.items() for x in p]), unit)


def direction(x: Column) -> Column:
    """-1, 0, 1 by the sign of the raw value; missing is 0."""
    return F.coalesce(F.signum(x), F.lit(0.0)).cast("int")


def stacked(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Long form keys, measure, x, so that one window serves all measures."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures]))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.measure", "p.x")


def normed(long: DataFrame, n: int, least: int) -> DataFrame:
    """long with z, pct and n_valid of each measure over its last n rows."""
    return windows.valid_norm(long, ["measure"], "x", n=n, least=least)


def extremeness(pct: Column, z: Column) -> Column:
    return F.when(pct.isNull(), 50 + F.least(10 * F.abs(z), F.lit(49.0))).otherwise(F.greatest(pct, 100 - pct))


def priority_key(priority: Column, pct: Column) -> Column:
    return priority * 1000.0 - F.when(pct.isNull(), 50.0).otherwise(F.greatest(pct, 100 - pct))


# Attention priority of each measure.
PRIORITY = {"oi6": 2, "oi1": 2, "funding": 3, "premium": 4, "long_liq": 5, "short_liq": 5, "etf": 7, "participation": 8, "spot_rvol": 8, "perp_rvol": 8}

# Fixed values: |z| at which a regime's ladder enters, leaves, enters and leaves its extreme level.
LADDERS = {"oi6": (1.0, 0.6, 2.0, 1.25), "funding": (1.5, 1.0, 2.5, 1.75), "etf": (1.0, 0.6, 2.0, 1.25), "long_liq": (1.5, 1.0, 2.5, 1.75), "short_liq": (1.5, 1.0, 2.5, 1.75)}
# Fixed values: |z| at which an impulse is unusual, and extreme.
IMPULSES = {"oi1": (1.0, 2.0), "premium": (2.0, 2.75), "participation": (1.0, 2.0), "spot_rvol": (1.5, 2.7), "perp_rvol": (1.5, 2.7)}
# Distance from the 200-day mean in ranges at which the trend state enters and leaves.
TREND = (0.5, 0.2)
# Names of the measures in lists of anomalies, in their order; * marks an impulse.
NAMES = {"oi6": "OI 24H", "oi1": "OI 4H *", "funding": "FUNDING", "premium": "PREMIUM *", "participation": "PARTICIP *", "spot_rvol": "SPOT RVOL *", "perp_rvol": "PERP RVOL *", "long_liq": "LONG LIQ *", "short_liq": "SHORT LIQ *", "etf": "ETF"}


def intensity(level: Column) -> Column:
    return F.when(level >= 2, "EXTREME").when(level == 1, "UNUSUAL").otherwise("NORMAL")


def _signed(sign: Column, up: str, down: str, flat: str) -> Column:
    return F.when(sign > 0, up).when(sign < 0, down).otherwise(flat)


def phrase(measure: Column, level: Column, sign: Column) -> Column:
    """What a measure's intensity and direction are called."""
    is_in = lambda *names: measure.isin(*names)
    word = intensity(level)
    extreme = F.when(level >= 2, "EXTREME ").otherwise("")
    return (
        F.when(is_in("participation"), F.when((level == 0) | (sign == 0), "NORMAL RELATIVE ACTIVITY").otherwise(F.concat(extreme, _signed(sign, "RELATIVE SPOT SURGE", "RELATIVE PERP SURGE", ""))))
        .when(level == 0, "NORMAL")
        .when(is_in("oi1", "oi6"), F.concat(word, _signed(sign, " EXPANSION", " REDUCTION", " FLAT")))
        .when(is_in("funding"), F.concat(F.when(level >= 2, "EXTREME").otherwise("ELEVATED"), _signed(sign, " LONG FUNDING", " SHORT FUNDING", " FLAT FUNDING")))
        .when(is_in("etf"), F.concat(word, _signed(sign, " INFLOW", " OUTFLOW", " FLAT")))
        .when(is_in("premium"), F.concat(word, _signed(sign, " POSITIVE PREMIUM", " NEGATIVE PREMIUM", " FLAT PREMIUM")))
        .when(is_in("spot_rvol", "perp_rvol"), F.when(sign == 0, "NORMAL").otherwise(F.concat(word, _signed(sign, " HIGH VOLUME", " LOW VOLUME", ""))))
        .when(is_in("long_liq"), F.concat(extreme, F.lit("LONG LIQUIDATION SPIKE")))
        .when(is_in("short_liq"), F.concat(extreme, F.lit("SHORT LIQUIDATION SPIKE")))
    )


def sentence(measure: Column, level: Column, sign: Column) -> Column:
    """One sentence on an engaged measure: what has happened, not what follows."""
    is_in = lambda *names: measure.isin(*names)
    word = F.when(level >= 2, "Extreme").otherwise("Unusual")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return (
        F.when(is_in("oi6", "oi1"), said(word, " open interest ", _signed(sign, "increase", "reduction", "move"), " over the last ", F.when(measure == "oi6", "24 hours").otherwise("4 hours"), "."))
        .when(is_in("funding"), said("Funding is ", F.when(level >= 2, "extremely ").otherwise("unusually "), _signed(sign, "positive — longs are paying shorts.", "negative — shorts are paying longs.", "flat.")))
        .when(is_in("premium"), said("Perpetual is trading at ", F.when(level >= 2, "an extreme ").otherwise("an unusual "), _signed(sign, "premium to spot.", "discount to spot.", "level against spot.")))
        .when(is_in("participation"), said(F.when(sign > 0, "Spot").otherwise("Perpetual"), " activity spike relative to the other venue."))
        .when(is_in("spot_rvol", "perp_rvol"), said(F.when(measure == "spot_rvol", "Spot").otherwise("Perpetual"), " volume is unusually ", F.when(sign > 0, "high").otherwise("low"), " for this time of day."))
        .when(is_in("long_liq", "short_liq"), said("Large ", F.when(measure == "long_liq", "long").otherwise("short"), "-liquidation spike detected."))
        .when(is_in("etf"), said(word, " ETF net ", _signed(sign, "inflow.", "outflow.", "flow.")))
    )


def positioning_word(known: Column, level: Column, sign: Column) -> Column:
    """The positioning word of the open-interest ladder."""
    return F.when(~known, "No data").when(level == 0, "Normal").otherwise(F.concat(F.when(level >= 2, "Extreme ").otherwise("Unusual "), _signed(sign, "build", "reduction", "flat")))


def trend_phrase(state: Column) -> Column:
    return F.when(state > 0, "ABOVE 200D").when(state < 0, "BELOW 200D").otherwise("NEAR 200D")


def event_priority(text: Column) -> Column:
    """Which lines come first where not all fit: a reading order by what a line says."""
    has, starts = text.contains, text.startswith
    return (
        F.when(has("STALE") | has("data available again") | has("updating"), 1).when(starts("OI "), 2).when(starts("Funding"), 3).when(starts("Premium"), 4)
        .when(has("liquidation spike"), 5).when(starts("Slow trend"), 6).when(has("ETF"), 7).otherwise(8)
    )


def event_key(text: Column) -> Column:
    """What a line is about: lines of one key are one going-on."""
    p = event_priority(text)
    oi = F.concat(F.lit("OI "), F.when(text.contains("reduction"), "down").when(text.contains("expansion"), "up").otherwise("flat"))
    return F.when(p == 2, oi).when(p == 5, F.when(text.startswith("Long"), "LIQ long").otherwise("LIQ short")).when(p == 1, F.concat(F.lit("FEED "), text)).otherwise(p.cast("string"))


def trend_score(state: Column, momentum: Column) -> Column:
    return direction(state) + direction(momentum)


def trend_word(score: Column, known: Column) -> Column:
    return F.when(~known, "No data").when(score >= 2, "Strong uptrend").when(score == 1, "Uptrend").when(score == 0, "Neutral").when(score == -1, "Downtrend").otherwise("Strong downtrend")


def trend_sentence(word: Column) -> Column:
    """What is said of a day whose trend state changed."""
    return F.concat(F.lit("Trend state changed to "), F.lower(word), F.lit(" — price moved relative to the 200-day average."))


def volatility_word(pct: Column) -> Column:
    return F.when(pct.isNull(), "No data").when(pct > 80, "High").when(pct > 55, "Elevated").when(pct < 20, "Low").otherwise("Normal")


def mechanics(price_change: Column, interest_change: Column) -> Column:
    """What price and open interest did together."""
    p, o = direction(price_change), direction(interest_change)
    both = F.concat(F.when(p > 0, "PRICE UP").otherwise("PRICE DOWN"), F.lit(" + "), F.when(o > 0, "POSITION BUILD").otherwise("POSITION REDUCTION"))
    return F.when(price_change.isNull() | interest_change.isNull(), "INSUFFICIENT DATA").when((p == 0) | (o == 0), "FLAT").otherwise(both)


def mechanics_sentence(price_change: Column, interest_change: Column) -> Column:
    p, o = direction(price_change), direction(interest_change)
    said = F.concat(
        F.when(p > 0, "Price rose").otherwise("Price fell"), F.lit(" while open interest "), F.when(o > 0, "rose").otherwise("fell"), F.lit(". Positions were "),
        F.when(o > 0, "added to").otherwise("reduced"), F.lit(" during the "), F.when(p > 0, "rise").otherwise("fall"), F.lit("."),
    )
    return F.when((p == 0) | (o == 0), "").otherwise(said)


def mechanics_note(funding: tuple[Column, Column, Column], premium: tuple[Column, Column, Column], perp_rvol: tuple[Column, Column, Column]) -> Column:
    """What stood beside the mechanics: (value, level, direction) of funding, premium and perpetual volume."""

    def part(name: str, value: Column, level: Column, sign: Column, word: Column) -> Column:
        grade = F.when(level > 0, F.concat(F.lit(" ("), F.lower(word), F.lit(")"))).otherwise("")
        return F.when(value.isNull(), f"{name} n/a").otherwise(F.concat(F.lit(f"{name} "), _signed(sign, "positive", "negative", "flat"), grade))

    value, level, sign = perp_rvol
    volume = F.when(value.isNull(), "perp RVOL n/a").otherwise(F.concat(F.lit("perp RVOL "), F.when((level > 0) & (sign > 0), "high").when((level > 0) & (sign < 0), "low").otherwise("normal")))
    grade = F.when(funding[1] >= 2, "EXTREME").otherwise("ELEVATED")
    return F.concat_ws(" · ", part("funding", *funding, grade), part("premium", *premium, intensity(premium[1])), volume)


def packed(parts: list[tuple[Column, int]]) -> Column:
    """Digits in mixed radix: the first part is the lowest."""
    out, scale = F.lit(0).cast("long"), 1
    for part, radix in parts:
        out = out + part.cast("long") * scale
        scale *= radix
    return out


# Shapes of an ETF feed and what the sum of each is called.
ETF_SHAPES = {"gated": "ETF LAST 5 OBS", "repeated": "ETF 5 CAL-DAY", "increments": "ETF 30-BAR SUM"}


def etf_flow(value: Column, shape: Column, w, per_day: int = 6, back: int = 90) -> tuple[Column, Column, Column]:
    """Five days of flow, its label, and the sample that it may be compared with.

    gated: a value only where something new came; the last five of `back` rows, and only a new one is a
    sample, so that the clock of the comparison is that of the arrivals. repeated: a daily value that stands
    all day; five rows a day apart. increments: the sum of all rows of five days, a missing one is none.
    """
    five = F.sum(F.coalesce(value, F.lit(0.0))).over(windows.frame(w, 5 * per_day))
    pick = lambda a, b, c: F.when(shape == "gated", a).when(shape == "repeated", b).otherwise(c)
    flow = pick(windows.sum_last_valid(value, 5, back, w), windows.strided_sum(value, per_day, 5, w), five)
    label = pick(*map(F.lit, ETF_SHAPES.values()))
    return flow, label, F.when((shape != "gated") | value.isNotNull(), flow)
