"""Texts of numbers and states, null as "n/a" unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trimmed(x: Column, digits: int) -> Column:
    """Up to `digits` decimals without trailing zeros."""
    text = F.format_string(f"%.{digits}f", F.round(x, digits))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _or_na(x: Column, text: Column, missing: str = "n/a") -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), missing).otherwise(text)


def number(x: Column, digits: int = 2) -> Column:
    return _or_na(x, _trimmed(x, digits))


def signed(x: Column, digits: int = 2) -> Column:
    return _or_na(x, F.concat(F.when(x >= 0, "+").otherwise(""), _trimmed(x, digits)))


def percent(x: Column, digits: int = 2) -> Column:
    return _or_na(x, F.concat(F.when(x >= 0, "+").otherwise(""), _trimmed(x * 100, digits), F.lit("%")))


def rank(x: Column) -> Column:
    return _or_na(x, F.concat(_trimmed(x, 1), F.lit("p")), "—")


def compact(x: Column) -> Column:
    """K, M and B from a thousand on."""
    a = F.abs(x)
    return _or_na(x, F.when(a >= 1e9, F.concat(_trimmed(x / 1e9, 2), F.lit("B"))).when(a >= 1e6, F.concat(_trimmed(x / 1e6, 2), F.lit("M"))).when(a >= 1e3, F.concat(_trimmed(x / 1e3, 2), F.lit("K"))).otherwise(_trimmed(x, 2)))


def grouped(x: Column) -> Column:
    """A price with grouped digits and up to two decimals."""
    whole = F.format_number(F.floor(F.abs(F.round(x, 2))), 0)
    rest = F.regexp_extract(_trimmed(F.abs(x), 2), r"(\.\d+)$", 1)
    return _or_na(x, F.concat(F.when(F.round(x, 2) < 0, "-").otherwise(""), whole, rest))


def dollars(x: Column, sign: bool = False) -> Column:
    mark = F.when(x >= 0, "+$").otherwise("-$") if sign else F.when(x < 0, "-$").otherwise("$")
    return _or_na(x, F.concat(mark, F.format_number(F.abs(x), 0)))


def r_units(x: Column, sign: bool = True) -> Column:
    return _or_na(x, F.concat(F.when((x >= 0) & F.lit(sign), "+").otherwise(""), _trimmed(x, 2), F.lit("R")))


# State words and the colour class each stands for, in the order they are tried.
CLASSES = (
    ("contains", ("UNAVAILABLE", "MISCONFIGURED"), "muted"),
    ("equals", ("INSUFFICIENT DATA", "NO DATA", "NOT SET", "NONE ENABLED"), "muted"),
    ("contains", ("STALE", "BLOCKED"), "bad"),
    ("equals", ("DATA INCOMPARABLE", "ISSUE", "CHECK"), "bad"),
    ("equals", ("NORMAL", "FRESH", "ACTIVE", "BALANCED", "FLAT", "NEAR 200D", "NORMAL RELATIVE ACTIVITY", "OK", "NEUTRAL"), "normal"),
    ("equals", ("LONG",), "up"),
    ("contains", ("UPTREND",), "up"),
    ("equals", ("SHORT",), "down"),
    ("contains", ("DOWNTREND",), "down"),
    ("startswith", ("EXTREME",), "extreme"),
    ("startswith", ("UNUSUAL", "ELEVATED"), "unusual"),
    ("contains", ("SPIKE", "SURGE"), "unusual"),
    ("equals", ("HIGH",), "unusual"),
)


def colour_class(text: Column) -> Column:
    """The class of a state text; the trailing marker is dropped and case ignored."""
    said = F.upper(F.trim(F.replace(text, F.lit("[σ]"), F.lit(""))))
    out = F.lit("plain")
    for how, words, name in reversed(CLASSES):
        for word in words:
            out = F.when(said == word if how == "equals" else getattr(said, how)(word), name).otherwise(out)
    return out
