"""Quality rules with adaptive thresholds.

One pass over the texts measures every document. The measures, scaled to whole
numbers, go into mergeable quantile sketches, one per language, source and
measure: counts of log-linear bins (exact below 64, then 32 bins for each power
of two, so a quantile is off by at most 1/32 of its value). Sketches merge by
adding counts, so partial aggregation merges them before the shuffle and the
hot source costs no more than the others; those of small groups are merged with
their language's, or with all.

No cutoff is fixed. A rate's limit in a group is its upper quartile and REACH times
the quartiles' distance, and what chance alone may add in a text of the group's
median length: a few occurrences for counts (RULES), three standard errors for the
mean word length. A join of measures and limits gives the verdicts.

Words are runs of anything but ASCII white space, lines are split by \\n. Null
texts are empty; null languages and sources are values of their own. Repeated rows
are judged each for itself, and each counts in the sketches. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tapeframe.llm.common import appended, cut_lineage, fields, hashed_runs, quoted, slices, small, strings, tally, without

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_pipes")

#: Base rules: fewest words, most repeated words in percent.
MIN_WORDS, MAX_REPEATED = 20, 30

#: Adaptive rules: rate (per 10,000), what it counts, of what, and the occurrences that are no pattern yet.
#: A repeated window of eight words is 16 repeated words.
RULES = {
    "symbol_rate": ("n_symbols", "n_words", 3),
    "pipe_rate": ("n_pipes", "n_words", 3),
    "dup_line_rate": ("n_dup_lines", "n_lines", 2),
    "repeat_rate": ("n_repeat_words", "n_words", 48),
    "word_length": ("word_chars", "n_words", None),
}
#: Quartiles' distances above the upper quartile, and the quantiles read.
REACH, QUANTILES = 3, (0.25, 0.5, 0.75)
#: Groups of fewer documents take their language's limits, and those of all where that has fewer too.
LEAST_GROUP = 30

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = ~_SPACE
_IN_LINE = np.ones(256, bool)
_IN_LINE[0x0A] = False
_FIRST_BYTE = _SOLID & ((np.arange(256) & 0xC0) != 0x80)  # of a character in a word
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = sorted_keys[1:] == sorted_keys[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def counted(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each [offset, next offset)."""
    return np.diff(np.searchsorted(places, offsets)).astype(np.int64)


def measured(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """MEASURES of texts. Equal words, lines and windows are found by 64-bit hashes."""
    n = len(offsets) - 1
    starts, ends, hashes = hashed_runs(data, offsets, _SOLID)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first).astype(np.int64)
    line_starts, line_ends, line_hashes = hashed_runs(data, offsets, _IN_LINE)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_hashes = line_starts[has_word], line_hashes[has_word]
    line_of = np.searchsorted(offsets, line_starts, side="right") - 1
    salt = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    lines = np.bincount(line_of, minlength=n).astype(np.int64)
    distinct = np.unique(line_hashes ^ salt[line_of], return_index=True)[1]
    word_of = np.repeat(np.arange(n), words)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= window:
        size = len(hashes) - window + 1
        rolled = np.zeros(size, np.uint64)
        for k in range(window):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + size]
        whole = np.flatnonzero(word_of[:size] == word_of[window - 1 :])
        found = whole[repeated((rolled ^ (rolled >> np.uint64(29)))[whole] ^ salt[word_of[whole]])]
        covered[found] += 1
        covered[found + window] -= 1
    inside = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
    return {
        "n_words": words,
        "word_chars": tally(data, offsets, _FIRST_BYTE),
        "n_symbols": tally(data, offsets, _SYMBOL),
        "n_dup_lines": lines - np.bincount(line_of[distinct], minlength=n),
        "n_repeat_words": counted(inside, first),
        "n_lines": lines,
        "n_pipes": counted(starts[(ends - starts == 1) & (data[starts] == 0x7C)], offsets),
    }


def with_measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with MEASURES of each text as long columns."""
    names = [prefix + m for m in MEASURES]
    df = without(df, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = measured(*strings(batch.column(text)))
            yield appended(batch, **{prefix + m: pa.array(found[m].astype(np.int64)) for m in MEASURES})

    return df.mapInArrow(run, fields(df.schema, *[T.StructField(n, T.LongType(), False) for n in names]))


def rates(prefix: str = "") -> dict[str, Column]:
    """The scaled measures that have adaptive thresholds, as whole numbers."""
    per = lambda name, of: F.floor(quoted(prefix + name) * 10_000 / F.greatest(quoted(prefix + of), F.lit(1)))
    return {rate: per(name, of) for rate, (name, of, _) in RULES.items()}


def bin_of(value: Column) -> Column:
    """The sketch's bin: the value below 64, else 32 bins for each power of two, by whole-number arithmetic."""
    bits = F.length(F.bin(value))
    shift = F.greatest(bits - 6, F.lit(0))
    return (shift * 32 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("int")


def bin_top(bin_column: Column) -> Column:
    """The largest value of a bin."""
    shift = F.greatest(F.floor(bin_column / 32) - 1, F.lit(0))
    return ((bin_column - shift * 32 + 1) * F.pow(F.lit(2.0), shift) - 1).cast("long")


def sketches(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Sketches in long form: keys, measure, bin, n. Merge them by summing n."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bin_of(v).alias("bin")) for k, v in values.items()]))
    return df.select(*map(quoted, keys), stacked.alias("__x")).groupBy(*map(quoted, keys), F.col("__x.measure").alias("measure"), F.col("__x.bin").alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """keys, measure, and columns q0, q1, .. : upper bounds of the quantiles `at` (nearest rank)."""
    group = W.partitionBy(*map(quoted, keys), "measure")
    ranked = sketch.withColumn("__to", F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("__all", F.sum("n").over(group))
    found = [F.min(F.when(F.col("__to") >= F.ceil(F.col("__all") * F.lit(q)), F.col("bin"))).alias(f"__q{i}") for i, q in enumerate(at)]
    grouped = ranked.groupBy(*map(quoted, keys), "measure").agg(*found)
    return grouped.select(*map(quoted, keys), "measure", *[bin_top(F.col(f"__q{i}")).alias(f"q{i}") for i in range(len(at))])


def _limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_docs and most_<rate> of each group of a sketch."""
    found = quantiles(sketch, keys, QUANTILES)
    counted_in = sketch.filter("measure = 'n_words'").groupBy(*map(quoted, keys)).agg(F.sum("n").alias("n_docs"))
    q = lambda measure, k: F.max(F.when(F.col("measure") == measure, F.col(f"q{k}")))
    limits = []
    for rate, (_, of, few) in RULES.items():
        length = F.greatest(q(of, 1), F.lit(1))
        # half its mean is a usual deviation of a word's length
        chance = F.floor(few * 10_000 / length) if few else F.floor(1.5 * q(rate, 1) / F.sqrt(length))
        limits.append((q(rate, 2) + REACH * (q(rate, 2) - q(rate, 0)) + chance).cast("long").alias(f"most_{rate}"))
    wide = found.groupBy(*map(quoted, keys)).agg(*limits)
    return _null_safe(wide, counted_in, keys)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right joined on keys that may be null; the keys are left's."""
    renamed = right.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[quoted(c) for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    return left.join(renamed, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def thresholds(measures: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """One row per group: keys and most_<rate>, the largest rate that passes.

    keys: from the most general to the most special; a group of fewer than LEAST_GROUP
    documents has the limits of the group above.
    """
    values = rates(prefix) | {c: quoted(prefix + c) for c in ("n_words", "n_lines")}
    sketch = cut_lineage(sketches(measures, keys, values))
    names = [f"most_{r}" for r in RULES]
    out = sketch.select(*map(quoted, keys)).distinct()
    for depth in range(len(keys) + 1):
        upper = sketch.groupBy(*map(quoted, keys[:depth]), "measure", "bin").agg(F.sum("n").alias("n"))
        limits = _limits(upper, keys[:depth])
        if depth:
            limits = limits.filter(F.col("n_docs") >= LEAST_GROUP)
        out = _null_safe(out, limits.select(*map(quoted, keys[:depth]), *[F.col(c).alias(f"{c}_{depth}") for c in names]), keys[:depth], "left")
    return out.select(*map(quoted, keys), *[F.coalesce(*[F.col(f"{c}_{d}") for d in range(len(keys), -1, -1)]).alias(c) for c in names])


def verdicts(measures: DataFrame, limits: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """measures with base_failed, rules_failed (names, comma-joined) and kept."""
    joined = _null_safe(measures, limits, keys, "left")
    broken = []
    for r, rate in rates(prefix).items():
        name, _, few = RULES[r]
        above = rate > F.col(f"most_{r}")
        broken.append(F.when(above & (quoted(prefix + name) > few) if few else above, F.lit(r)))
    base = (quoted(prefix + "n_words") < MIN_WORDS) | (100 * quoted(prefix + "n_repeat_words") > MAX_REPEATED * quoted(prefix + "n_words"))
    out = joined.withColumn(prefix + "rules_failed", F.concat_ws(",", *broken)).withColumn(prefix + "base_failed", base)
    return out.withColumn(prefix + "kept", ~quoted(prefix + "base_failed") & (quoted(prefix + "rules_failed") == "")).drop(*[f"most_{r}" for r in RULES])


def judge(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per row of df: key, MEASURES, base_failed, rules_failed, kept.

    df needs key, text, lang and source. An empty table gives no rows.
    """
    keys = ["lang", "source"]
    measures = cut_lineage(with_measures(df.select(quoted(key), *keys, "text")).drop("text"))
    limits = cut_lineage(thresholds(measures, keys))
    return verdicts(measures, small(limits, limits.count()), keys).drop(*keys)


def keep(df: DataFrame) -> DataFrame:
    """The rows of df that judge() keeps, with df's columns. Texts are measured twice, so as not to be written."""
    keys, own = ["lang", "source"], "__quality_"
    measured_rows = with_measures(df, prefix=own)
    limits = cut_lineage(thresholds(with_measures(df.select(*keys, "text"), prefix=own).drop("text"), keys, own))
    judged = verdicts(measured_rows, small(limits, limits.count()), keys, own)
    return judged.filter(quoted(own + "kept")).select(*map(quoted, df.columns))
