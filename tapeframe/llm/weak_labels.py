"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. An
expectation-maximisation over the counts of vote patterns (at most 3 ** labellers,
whatever the corpus) estimates the share of good documents and what each labeller
votes on good and on bad ones. The posterior of its pattern is a document's soft
label; a bounded sample of documents with their soft labels trains a linear scorer on
hashed features, shapes of byte 4-grams and bins of the measures behind the votes,
which scores every whole text.

Null texts are empty. Where the votes leave one class empty, the scorer gives the
mean of the soft labels. Repeated rows are judged alike; they count in the estimation
and are sampled once. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.common import SLICE_BYTES, appended, cut_lineage, fields, quoted, slices, strings, tally, text_or_empty, without
from tapeframe.llm.quality_rules import MEASURES, measured

#: Documents, about, that train the scorer; its table has 2 ** BITS weights for grams and BINS for each labeller's measure.
SAMPLE, BITS, BINS, SCALE = 6000, 16, 16, 60.0

#: Bad votes that a document of the bad class draws on average, at least: with fewer there is no bad class,
#: as in a corpus whose bad documents are gone, where the estimation would split the good ones.
LEAST_BAD = 0.5

EXTRA = ("n_upper", "n_letters", "n_short", "n_ended")
#: Each labeller's votes: (name, measure per measure, bad if at least, good if at most) or reversed.
LABELLERS = (
    ("symbols", "n_symbols", "n_words", 0.10, 0.02),
    ("pipes", "n_pipes", "n_words", 0.08, 0.01),
    ("repeats", "n_repeat_words", "n_words", 0.25, 0.15),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0.40, 0.10),
    ("capitals", "n_upper", "n_letters", 0.40, 0.12),
    ("few_short_words", "n_short", "n_words", -0.06, -0.15),
    ("unended_lines", "n_ended", "n_lines", -0.30, -0.60),
    ("few_words", "n_words", None, -20, -60),
    ("word_length", "word_chars", "n_words", 12.0, 8.0),
)


_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES and EXTRA of texts."""
    from tapeframe.llm.common import runs

    found = measured(data, offsets)
    solid = (data > 0x20) | (data < 0x09)
    starts, ends = runs(solid, offsets)
    short = starts[ends - starts <= 4]
    line_ends = runs(data != 0x0A, offsets)[1]
    ended = line_ends[np.isin(data[line_ends - 1], np.frombuffer(b".!?;:\"')", np.uint8))]
    place = lambda x: np.diff(np.searchsorted(x, offsets))
    return found | {"n_upper": tally(data, offsets, _UPPER), "n_letters": tally(data, offsets, _LETTER), "n_short": place(short), "n_ended": place(ended - 1)}


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """A row per text and a column per labeller: 0 bad, 1 good, 2 nothing."""
    out = []
    for _, part, whole, bad, good in LABELLERS:
        rate = found[part] / (np.maximum(found[whole], 1) if whole else 1)
        if bad < 0:
            rate = -rate
        out.append(np.where(rate >= bad, 0, np.where(rate <= good, 1, 2)))
    return np.stack(out, 1)


def bins(found: dict[str, np.ndarray]) -> np.ndarray:
    """The scorer's table indices of each text's measures: a row per text, a column per labeller."""
    out = []
    for k, (_, part, whole, _, good) in enumerate(LABELLERS):
        rate = found[part] / (np.maximum(found[whole], 1) if whole else 1)
        place = rate * 20 if whole and abs(good) < 1 else rate if whole else np.log2(rate + 1)
        out.append((1 << BITS) + BINS * k + np.minimum(np.floor(place), BINS - 1).astype(np.int64))
    return np.stack(out, 1)


def packed(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(1)


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of "good" for each pattern, the share of good, and vote probabilities [class, labeller, vote] where it votes.

    Starts from the patterns' majorities, so that class 1 stays the one the labellers call good. All are
    good where the other class draws fewer than LEAST_BAD bad votes.
    """
    v = unpacked(patterns)
    said = np.stack([v == 0, v == 1], 2).astype(float)  # a labeller that says nothing is no evidence
    good = (said[:, :, 1].sum(1) + 1) / (said.sum((1, 2)) + 2)
    good = np.where(good < 0.85, 0.1, 0.9)
    for _ in range(rounds):
        share = (good * counts).sum() / max(counts.sum(), 1)
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.einsum("cp,plv->clv", weight, said) + 0.5  # half a vote each: a labeller that never votes says nothing
        table /= table.sum(2, keepdims=True)
        log = np.einsum("plv,clv->pc", said, np.log(table)) + np.log(np.clip([1 - share, share], 1e-9, 1))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    if table[0, :, 0].sum() < LEAST_BAD:
        good = np.ones(len(good))
    share = float((good * counts).sum() / max(counts.sum(), 1))
    return good, share, table


# ---------------------------------------------------------------- scorer

_SHAPE = np.zeros(256, np.uint8)
for _byte in range(256):
    _char = chr(_byte)
    _SHAPE[_byte] = ord("A") if "A" <= _char <= "Z" else ord("a") if "a" <= _char <= "z" or _byte >= 0x80 else ord("0") if _char.isdigit() else _byte


def grams(data: np.ndarray) -> np.ndarray:
    """The table index of the shape 4-gram at each byte, as if zeros followed the data."""
    out = np.empty(len(data), np.uint32)
    for start in range(0, len(data), SLICE_BYTES):
        n = min(SLICE_BYTES, len(data) - start)
        shape = np.zeros(n + 3, np.uint32)
        some = _SHAPE[data[start : start + n + 3]]
        shape[: len(some)] = some
        packed_grams = shape[:n] | shape[1 : n + 1] << np.uint32(8) | shape[2 : n + 2] << np.uint32(16) | shape[3 : n + 3] << np.uint32(24)
        out[start : start + n] = (packed_grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A text's mean weight; its last three bytes, whose grams would run into the next, begin none."""
        starts, ends = offsets[:-1], np.maximum(offsets[1:] - 3, offsets[:-1])
        total = np.zeros(len(starts))
        for start in range(0, len(data), SLICE_BYTES):
            n = min(SLICE_BYTES, len(data) - start)
            at = np.concatenate([[0.0], np.cumsum(self.weights[grams(data[start : start + n + 3])[:n]], dtype=np.float64)])
            total += at[np.clip(ends - start, 0, n)] - at[np.clip(starts - start, 0, n)]
        return self.bias + SCALE * total / np.maximum(ends - starts, 1) + self.weights[bins(measures(data, offsets))].sum(1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, rounds: int = 300) -> Scorer:
    """Logistic regression on gram frequencies with soft labels, by accelerated gradient descent."""
    weights, bias = np.zeros((1 << BITS) + BINS * len(LABELLERS)), 0.0
    if not len(soft):
        return Scorer(weights.astype(np.float32), bias)
    mean = float(np.clip(soft.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    if soft.max() - soft.min() < 1e-6:
        return Scorer(weights.astype(np.float32), bias)
    used = np.unique(np.concatenate([k for k, _ in rows]))
    column = np.concatenate([np.searchsorted(used, k) for k, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    balance = np.where(soft >= 0.5, 0.5 / max((soft >= 0.5).mean(), 1e-9), 0.5 / max((soft < 0.5).mean(), 1e-9))
    rate = 4.0 / (np.bincount(row, value**2).max() + 1.0)
    w, b, aw, ab = np.zeros(len(used)), bias, np.zeros(len(used)), bias
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * aw[column], len(rows)) + ab, -30, 30)))
        error = (soft - p) * balance / len(rows)
        nw = aw + rate * (np.bincount(column, value * error[row], len(used)) - 1e-5 * aw)
        nb = ab + rate * error.sum()
        step = k / (k + 3)
        aw, ab = nw + step * (nw - w), nb + step * (nb - b)
        w, b = nw, nb
    weights[used] = w
    return Scorer(weights.astype(np.float32), float(b))


# ---------------------------------------------------------------- on DataFrames


def _patterns(batches: Iterable[pa.RecordBatch], text: str, to: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text):
        yield appended(batch, **{to: pa.array(packed(votes(measures(*strings(batch.column(text))))).astype(np.int32))})


def with_votes(df: DataFrame, text: str = "text", to: str = "votes") -> DataFrame:
    """df with the packed votes of all labellers."""
    df = without(df, [to])
    return df.mapInArrow(lambda batches: _patterns(batches, text, to), fields(df.schema, T.StructField(to, T.IntegerType(), False)))


@dataclass
class Quality:
    """A fitted classifier: posteriors by pattern, labellers' vote table, share of good, scorer."""

    posterior: dict[int, float]
    share: float
    table: np.ndarray
    scorer: Scorer


def fit(df: DataFrame, sample: int = SAMPLE) -> Quality:
    """Fits on all votes of df, and the scorer on about `sample` of its rows (by a seeded hash of the text)."""
    texts = df.select(text_or_empty().alias("text"))
    voted = cut_lineage(with_votes(texts).select("votes", F.xxhash64(F.lit("weak"), "text").alias("h")))
    found = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    patterns, counts = np.array([r.votes for r in found], int), np.array([r.n for r in found], float)
    if not len(found):
        return Quality({}, 0.5, np.full((2, len(LABELLERS), 2), 0.5), train([], np.zeros(0)))
    good, share, table = expectation_maximisation(patterns, counts)
    posterior = {int(p): float(g) for p, g in zip(patterns, good, strict=True)}
    part = min(1.0, sample / counts.sum())
    chosen = with_votes(texts.filter(F.abs(F.xxhash64(F.lit("weak"), "text")) / F.lit(float(2**63)) < part).distinct())

    def shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = strings(batch.column("text"))
            index = grams(data)
            keys, values = [], []
            for a, b, more in zip(offsets[:-1], offsets[1:], bins(measures(data, offsets)), strict=True):
                k, n = np.unique(index[a : max(b - 3, a)], return_counts=True)
                keys.append(np.concatenate([k.astype(np.int32), more.astype(np.int32)]))
                values.append(np.concatenate([SCALE * n / max(n.sum(), 1), np.ones(len(more))]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("votes"), pa.array([k.tolist() for k in keys], pa.list_(pa.int32())), pa.array([v.tolist() for v in values], pa.list_(pa.float32()))], names=["votes", "k", "v"])

    rows = chosen.mapInArrow(shapes, "votes int, k array<int>, v array<float>").orderBy("votes", "k", "v").collect()
    pairs = [(np.array(r.k, int), np.array(r.v, float)) for r in rows]
    return Quality(posterior, share, table, train(pairs, np.array([posterior[r.votes] for r in rows])))


def score(df: DataFrame, scorer: Scorer, text: str = "text", to: str = "quality") -> DataFrame:
    """df with the score 0..1 of each text, higher for good ones."""
    df = without(df, [to])
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            logit = shared.value.logits(*strings(batch.column(text)))
            yield appended(batch, **{to: pa.array(np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6))})

    return df.mapInArrow(run, fields(df.schema, T.StructField(to, T.DoubleType(), False)))


def classify(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per row of df: key, votes (text), soft_label, quality, kept (quality >= 0.5)."""
    rows = df.select(quoted(key), text_or_empty().alias("text"))
    model = fit(rows)
    names = [name for name, *_ in LABELLERS]
    scored = score(with_votes(rows), model.scorer).drop("text")
    soft: Column = F.lit(model.share)
    if model.posterior:
        soft = F.element_at(F.create_map(*[F.lit(x) for p in model.posterior.items() for x in p]), F.col("votes"))
    said = F.concat_ws(",", *[F.when(F.floor(F.col("votes") / 3**k) % 3 == 0, F.lit(name)) for k, name in enumerate(names)])
    return scored.select(quoted(key), said.alias("bad_votes"), F.round(soft, 6).alias("soft_label"), "quality", (F.col("quality") >= 0.5).alias("kept"))


def keep(df: DataFrame) -> DataFrame:
    """The rows of df with a quality of at least 0.5, with df's columns. Texts are measured again, so as not to be written."""
    own = "__quality_score"
    return score(df, fit(df).scorer, to=own).filter(quoted(own) >= 0.5).select(*map(quoted, df.columns))
