"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs
that stand for letters to those letters, everything else that is no letter to
spaces. Lexicon entries are word beginnings (" idio") or whole words (" idiot ").
Matches inside an exception phrase do not count. The weights of all matches are
summed, normalised by the length of the text, and squashed to a score in 0..1.

The lexicon is learned from a bounded sample of labelled rows (SAMPLE of each
class at most): the ENTRIES of clearest log-odds of their counts, in which a text counts
CLIP times at most, and weights by a regularised logistic regression. Scores see the
text alone. Null and empty texts have the score of a text without matches. Repeated
rows are scored each for itself. A document whose labels conflict is toxic in learning.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.common import appended, cut_lineage, fields, quoted, slices, text_or_empty, without

#: Most labelled rows of a class that the lexicon is learned from, and most entries.
SAMPLE = 5000
ENTRIES = 400
#: What one text adds at most to the counts from which entries are chosen, so that none makes an entry by itself.
CLIP = 3
#: Fewest positive rows with an entry; lengths of word beginnings.
MIN_ROWS, PREFIXES = 4, range(3, 11)

# Letters that look like Latin ones, and what they look like.
LOOKALIKES = (
    "аеорсухіјѕԁһкмтвнԛԝїёαεοιυνρτκχγσηκ"
    "ɑɡıłøðþƒⅰⅴⅹⅼⅽⅾⅿ",
    "aeopcyxijsdhkmtbhqwieaeoiuvptkxysnk"
    "agilodpfivxlcdm",
)
# Signs that stand for letters.
SIGNS = ("0134578@$€£", "oieastbaseL")
# Phrases in which an insult is none.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown act", "pond scum", "sore loser rule", "idiot proof", "idiot light")


def _folding() -> dict[int, str]:
    table = {ord(a): b for a, b in zip(*LOOKALIKES, strict=True)}
    for code in [*range(0x80), *range(0xA0, 0xC0), *range(0x2000, 0x2070), *range(0x3000, 0x3004)]:
        if not chr(code).isalpha():
            table.setdefault(code, " ")
    for code in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):  # these join what they stand between
        table[code] = ""
    for code in range(0xFF01, 0xFF5F):
        table[code] = chr(code - 0xFEE0).lower() if chr(code - 0xFEE0).isalpha() else " "
    table.update({ord(a): b.lower() for a, b in zip(*SIGNS, strict=True)})
    return table


_FOLD = _folding()


def folded(text: str) -> str:
    """The text as the automaton sees it, with a space before and after."""
    return f" {text.lower().translate(_FOLD)} "


@dataclass
class Model:
    """Lexicon entries and weights, and the length normalisation's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    scale: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        tree = ahocorasick.Automaton()
        for k, entry in enumerate(self.weights):
            tree.add_word(entry, (k, len(entry)))
        for phrase in self.exceptions:
            tree.add_word(f" {phrase} ", (-1, len(phrase) + 2))
        tree.make_automaton()
        return tree


def hits(tree, text: str) -> list[int]:
    """Indices of the entries matched in a folded text, outside exception phrases."""
    found, exempt = [], []
    for end, (k, size) in tree.iter(text) if len(tree) else ():
        (exempt if k < 0 else found).append((end - size + 1, end + 1, k))
    if not exempt:
        return [k for _, _, k in found]
    exempt.sort()
    starts = [x for x, _, _ in exempt]
    reach = list(accumulate((y for _, y, _ in exempt), max))  # how far the phrases that begin up to here go
    return [k for a, _, k in found if (at := bisect_right(starts, a)) == 0 or reach[at - 1] <= a + 1]


def _features(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    size = lengths / 6 + 20
    return np.stack([np.ones_like(sums), sums / np.sqrt(size), sums / size * 10, np.log1p(np.abs(sums)) * np.sign(sums), np.log(size) / 5], 1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton's method for penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words by class, each row's count clipped at CLIP; and rows with the word."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            for word, n in Counter(folded(text or "").split()).items():
                row = counts.setdefault(word, [0, 0, 0])
                row[label] += min(n, CLIP)
                row[2] += label
    names = list(counts)
    for a in range(0, len(names), 20_000):
        some = names[a : a + 20_000]
        values = np.array([counts[n] for n in some], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(values[:, k]) for k in range(3)]], names=["word", "neg", "pos", "rows"])


def learn(labelled: DataFrame) -> Model:
    """A model from rows of (doc_id, text, label 0/1); rows without a label are left out.

    Without both classes the model has no entries and a low score for every text.
    """
    rows = labelled.filter("label in (0, 1)").select("doc_id", text_or_empty().alias("text"), F.col("label").cast("int").alias("label"))
    rows = cut_lineage(rows)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    counts = rows.mapInArrow(_word_counts, "word string, neg long, pos long, rows long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), F.sum("rows").alias("rows"))
    ends = [F.when(F.length("word") >= n, F.concat(F.lit(" "), F.substring("word", 1, n))) for n in PREFIXES]
    entries = F.explode(F.array_distinct(F.array_compact(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *ends)))).alias("entry")
    total = counts.agg(F.sum("pos"), F.sum("neg")).first()
    summed = counts.select(entries, "neg", "pos", "rows").groupBy("entry").agg(F.sum("neg").alias("b"), F.sum("pos").alias("a"), F.sum("rows").alias("rows")).filter(F.col("rows") >= MIN_ROWS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / float(total[0] + 1)) - F.log(b / float(total[1] + 1))
    best = summed.withColumn("z", odds / F.sqrt(1 / a + 1 / b)).filter(F.col("z") > 3).orderBy(F.desc("z"), "entry").limit(ENTRIES).select("entry").collect()
    model = Model({r.entry: 1.0 for r in best})
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value.automaton()
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column("doc_id").to_pylist(), "label": batch.column("label").to_pylist(), "length": [], "entries": [], "counts": []}
            for text in batch.column("text").to_pylist():
                said = folded(text or "")
                found = Counter(hits(tree, said))
                out["length"].append(len(said))
                out["entries"].append(list(found))
                out["counts"].append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["label"], pa.int32()), pa.array(out["length"], pa.int64()), pa.array(out["entries"], pa.list_(pa.int32())), pa.array(out["counts"], pa.list_(pa.int32()))], names=list(out))

    seen = rows.mapInArrow(matched, "doc_id long, label int, length long, entries array<int>, counts array<int>").orderBy("doc_id").collect()
    x = np.zeros((len(seen), len(best)))
    y = np.array([r.label for r in seen], float)
    lengths = np.array([r.length for r in seen], float)
    for k, r in enumerate(seen):
        x[k, r.entries] = np.array(r.counts) if r.entries else 0
    size = np.sqrt(lengths / 6 + 20)[:, None]
    fitted = _logistic(np.hstack([x * 20 / size, np.ones((len(y), 1))]), y, np.array([1.0] * len(best) + [1e-6]))
    weights = np.round(fitted[:-1], 6)
    scale = _logistic(_features(x @ weights, lengths), y, np.full(5, 1e-2))
    return Model({r.entry: float(w) for r, w in zip(best, weights, strict=True)}, tuple(np.round(scale, 6)))


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: str | None = None, most: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, text, label) for learning: of each class about `most` by a seeded hash.

    Of conflicting labels of a document the largest counts.

    keep: an SQL condition on doc_id that labelled rows must meet.
    """
    known = labels.filter(f"{label} in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.filter(keep) if keep else known
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for c in (0, 1) for x in (c, min(1.0, most / max(sizes.get(c, 0), 1)))])
    chosen = known.filter(F.abs(F.xxhash64(F.lit("toxicity"), "doc_id")) / F.lit(float(2**63)) < share[F.col("label")])
    # about 2 * most rows of two numbers, whatever the tables' sizes
    return docs.select(quoted("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """df with the toxicity score of each text."""
    df = without(df, [to])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tree = model.automaton()
        weights = np.array([*model.weights.values()])
        scale = np.array(model.scale)
        for batch in slices(batches, text):
            sums, lengths = [], []
            for said in batch.column(text).to_pylist():
                said = folded(said or "")
                found = hits(tree, said)
                sums.append(float(weights[found].sum()) if found else 0.0)
                lengths.append(len(said))
            logit = _features(np.array(sums, float), np.array(lengths, float)) @ scale
            yield appended(batch, **{to: pa.array(np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 9))})

    return df.mapInArrow(run, fields(df.schema, T.StructField(to, T.DoubleType(), False)))


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learned from the other folds."""
    model = learn(sample(docs, labels, keep=f"not coalesce({HELD_OUT}, false)"))
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
