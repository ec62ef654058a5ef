"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the K smallest distinct 64-bit hashes of a text's shingles (five
words in a row; words are runs of letters, digits and non-ASCII characters, A-Z
lowered; a shorter text's one shingle is all its words). Fingerprints of parts merge
to the fingerprint of the whole, and two of them estimate resemblance, containment
and the number of distinct shingles; they are exact where a text has at most K.

Likeness of two texts without words is 1, of one with and one without 0. Null texts
are empty texts. Rows of one doc_id follow each other by text, equal ones in any order.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.common import SLICE_BYTES, appended, fields, quoted, slices, strings, text_or_empty, without
from tapeframe.llm.near_dedup import shingled, worded

K = 128
#: Text of a part that neighbours are looked for in, and most parts.
PART_BYTES, MOST_PARTS = 32 << 20, 1 << 16


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:  # the k-th distinct one is rarely beyond the 2k-th
        part = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(hashes)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A or B|."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~same])
    rank = np.cumsum(distinct)
    size = min(k, int(rank[-1]))
    return float(np.count_nonzero(same & (rank[1:] <= size)) / size)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of A's shingles that B has; 1 for an empty A."""
    if not len(a):
        return 1.0
    union = distinct_count(merged(a, b, k), k)
    return float(min(1.0, resemblance(a, b, k) * union / distinct_count(a, k)))


def packed(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u8").tobytes()


def unpacked(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, ">u8").astype(np.uint64)


def _sketches(column: pa.Array, k: int) -> list[np.ndarray]:
    grams, at = shingled(*worded(*strings(column)))
    return [bottom(grams[a:b], k) for a, b in zip(at[:-1], at[1:], strict=True)]


def fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint", k: int = K) -> DataFrame:
    """df with the packed sketch (binary) of each text."""
    df = without(df, [to])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield appended(batch, **{to: pa.array([packed(s) for s in _sketches(batch.column(text), k)], pa.binary())})

    return df.mapInArrow(run, fields(df.schema, T.StructField(to, T.BinaryType(), False)))


def merge(df: DataFrame, keys: list[str], sketch: str = "fingerprint", k: int = K) -> DataFrame:
    """keys and the fingerprint of all rows of each group, merged natively: no group meets in one task before it is down to k hashes a part."""
    hashes = df.select(*map(quoted, keys), F.posexplode(F.expr(f"regexp_extract_all(hex(`{sketch}`), '([0-9A-F]{{16}})', 1)")).alias("__at", "__hash"))
    salted = hashes.groupBy(*map(quoted, keys), F.pmod(F.xxhash64("__hash"), F.lit(64)).alias("__part")).agg(F.slice(F.array_sort(F.collect_set("__hash")), 1, k).alias("__few"))
    grouped = salted.groupBy(*map(quoted, keys)).agg(F.slice(F.array_sort(F.flatten(F.collect_list("__few"))), 1, k).alias("__all"))
    return grouped.select(*map(quoted, keys), F.unhex(F.array_join("__all", "")).alias(sketch))


# ---------------------------------------------------------------- neighbours in the order of ids


def _constant(values: list[int]) -> Column:
    """An array of longs as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above key, by two looks at about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    upto = lambda row: F.size(F.filter(row, lambda b: b <= key))
    table = F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";")
    row = F.greatest(upto(_constant([r[0] for r in rows])) - 1, F.lit(0))
    return row * step + upto(F.split(F.get(table, row), ",").cast("array<bigint>"))


def with_next(df: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (part, halo, doc_id, text), dealt so that each partition holds runs of the descending order.

    A part is a range of ids of about part_bytes of text, MOST_PARTS at most; each part also
    gets, marked halo, the rows of the id that follows its last one (after the lowest id: the
    highest), so no row looks beyond its part.
    """
    rows = df.select(quoted("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    lowest = -(2**63)
    key = F.coalesce("doc_id", F.lit(lowest))
    parts = min(max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)), MOST_PARTS)
    bounds = sorted(set(map(int, rows.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts)))) if parts > 1 else []
    part = _place(key, bounds)
    heads = {r.part: r.head for r in rows.groupBy(part.alias("part")).agg(F.max(key).alias("head")).collect()}  # a row a part
    used = sorted(heads)
    above = {used[k - 1]: used[k] for k in range(len(used))}  # a part's head follows the part above it; the highest id follows the lowest part
    every = range(len(bounds) + 1)
    halo = F.when(key == F.get(_constant([heads.get(p, lowest) for p in every]), part), F.get(_constant([above.get(p, 0) for p in every]), part).cast("int"))
    places = F.explode(F.array_compact(F.array(F.struct(part.alias("part"), F.lit(0).alias("halo")), F.when(halo.isNotNull(), F.struct(halo.alias("part"), F.lit(1).alias("halo"))))))
    dealt = rows.select(places.alias("at"), "doc_id", "text").select("at.part", "at.halo", "doc_id", "text")
    return dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), "text")


NEIGHBOURS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType(), False),
        T.StructField("edited", T.StringType(), False),
        T.StructField("fingerprint", T.BinaryType(), False),
        T.StructField("edited_fingerprint", T.BinaryType(), False),
        T.StructField("near_edited", T.DoubleType(), False),
        T.StructField("near_next", T.DoubleType(), False),
    ]
)


def edited_text(text: str, following: str) -> str:
    """text with its last third replaced by the first as many characters of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def neighbours(df: DataFrame, k: int = K) -> DataFrame:
    """NEIGHBOURS of every row of df(doc_id, text): its edited text, both fingerprints and likenesses.

    The next document is the next row in the order of descending doc_id (null last), then
    text; after the last comes the first. A single row is its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: part, halo, id, text, sketch
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            edits = [edited_text(said, after) for _, said, _, after, _ in out]
            found = _sketches(pa.array(edits, pa.large_string()), k)
            columns = [
                pa.array([i for i, *_ in out], pa.int64()),
                pa.array([len(said) for _, said, *_ in out], pa.int64()),
                pa.array(edits, pa.string()),
                pa.array([packed(own) for _, _, own, _, _ in out], pa.binary()),
                pa.array([packed(e) for e in found], pa.binary()),
                pa.array([resemblance(own, e, k) for (_, _, own, _, _), e in zip(out, found, strict=True)]),
                pa.array([resemblance(own, other, k) for _, _, own, _, other in out]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=NEIGHBOURS.names)

        for batch in slices(batches, "text"):
            rows = zip(batch.column("part").to_pylist(), batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), _sketches(batch.column("text"), k), strict=True)
            for row in rows:
                if held is not None and held[0] == row[0] and not held[1]:
                    out.append((held[2], held[3], held[4], row[3], row[4]))
                    size += len(held[3])
                held = row
                if size >= SLICE_BYTES or len(out) >= 4096:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return with_next(df).mapInArrow(run, NEIGHBOURS)


def report(df: DataFrame) -> DataFrame:
    """The digest columns of neighbours()."""
    found = neighbours(df)
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.base64("fingerprint").alias("fingerprint"), F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next"
    )
