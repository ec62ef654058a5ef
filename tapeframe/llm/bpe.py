"""Byte-level BPE encoding and decoding.

Each text is cut at safe boundaries into parts of bounded length, the tiktoken
library encodes the parts from a local rank file, and decoding joins the raw
bytes of the ids. A boundary is safe before white space that follows something
else: no match of the pattern runs over it and no match looks beyond it, so the
ids are those of the whole text. Null texts are empty texts and have no ids.

The library's matching gives up on some hundred thousand white characters in a row, so
runs of LONG_BLANK or more are found without it where the pattern takes white space as
`\\s+(?!\\S)|\\s+` last: all of the run but its last character is one match (at the end
of the text: all of it), and the last begins the rest.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.common import appended, fields, slices, strings, without

#: Characters of a part, about; a run without a safe boundary stays whole.
PART_CHARS = 1 << 16

#: White characters in a row that are matched without the pattern.
LONG_BLANK = 10_000

_SAFE = re.compile(r"(?<=[^\s])(?=[ \n\t\r])")
# Unicode's White_Space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{LONG_BLANK},}}")
_BLANK_LAST = r"|\s+(?!\S)|\s+"


def rank_table(path: str) -> bytes:
    """The bytes of a rank file; the driver reads it, tasks get it with a broadcast of that size."""
    with open(path, "rb") as f:
        return f.read()


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of the text of at least `size` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Coder:
    """Encoder and raw-byte decoder for one rank table and pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._one_match = None
        if pattern.endswith(_BLANK_LAST):
            self._one_match = tiktoken.Encoding("one", pat_str="(?s).+", mergeable_ranks=table, special_tokens={}).encode_ordinary
        size = max(table.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in table.items():
            tokens[rank] = token
        self.tokens = tokens

    def _encoded(self, text: str) -> Iterator[list[int]]:
        """The ids of the text, a part at a time."""
        start = 0
        if self._one_match and len(text) > LONG_BLANK:
            for run in _BLANK.finditer(text):
                for part in parts(text[start : run.start()]):
                    yield self._encode(part)
                start = run.end() if run.end() == len(text) else run.end() - 1
                yield self._one_match(text[run.start() : start])
        for part in parts(text[start:] if start else text):
            yield self._encode(part)

    def encoded(self, text: str) -> np.ndarray:
        if len(text) <= LONG_BLANK:
            return np.array(self._encode(text), np.int32)
        found = [np.array(ids, np.int32) for ids in self._encoded(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def encode(self, text: str) -> list[int]:
        return self.encoded(text).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids, not necessarily valid text; an unknown or negative id raises."""
        tokens = self.tokens
        ids = list(ids)
        if ids and (min(ids) < 0 or max(ids) >= len(tokens)):
            raise ValueError("id outside the vocabulary")
        return b"".join([tokens[i] for i in ids])


def _coder(shared, pattern: str, known: dict = {}) -> Coder:  # noqa: B006  one for each worker
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in known:
        known.clear()
        known[key] = Coder(shared.value, pattern)
    return known[key]


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the array of ids of each text in column `ids`."""
    df = without(df, [ids])
    shared = df.sparkSession.sparkContext.broadcast(rank_table(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for batch in slices(batches, text):
            rows = [coder.encoded(x or "") for x in batch.column(text).to_pylist()]
            yield appended(batch, **{ids: _lists(rows)})

    return df.mapInArrow(run, fields(df.schema, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)))


def decode(df: DataFrame, rank_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the raw bytes of each array of ids; a null array has no bytes."""
    df = without(df, [decoded])
    shared = df.sparkSession.sparkContext.broadcast(rank_table(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, ".")
        for batch in batches:
            yield appended(batch, **{decoded: pa.array([coder.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())})

    return df.mapInArrow(run, fields(df.schema, T.StructField(decoded, T.BinaryType(), False)))


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with `ids` and `decoded`, as encode() and decode() in turn, in one pass over the rows."""
    df = without(df, ["ids", "decoded"])
    shared = df.sparkSession.sparkContext.broadcast(rank_table(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        tokens = coder.tokens
        for batch in slices(batches, text):
            rows = [coder.encoded(x or "") for x in batch.column(text).to_pylist()]
            back = pa.array([b"".join([tokens[i] for i in row.tolist()]) for row in rows], pa.binary())
            yield appended(batch, ids=_lists(rows), decoded=back)

    return df.mapInArrow(run, fields(df.schema, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def digests(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of a table with `ids` and `decoded`."""
    return df.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
