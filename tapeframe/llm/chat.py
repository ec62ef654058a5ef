"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text: for each turn a header with its
role, the escaped content and an end mark. For a block of turns the kernel
computes the lengths of all segments, their cumulative offsets and the scatter
indices in numpy, and copies headers and contents into one preallocated buffer,
which becomes the data of an Arrow column without another copy.

Template of a turn, with control strings only there:  <|ROLE|>\\nCONTENT<|end|>\\n
Escapes inside roles and contents:  "\\" -> "\\\\"  and  "<|" -> "<\\|",  so that no
"<|" of a text survives and unescaping gives the text back.  Roles also escape
"|>" as "|\\>" .

Turns are ordered by turn (null first), then role and text, so that ties and
repeated rows have a defined order. A null role is an empty role, a null text an
empty text, rows with a null conversation id form one conversation. Conversations
are split by nothing: one has to fit into an executor's memory, as its output does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.common import SLICE_BYTES, quoted, spread, strings, text_or_empty

OPEN, CLOSE, NEWLINE, END = b"<|", b"|>", b"\n", b"<|end|>\n"
#: The role whose contents are under the loss mask.
LEARNED = "assistant"

_BACKSLASH, _LESS, _BAR = 0x5C, 0x3C, 0x7C

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType(), False),
        T.StructField("formatted", T.BinaryType(), False),
        T.StructField("loss_spans", T.ArrayType(T.LongType(), False), False),
    ]
)


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a backslash before every backslash and inside every "<|"."""
    before = data == _BACKSLASH
    inner = np.zeros(len(data), bool)
    if len(data) > 1:
        inner[1:] = (data[1:] == _BAR) & (data[:-1] == _LESS)
        inner[offsets[:-1][offsets[:-1] < len(data)]] = False  # a bar that begins a text follows no "<"
    extra = (before | inner).astype(np.int64)
    if not extra.any():
        return data, offsets
    shift = np.zeros(len(data) + 1, np.int64)
    np.cumsum(extra, out=shift[1:])
    out = np.full(len(data) + int(shift[-1]), _BACKSLASH, np.uint8)
    out[np.arange(len(data)) + shift[1:]] = data
    return out, offsets + shift[offsets]


def unescaped(text: bytes) -> bytes:
    """What was escaped."""
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.S) if b"\\" in text else text


def assemble(roles: list[bytes], role_of: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Formats turns: the bytes, each turn's end and each content's start in them.

    roles: distinct roles; role_of: each turn's index into them; data, offsets: contents.
    """
    heads = [OPEN + re.sub(rb"\|>", rb"|\\>", bytes(escaped(r := np.frombuffer(x, np.uint8), np.array([0, len(r)]))[0])) + CLOSE + NEWLINE for x in roles]
    pieces = np.frombuffer(b"".join([*heads, END]), np.uint8)
    piece_at = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int64)
    head_size = np.diff(piece_at)[role_of] if len(role_of) else np.zeros(0, np.int64)
    data, offsets = escaped(data, offsets)
    size = np.diff(offsets)
    ends = np.cumsum(head_size + size + len(END))
    starts = ends - (head_size + size + len(END))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[np.repeat(starts, head_size) + spread(head_size)] = pieces[np.repeat(piece_at[role_of], head_size) + spread(head_size)]
    out[np.repeat(starts + head_size - offsets[:-1], size) + np.arange(len(data))] = data
    out[(ends - len(END))[:, None] + np.arange(len(END))] = pieces[piece_at[-1] :]
    return out, ends, starts + head_size


def format_chats(df: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    loss_spans holds start, end byte offsets, in turn, of the contents under the loss mask.
    df needs conv_id, turn, role and text; other columns are ignored.
    """
    rows = df.select(
        quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text")
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return sorted_rows.mapInArrow(lambda batches: _formatted(batches, learned), SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations of about SLICE_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < SLICE_BYTES:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        ids = whole.column("conv_id")
        last = ids[len(ids) - 1].as_py()
        keep = len(ids)
        while keep and ids[keep - 1].as_py() == last:
            keep -= 1
        if keep:
            yield whole.slice(0, keep)
        held = whole.slice(keep).to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _formatted(batches: Iterator[pa.RecordBatch], learned: str) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        ids = block.column("conv_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (known[1:] != known[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(keys))
        roles = block.column("role").combine_chunks().dictionary_encode()
        roles = roles.chunk(0) if isinstance(roles, pa.ChunkedArray) else roles
        names = [r.encode() for r in roles.dictionary.to_pylist()]
        role_of = roles.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = strings(block.column("text"))
        out, ends, starts = assemble(names, role_of, data, offsets)
        bounds = np.concatenate([[0], ends[last - 1]])
        learns = role_of == (names.index(learned.encode()) if learned.encode() in names else -1)
        base = np.repeat(bounds[:-1], last - first)
        spans = np.stack([starts - base, ends - len(END) - base], 1)[learns].reshape(-1)
        many = np.add.reduceat(learns.astype(np.int64), first) * 2
        for a in range(0, len(first), 4096):
            b = min(a + 4096, len(first))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[first[a:b]], mask=~known[first[a:b]]),
                    pa.array((last - first)[a:b]),
                    pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(bounds[a : b + 1])), pa.py_buffer(out)]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[a:b])]).astype(np.int32)), pa.array(spans[many[:a].sum() : many[:b].sum()])),
                ],
                names=SCHEMA.names,
            )


_TURN = re.compile(rb"<\|((?:[^\\|]++|\\.|\|(?!>))*+)\|>\n((?:[^\\<]++|\\.|<(?!\|))*+)<\|end\|>\n", re.S)


def read_back(formatted: bytes) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError("not a formatted conversation")
        turns.append((unescaped(found[1]).decode(), unescaped(found[2]).decode()))
        at = found.end()
    return turns


def learned_text(formatted: bytes, spans: list[int]) -> str:
    """All text under the loss mask, unescaped."""
    return b"".join(unescaped(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True)).decode()


DIGESTS = T.StructType(
    [T.StructField("conv_id", T.LongType())]
    + [T.StructField(n, T.LongType() if n.endswith(("turns", "chars")) else T.StringType(), False) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]
)


def digests(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read back from the formatted bytes and the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out: list[list] = [[] for _ in DIGESTS.names]
            for row in batch.to_pylist():
                turns = read_back(row["formatted"])
                loss = learned_text(row["formatted"], row["loss_spans"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                values = (row["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"].decode()))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in DIGESTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=DIGESTS.names)

    return chats.mapInArrow(run, DIGESTS)
