"""Near-duplicate documents by Order MinHash.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered; shingles are
five words in a row (all words of a shorter text). Repeated shingles are labelled with
their occurrence. For each of SAMPLES hash functions a text's ORDER smallest labelled
shingles are taken and kept in text order; equal samples bring two texts into one
bucket. Texts of aligned similarity 0.8 miss all 24 buckets with a chance of 3e-6.

Two texts of a bucket are a link if the longest common subsequence of their labelled
shingles, looked for within the band that a link can't leave, is 0.8 of their union or
more. Classes are the connected components of the links. Copies (equal words) are
collapsed first; then three passes find the components without comparing all pairs:

1. each bucket's members with one of them, the hub;
2. in buckets whose members are still of several components, each member with the
   closest member of another component;
3. all pairs of different components that share a bucket, are not compared yet and that
   the parity bitmaps leave possible.

A parity bitmap has a bit for a part of the labelled shingles' hashes, set if an odd
number of the text's shingles are of that part. Each shingle that only one of two texts
has turns one bit at most, so the number of bits that differ bounds the number of such
shingles from below, and the similarity from above: no link is lost to it. Bitmaps are
compared in blocks of BLOCK members, so a hot bucket is many pairs of blocks.

Texts without words are copies if their bytes are equal. Every row takes part with its
own text, so different texts under one doc_id are different documents, and rows without
a doc_id have classes like others. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.common import appended, cut_lineage, fields, gram_hashes, hashed_runs, mixed, quoted, scratch_folder, settings, slices, small, strings, text_or_empty

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, ORDER = 24, 4
#: Members of a bucket whose bitmaps are compared at once with those of another block.
BLOCK = 512
#: Fewest and most bits of a bitmap; beyond 16,000 shingles it bounds less tightly.
BITS = (64, 1 << 15)
#: Settings of the passes: small Arrow batches, since a row has two texts or a block, and plans
#: without inferred constraints, which pile up over the passes' tables.
PASSES = {"spark__sql__execution__arrow__maxRecordsPerBatch": 500, "spark__sql__constraintPropagation__enabled": False}
BLOCK_BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": 32}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_SEEDS = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _SEEDS[:SAMPLES] | np.uint64(1), _SEEDS[SAMPLES:]


def worded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's first word (n+1)."""
    data = _LOWER[data]
    starts, _, hashes = hashed_runs(data, offsets, _WORD)
    return hashes, np.searchsorted(starts, offsets)


def shingled(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and each text's first shingle (n+1)."""
    grams, many = gram_hashes(words, first[:-1], np.diff(first), SHINGLE)
    return grams, np.concatenate([[0], np.cumsum(many)])


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingle hashes of one text with the number of their occurrence mixed in."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return grams
    at = np.arange(len(grams))
    nth = np.empty(len(grams), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, mixed(grams + nth * np.uint64(0xA24BAED4963EE407)), grams)


def samples(marks: np.ndarray) -> np.ndarray:
    """The SAMPLES order-min-hashes of a text's labelled shingles (none of a text without words)."""
    if not len(marks):
        return np.zeros(0, np.int64)
    if len(marks) <= ORDER:
        chosen = np.broadcast_to(np.arange(len(marks)), (SAMPLES, len(marks)))
    else:
        least = []
        step = max(1, (1 << 20) // len(marks))  # hash functions at once: a bound on the values held
        for k in range(0, SAMPLES, step):
            values = marks[None, :] * _FACTORS[k : k + step, None] + _SHIFTS[k : k + step, None]
            least.append(np.argpartition(values, ORDER - 1, axis=1)[:, :ORDER].copy())  # a view would keep them all
        chosen = np.sort(np.concatenate(least), axis=1)
    out = np.arange(SAMPLES, dtype=np.uint64)
    for k in range(chosen.shape[1]):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + marks[chosen[:, k]])
    return out.view(np.int64)


def parities(marks: np.ndarray) -> bytes:
    """The parity bitmap of labelled shingles: twice to four times as many bits."""
    size = min(max(BITS[0], 1 << (2 * len(marks)).bit_length()), BITS[1])
    places = ((marks >> np.uint64(17)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def halved(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (a row of words each) folded to half as many bits."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def most_different(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most shingles that only one of two texts of x and y shingles may have in a link."""
    return np.floor((x + y) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9)


def aligned(x: np.ndarray, y: np.ndarray) -> float:
    """|common| / |union| of labelled shingles, where common is their longest common subsequence.

    A link leaves at most so many shingles of the longer text unaligned as `band` says, so an aligned
    pair of shingles of a link is no further from the diagonal.
    """
    order = np.argsort(y)
    place = order[np.minimum(np.searchsorted(y, x, sorter=order), len(y) - 1)]
    common = np.flatnonzero(y[place] == x)
    place = place[common]
    band = max(len(x), len(y)) - int(np.ceil((len(x) + len(y)) * SIMILARITY / (1 + SIMILARITY) - 1e-9))
    near = place[np.abs(place - common) <= band]
    if len(near) > 1 and (np.diff(near) < 0).any():
        tails: list[int] = []  # longest increasing subsequence
        for p in near.tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        many = len(tails)
    else:
        many = len(near)
    return many / (len(x) + len(y) - many)


def _copies(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, first: np.ndarray) -> list[bytes]:
    """16 bytes a text: equal for equal words, or equal bytes of texts without words."""
    said = [b"w" + words[i:j].tobytes() if i < j else b"t" + data[a:b].tobytes() for i, j, a, b in zip(first[:-1], first[1:], offsets[:-1], offsets[1:], strict=True)]
    return [hashlib.blake2b(s, digest_size=16).digest() for s in said]


def with_copies(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the digest of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offsets = strings(batch.column(text))
            yield appended(batch, **{to: pa.array(_copies(data, offsets, *worded(data, offsets)), pa.binary())})

    return df.mapInArrow(run, fields(df.schema, T.StructField(to, T.BinaryType(), False)))


def sketches(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, copy, n (shingles), bits (the parity bitmap) and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = strings(batch.column("text"))
            words, first = worded(data, offsets)
            grams, at = shingled(words, first)
            bits, sketch = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                marks = labelled(grams[a:b])
                bits.append(parities(marks))
                sketch.append(samples(marks))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_copies(data, offsets, words, first), pa.binary()), pa.array(np.diff(at)), pa.array(bits, pa.binary()), lists], names=["doc_id", "copy", "n", "bits", "sketch"])

    rows = df.select(quoted(key).cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, copy binary, n long, bits binary, sketch array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, rows: int) -> DataFrame:
    """a, b, similarity of distinct pairs (a, b) of nodes, `rows` of them; texts: node, text of all of them.

    Both texts come to a pair by joins on the pair itself, so a hub of many pairs is no hot key.
    """
    few = small(pairs, rows)
    left = texts.join(few, F.col("node") == F.col("a")).select("a", "b", F.col("text").alias("text_a"))
    right = texts.join(few, F.col("node") == F.col("b")).select("a", "b", F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            x, first = shingled(*worded(*strings(batch.column("text_a"))))
            y, second = shingled(*worded(*strings(batch.column("text_b"))))
            out = [aligned(labelled(x[first[k] : first[k + 1]]), labelled(y[second[k] : second[k + 1]])) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    joined = left.join(right.hint("merge"), ["a", "b"]).select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame, keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """node, label (smallest node of its component) of all nodes of links (a, b).

    Labels spread over links and jump to their label's label, until none changes.
    keep(df, rows) writes a table.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = keep(edges, 2 * links.count())
    labels = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), edges.count())
    nodes = labels.count()
    while True:
        heard = edges.join(small(labels, nodes), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        new = heard.join(small(labels, nodes), F.col("node") == F.col("a")).join(small(jump, nodes), F.col("label") == F.col("via"))
        new = keep(new.select("node", F.least("label", "heard", "further").alias("label"), F.col("label").alias("old")), nodes)
        changed = not new.filter("label <> old").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels


def merged(labels: DataFrame | None, links: DataFrame, keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """labels (node, label) after more links (a, b): only the components that these join are gone through."""
    if labels is None:
        return components(links, keep)
    known = labels.count()
    of = lambda end: small(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), known)
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(keep(between, links.count()), keep)
    n = joined.count()
    moved = labels.join(small(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), n), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    first = joined.join(small(labels.select("node"), known), "node", "left_anti")
    return keep(moved.unionByName(first), known + n)


_MEMBERS = "array<struct<node: bigint, label: bigint, n: bigint, bits: binary, sketch: array<bigint>>>"


class _Block:
    """A block's members, with their bitmaps by size."""

    def __init__(self, members: pa.StructArray) -> None:
        whole = lambda name: members.field(name).to_numpy(zero_copy_only=False)
        self.node, self.label, self.n = whole("node"), whole("label"), whole("n")
        self.sketch = np.array(members.field("sketch").to_pylist(), np.int64).reshape(len(members), -1)
        bits = members.field("bits").to_pylist()
        sizes = np.array([len(b) for b in bits])
        self.bits = {}
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            self.bits[size] = (rows, np.frombuffer(b"".join(bits[r] for r in rows), np.uint64).reshape(len(rows), -1))


def _possible(x: _Block, y: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x, places in y and differing bits of the pairs of different labels that may be links."""
    for size, (rows, bits) in x.bits.items():
        for other in (size // 2, size, size * 2):  # a link's texts are of like length
            if other not in y.bits:
                continue
            columns, against = y.bits[other]
            mine = bits
            if other < size:
                mine = halved(mine)
            elif other > size:
                against = halved(against)
            step = max(1, (1 << 21) // (against.shape[0] * against.shape[1]))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                differ = np.bitwise_count(mine[k : k + step, None, :] ^ against[None, :, :]).sum(axis=2, dtype=np.int64)
                fits = (differ <= most_different(x.n[some][:, None], y.n[columns][None, :])) & (x.label[some][:, None] != y.label[columns][None, :])
                i, j = np.nonzero(fits)
                yield some[i], columns[j], differ[i, j]


def _closest(a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """For each value of a the place of its pair with the fewest differing bits, the least b among equals."""
    order = np.lexsort((b, differ, a))
    first = np.ones(len(order), bool)
    first[1:] = a[order][1:] != a[order][:-1]
    return order[first]


def _pairs_of_blocks(all_pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column("bucket").to_pylist()
            for k, bucket in enumerate(buckets):
                x = _Block(batch.column("xs")[k].values)
                y = _Block(batch.column("ys")[k].values) if batch.column("ys")[k].is_valid else x
                parts = list(_possible(x, y))
                if not parts:
                    continue
                i, j, differ = (np.concatenate(p) for p in zip(*parts, strict=True))
                a, b = x.node[i], y.node[j]
                if all_pairs:
                    # a pair is given by the first bucket that both texts have, once
                    same = x.sketch[i] == y.sketch[j]
                    mine = (x.sketch[i, same.argmax(axis=1)] == bucket) & ((x is not y) | (a > b))
                    a, b = a[mine], b[mine]
                else:
                    chosen = np.concatenate([_closest(a, b, differ), _closest(b, a, differ)])
                    a, b = a[chosen], b[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return run


def possible_links(members: DataFrame, marks: DataFrame, all_pairs: bool, keep: Callable[[DataFrame, int | None], DataFrame]) -> DataFrame:
    """Pairs (a, b), a > b, of members (bucket, node, label) that have a bucket in common and different labels
    and that their bitmaps leave possible: all of them, or some with each member's closest.

    marks: node, n, bits, sketch. A pair of nodes is there once if all_pairs is true.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    sizes = keep(sizes.select("bucket", F.ceil(F.col("size") / BLOCK).alias("blocks")), None)
    n = sizes.count()
    rows = keep(members.join(small(sizes, n), "bucket"), None).join(marks.select("node", "n", "bits", "sketch"), "node")
    rows = rows.select("bucket", F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.struct("node", "label", "n", "bits", "sketch").alias("m"))
    blocks = keep(rows.groupBy("bucket", "block").agg(F.collect_list("m").alias("xs")), None)
    several = sizes.filter("blocks > 1").select("bucket", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).alias("y"))
    several = several.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("y") - 1)).alias("x"), "y")
    left, right = blocks.withColumnRenamed("block", "x"), blocks.select("bucket", F.col("block").alias("y"), F.col("xs").alias("ys"))
    apart = several.join(left, ["bucket", "x"]).join(right, ["bucket", "y"]).select("bucket", "xs", "ys")
    with settings(members.sparkSession, **BLOCK_BATCH):
        within = blocks.select("bucket", "xs", F.lit(None).cast(_MEMBERS).alias("ys"))
        pairs = within.unionByName(apart).mapInArrow(_pairs_of_blocks(all_pairs), "a long, b long")
        return keep(pairs if all_pairs else pairs.distinct(), None)


def linked(members: DataFrame, marks: DataFrame, texts: DataFrame, keep: Callable[[DataFrame, int | None], DataFrame]) -> DataFrame:
    """node, label of the members (bucket, node, size) that have links: the smallest node of their component.

    marks: node, n, bits, sketch of the members; texts: node, text.
    """
    # the hub is a member of many in all its buckets, as the common ancestor of edited copies is
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    best = members.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("hub"))
    hubs = keep(best.select("bucket", F.col("hub.node").alias("hub")), None)
    pairs = members.join(small(hubs, hubs.count()), "bucket").filter("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    labels, done = None, None
    for step in ("hubs", "closest", "rest"):
        if step != "hubs":
            now = members.select("bucket", "node")
            if labels is not None:
                now = now.join(small(labels, labels.count()), "node", "left").withColumn("label", F.coalesce("label", "node"))
            else:
                now = now.withColumn("label", F.col("node"))
            pairs = possible_links(now, marks, step == "rest", keep)
            if pairs.isEmpty():
                break
            pairs = pairs.join(small(done, done.count()), ["a", "b"], "left_anti")
        pairs = keep(pairs, None)
        found = keep(similarities(pairs, texts, pairs.count()), None)
        done = found.select("a", "b") if done is None else done.unionByName(found.select("a", "b"))
        links = found.filter(F.col("similarity") >= SIMILARITY).select("a", "b")
        if not links.isEmpty():
            labels = merged(labels, links, keep)
    return labels if labels is not None else members.select("node", F.col("node").alias("label")).limit(0)


def _named(df: DataFrame, key: str, sketch: DataFrame, keep: Callable[[DataFrame, int | None], DataFrame]) -> DataFrame:
    """copy, n_copies, class_id, class_key, win_id, win_copy of the texts that have copies or links."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n", "bits", "sketch")).alias("first")
    reps = sketch.groupBy("copy").agg(first, F.count("*").alias("n_copies"))
    reps = keep(reps.select(F.monotonically_increasing_id().alias("node"), "copy", F.col("first.doc_id").alias("rep"), "n_copies", "first.n", "first.bits", "first.sketch"), None)
    members = reps.select("node", F.explode("sketch").alias("bucket"))
    shared = keep(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), None)
    members = keep(members.join(small(shared, shared.count()), "bucket"), None)
    nodes = keep(members.select("node").distinct(), None)
    many = nodes.count()
    marks = keep(reps.join(small(nodes, many), "node"), None)
    chosen = df.select(quoted(key).cast("long").alias("doc_id"), text_or_empty().alias("text"))
    chosen = chosen.join(small(marks.select("rep").distinct(), many), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    of = small(marks.select("node", F.col("copy").alias("said"), "rep"), many)
    texts = keep(with_copies(chosen, "text", "copy").join(of, (F.col("copy") == F.col("said")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text"), None)
    if texts.count() > many:  # rows that are equal in id and words
        texts = keep(texts.groupBy("node").agg(F.min("text").alias("text")), None)
    labels = linked(members, marks, texts, keep)
    special = reps.select("node", "copy", "rep", "n_copies").join(small(labels, labels.count()), "node", "left").filter("n_copies > 1 or label is not null")
    special = keep(special.withColumn("label", F.coalesce("label", "node")), None)
    win = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "copy")).alias("win")
    classes = special.groupBy("label").agg(win, F.min("copy").alias("class_key")).select("label", F.col("win.rep").alias("class_id"), "class_key", F.col("win.copy").alias("win_copy"))
    return special.join(classes, "label").select("copy", "n_copies", "class_id", "class_key", "win_copy")


def _classes(df: DataFrame, key: str) -> DataFrame:
    """doc_id, copy, class_id, class_key, n_copies, kept of each row of df."""
    spark = df.sparkSession
    with settings(spark, **PASSES), scratch_folder(spark) as folder:
        sketch = cut_lineage(sketches(df, key))
        named = cut_lineage(_named(df, key, sketch, lambda d, rows: cut_lineage(d, rows, folder=folder)))
    rows = sketch.select("doc_id", "copy").join(small(named, named.count()), "copy", "left")
    alone = F.col("win_copy").isNull()
    return rows.select(
        "doc_id",
        "copy",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.lower(F.hex(F.coalesce("class_key", "copy"))).alias("class_key"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (alone | ((F.col("win_copy") == F.col("copy")) & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("kept"),
    )


def near_duplicates(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, class_id, class_key, n_copies, kept of each row of df.

    class_id: the class's smallest doc_id, null if none of its rows has one; class_key tells
    classes apart also where one doc_id stands for unlike texts. n_copies: rows of equal words.
    kept: the row is its class's first by doc_id (null last) and words, or equal to it in both.
    """
    return _classes(df, key).drop("copy")


def keep(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df's rows and columns without all but one row of each class.

    The row that stays has the class's least doc_id (null last), then the least digest of its
    words; of rows equal in both it is the least as JSON text.
    """
    own, here = "__copy", F.col("__copy")
    rows = _classes(df, key).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__said"), "kept")
    lost = cut_lineage(rows.filter("not kept").select("__id", "__said").distinct())
    again = cut_lineage(rows.filter("kept").groupBy("__id", "__said").agg(F.count("*").alias("__n")).filter("__n > 1"))
    same = quoted(key).cast("long").eqNullSafe(F.col("__id")) & (here == F.col("__said"))
    left = with_copies(df, "text", own).join(small(lost, lost.count()), same, "left_anti")
    repeats = again.count()
    if not repeats:
        return left.drop(own)
    left = left.join(small(again, repeats), same, "left")
    whole = F.struct(*map(quoted, df.columns)).alias("whole")
    one = left.filter("__n is not null").groupBy("__id", "__said").agg(F.min_by(whole, F.to_json(whole)).alias("one"))
    return left.filter("__n is null").select(*map(quoted, df.columns)).unionByName(one.select("one.*"))
