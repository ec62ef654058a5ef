"""Ranked lexical search over inverted treaps.

Documents are indexed in shards of bounded size. In a shard each term has a treap of
its postings: a search tree by document (shard documents stand in the order of their
ids) and a heap by impact, the part of a posting's score that the query doesn't
change. Ties of impact fall by a hash of the document, so copies don't make chains.

A query walks the treaps of its terms together. A state is an interval of documents
with, for each term, the top of its treap within the interval: the largest impact
there. Where the weighted tops together can't enter the best k found so far the whole
interval goes. Else the document of the heaviest top is scored, and the interval is
split there. The states of many queries of a shard advance together, in numpy; a
shard gives each query its best k, and a window over shards times k rows ranks them.

The walk gets lower bounds of the k-th score from a first walk of a few shards, so the
others prune from the start. Terms are maximal runs of letters, digits and non-ASCII
characters, A-Z lowered. Null texts have no terms and are not counted in N. Each row
is a document, also where ids repeat; equal scores go by id, null ids last. Long texts
are read in pieces that end between terms. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tapeframe.llm.common import SLICE_BYTES, cut_lineage, quoted, scratch_folder, settings, slices, strings

#: Postings after which a shard ends; a document is never split.
SHARD_POSTINGS = 1 << 18

#: Query bytes that are searched together; more are searched in blocks.
BLOCK_BYTES = 4 << 20

#: Postings of the queries that walk together in a shard.
WALK_POSTINGS = 1 << 19

#: One shard of so many is walked first, for lower bounds.
SEED_EVERY = 16

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

INDEX = T.StructType(
    [
        T.StructField("seed", T.BooleanType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("docs", T.ArrayType(T.IntegerType())),
        T.StructField("impacts", T.ArrayType(T.IntegerType())),
        T.StructField("left", T.ArrayType(T.IntegerType())),
        T.StructField("right", T.ArrayType(T.IntegerType())),
        T.StructField("tops", T.ArrayType(T.IntegerType())),
    ]
)
FOUND = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def pieces(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """The bytes in pieces of about `size` that end between terms."""
    start = 0
    while len(data) - start > size:
        found = _GAP.search(data, start + size)
        if found is None:
            break
        yield data[start : found.start()]
        start = found.start()
    yield data[start:] if start else data


def terms_of(data: bytes) -> Counter:
    """Occurrences of each term of a text."""
    out: Counter = Counter()
    for piece in pieces(data):
        out.update(TERM.findall(piece.lower()))
    return out


def n_terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of terms of each text, from first bytes of terms."""
    total = np.zeros(len(offsets) - 1, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = False
    for start in range(0, len(data), SLICE_BYTES):
        inside = _IN_TERM[data[start : start + SLICE_BYTES]]
        fresh = inside & ~np.concatenate([[before], inside[:-1]]) | inside & cut[start : start + len(inside)]
        before = bool(inside[-1])
        total += np.diff(np.searchsorted(np.flatnonzero(fresh) + start, offsets))
    return total


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N, the rows with a term, and L, all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in slices(batches, text):
            found = n_terms(*strings(batch.column(text)))
            n, total = n + int((found > 0).sum()), total + int(found.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "l": [total]})

    row = docs.select(quoted(text)).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return int(row[0] or 0), int(row[1] or 0)


def treaps(docs: np.ndarray, impacts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right (postings, -1: none) and the top of each term; docs ascend within a term."""
    spread_docs = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    heap = ((impacts.astype(np.int64) << 20) | spread_docs.astype(np.int64)).tolist()
    left, right, tops = [-1] * len(heap), [-1] * len(heap), []
    start = 0
    for end in ends.tolist():
        if end - start == 1:
            tops.append(start)
            start = end
            continue
        spine: list[int] = []  # postings on the right edge, impacts falling
        for at in range(start, end):
            mine, last = heap[at], -1
            while spine and heap[spine[-1]] < mine:
                last = spine.pop()
            left[at] = last
            if spine:
                right[spine[-1]] = at
            spine.append(at)
        tops.append(spine[0])
        start = end
    return np.array(left, np.int32), np.array(right, np.int32), np.array(tops, np.int32)


class _Shard:
    """Documents gathered for one row of the index."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.known: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, found: Counter) -> None:
        known = self.known
        self.ids.append(doc_id)
        self.terms.append(np.fromiter([known.setdefault(t, len(known)) for t in found], np.int64, len(found)))
        tf = np.fromiter(found.values(), np.int64, len(found))
        self.tfs.append(tf)
        self.sizes.append(int(tf.sum()))
        self.postings += len(found)

    def row(self, seed: bool, n_docs: int, n_all: int) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        many = np.array([len(t) for t in self.terms], np.int64)
        doc = np.repeat(place, many)
        n = np.repeat(np.array(self.sizes, np.int64), many)
        term, tf = np.concatenate(self.terms), np.concatenate(self.tfs)
        m = 25 + 75 * n * n_docs // n_all
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        by = np.lexsort((doc, term))
        doc, impact = doc[by].astype(np.int32), impact[by].astype(np.int32)
        ends = np.cumsum(np.bincount(term, minlength=len(self.known))).astype(np.int32)
        left, right, tops = treaps(doc, impact, ends)
        lists = [pa.array([self.ids[k] for k in order], pa.int64()), pa.array([t.decode() for t in self.known], pa.string())]
        lists += [pa.array(a) for a in (ends, doc, impact, left, right, tops)]
        cells = [pa.array([seed]), *[pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in lists]]
        return pa.RecordBatch.from_arrays(cells, names=INDEX.names)


def index(docs: DataFrame, size: tuple[int, int], key: str = "doc_id", text: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The treaps of docs, one row a shard, made where the documents are: nothing is shuffled.

    size: corpus_size() of the documents that are to be ranked. seed: whether the shard is
    one of those walked first, about one of SEED_EVERY and the first one at least.
    """
    n_docs, n_all = size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = _Shard(), TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary())
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                found = terms_of(data.as_py() or b"")
                if found:
                    held.add(doc_id, found)
                if held.postings >= shard_postings:
                    yield held.row(made % SEED_EVERY == 0, n_docs, n_all)
                    held, made = _Shard(), made + 1
        if held.ids:
            yield held.row(made % SEED_EVERY == 0, n_docs, n_all)

    return docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(run, INDEX)


def written(treap_index: DataFrame, path: str) -> DataFrame:
    """The index as a table whose seeds lie apart, so that walking them reads nothing else."""
    spark = treap_index.sparkSession
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters=2):  # else the large rows are sorted
        treap_index.write.partitionBy("seed").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def document_counts(treap_index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents of the index each term stands; as many rows come back as there are terms."""
    shared = treap_index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(shared.value, pa.string()), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                ends = batch.column("ends")[k].values.to_numpy()
                at = pc.index_in(wanted, value_set=batch.column("terms")[k].values)
                here = at.fill_null(-1).to_numpy()
                total += np.where(here < 0, 0, np.diff(ends, prepend=0)[here])
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["term", "n"])

    found = treap_index.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {terms[r.term]: int(r.n) for r in found.collect()}


# ---------------------------------------------------------------- the walk


class _Best:
    """The best k (score, document) of each query of a walk."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.item, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.last = least.copy(), np.full(n, np.iinfo(np.int64).max)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = (score > 0) & ((score > self.least[item]) | (score == self.least[item]) & (doc < self.last[item]))
        item, score, doc = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc)))
        by = np.lexsort((doc, -score, item))
        item, score, doc = item[by], score[by], doc[by]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = np.flatnonzero(rank == self.k - 1)
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]


def _within(at: np.ndarray, low: np.ndarray, high: np.ndarray, docs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The tops of the treaps below `at` of the documents between low and high, both excluded; -1: none."""
    at = at.copy()
    moving = np.flatnonzero(at >= 0)
    while len(moving):
        here = at[moving]
        d = docs[here]
        over, under = d >= high[moving], d <= low[moving]
        at[moving] = np.where(over, left[here], np.where(under, right[here], here))
        moving = moving[(over | under) & (at[moving] >= 0)]
    return at


def walk(entry_item: np.ndarray, entry_top: np.ndarray, entry_weight: np.ndarray, least: np.ndarray, k: int, n_docs: int, docs: np.ndarray, impacts: np.ndarray, left: np.ndarray, right: np.ndarray) -> _Best:
    """The best k documents of each query, at least as good as `least` (0: any).

    entry_*: a row for each query's term in the shard, sorted by query. Each step handles all
    states that are left: those whose bound can't enter the best k go, the others are split.
    """
    best = _Best(len(least), k, least)
    item, first = np.unique(entry_item, return_index=True)
    low, high = np.full(len(item), -1), np.full(len(item), n_docs)
    node, weight = entry_top.astype(np.int64), entry_weight
    many = np.diff(np.append(first, len(node)))
    while len(item):
        start = np.cumsum(many) - many
        value = weight * impacts[node]
        bound = np.add.reduceat(value, start)
        # the leftmost document of an interval is low + 1: a tie is won only from there
        going = (bound > best.least[item]) | (bound == best.least[item]) & (low + 1 < best.last[item])
        if not going.all():
            inside = np.repeat(going, many)
            node, weight, value = node[inside], weight[inside], value[inside]
            item, low, high, many = item[going], low[going], high[going], many[going]
            if not len(item):
                break
            start = np.cumsum(many) - many
        state = np.repeat(np.arange(len(item)), many)
        top = np.maximum.reduceat(value, start)
        is_top = np.flatnonzero(value == top[state])
        heaviest = is_top[np.searchsorted(state[is_top], np.arange(len(item)))]
        pivot = docs[node[heaviest]].astype(np.int64)
        here, lows, highs = pivot[state], low[state], high[state]
        hit = _within(node, here - 1, here + 1, docs, left, right)
        score = np.bincount(state, np.where(hit >= 0, weight * impacts[hit], 0), len(item)).astype(np.int64)
        best.offer(item, score, pivot)
        sides = []
        for near, far in ((lows, here), (here, highs)):
            down = _within(node, near, far, docs, left, right)
            sides.append((np.flatnonzero(down >= 0), down))
        kept = [np.unique(state[at], return_counts=True) for at, _ in sides]
        node = np.concatenate([down[at] for at, down in sides])
        weight = np.concatenate([weight[at] for at, _ in sides])
        many = np.concatenate([counts for _, counts in kept])
        (l, _), (r, _) = kept
        item, low, high = np.concatenate([item[l], item[r]]), np.concatenate([low[l], pivot[r]]), np.concatenate([pivot[l], high[r]])
    return best


class _Queries:
    """Query texts as rows (query, term, weight), sorted by query; a term's repeats raise its weight."""

    def __init__(self, texts: list[str | None], counts: dict[str, int], n_docs: int):
        found = [terms_of((t or "").encode()) for t in texts]
        self.terms = sorted({t.decode() for c in found for t in c})
        place = {t.encode(): k for k, t in enumerate(self.terms)}
        rows = [(k, place[t], n * weight(counts.get(t.decode(), 0), n_docs)) for k, c in enumerate(found) for t, n in c.items()]
        rows = [r for r in rows if r[2] > 0]
        self.item, self.term, self.weight = (np.array([r[j] for r in rows], np.int64) for j in range(3))
        self.n = len(texts)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) if df else 0


def _walks(queries: _Queries, least: np.ndarray, k: int, cells: dict[str, np.ndarray], terms: pa.Array) -> Iterator[_Best]:
    """The best of a shard, a group of queries at a time, so that a group has few postings beyond WALK_POSTINGS."""
    here = pc.index_in(pa.array(queries.terms, pa.string()), value_set=terms).fill_null(-1).to_numpy()[queries.term]
    item, at, heavy = queries.item[here >= 0], here[here >= 0], queries.weight[here >= 0]
    if not len(item):
        return
    before = np.cumsum(np.diff(cells["ends"], prepend=0)[at]) - np.diff(cells["ends"], prepend=0)[at]
    first = np.flatnonzero(np.diff(item, prepend=-1))
    group = before[first] // WALK_POSTINGS
    cuts = [*first[np.flatnonzero(np.diff(group, prepend=-1))], len(item)]
    for start, stop in pairwise(cuts):
        part = slice(start, stop)
        yield walk(item[part], cells["tops"][at[part]], heavy[part], least, k, len(cells["doc_ids"]), cells["docs"], cells["impacts"], cells["left"], cells["right"])


def _search(treap_index: DataFrame, queries: _Queries, least: np.ndarray, k: int) -> DataFrame:
    """item (the query's place), doc_id, score: of each task the best k of each query and what ties with the last.

    A task's later shards are pruned by what it has found in the earlier ones.
    """
    shared = treap_index.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = shared.value
        floor, held = floor.copy(), pa.Table.from_batches([], pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))
        for batch in batches:
            for row in range(batch.num_rows):
                lists = {n: batch.column(n)[row].values for n in INDEX.names if n != "seed"}
                ids, terms = lists["doc_ids"], lists.pop("terms")
                cells = {n: a.to_numpy(zero_copy_only=False) for n, a in lists.items()}
                new = [pa.table({"item": b.item, "doc_id": ids.take(pa.array(b.doc)), "score": b.score}) for b in _walks(asked, floor, k, cells, terms)]
                held = pa.concat_tables([held, *new])
                item, score = held.column("item").to_numpy(), held.column("score").to_numpy()
                by = np.lexsort((-score, item))
                last = by[np.arange(len(by)) - np.searchsorted(item[by], item[by]) == k - 1]
                floor[item[last]] = np.maximum(floor[item[last]], score[last])
                held = held.filter(pa.array(score >= floor[item]))
        yield from held.combine_chunks().to_batches()

    return treap_index.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(items: Iterable[Row], most: int = BLOCK_BYTES) -> Iterator[list[Row]]:
    """The rows (item_id, text) in lists of at most so many bytes of text, one row at least."""
    block, held = [], 0
    for row in items:
        size = len((row.text or "").encode())
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += size
    if block:
        yield block


def search(treap_index: DataFrame, n_docs: int, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best k documents of the index, scores above 0 only.

    items (item_id, text) come to the driver in blocks of bounded size; what goes to the tasks is
    a block's terms, weights and bounds.
    """
    spark, out = treap_index.sparkSession, []
    for block in blocks(items.select("item_id", "text").toLocalIterator()):
        texts = [r.text for r in block]
        wanted = sorted({t.decode() for x in texts for t in terms_of((x or "").encode())})
        queries = _Queries(texts, document_counts(treap_index, wanted), n_docs)
        bounds = _ranked(_search(treap_index.where("seed"), queries, np.zeros(queries.n, np.int64), k), k).where(F.col("rank") == k)
        least = np.zeros(queries.n, np.int64)
        for row in bounds.collect():
            least[row.item] = row.score
        best = _ranked(_search(treap_index, queries, least, k), k)
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"]]))
        out.append(cut_lineage(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
    if not out:
        kind = items.schema["item_id"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Indexes docs (doc_id, text), writes the index to the shared folder, and ranks it for items (item_id, text)."""
    size, spark = corpus_size(docs), docs.sparkSession
    with scratch_folder(spark) as folder, settings(spark, spark__sql__parquet__enableNestedColumnVectorizedReader=False):
        # that reader would hold thousands of rows at once, and a row is a shard
        return search(written(index(docs, size), f"{folder}/index"), size[0], items, k)


SQL = r"""
with words as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), docs as (
  select *, len(ws)::bigint as n from words where len(ws) > 0
), corpus as (
  select count(*)::bigint as big_n, sum(n)::bigint as big_l from docs
), postings as (
  select rid, any_value(doc_id) as doc_id, any_value(n) as n, t, count(*)::bigint as tf from (select rid, doc_id, n, unnest(ws) as t from docs) group by rid, t
), asked as (
  select qid, item_id, t, count(*)::bigint as times from (
    select row_number() over () as qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)
  group by all
), weighed as (
  select t, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::bigint as w from postings, corpus where t in (select t from asked) group by t
), scored as (
  select qid, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::bigint as score
  from asked join weighed using (t) join postings using (t), corpus group by all
), ranked as (
  select *, row_number() over (partition by qid order by score desc, doc_id nulls last) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
