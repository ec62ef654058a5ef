"""Phrase collocations by position bitmaps, counted over shards of text.

Texts of a language are strung together into shards of word positions, with an empty
position at each piece boundary. In a shard every word has a compressed bitmap of its
positions: the bytes of it that aren't zero, with their places. A phrase's bitmap marks
its last words; shifted by one and ANDed with the bitmaps of the words it marks the
phrases that are one word longer, and its popcount is their number. Phrases grow
depth-first, a group of first words at a time; a shard carries the next words of its
neighbour behind its own positions, so phrases that begin in it are counted whole.

Popcounts are summed over all shards, a length at a time. A phrase is extended only if
it is common, and counted only if it is common without its first word too. Which phrases
are common the tasks know from a sieve of fixed size (SIEVE_BITS), a Bloom filter of the
hashes whose summed popcounts reach LEAST: it may let a rare phrase through, which costs
time and no result. With its sum a phrase keeps one of the shards that hold it, and a last
walk lets that shard alone tell its words, so a phrase's text is moved once.

A null language is `und`; null texts have no words. Repeated rows count each for itself.
An empty table gives an empty result. Phrases are told apart by 64-bit hashes with the
language mixed in: a common phrase shares its sum with another with a chance of 5e-20 for
each phrase there is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tapeframe.llm.common import cut_lineage, hashed_runs, mixed, quoted, scratch_folder, settings, slices, spread, strings, text_or_empty

#: Occurrences of a candidate, words of the longest, and the rows of a language's report.
LEAST, LONGEST, TOP = 100, 5, 2000

#: Bits of the sieve of one phrase length: 8 MB, whatever the corpus.
SIEVE_BITS = 1 << 26

#: Own positions of a shard, bitmap bytes of the first words that grow together, and hashes a task merges before it hands them on.
SHARD, GROUP, MERGED = 1 << 20, 1 << 17, 1 << 21

_SOLID = np.ones(256, bool)
_SOLID[list(b" \t\n\x0b\x0c\r.,;:!?")] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(b"\n\x0b\x0c\r.,;:!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STEP = np.uint64(0x9FB21C651E98DF25)

SHARDS = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("words", T.LongType()),
        T.StructField("own", T.IntegerType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("vocabulary", T.ArrayType(T.StringType())),
    ]
)


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _key(hashes: np.ndarray, length: int, salt: np.uint64) -> np.ndarray:
    return mixed(hashes ^ salt ^ np.uint64(length << 56))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language of a batch: it, the bytes (A-Z lowered), and its words' starts, ends, hashes, and whether a piece begins."""
    data, offsets = strings(batch.column("text"))
    data = _LOWER[data]
    starts, ends, hashes = hashed_runs(data, offsets, _SOLID)
    text = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.searchsorted(np.flatnonzero(_BREAK[data]), starts)
    fresh = (np.diff(breaks, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)
    langs = batch.column("lang").dictionary_encode()
    code = langs.indices.to_numpy()[text] if len(text) else np.zeros(0, np.int64)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        at = np.flatnonzero(code == k) if len(langs.dictionary) > 1 else slice(None)
        yield lang, data, starts[at], ends[at], hashes[at], fresh[at]


class _Sums:
    """Sums of counts by hash with a shard that has it, handed on when there are MERGED of them and at the end."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, shard: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, counts, np.full(len(keys), shard)))
        self.size += len(keys)
        if self.size > MERGED:
            self._merge()
            if self.size > MERGED // 2:
                yield from self.rest()

    def _merge(self) -> None:
        keys, counts, shards = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
        self.held = [(keys, np.bincount(at, counts, len(keys)).astype(np.int64), shards[first])]
        self.size = len(keys)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            keys, counts, shards = self.held[0]
            for start in range(0, len(keys), 1 << 16):
                part = slice(start, start + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part]), pa.array(shards[part])], names=["key", "n", "shard"])
        self.held, self.size = [], 0


COUNTS = "key long, n long, shard long"


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n, 0): occurrences of every language's words, by hash, summed within the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in slices(batches, "text"):
            for lang, _, _, _, hashes, _ in _by_language(batch):
                found, n = np.unique(hashes, return_counts=True)
                yield from sums.add(_key(found, 1, _salt(lang)), n)
        yield from sums.rest()

    return docs.mapInArrow(run, COUNTS)


def summed(counts: DataFrame, least: int) -> DataFrame:
    """(key, n, shard) of the keys whose counts sum up to `least`."""
    return counts.groupBy("key").agg(F.sum("n").alias("n"), F.min("shard").alias("shard")).where(F.col("n") >= least)


class Sieve:
    """A Bloom filter of 64-bit hashes with two bits for each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            bit = (keys >> np.uint64(shift)) & np.uint64(SIEVE_BITS - 1)
            out &= ((self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def sieve(keys: DataFrame) -> Sieve:
    """The sieve of the column `key`; its bits are made by the tasks, SIEVE_BITS / 64 rows at most come back."""
    bits = F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(SIEVE_BITS - 1)) for s in (0, 32)])).alias("bit")
    rows = keys.select(bits).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(SIEVE_BITS // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Sieve(words)


# ---------------------------------------------------------------- shards


class _Stream:
    """A language's positions in one task: hashes of words the sieve lets through, 0 for gaps (one in a row)."""

    def __init__(self, lang: str, least_sieve: Sieve):
        self.lang, self.sieve, self.salt = lang, least_sieve, _salt(lang)
        self.held = np.zeros(0, np.uint64)
        self.known: dict[int, bytes] = {}
        self.words, self.shard = 0, TaskContext.get().partitionId() << 32

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.words += len(hashes)
        kept = np.where(self.sieve.has(_key(hashes, 1, self.salt)), hashes, np.uint64(0))
        new, first = np.unique(kept, return_index=True)
        for h, k in zip(new.tolist(), first.tolist(), strict=True):
            if h and h not in self.known:
                self.known[h] = data[starts[k] : ends[k]].tobytes()
        laid = np.zeros(len(kept) + int(fresh.sum()), np.uint64)
        laid[np.arange(len(kept)) + np.cumsum(fresh)] = kept
        laid = np.concatenate([self.held, laid])
        solid = laid != 0
        self.held = laid[solid | np.concatenate([[True], solid[:-1]])]
        while len(self.held) >= SHARD + LONGEST - 1:
            yield self._row(self.held[: SHARD + LONGEST - 1], SHARD)
            self.held = self.held[SHARD:]

    def _row(self, hashes: np.ndarray, own: int) -> pa.RecordBatch:
        found, codes = np.unique(hashes, return_inverse=True)
        if len(found) and found[0]:  # code 0 is the gap
            found, codes = np.concatenate([[np.uint64(0)], found]), codes + 1
        names = pa.array([self.known[h].decode() for h in found.tolist() if h], pa.string())
        cells = [pa.array([self.shard], pa.int64()), pa.array([self.lang]), pa.array([self.words], pa.int64()), pa.array([own], pa.int32())]
        cells += [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (pa.array(codes.astype(np.int32)), names)]
        self.words, self.shard = 0, self.shard + 1
        return pa.RecordBatch.from_arrays(cells, names=SHARDS.names)

    def rest(self) -> pa.RecordBatch:
        return self._row(self.held, len(self.held))


def shards(docs: DataFrame, least_sieve: Sieve) -> DataFrame:
    """A row for each shard: language, words read (also those left out), own positions, code of the word at each position (0: none), words by code."""
    shared = docs.sparkSession.sparkContext.broadcast(least_sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[str, _Stream] = {}
        for batch in slices(batches, "text"):
            for lang, *words in _by_language(batch):
                yield from streams.setdefault(lang, _Stream(lang, shared.value)).add(*words)
        for stream in streams.values():
            yield stream.rest()

    return docs.mapInArrow(run, SHARDS)


# ---------------------------------------------------------------- bitmaps


class Bitmaps:
    """Compressed position bitmaps of a shard's words: (place of the byte, word, byte), by place."""

    def __init__(self, codes: np.ndarray):
        at = np.flatnonzero(codes)
        self.size = int(codes.max(initial=0)) + 1
        key = (at >> 3) * self.size + codes[at]
        order = np.argsort(key, kind="stable")
        key, bits = key[order], (np.uint8(1) << (at[order] & 7).astype(np.uint8))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.byte = np.bitwise_or.reduceat(bits, first) if len(first) else np.zeros(0, np.uint8)
        self.place, self.word = key[first] // self.size, key[first] % self.size
        self.start = np.searchsorted(self.place, np.arange((len(codes) >> 3) + 3))

    def words(self, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """word, place, byte of the positions before `own`, by word."""
        inside = np.clip(own - self.place * 8, 0, 8)
        byte = self.byte & ((1 << inside) - 1).astype(np.uint8)
        at = np.flatnonzero(byte)
        at = at[np.argsort(self.word[at], kind="stable")]
        return self.word[at], self.place[at], byte[at]

    def extended(self, phrase: np.ndarray, place: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """phrase, word, place, byte: bitmaps of the phrases one word longer, those without a bit left out."""
        moved, carried = byte << np.uint8(1), byte >> np.uint8(7)
        m, c = np.flatnonzero(moved), np.flatnonzero(carried)
        phrase, place = np.concatenate([phrase[m], phrase[c]]), np.concatenate([place[m], place[c] + 1])
        byte = np.concatenate([moved[m], carried[c]])
        many = self.start[place + 1] - self.start[place]
        with_word = np.repeat(self.start[place], many) + spread(many)
        both = np.repeat(byte, many) & self.byte[with_word]
        hit = np.flatnonzero(both)
        by = np.repeat(np.arange(len(place)), many)[hit]
        return phrase[by], self.word[with_word[hit]], place[by], both[hit]


#: What to do with phrases of one length: (length, hashes, hashes without the first word, popcounts, words) -> which grow on.
Visit = Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def grow(codes: np.ndarray, own: int, hashes: np.ndarray, longest: int, visit: Visit) -> None:
    """Visits the shard's phrases, depth-first by groups of first words. hashes: of the words, by code."""
    maps = Bitmaps(codes)
    words, places, bytes_ = maps.words(own)
    first = np.flatnonzero(np.diff(words, prepend=-1))
    cuts = [*first[np.flatnonzero(np.diff(first // GROUP, prepend=-1))], len(words)]
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        phrase, place, byte = words[start:stop], places[start:stop], bytes_[start:stop]
        chain = np.zeros((1, 0), np.int64)  # words of each phrase
        whole, tail = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        parent = np.zeros(len(phrase), np.int64)
        for length in range(1, longest + 1):
            if length > 1:
                parent, phrase, place, byte = maps.extended(parent, place, byte)
            found, at = np.unique(parent * maps.size + phrase, return_inverse=True)
            counts = np.bincount(at, np.bitwise_count(byte), len(found)).astype(np.int64)
            mother, word = found // maps.size, found % maps.size
            chain = np.concatenate([chain[mother], word[:, None]], axis=1)
            tail = tail[mother] * _STEP + hashes[word] if length > 1 else np.zeros(len(word), np.uint64)
            whole = whole[mother] * _STEP + hashes[word]
            going = visit(length, whole, tail, counts, chain)
            if length == longest or not going.any():
                break
            number = np.cumsum(going) - 1
            inside = going[at]
            parent, place, byte = number[at[inside]], place[inside], byte[inside]
            chain, whole, tail = chain[going], whole[going], tail[going]


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray, int, np.ndarray, list[str]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            names = batch.column("vocabulary")[k].values
            _, _, hashes = hashed_runs(*strings(names), _SOLID)
            codes = batch.column("codes")[k].values.to_numpy(zero_copy_only=False)
            shard, lang, own = (batch.column(c)[k].as_py() for c in ("shard", "lang", "own"))
            yield shard, lang, codes, own, np.concatenate([[np.uint64(0)], hashes]), ["", *names.to_pylist()]


def phrase_counts(shard_rows: DataFrame, lengths: tuple[int, ...], sieves: list[Sieve]) -> DataFrame:
    """(key, n, shard): popcounts of the phrases of so many words whose shorter phrases pass the sieves (of 1, 2, .. words).

    Of words and of pairs all are counted: shards have common words only.
    """
    shared = shard_rows.sparkSession.sparkContext.broadcast(sieves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = shared.value, _Sums()
        for shard, lang, codes, own, hashes, _ in _shard_rows(batches):
            salt, ready = _salt(lang), []

            def visit(k, whole, tail, counts, chain, shard=shard, salt=salt, ready=ready):
                if k not in lengths:
                    return known[k - 1].has(_key(whole, k, salt))
                good = known[k - 2].has(_key(tail, k - 1, salt)) if k > 2 else np.ones(len(whole), bool)
                ready.extend(sums.add(_key(whole[good], k, salt), counts[good], shard))
                return good

            grow(codes, own, hashes, lengths[-1], visit)
            yield from ready
        yield from sums.rest()

    return shard_rows.mapInArrow(run, COUNTS)


def _placed(keys: np.ndarray, shard: int) -> np.ndarray:
    """One value for a key and a shard: the shard's task and number are spread over the bits that a sieve reads."""
    return keys ^ np.uint64((shard ^ shard >> 32 ^ shard << 40) & 0xFFFFFFFFFFFFFFFF)


def phrases(shard_rows: DataFrame, common: DataFrame, sieves: list[Sieve]) -> DataFrame:
    """(lang, phrase, k, a) of the phrases whose (key, n, shard) are in common: each shard tells the words of its own."""
    longest = len(sieves)
    # the pairs of key and shard go through a sieve of their own, whose chance hits the join on the key drops
    place = F.col("shard").bitwiseXOR(F.shiftrightunsigned("shard", 32)).bitwiseXOR(F.shiftleft("shard", 40))
    pairs = sieve(common.select(F.col("key").bitwiseXOR(place).alias("key")))
    shared = shard_rows.sparkSession.sparkContext.broadcast((sieves, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own_pairs = shared.value
        for shard, lang, codes, own, hashes, names in _shard_rows(batches):
            salt, keys, said, lengths = _salt(lang), [], [], []

            def visit(k, whole, tail, counts, chain, shard=shard, salt=salt, keys=keys, said=said, lengths=lengths, names=names):
                key = _key(whole, k, salt)
                going = known[k - 1].has(key)
                mine = going & own_pairs.has(_placed(key, shard))
                keys.append(key[mine])
                said.extend([" ".join([names[w] for w in row]) for row in chain[mine].tolist()])
                lengths.append(np.full(int(mine.sum()), k))
                return going

            grow(codes, own, hashes, longest, visit)
            if said:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(said)), pa.array(said), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(keys).view(np.int64))], names=["lang", "phrase", "k", "key"])

    told = shard_rows.mapInArrow(run, "lang string, phrase string, k long, key long").distinct()
    return told.join(common.select("key", F.col("n").alias("a")), "key").select("lang", "phrase", "k", "a")


# ---------------------------------------------------------------- scores


def scored(common: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the phrases of two words or more, by their weakest cut.

    Products are of decimals with 38 digits; the quotient is at most 10 n.
    """
    cuts = common.where("k > 1").select("*", F.split("phrase", " ").alias("w")).select("lang", "phrase", "k", "a", F.explode(F.expr("transform(sequence(1, cast(k as int) - 1), j -> named_struct('cut', j, 'head', array_join(slice(w, 1, j), ' '), 'rest', array_join(slice(w, j + 1, cast(k as int)), ' ')))")).alias("c"))
    part = lambda name, to: common.select("lang", F.col("phrase").alias(name), F.col("a").alias(to))
    cuts = cuts.select("lang", "phrase", "k", "a", "c.cut", "c.head", "c.rest").join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(5,0)) * cast(a as decimal(19,0)) * cast(n as decimal(14,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    least = F.min(F.struct("score", "cut", "l", "r", "n")).alias("x")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(least).select("lang", "phrase", "k", "a", "x.l", "x.r", "x.n", "x.score")


def contained(common: DataFrame) -> DataFrame:
    """(lang, phrase, most): for each phrase within longer ones the largest count of those."""
    inner = F.expr("transform(flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> named_struct('i', i, 'm', m)))), x -> array_join(slice(w, x.i, x.m), ' '))")
    longer = common.where("k > 2").select("lang", "a", F.col("k").cast("int").alias("k"), F.split("phrase", " ").alias("w"))
    return longer.select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def report(common: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first phrases, in two steps, so that no task ranks all of a language's."""
    found = scored(common, sizes).join(contained(common), ["lang", "phrase"], "left").where("most is null or 100 * most < 100 * a").drop("most", "k")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = parts.withColumn("__at", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*best))).where(F.col("__at") <= top).drop("__at", "__part")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's strongest collocations."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    with scratch_folder(spark) as folder, settings(spark, spark__sql__parquet__enableNestedColumnVectorizedReader=False):
        # that reader would hold thousands of rows at once, and a row is a shard
        rows = cut_lineage(shards(docs, sieve(summed(word_counts(docs), least))), folder=folder)
        sieves, counted = [], []
        for lengths in ((1, 2), *((k,) for k in range(3, longest + 1))):
            counted.append(cut_lineage(summed(phrase_counts(rows, lengths, sieves), least), folder=folder))
            sieves += [sieve(counted[-1])] * len(lengths)
        common = cut_lineage(phrases(rows, reduce(DataFrame.unionByName, counted), sieves), folder=folder)
        sizes = cut_lineage(rows.groupBy("lang").agg(F.sum("words").alias("n")), folder=folder)
        return cut_lineage(report(common, sizes, top))


SQL = r"""
with texts as (
  select row_number() over () as rid, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select rid, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from texts
), worded as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), sizes as (
  select lang, sum(len(w))::hugeint as n from worded group by lang
), grams as (
  select lang, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase, k from worded, (select unnest(range(1, 6)) as k) where len(w) >= k
), common as (
  select lang, phrase, k, count(*)::hugeint as a from grams group by all having count(*) >= 100
), cuts as (
  select *, unnest(range(1, k)) as j, string_split(phrase, ' ') as w from common where k > 1
), halves as (
  select c.lang, c.phrase, c.k, c.a, j, x.a as l, y.a as r, n, (1000 * c.a * n) // (x.a * y.a) as score
  from cuts c join common x on x.lang = c.lang and x.phrase = array_to_string(w[1 : j], ' ')
    join common y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1 :], ' ') join sizes s on s.lang = c.lang
), weakest as (
  select * from halves qualify row_number() over (partition by lang, phrase order by score, j) = 1
), inner_parts as (
  select lang, a, k, w, m, unnest(range(1, k - m + 2)) as i from (select lang, a, k, string_split(phrase, ' ') as w, unnest(range(2, k)) as m from common where k > 2)
), within as (
  select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as most from inner_parts group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from weakest left join within using (lang, phrase) where most is null or 100 * most < 100 * a
qualify rank <= 2000
"""
