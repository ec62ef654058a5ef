"""Removal of lines that many documents share, on DataFrame functions only.

A line's key is the line without blanks and controls at its ends, A-Z lowered; the
empty key is no key. Keys are known by two 64-bit hashes. The store of hashes is a
set of sorted runs in levels (`LineRuns`): a run is a table of (hash, documents),
bucketed and sorted by hash. A new batch is first merge-anti-joined with the hashes
that some run proves common already (their lines go anyway, so no more of them need
be stored), and what is left becomes a run of its own on level 0. When a level has
FANOUT runs they are compacted: merged into one run of the next level, documents
added up. A hash is common if the runs' documents together reach the limit; a settled
hash reaches it in one run, so leaving out its later documents changes no verdict.

Runs of one store have the same buckets, so merging and anti-joining shuffle nothing
but the batch. A batch is aggregated in its tasks before it is shuffled: a line of a
third of all documents is one row a task. Dropped places come back per document as a
sorted array of line numbers; the kept text is joined from the slices between them, in
time linear in the text. Common hashes are broadcast where their measured count allows;
else only those hot enough to be few by arithmetic are, and the rest are joined by sort
and merge with AQE's skew handling.

Null or empty texts have one empty line. Each row is a document, also where rows or ids
repeat; null ids are ids. Extra columns stay; those named like the results are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm.common import SMALL_ROWS, cut_lineage, quoted, scratch_folder, text_or_empty, without

#: Documents from which a line is common.
LIMIT = 10

#: Runs of a level that are compacted to one of the next.
FANOUT = 2

#: Batches in which deduplicated() hands a table to the store.
BATCHES = 4

_SPACE = " \t\n\x0b\x0c\r"
_HASH = ["h", "g"]
_ROW = ["__r", "__s"]


def line_key(line: Column) -> Column:
    """The line stripped and A-Z lowered; translate() is slow, and only lines with other characters need it."""
    bare = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def hashed_lines(text: Column) -> Column:
    """Array of each line's (h, g), null for empty keys."""
    keys = F.transform(F.split(text, "\n", -1), line_key)
    return F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))))


def line_counts(docs: DataFrame, text: str = "text", by: list[Column] | None = None) -> DataFrame:
    """(by, h, g, n): in how many rows of docs each line's key stands."""
    by = by or []
    own = F.explode(F.filter(F.array_distinct(hashed_lines(text_or_empty(text))), lambda k: k.isNotNull())).alias("k")
    names = [f"__b{i}" for i in range(len(by))]
    rows = docs.select(*[c.alias(n) for c, n in zip(by, names, strict=True)], own).select(*names, "k.h", "k.g")
    return rows.groupBy(*names, *_HASH).agg(F.count("*").alias("n"))


class LineRuns:
    """Levelled sorted runs of line hashes below a folder; `close` forgets the tables."""

    def __init__(self, spark: SparkSession, folder: str, limit: int = LIMIT, fanout: int = FANOUT):
        self.spark, self.folder, self.limit, self.fanout = spark, folder, limit, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._tables: list[str] = []

    def stored(self, counts: DataFrame) -> str:
        """counts (h, g, n) as a table bucketed and sorted by hash."""
        name = f"tapeframe_lines_{uuid.uuid4().hex}"
        dealt = counts.select(*_HASH, "n").repartition(self.buckets, *_HASH)
        dealt.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self._tables.append(name)
        return name

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's (h, g, n), but for the hashes that are settled."""
        for run in self._runs():
            settled = run.where(F.col("n") >= self.limit).select(*_HASH)
            counts = counts.join(settled.hint("merge"), _HASH, "left_anti")
        self.levels[0].append(self.stored(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compacted(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _compacted(self, names: list[str]) -> str:
        """One run of several, merged two at a time by their sort order."""

        def merged(a: str, b: str) -> str:
            left, right = (self.spark.table(name).select(*_HASH, F.col("n").alias(to)) for name, to in ((a, "x"), (b, "y")))
            both = left.join(right.hint("merge"), _HASH, "full")
            return self.stored(both.select(*_HASH, (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("n")))

        return reduce(merged, names)

    def common(self) -> DataFrame:
        """(h, g, n) of the hashes in `limit` documents or more, after compaction of all runs; n is a lower bound of their documents."""
        names = [name for level in self.levels for name in level]
        self.levels = [[], [self._compacted(names)]]
        return self.spark.table(self.levels[1][0]).where(F.col("n") >= self.limit)

    def close(self) -> None:
        for name in self._tables:
            self.spark.sql(f"drop table if exists {name}")


def common_lines(docs: DataFrame, text: str = "text", limit: int = LIMIT, batches: int = BATCHES) -> DataFrame:
    """(h, g, n) of the lines in at least `limit` rows, by a store of runs that gets docs in batches."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64(text_or_empty(text)), F.lit(batches))
    with scratch_folder(spark) as folder:
        arrived = f"{folder}/batches"
        line_counts(docs, text, [batch]).write.partitionBy("__b0").parquet(arrived)
        store = LineRuns(spark, folder, limit)
        try:
            every = spark.read.schema("h bigint, g bigint, n bigint, __b0 bigint").parquet(arrived)
            for k in range(batches):
                store.add(every.where(F.col("__b0") == k).drop("__b0"))
            return cut_lineage(store.common())
        finally:
            store.close()


def _row_key(names: list[str]) -> list[Column]:
    held = [quoted(c) for c in names]
    return [F.xxhash64(*held).alias(_ROW[0]), F.xxhash64(F.lit(1), *reversed(held)).alias(_ROW[1])]


def dropped_places(docs: DataFrame, common: DataFrame, row: list[str], text: str = "text") -> DataFrame:
    """(row key, dropped): sorted numbers, from 0, of the lines whose hash is common; rows without one are missing.

    row: the columns that tell rows apart; rows equal in all of them have the same lines and one array.
    """
    lines = docs.select(*_row_key(row), F.posexplode(hashed_lines(text_or_empty(text))).alias("at", "k")).where("k is not null")
    lines = lines.select(*_ROW, "at", "k.h", "k.g")
    rows = common.count()
    if rows <= SMALL_ROWS:
        found = lines.join(F.broadcast(common.select(*_HASH)), _HASH, "left_semi")
    else:
        # At most SMALL_ROWS hashes can have so many of all documents.
        bar = F.lit(common.agg(F.sum("n")).first()[0] / SMALL_ROWS)
        hot = F.broadcast(common.where(F.col("n") >= bar).select(*_HASH))
        found = lines.join(hot, _HASH, "left_semi").unionByName(
            lines.join(hot, _HASH, "left_anti").join(common.where(F.col("n") < bar).select(*_HASH), _HASH, "left_semi")
        )
    return found.groupBy(*_ROW).agg(F.array_sort(F.collect_set("at")).alias("dropped"))


_KEPT = """element_at(transform(array(named_struct('l', split(__text, '\\n', -1), 'd', dropped)), s ->
    array_join(flatten(transform(array_append(s.d, size(s.l)), (d, k) ->
        slice(s.l, if(k = 0, 0, element_at(s.d, k) + 1) + 1, d - if(k = 0, 0, element_at(s.d, k) + 1)))), '\\n')), 1)"""


def deduplicated(docs: DataFrame, text: str = "text", limit: int = LIMIT, batches: int = BATCHES) -> DataFrame:
    """docs with n_lines (before), n_dropped, and kept: the text without the lines found in `limit` rows or more."""
    docs = without(docs, ["n_lines", "n_dropped", "kept", "dropped", "__text", *_ROW])
    common = common_lines(docs, text, limit, batches)
    row = [c for c in ("doc_id", text) if c in docs.columns]
    places = dropped_places(docs, common, row, text)
    joined = docs.withColumns(dict(zip(_ROW, _row_key(row), strict=True))).join(places, _ROW, "left").withColumn("__text", text_or_empty(text))
    return (
        joined.withColumn("n_lines", F.size(F.split("__text", "\n", -1)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("dropped"), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
        .withColumn("kept", F.when(F.col("dropped").isNull(), F.col("__text")).otherwise(F.expr(_KEPT)))
        .drop("dropped", "__text", *_ROW)
    )


def report(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """A row per row of docs: key, n_lines, n_dropped and the digest of the kept text."""
    out = deduplicated(docs.select(quoted(key), "text"), limit=limit)
    return out.select(quoted(key), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), lines as (
  select rid, doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from (select rid, doc_id, string_split(text, chr(10)) as l from docs)
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), common as (
  select k from keyed where k <> '' group by k having count(distinct rid) >= 10
)
select doc_id, count(*)::bigint as n_lines, count(c.k)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where c.k is null), '')) as kept_sha256
from keyed left join common c using (k) group by rid, doc_id
"""
