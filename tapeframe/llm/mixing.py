"""Mixing sources to target weights by capped water-filling.

Sources are taken in code-point order (null last) and weigh 5, 2, 1, 5, 2, 1, ..
The total of all sizes is shared by weight; a source above its cap (MAX_EPOCHS
times its size) is clamped there, and what it cannot take is shared again by
weight among the others until none is above. A source with target T and size S
then repeats every document floor(T / S) times, and a seeded fraction once more:
documents in the order of a seeded hash are taken until the words left for the
source are used up, the last one in part (rows that repeat share that part evenly). The order's running sums are computed
in two levels, hash buckets of a source first and rows of the one bucket where the
words run out second, so that a hot source is no single task.

Tables of sources (names, sizes, targets) are aggregated per source and have one
row each. Null texts have size 0; documents of size 0 take 0 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.llm.common import cut_lineage, quoted, small, text_or_empty

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Hash buckets of a source: 16 ** BUCKET_DIGITS.
BUCKET_DIGITS = 3


def words_in(text: Column) -> Column:
    """The number of runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sizes(df: DataFrame, key: str, text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of df: the key, its source, size and seeded hash."""
    return df.select(
        quoted(key).alias("doc_id"),
        quoted(source).cast("string").alias("source"),
        words_in(text_or_empty(text)).alias("size"),
        _hash(key).alias("hash"),
    )


def _hash(key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), quoted(key).cast("string")))


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, weight, target (double), words (target rounded)."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    level = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight.cast("long"))
    level = level.select("source", "source_size", "weight", (F.col("source_size") * MAX_EPOCHS).alias("cap"), F.lit(False).alias("clamped"))
    level = cut_lineage(level)
    total = level.agg(F.sum("source_size")).first()[0] or 0
    while True:
        held, free = level.agg(F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)), F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight")))).first()
        share = F.lit(float(total - (held or 0))) * F.col("weight") / F.lit(float(free or 1))
        above = ~F.col("clamped") & (share > F.col("cap"))
        if level.filter(above).isEmpty():
            break
        # a source once clamped stays so, since the others' shares only grow
        level = cut_lineage(level.withColumn("clamped", F.col("clamped") | above))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share)
    return level.select("source", "source_size", "weight", target.alias("target")).withColumn("words", F.round("target").cast("long"))


def plan(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per source: s, source_size, target, whole repetitions, and the cut of the fraction.

    Documents before (cut_hash, cut_id) in the hash order are taken once more; the ones at
    the cut (several only if rows repeat) give cut_taken words each.
    sized: from sizes(), wanted: from targets(); both should be materialized.
    """
    wanted = wanted.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    wanted = wanted.select(F.col("source").alias("s"), "source_size", "target", "whole", (F.col("words") - F.col("whole") * F.col("source_size")).alias("rest"))
    rests = small(wanted, wanted.count())
    bucket = F.substring("hash", 1, BUCKET_DIGITS)
    running = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    by_bucket = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    edges = by_bucket.withColumn("before", F.coalesce(F.sum("n").over(running.partitionBy("source")), F.lit(0))).join(rests, F.col("source").eqNullSafe(F.col("s")))
    edges = cut_lineage(edges.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).select("s", F.col("bucket").alias("edge"), "before", "rest"))
    rows = sized.join(small(edges, edges.count()), F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("edge")))
    tied = rows.groupBy("s", "before", "rest", "hash", "doc_id").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    ordered = W.partitionBy("s").orderBy("hash", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    tied = tied.withColumn("room", F.col("rest") - F.col("before") - F.coalesce(F.sum("n").over(ordered), F.lit(0)))
    cuts = tied.filter((F.col("room") >= 0) & (F.col("room") < F.col("n"))).select("s", F.col("hash").alias("cut_hash"), F.col("doc_id").alias("cut_id"), F.floor(F.col("room") / F.col("rows")).alias("cut_taken"))
    return cut_lineage(wanted.join(cuts.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t", "rest"))


def with_taken(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """rows of sizes() and any other columns, with source_size, target, whole, extra and taken."""
    joined = rows.join(small(plans, plans.count()), F.col("source").eqNullSafe(F.col("s")))
    before = (F.col("hash") < F.col("cut_hash")) | ((F.col("hash") == F.col("cut_hash")) & (F.col("doc_id") < F.col("cut_id")))
    at = (F.col("hash") == F.col("cut_hash")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    extra = F.when(at, F.least("size", "cut_taken")).when(before, F.col("size")).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    return joined.drop("s", "cut_hash", "cut_id", "cut_taken")


def mixed_documents(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of df (needs text and source)."""
    sized = cut_lineage(sizes(df, key))
    return with_taken(sized, plan(sized, targets(sized))).select("doc_id", "size", "source_size", "target", "taken")


def materialized(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: df's rows and columns, each row as often as the mix repeats it.

    A document that the fraction takes in part is repeated if at least half of it is taken.
    """
    sized = cut_lineage(sizes(df, key))
    plans = plan(sized, targets(sized))
    held = F.struct(*[quoted(c) for c in df.columns]).alias("held")
    rows = with_taken(df.select(quoted(key).alias("doc_id"), quoted("source").cast("string").alias("source"), words_in(text_or_empty()).alias("size"), _hash(key).alias("hash"), held), plans)
    times = F.col("whole") + F.when((F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)
    return rows.select("held", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("held.*")


#: DuckDB SQL of mixed_documents over the view {documents}.
SQL = r"""
with recursive sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5('mix-1:' || doc_id) as hash from {documents}
), per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) - 1 as rank from sized group by source
), weighed as (
  select source, source_size, [5, 2, 1][rank % 3 + 1] as weight, 3 * source_size as cap from per
), level as (
  select source, source_size, weight, cap, sum(cap) over o as cap_below, (select sum(source_size) from weighed) as total, (select sum(weight) from weighed) as weights, sum(weight) over o as weight_below
  from weighed window o as (order by cap / weight, cap, source nulls last rows between unbounded preceding and current row)
), marked as (
  select *, (total - (cap_below - cap))::double * weight / (weights - (weight_below - weight))::double > cap as is_capped from level
), sums as (
  select coalesce(sum(cap) filter (where is_capped), 0) as cap_sum, coalesce(sum(weight) filter (where not is_capped), 0) as free_weight from marked
), wanted as (
  select source, source_size, case when is_capped then cap::double else (total - cap_sum)::double * weight / free_weight::double end as target from marked, sums
), words as (
  select *, round(target)::bigint as words from wanted
), rests as (
  select *, case when source_size > 0 then words // source_size else 0 end as whole, words - case when source_size > 0 then words // source_size else 0 end * source_size as rest from words
), placed as (
  select doc_id, s.source, size, source_size, target, whole, rest, coalesce(sum(size) over (partition by s.source order by hash, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join rests r on s.source is not distinct from r.source
)
select doc_id, size, source_size, target, (whole * size + least(size, greatest(rest - before, 0)))::bigint as taken from placed
"""
