"""Language identification by Bayesian fusion of evidence.

For every page the posterior of each language is proportional to the product of
  - the likelihood of its visible text under byte-trigram models,
  - the likelihood of the language its markup declares,
  - the likelihood of the language its address names (country suffix, else a path part),
  - the prior of its host, smoothed towards its domain, its suffix and all pages.
The trigram models are learned from a bounded sample of labelled documents (SAMPLE of
each language). How reliable declarations and addresses are, and the priors at each
level, come from grouped sums of the pages' text posteriors; a page's own share is
taken out of its host's prior. Sums are aggregated before they are shuffled, so a host
with a third of all pages is one row like any other.

A null text or address, and a declaration of no known language, is no evidence. With
no evidence at all a page gets its host's most likely language. Repeated pages are
identified alike, and each counts in its host's prior. Without labelled documents the
result has no rows, as there are no languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.common import appended, cut_lineage, fields, quoted, slices, strings, text_or_empty

#: Documents of a language that its model is learned from, about; table size for each language.
SAMPLE, BITS = 1000, 15
#: Hosts of at least this share of the pages get their prior by broadcast: there are at most 10,000.
HOT_SHARE = 1e-4
#: Trigrams beyond which more text is no more evidence, and what one counts (they overlap).
ENOUGH, WORTH = 400, 1 / 3
#: Weight of the level above in each level's prior, in pages.
SMOOTHING = 5.0

# Languages of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv", "tr": "tr"}

_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table index of the trigram at each byte (as if blanks followed) and whether it has a letter."""
    c = np.concatenate([_CLASS[data], np.full(2, 0x20, np.uint8)]).astype(np.uint32)
    n = len(data)
    code = c[:n] << np.uint32(16) | c[1 : n + 1] << np.uint32(8) | c[2 : n + 2]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), code != 0x202020


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities [language, trigram] from rows (text, lang)."""
    known = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit("language"), "text").alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    names = sorted(r.lang for r in sizes)
    if not names:
        return [], np.zeros((0, 1 << BITS), np.float32)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, sample / r.n))])
    chosen = known.filter(F.abs("h") / F.lit(float(2**63)) < share[F.col("lang")]).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(names), 1 << BITS), np.int64)
        for batch in slices(batches, "text"):
            index, solid = trigrams(strings(batch.column("text"))[0])
            _, offsets = strings(batch.column("text"))
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                a, b = offsets[k], max(offsets[k], offsets[k + 1] - 2)
                totals[names.index(lang)] += np.bincount(index[a:b][solid[a:b]], minlength=1 << BITS)
        lang, gram = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(totals[lang, gram])], names=["l", "g", "n"])

    counts = np.full((len(names), 1 << BITS), 0.1)
    for r in chosen.mapInArrow(counted, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toLocalIterator():  # at most 2 ** BITS rows a language
        counts[r.l, r.g] += r.n
    return names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def visible(html: Column) -> Column:
    """Text of a page: without comments, scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]{1,10};", " ")


def declared(html: Column) -> Column:
    """Primary language subtag that the markup declares: <html lang>, else content-language."""
    tag = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1)
    return F.lower(F.coalesce(F.nullif(tag, F.lit("")), F.nullif(meta, F.lit(""))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def evidence(pages: DataFrame, names: list[str], table: np.ndarray, key: str = "page_id") -> DataFrame:
    """key, host, domain, suffix, said (declared), named (by the address), text_log: a value per language."""
    shared = pages.sparkSession.sparkContext.broadcast(table)
    h = host(quoted("url"))
    labels = F.split(h, r"\.")
    path = F.lower(F.regexp_extract(F.coalesce(quoted("url"), F.lit("")), rf"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*/(?:[^?#]*/)?({'|'.join(re.escape(n) for n in names)})(?:[/?#]|$)", 1))
    country = F.create_map(*[F.lit(x) for p in SUFFIXES.items() for x in p])[F.element_at(labels, -1)]
    rows = pages.select(
        quoted(key),
        h.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"),
        F.when(declared(quoted("html")).isin(names), declared(quoted("html"))).alias("said"),
        F.coalesce(F.when(country.isin(names), country), F.nullif(path, F.lit(""))).alias("named"),
        visible(text_or_empty("html")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches, "text"):
            data, offsets = strings(batch.column("text"))
            index, solid = trigrams(data)
            ends = np.maximum(offsets[1:] - 2, offsets[:-1])
            total = lambda x: (s := np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)]))[ends] - s[offsets[:-1]]  # noqa: B023, E731
            n = total(solid)
            weight = WORTH * np.minimum(n, ENOUGH) / np.maximum(n, 1)
            logs = np.stack([total(np.where(solid, row[index], 0)) * weight for row in table], 1)
            logs -= logs.max(1, keepdims=True)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(np.round(logs, 6).reshape(-1)), table.shape[0]).cast(pa.list_(pa.float64()))
            yield appended(batch, text_log=flat)

    return rows.mapInArrow(run, fields(rows.schema, T.StructField("text_log", T.ArrayType(T.DoubleType()), False))).drop("text")


def _normal(logs: Column) -> Column:
    """Probabilities of unnormalised logs."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(column: str, size: int) -> list[Column]:
    return [F.sum(F.col(column)[k]).alias(f"s{k}") for k in range(size)]


def reliability(found: DataFrame, column: str, names: list[str]) -> dict[str, list[float]]:
    """log P(value | language) for each value of the evidence column, smoothed towards agreement."""
    size = len(names)
    sums = {r[column]: [r[f"s{k}"] for k in range(size)] for r in found.filter(F.col(column).isNotNull()).groupBy(column).agg(*_sums("p", size)).collect()}  # a row for each language at most
    table = np.array([[sums.get(v, [0.0] * size)[k] + (2.0 if v == names[k] else 0.5) for k in range(size)] for v in names])
    table = np.log(table / table.sum(0))
    return {v: [round(float(x), 9) for x in table[i]] for i, v in enumerate(names)}


def host_priors(found: DataFrame, size: int) -> DataFrame:
    """host, n, own sums and the prior of the level above (already smoothed) for each host."""
    hosts = found.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.array(*_sums("p", size)).alias("own"))
    hosts = cut_lineage(hosts)

    def level(by: str) -> DataFrame:
        return hosts.groupBy(by).agg(F.sum("n").alias(f"n_{by}"), F.array(*[F.sum(F.col("own")[k]) for k in range(size)]).alias(f"sum_{by}"))

    whole = hosts.agg(F.sum("n").alias("n"), *[F.sum(F.col("own")[k]).alias(f"s{k}") for k in range(size)]).first()
    above = [(whole[f"s{k}"] + 1.0) / (whole["n"] + size) if whole["n"] else 1.0 / size for k in range(size)]
    smooth = lambda sums, n, upper: F.zip_with(sums, upper, lambda s, u: (s + SMOOTHING * u) / (n + SMOOTHING))
    suffixes = level("suffix").withColumn("p_suffix", smooth(F.col("sum_suffix"), F.col("n_suffix"), F.array(*map(F.lit, above)))).select("suffix", "p_suffix")
    domains = hosts.select("domain", "suffix").distinct().join(level("domain"), "domain").join(suffixes, "suffix")
    domains = domains.withColumn("p_domain", smooth(F.col("sum_domain"), F.col("n_domain"), F.col("p_suffix"))).select("domain", "suffix", "p_domain")
    return cut_lineage(hosts.join(domains, ["domain", "suffix"]).select("host", "n", "own", "p_domain"))


def _with_priors(found: DataFrame, priors: DataFrame) -> DataFrame:
    """found joined to its hosts' priors: hot hosts by broadcast, so that none is one task of a shuffle."""
    least = (priors.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(priors.filter(F.col("n") >= least))
    rest = found.join(hot.select("host"), "host", "left_anti").join(priors.filter(F.col("n") < least), "host")
    return found.join(hot, "host").unionByName(rest)


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id") -> DataFrame:
    """key, host, declared, named, text_lang, lang, confidence of every page (key, url, html).

    docs: labelled documents (text, lang). Ties go to the language first by name.
    """
    names, table = learn(docs)
    if not names:
        return pages.select(quoted(key), *[F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("declared", "string"), ("named", "string"), ("text_lang", "string"), ("lang", "string"), ("confidence", "double"))]).limit(0)
    size = len(names)
    found = cut_lineage(evidence(pages, names, table, key).withColumn("p", _normal(F.col("text_log"))))
    said, named = reliability(found, "said", names), reliability(found, "named", names)
    looked = lambda column, table: F.coalesce(F.create_map(*[x for v, row in table.items() for x in (F.lit(v), F.array(*map(F.lit, row)))])[F.col(column)], F.array(*[F.lit(0.0)] * size))
    priors = host_priors(found, size)
    joined = _with_priors(found, priors)
    prior = F.expr(f"transform(sequence(0, {size - 1}), k -> (greatest(own[k] - p[k], 0D) + {SMOOTHING}D * p_domain[k]) / (n - 1 + {SMOOTHING}D))")
    joined = joined.withColumn("prior", prior).withColumn("l_said", looked("said", said)).withColumn("l_named", looked("named", named))
    joined = joined.withColumn("posterior", _normal(F.expr(f"transform(sequence(0, {size - 1}), k -> text_log[k] + l_said[k] + l_named[k] + ln(prior[k]))")))
    best = lambda c: F.element_at(F.array(*map(F.lit, names)), F.array_position(F.col(c), F.array_max(F.col(c))).cast("int"))
    return joined.select(quoted(key), "host", F.col("said").alias("declared"), "named", best("p").alias("text_lang"), best("posterior").alias("lang"), F.round(F.array_max("posterior"), 6).alias("confidence"))
