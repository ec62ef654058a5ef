"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; the last returns a row per sequence: doc_id, lang, source, n_tokens,
ids, intact (whether the ids decode to the text's bytes).

In every stage a null text is an empty text, a null language or source is a value of
its own, rows without a doc_id are documents like others, and an empty table gives an
empty result. Columns beyond those of documents are passed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import bpe, mixing, near_dedup, quality_rules, weak_labels
from tapeframe.llm.common import modest_batches, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and adaptive rules keep. Repeated rows are judged alike, each for itself; empty texts go."""
    modest_batches(spark)
    return quality_rules.keep(docs)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps. Repeated rows are judged alike, each for itself."""
    modest_batches(spark)
    return weak_labels.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of least doc_id (null last), then least digest of its words.

    Unlike texts under one doc_id are different documents; of rows equal in both one stays.
    """
    modest_batches(spark)
    return near_dedup.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix repeats them: none, one or several times, the same in every run.

    Documents of one source are ranked by a seeded hash of doc_id; rows of one doc_id tie and share what is left.
    """
    modest_batches(spark)
    return mixing.materialized(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, and whether they decode to its text. A null or empty text has no ids."""
    import public_tokenizers

    modest_batches(spark)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    intact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", intact.alias("intact"))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encode", encode_texts),
]

#: SQL can't express the trained classifier, the sketches' classes or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of sf_dir; stages in between go to the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
