"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeframe.llm import bpe, chat, collocations, fingerprints, language_id, lexical_search, licenses, line_dedup, mixing, near_dedup, oracles, quality_rules, toxicity, weak_labels
from tapeframe.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan of every document."""
    return licenses.report(table(spark, sf_dir, "documents"))


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_licenses that SQL can express."""
    return op1_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and raw bytes of every document, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weak-label classifier's verdict on every document."""
    return weak_labels.classify(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text, and likenesses."""
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned without the held-out fold."""
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the fixed conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    fixed = [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    added = spark.createDataFrame(fixed, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(added)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's strongest phrases."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_licenses, op2_bpe, op3_language_id, op4_quality_classifier, op5_fingerprints, op6_mixing, op7_toxicity, op8_quality_rules, op9_chat, op10_near_dedup, op11_lexical_search, op12_collocations, op13_line_dedup, licenses_base)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL.format(documents="documents"), "op8_quality_rules": oracles.QUALITY_RULES, "op9_chat": oracles.CHAT, "licenses_base": oracles.LICENSES_BASE, "op11_lexical_search": lexical_search.SQL, "op12_collocations": collocations.SQL, "op13_line_dedup": line_dedup.SQL}
