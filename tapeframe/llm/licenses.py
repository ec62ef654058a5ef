"""License scan with ordered signature rules, on DataFrame functions only.

A text's words are runs of letters, digits and non-ASCII characters, A-Z lowered.
A keyword prefilter drops the texts that no rule can match. In the others every
place whose word can begin a signature is a spot; a spot's context is the next
CONTEXT words, as many as the longest signature has. The prefilter, the first words
and CONTEXT are read from the rules' regexes. Rules whose first word and keyword occur there are tried as
anchored regexes. A detection goes if one of higher priority (then longer, then
earlier in the rule order) contains its interval. Since a match is no longer than
a context, only spots at most CONTEXT places back can contain one, so the work is
linear in the text and nothing is shuffled.

Null texts have no words. Repeated rows are scanned each for itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.common import quoted, text_or_empty, without
from tapeframe.llm.license_rules import longest, openings, required, rules

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Words of the longest signature, and the words that can begin one.
CONTEXT = max(longest(regex) for *_, regex in rules())
FIRST = sorted(frozenset().union(*[openings(regex) for *_, regex in rules()]))

_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_NOT_WORD = rf"{_SEPARATOR}+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def gates() -> list[str]:
    """Every base phrase and every signature has one of these, from the beginning of a word."""
    literal = [(keyword, required(regex)) for _, keyword, _, _, regex in rules()] + [(phrase, (phrase,)) for phrase in BASE]
    return sorted({"licen" if any(" licen" in run for run in runs) else keyword for keyword, runs in literal})


def _prefilter() -> str:
    """The gates as a regex on the text itself."""
    found = [_NOT_WORD.join(re.escape(w) for w in gate.split()) for gate in gates()]
    return rf"(?i)(?:^|{_SEPARATOR})(?:{'|'.join(found)})"


PREFILTER = _prefilter()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _phrase_at(phrase: str) -> str:
    first, *rest = phrase.split()
    return " and ".join([f"w = '{first}'", *[f"get(__words, i + {k}) = '{word}'" for k, word in enumerate(rest, 1)]])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections: array of (start, n, priority, confidence, label, rule), start and n in words,
    rule the rule's place in the order.
    """
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections", "__words", "__rules", "__base", "__spots"]
    df = without(df, own)
    source = text_or_empty(text)
    spaced = F.trim(F.translate(F.regexp_replace(source, _NOT_WORD, " "), _UPPER, _LOWER))
    words = F.when(source.rlike(PREFILTER), F.filter(F.split(spaced, " "), lambda w: w != ""))
    table = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"), F.lit(f"^(?:{regex})(?= |$)").alias("regex"), F.lit(k).alias("rule"))
            for k, (label, keyword, priority, confidence, regex) in enumerate(rules())
        ]
    )
    firsts = ", ".join(f"'{w}'" for w in FIRST)
    base = " ".join(f"when {_phrase_at(p)} then '{label}'" for p, label in BASE.items())
    out = df.withColumn("n_words", F.regexp_count(source, F.lit(_WORD)).cast("long")).withColumn("__words", words).withColumn("__rules", table)
    out = out.withColumn("__base", F.expr(f"filter(transform(__words, (w, i) -> named_struct('at', i, 'label', case {base} end)), b -> b.label is not null)"))
    spots = f"filter(transform(__words, (w, i) -> case when w in ({firsts}) then named_struct('at', i, 'said', array_join(slice(__words, i + 1, {CONTEXT}), ' ')) end), s -> s is not null)"
    tried = """transform(filter(__rules, r -> contains(s.said, r.keyword)), r -> named_struct('start', s.at, 'found', regexp_extract(s.said, r.regex, 0), 'rule', r))"""
    found = """transform(filter({tried}, d -> d.found != ''), d -> named_struct('start', d.start, 'n', size(split(d.found, ' ')), 'priority', d.rule.priority,
        'confidence', d.rule.confidence, 'label', d.rule.label, 'rule', d.rule.rule))""".format(tried=tried)
    out = out.withColumn("__spots", F.expr(f"transform({spots}, s -> {found})"))
    stronger = "(e.priority > d.priority or (e.priority = d.priority and (e.n > d.n or (e.n = d.n and e.start = d.start and e.rule < d.rule))))"
    contains = "e.start <= d.start and e.start + e.n >= d.start + d.n"
    near = f"flatten(slice(__spots, greatest(k - {CONTEXT}, 0) + 1, {CONTEXT} + 1))"
    out = out.withColumn("detections", F.expr(f"coalesce(flatten(transform(__spots, (ds, k) -> filter(ds, d -> not exists({near}, e -> {contains} and {stronger})))), array())"))
    places = F.col("__base.at")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.col("__base.label"), F.array().cast("array<string>"))))
    every = F.array_sort(F.array_union(base_labels, F.array_distinct(F.col("detections.label"))))
    best = F.array_max(F.col("detections.confidence"))
    return (
        out.withColumn("n_base", F.coalesce(F.size("__base"), F.lit(0)).cast("long"))
        .withColumn("n_base", F.greatest("n_base", F.lit(0).cast("long")))
        .withColumn("first_word", F.array_min(places).cast("long"))
        .withColumn("last_word", F.array_max(places).cast("long"))
        .withColumn("base_labels", F.array_join(base_labels, ","))
        .withColumn("labels", F.array_join(every, ","))
        .withColumn("score", F.coalesce(best, F.when(F.size("__base") > 0, F.lit(0.5)), F.lit(0.0)))
        .drop("__words", "__rules", "__base", "__spots")
    )


def report(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per row of df: the key and the scan's columns but the detections."""
    scanned: list[Column] = [F.col(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    return scan(df.select(quoted(key), "text")).select(quoted(key), *scanned)
