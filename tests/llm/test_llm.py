"""The training-data operators against brute force, on small fixtures with edge cases."""

import bisect
import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeframe.llm import bpe, chat, common, fingerprints, language_id, license_rules, licenses, mixing, near_dedup, quality_rules, toxicity, weak_labels

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) + r.choice(["", "", ".", "\n"]) for _ in range(n))


#: Nulls in any column, empty, white, very long and repeated texts, ties, clashing extra columns (score, label).
ROWS = [
    (1, prose(1, 120), "en", "a", 1, 0.5, 9),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 0.5, 9),
    (4, " \n\t ", "fr", "", 4, 0.5, 9),
    (5, prose(1, 120), "en", "b", 1, 0.5, 9),
    (5, prose(1, 120), "en", "b", 1, 0.5, 9),
    (6, prose(2, 60_000), "en", "a", 1, 0.5, 9),
    (7, "é漢😀 " * 30 + "x", None, "a", 1, 0.5, 9),
    (None, "no id at all", "en", None, 1, 0.5, 9),
    (8, "x" * 200_000, "en", "a", 1, 0.5, 9),
    (9, "word " * 300, "en", "a", 1, 0.5, 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def sf01(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


OPERATORS = {
    "licenses": licenses.report,
    "bpe": lambda d: bpe.digests(bpe.round_trip(d, *_tokenizer())),
    "weak_labels": weak_labels.classify,
    "weak_keep": weak_labels.keep,
    "fingerprints": fingerprints.report,
    "mixing": mixing.mixed_documents,
    "mixed": mixing.materialized,
    "toxicity": lambda d: toxicity.held_out_scores(d, d.select("doc_id", F.lit(1).alias("toxic"))),
    "rules": quality_rules.judge,
    "rules_keep": quality_rules.keep,
    "near": near_dedup.near_duplicates,
    "near_keep": near_dedup.keep,
    "languages": lambda d: language_id.identify(d.withColumns({"page_id": F.col("doc_id"), "url": F.col("source"), "html": F.col("text"), "host": F.lit(1), "p": F.lit(2)}), d),
    "chat": lambda d: chat.digests(chat.format_chats(d.withColumns({"conv_id": F.col("doc_id"), "turn": F.col("label"), "role": F.col("lang"), "n_turns": F.lit("x"), "formatted": F.lit(1)}))),
}


def _tokenizer():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_cases_and_empty_tables(docs, name):
    found = OPERATORS[name](docs)
    rows = found.collect()
    assert len(set(found.columns)) == len(found.columns)
    if name in ("licenses", "bpe", "weak_labels", "fingerprints", "mixing", "toxicity", "rules", "languages"):
        assert len(rows) == len(ROWS)
    if name.endswith("keep"):
        assert found.columns == docs.columns
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_licenses_match_brute_force(spark, docs, sf01):
    noise = [(10_000 + k, t) for k, t in enumerate(["Apache\n-License apache LICENSE", "CC-BY cc by-NC 4.0", "the mitİ license; MIT  License", "gnu general public", "Licensed under the GNU GPL v3", "mit license " * 2000])]
    rows = sf01.select("doc_id", "text").unionByName(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")).unionByName(spark.createDataFrame(noise, "doc_id long, text string"))
    rows = rows.dropDuplicates(["doc_id"]).cache()
    said = texts(rows)
    for r in licenses.report(rows).collect():
        words = WORD.findall(said[r.doc_id].translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) >= bool(at)
    by = {r.doc_id: r for r in licenses.report(rows).collect()}
    assert by[10_001].labels == "cc-by,cc-by-nc" and "gpl" in by[10_004].labels


def test_licenses_behind_underscores_and_with_joined_versions(spark):
    said = ["_CC BY 4.0_", "icon_cc_by", "__cc__by__", "_cc_0", "écc by", "GPL3", "under gpl1", "(GPL2)", "LGPL3", "lgpl2", "AGPL3", "x_GPL3_x", "mpl2"]
    want = ["cc-by"] * 3 + ["cc0", "", "gpl", "gpl", "gpl", "lgpl", "lgpl", "agpl", "gpl", "mpl"]
    found = {r.doc_id: r for r in licenses.report(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()}
    assert [found[k].labels for k in range(len(said))] == want
    for k, text in enumerate(said):
        words = WORD.findall(text.translate(LOWER))
        at = [i for i in range(len(words)) if words[i : i + 2] == ["cc", "by"]]
        assert (found[k].n_words, found[k].n_base, found[k].first_word, found[k].last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))


def an_instance(r, alternatives):
    """A random match of a parsed rule regex."""
    out = ""
    for item, least, most in r.choice(alternatives):
        for _ in range(r.randint(least, min(most, least + 2))):
            out += an_instance(r, item) if isinstance(item, list) else r.choice("xyz") if item is None else r.choice(sorted(item))
    return out


def naive_scan(words):
    """All matches of all rules, less those that a stronger one contains."""
    found = []
    for start in range(len(words)):
        rest = " ".join(words[start:])
        for k, (label, _, priority, _, regex) in enumerate(license_rules.rules()):
            if m := re.match(rf"(?:{regex})(?= |$)", rest):
                if m[0]:
                    found.append((start, len(m[0].split(" ")), priority, label, k))
    stronger = lambda e, d: e[2] > d[2] or (e[2] == d[2] and (e[1] > d[1] or (e[1] == d[1] and e[0] == d[0] and e[4] < d[4])))
    return sorted(d for d in found if not any(e[0] <= d[0] and e[0] + e[1] >= d[0] + d[1] and stronger(e, d) for e in found))


def test_license_rules_one_by_one(spark):
    """A random match of every rule, between separators and other words, is scanned as by brute force."""
    assert len({x[4] for x in license_rules.rules()}) == len(license_rules.rules()) > 200
    r, rows = random.Random(8), []
    for k, rule in enumerate(license_rules.rules() * 2):
        words = an_instance(r, license_rules._parsed(rule[4])).split()
        assert re.fullmatch(rule[4], " ".join(words)) and len(words) <= licenses.CONTEXT and words[0] in licenses.FIRST
        said = "".join(w + r.choice([" ", "_", ", ", "\n", "-", " / "]) for w in [*prose(k, 3).split(), *words, "other", *words[:2]])
        rows.append((k, "".join(c.upper() if r.random() < 0.3 else c for c in said)))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for row in found:
        got = sorted((d.start, d.n, d.priority, d.label, d.rule) for d in row.detections)
        assert got == naive_scan(WORD.findall(row.text.translate(LOWER))), row.text
        assert license_rules.rules()[row.doc_id % len(license_rules.rules())][0] in row.labels or got


def test_license_suppression(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0 or later")], "doc_id long, text string")
    (found,) = licenses.scan(df).first().detections
    assert (found.start, found.n, found.label, found.priority) == (0, 8, "apache", 65)


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 16])
def test_parts_encode_like_wholes(size):
    import tiktoken

    coder = bpe.Coder(bpe.rank_table(_tokenizer()[0]), _tokenizer()[1])
    r = random.Random(size)
    for _ in range(60):
        text = "".join(r.choice(["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "9", "é", " ", " ", "!", "😀", "\x1c", "\x85", "word"]) for _ in range(r.randint(0, 200)))
        ids = [i for part in bpe.parts(text, size) for i in coder.encode(part)]
        assert ids == coder.encode(text) and coder.decode(ids) == text.encode()
    assert tiktoken.__version__
    with pytest.raises(ValueError):
        coder.decode([-1])


def test_bpe_digests(docs):
    """Against the library on whole texts, without parts."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(_tokenizer()[0], "rb"))}
    library = tiktoken.Encoding("whole", pat_str=_tokenizer()[1], mergeable_ranks=ranks, special_tokens={})
    said = texts(docs)
    assert max(map(len, said.values())) > 2 * bpe.PART_CHARS
    for r in bpe.digests(bpe.round_trip(docs, *_tokenizer())).collect():
        ids = library.encode_ordinary(said[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said[r.doc_id].encode()).hexdigest())
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), *_tokenizer()), _tokenizer()[0])
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())


def test_rule_measures_match_brute_force(docs, sf01):
    rows = sf01.unionByName(docs.filter("doc_id > 3").select(*sf01.columns))
    said = rows.select("doc_id", "text").dropDuplicates(["doc_id"])
    want = texts(said)
    for r in quality_rules.with_measures(said).collect():
        text = want[r.doc_id]
        words, seen, dup = SPACED.findall(text), set(), 0
        for line in text.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


def test_sketch_quantiles_and_merging(spark):
    values = [random.Random(1).randint(0, 10**6) for _ in range(5000)] + [3, 63, 64, 65]
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "g int, v long")
    sketch = quality_rules.sketches(df, ["g"], {"v": F.col("v")})
    whole = quality_rules.sketches(df.withColumn("g", F.lit(0)), ["g"], {"v": F.col("v")})
    merged = sketch.groupBy(F.lit(0).alias("g"), "measure", "bin").agg(F.sum("n").alias("n"))
    assert merged.exceptAll(whole).count() == 0 == whole.exceptAll(merged).count()
    found = quality_rules.quantiles(whole, ["g"], (0.5, 0.99)).first()
    for q, got in ((0.5, found.q0), (0.99, found.q1)):
        true = sorted(values)[int(np.ceil(q * len(values))) - 1]
        assert true <= got <= true * 33 / 32 + 1


def naive_limits(rows):
    """most_<rate> of a group, from its documents' (rates, words, lines) with the sketch's rounding."""

    def quantile(values, q):
        v = sorted(values)[int(np.ceil(q * len(values))) - 1]
        shift = max(v.bit_length() - 6, 0)
        return (((v >> shift) + 1) << shift) - 1

    out = {}
    for rate, (_, of, few) in quality_rules.RULES.items():
        values = [r[rate] for r in rows]
        length = max(quantile([r[of] for r in rows], 0.5), 1)
        chance = few * 10_000 // length if few else int(1.5 * quantile(values, 0.5) / np.sqrt(length))
        out[rate] = quantile(values, 0.75) + 3 * (quantile(values, 0.75) - quantile(values, 0.25)) + chance
    return out


def test_verdicts_match_brute_force(spark):
    """Thresholds, base_failed and kept by loops; small groups fall back to their language's, then to all."""
    r, rows = random.Random(4), []
    for k in range(400):
        lang, source = r.choice([("en", "big"), ("en", "big"), ("en", "other"), ("de", "big"), ("en", "few"), (None, None), ("xx", "few")][: 7 if k % 10 == 0 else 4])
        n = r.choice([5, 30, 200])
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7 if source == "big" else 12))) for _ in range(n)]
        words += ["#"] * r.choice([0, 0, 0, 0, 1, 4, 60]) + ["|"] * r.choice([0] * 9 + [9]) + ["x" * 40] * r.choice([0] * 9 + [30]) + words[:9] * r.choice([0] * 12 + [5])
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
        rows.append((k, "\n".join(lines + lines[:1] * r.choice([0] * 9 + [6])), lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    measured = {x.doc_id: x.asDict() for x in quality_rules.with_measures(df).collect()}
    for m in measured.values():
        for rate, (count, of, _) in quality_rules.RULES.items():
            m[rate] = m[count] * 10_000 // max(m[of], 1)
    found = {x.doc_id: x for x in quality_rules.judge(df).collect()}
    seen = set()
    for k, m in measured.items():
        groups = [[o for o in measured.values() if (o["lang"], o["source"])[:depth] == (m["lang"], m["source"])[:depth]] for depth in (2, 1, 0)]
        depth = next(i for i, g in enumerate(groups) if len(g) >= quality_rules.LEAST_GROUP or i == 2)
        limits = naive_limits(groups[depth])
        failed = [rate for rate, (count, _, few) in quality_rules.RULES.items() if m[rate] > limits[rate] and (few is None or m[count] > few)]
        base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        assert (found[k].base_failed, found[k].rules_failed, found[k].kept) == (base, ",".join(failed), not base and not failed)
        seen |= {depth, *failed}
    assert seen >= {0, 1, 2, "symbol_rate", "pipe_rate", "word_length"}
    assert {x.doc_id for x in quality_rules.keep(df).collect()} == {k for k, x in found.items() if x.kept}


def test_rules_follow_the_group(spark):
    """A text of long words fails where words are short, and passes where they are long; so with symbols."""
    r = random.Random(4)
    said = lambda n, more="": " ".join("".join(r.choice("abcdefgh") for _ in range(r.choice([n - 1, n, n + 1]))) for _ in range(200)) + more
    rows = [(k, said(5), "en", "short") for k in range(40)] + [(100 + k, said(10, " #" * 30), "en", "long") for k in range(40)]
    rows += [(500, said(10), "en", "short"), (501, said(5, " #" * 30), "en", "short"), (502, said(5), "en", "short"), (503, said(10, " #" * 30), "en", "long")]
    found = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {k: x.rules_failed for k, x in found.items() if not x.kept} == {500: "word_length", 501: "symbol_rate"}


def test_mixing_clamps_and_hits_targets(spark):
    rows = [(k, "w " * (k % 9 + 1), "tiny" if k < 4 else "big" if k % 3 else None) for k in range(400)] + [(k, "same words here", "tie") for k in [500] * 20]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sized = mixing.sizes(df, "doc_id").cache()
    wanted = {r.source: r for r in mixing.targets(sized).collect()}
    total = sum(r.source_size for r in wanted.values())
    assert abs(sum(r.target for r in wanted.values()) - total) < 1e-6 and wanted["tiny"].target == 3 * wanted["tiny"].source_size
    free = [r for r in wanted.values() if r.target < 3 * r.source_size]
    assert len({round(r.target / r.weight, 6) for r in free}) == 1
    mix = mixing.mixed_documents(df).collect()
    assert len(mix) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in mix)
    of = {r.doc_id: r for r in mixing.mixed_documents(df).collect()}
    assert all(of[r.doc_id].taken == r.taken for r in mix)
    source = {k: s for k, _, s in rows}
    taken = collections.Counter()
    for r in mix:
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - w.target) <= (21 if s == "tie" else 1) for s, w in wanted.items())


def test_chat_round_trip_and_mask(spark):
    nasty = ["\\", "<|", "<|end|>\n", "<", "\\<|", "<\\|end|>", "|>", "", None, "é😀<|user|>\n", "\\### Assistant: </turn> ok"]
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "a|>b", "", None, "<|x"]), r.choice(nasty) if t % 2 else "".join(r.choice("<|\\>ae") for _ in range(30))) for c in [*range(40), None] for t in range(r.randint(1, 9))] + [(7, None, "user", "first"), (7, 0, "user", "dup"), (7, 0, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    found = chat.format_chats(df).collect()
    assert len(found) == len(want)
    for row in found:
        formatted = bytes(row.formatted)
        assert chat.read_back(formatted) == want[row.conv_id] and row.n_turns == len(want[row.conv_id])
        assert chat.learned_text(formatted, row.loss_spans) == "".join(t for role, t in want[row.conv_id] if role == "assistant")
        assert formatted.count(b"<|") == 2 * row.n_turns
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_chat_query_digests(spark, tmp_path):
    """op9 on odd rows and the fixed conversation, against digests of the rows themselves."""
    from tapeframe.llm import queries

    rows = [(1, 1, "assistant", "b\\<|"), (1, 0, "user", None), (2, 0, "assistant", "a<|end|>\n"), (2, 1, "assistant", "é"), (-7, 5, "user", "also -7"), (3, None, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    fixed = r"\### Assistant: </turn> ok"
    want = {1: [("user", ""), ("assistant", "b\\<|")], 2: [("assistant", "a<|end|>\n"), ("assistant", "é")], -7: [("user", fixed), ("assistant", fixed), ("user", "also -7")], 3: [("", "x")]}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    found = {r.conv_id: r for r in queries.op9_chat(spark, str(tmp_path)).collect()}
    assert set(found) == set(want)
    for k, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        said = digest("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (found[k].n_turns, found[k].turns_sha256, found[k].loss_chars, found[k].loss_sha256) == (len(turns), said, len(loss), digest(loss))


def occurrences(text):
    """The shingles of a text in order, each with the number of its occurrence."""
    w, seen, out = WORD.findall(text.translate(LOWER)), collections.Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        shingle = tuple(w[i : i + 5])
        out.append((shingle, seen[shingle]))
        seen[shingle] += 1
    return out


def similarity(x, y):
    """|longest common subsequence| / |union| of two lists without repeats."""
    at, tails = {s: k for k, s in enumerate(y)}, []
    for s in x:
        if s in at:
            k = bisect.bisect_left(tails, at[s])
            tails[k : k + 1] = [at[s]]
    return len(tails) / (len(x) + len(y) - len(tails))


def classes_of(texts):
    """The index of the first text of each text's class, by comparing all pairs."""
    said, label = [occurrences(t) for t in texts], list(range(len(texts)))
    words = [WORD.findall(t.translate(LOWER)) or t for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and (words[a] == words[b] or (said[a] and said[b] and similarity(said[a], said[b]) >= 0.8)):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def assert_classes(spark, said):
    """near_duplicates against all pairs; doc_ids are the texts' places."""
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(4)
    label = classes_of([t or "" for t in said])
    rows = near_dedup.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(label)) and len(rows) == len(said)
    assert {r.doc_id for r in rows if r.kept} == set(label)
    assert len({r.class_key for r in rows}) == len(set(label))
    return label


def edited(r, words, most):
    words = list(words)
    for _ in range(r.randint(0, most)):
        at = r.randrange(len(words))
        words[at : at + 1] = r.choice([[f"edit{r.randrange(10**6)}"], [], [words[at], f"more{r.randrange(99)}"]])
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    """Small groups, a large group of edited copies, swapped halves, repeated passages, texts that share one passage."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r, said = random.Random(11), []
    for g in range(12):
        base = prose(1000 + g, 150).split()
        said += [edited(r, base, 9) for _ in range(10)]
    hot = prose(2000, 200).split()
    said += [edited(r, hot, 12) for _ in range(120)]
    said += [" ".join(hot[100:] + hot[:100]), " ".join(hot * 2), " ".join(hot * 3), " ".join(hot[:170]), " ".join(hot[:150])]
    passage = prose(2001, 80)
    said += [f"{prose(3000 + k, k)} {passage} {prose(4000 + k, 7)}" for k in range(2, 40)]
    said += ["", None, "!!", "!!", "One two", "one, TWO", "one two three four five six seven", "one two three four five six seven eight"]
    label = assert_classes(spark, said)
    assert label[240] == 240 and label[241] == 241, "neither swapped halves nor a text twice is a near copy"


def test_links_of_drifting_chains_and_families(spark, monkeypatch):
    """Chains in which only neighbours are similar, and families of edited copies with passages in common."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    r, said = random.Random(5), []
    for g in range(3):
        words = prose(7000 + g, 1600).split()
        said += [" ".join(words[at : at + 104]) for at in range(0, 1400, 10) if g == 0 or r.random() < 0.93]
        for _ in range(25):
            at = r.randrange(1200)
            said.append(edited(r, words[at : at + 104], 4))
    r.shuffle(said)
    label = assert_classes(spark, said)
    assert 3 < len(set(label)) < len(said) / 3


def test_possible_links_of_one_bucket_lose_none(spark, monkeypatch):
    """All members in one bucket, many blocks: what the bitmaps leave has every link, once."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r, said = random.Random(6), []
    for g in range(4):
        base = prose(7500 + g, r.choice([30, 120, 700])).split()
        said += [edited(r, base, len(base) // 12) for _ in range(20)]
    marked = near_dedup.sketches(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"))
    marks = marked.select(F.col("doc_id").alias("node"), "n", "bits", F.array(F.lit(7).cast("long")).alias("sketch")).cache()
    members = marks.select(F.lit(7).cast("long").alias("bucket"), "node", F.col("node").alias("label"))
    got = [(x.a, x.b) for x in near_dedup.possible_links(members, marks, True, near_dedup.cut_lineage).collect()]
    sets = [set(occurrences(t)) for t in said]
    links = {(a, b) for a in range(80) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and links <= set(got) and len(got) < 2 * len(links) + 40
    some = [(x.a, x.b) for x in near_dedup.possible_links(members, marks, False, near_dedup.cut_lineage).collect()]
    assert len(some) <= 2 * 80 * 10 and set(some) <= set(got)
    one = near_dedup.possible_links(members.withColumn("label", F.lit(1).cast("long")), marks, True, near_dedup.cut_lineage)
    assert one.isEmpty(), "members of one component are not compared"


def test_rows_of_one_id_and_of_none_are_documents(spark):
    """Unlike texts under one id stay, equal rows leave one, rows without an id have classes."""
    a, b, c = prose(1, 100), prose(2, 100), prose(3, 100)
    rows = [(3, a, "x"), (3, b, "y"), (3, b, "a"), (3, b, "a"), (None, c, None), (None, c + " end", "z"), (4, a + " end", "x"), (None, "", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    found = near_dedup.near_duplicates(df).collect()
    assert len(found) == len(rows) and len({r.class_key for r in found}) == 4
    kept = sorted((r.doc_id, r.text or "", r.kept) for r in near_dedup.keep(df).collect() if r.doc_id)
    assert kept == [(3, a, "x"), (3, b, "a")] or kept == sorted([(3, a, "x"), (3, b, "a")], key=lambda k: k[1])
    assert sorted((r.text or "")[:5] for r in near_dedup.keep(df).collect() if not r.doc_id) == ["", c[:5]]


def test_aligned_comparison():
    def marks(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return near_dedup.labelled(near_dedup.shingled(*near_dedup.worded(data, np.array([0, len(data)])))[0])

    r = random.Random(9)
    for k in range(200):
        base = prose(k, r.randint(1, 60)).split()
        x, y = edited(r, base, 6), edited(r, base, 6)
        if k % 3 == 0:
            cut = len(base) // 2
            y = " ".join(base[cut:] + base[:cut])
        if not (x.split() and y.split()):
            continue
        want, got = similarity(occurrences(x), occurrences(y)), near_dedup.aligned(marks(x), marks(y))
        assert got <= want + 1e-12 and (want < 0.8 or got == want)
        a, b = (np.frombuffer(near_dedup.parities(marks(t)), np.uint64) for t in (x, y))
        if len(a) == len(b):
            assert np.bitwise_count(a ^ b).sum() <= len(set(occurrences(x)) ^ set(occurrences(y)))


def test_components(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    found = near_dedup.components(links, near_dedup.cut_lineage)
    got = {r.node: r.label for r in found.collect()}
    assert got == {k: 0 for k in range(41)} | {100: 90, 90: 90, 95: 90}
    more = spark.createDataFrame([(95, 20), (200, 201), (201, 202)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.merged(found, more, near_dedup.cut_lineage).collect()}
    assert got == {k: 0 for k in [*range(41), 90, 95, 100]} | {200: 200, 201: 200, 202: 200}


def test_fingerprints(spark, sf01):
    said = texts(sf01)
    order = sorted(said, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = fingerprints.report(sf01).collect()
    errors = []
    for r in rows:
        text = said[r.doc_id]
        edited = fingerprints.edited_text(text, said[after[r.doc_id]])
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(said[after[r.doc_id]])
        for got, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
            if max(len(x), len(y), 1) <= fingerprints.K:  # both sketches hold all shingles
                near = len(x & y) / len(x | y) if x | y else 1.0
                assert got == near or len(x | y) > fingerprints.K and abs(got - near) < 0.2
        errors.append(abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(errors) < 0.05
    of = {}
    for r in rows:
        assert of.setdefault(said[r.doc_id], r.fingerprint) == r.fingerprint and of.setdefault(fingerprints.edited_text(said[r.doc_id], said[after[r.doc_id]]), r.edited_fingerprint) == r.edited_fingerprint
    parts = spark.createDataFrame([(1, prose(1, 300)), (1, prose(2, 300)), (2, prose(1, 300))], "g int, text string")
    merged = {r.g: fingerprints.unpacked(r.fingerprint) for r in fingerprints.merge(fingerprints.fingerprint(parts), ["g"]).collect()}
    assert 0.3 < fingerprints.resemblance(merged[1], merged[2]) < 0.7 and fingerprints.containment(merged[2], merged[1]) > 0.8
    assert abs(fingerprints.distinct_count(merged[1]) / 592 - 1) < 0.35


def test_neighbours_over_many_parts(spark, docs):
    """The next document is the same however the table is cut into parts."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()] + [(100 + k, prose(k, 40)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    for part_bytes in (1 << 30, 20_000, 300):
        got = []
        for part in fingerprints.with_next(df, part_bytes).rdd.glom().collect():
            got += [(str(a.doc_id), a.text, b.text) for a, b in zip(part, part[1:], strict=False) if a.part == b.part and not a.halo]
        assert sorted(got) == want


def naive_toxicity(model, text):
    """The score by looking for every entry everywhere."""
    said = toxicity.folded(text)
    spans = [(i, i + len(p) + 2) for p in model.exceptions for i in range(len(said)) if said.startswith(f" {p} ", i)]
    total = 0.0
    for entry, weight in model.weights.items():
        total += weight * sum(said.startswith(entry, i) and not any(a <= i and i + 1 < b for a, b in spans) for i in range(len(said)))
    size = len(said) / 6 + 20
    terms = [1.0, total / size**0.5, total / size * 10, np.log1p(abs(total)) * np.sign(total), np.log(size) / 5]
    return 1 / (1 + np.exp(-np.clip(np.dot(terms, model.scale), -30, 30)))


def test_toxicity_scores_match_brute_force(spark):
    r = random.Random(12)
    model = toxicity.Model({" idiot ": 2.0, " idi": 0.5, " trash": 1.5, " scum ": -0.7, " clown ": 1.0}, (-2.0, 1.1, 0.4, 0.9, -0.3))
    said = [" ".join(r.choice(["1d10t", "IDIOT", "idiots", "trash can", "trash", "pond scum", "scum", "fine", "сlown", "clown fish", "w\u200bord", "x" * 60]) for _ in range(n)) for n in [0, 1, 3, 10, 40, 3000] * 4] + [None, "idiot " * 400]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for row in toxicity.score(df, model).collect():
        assert abs(row.score - naive_toxicity(model, row.text or "")) < 1e-6


def test_conflicting_labels_are_toxic_in_learning(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 0), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert sorted((r.doc_id, r.text, r.label) for r in toxicity.sample(docs, labels).collect()) == [(1, "a", 1), (2, "b", 0), (2, "c", 0)]


def test_toxicity_learns_and_excepts(spark):
    r = random.Random(2)
    rows = []
    for k in range(600):
        words = prose(3000 + k, 60).split()
        bad = k % 5 == 0
        for _ in range(3 if bad else 0):
            words[r.randrange(60)] = r.choice(["blorg", "bl0rg", "BLORG", "blоrg", "blorgish"])
        rows.append((k, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.learn(df.filter("doc_id < 400"))
    found = toxicity.score(df.filter("doc_id >= 400"), model).collect()
    assert np.mean([(x.score >= 0.5) == bool(x.label) for x in found]) > 0.97
    assert toxicity.folded("B1Оrg") == " biorg "
    phrase = toxicity.Model({" trash": 3.0})
    assert toxicity.hits(phrase.automaton(), toxicity.folded("a trash can")) == [] and toxicity.hits(phrase.automaton(), toxicity.folded("you trash")) == [0]


def test_held_out_rows_teach_nothing(sf01, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.expr(toxicity.HELD_OUT), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.held_out_scores(sf01, labels), toxicity.held_out_scores(sf01, turned)
    assert a.exceptAll(b).count() == 0


def test_expectation_maximisation_recovers_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.8
    votes = np.stack([np.where(r.random(4000) < 0.25, 2, np.where(truth, r.random(4000) < 0.98, r.random(4000) < 0.3)) for _ in weak_labels.LABELLERS], 1).astype(int)
    patterns, counts = np.unique(weak_labels.packed(votes), return_counts=True)
    good, share, table = weak_labels.expectation_maximisation(patterns, counts)
    of = dict(zip(patterns, good, strict=True))
    assert np.mean([(of[p] > 0.5) == t for p, t in zip(weak_labels.packed(votes), truth, strict=True)]) > 0.97 and abs(share - 0.8) < 0.03
    assert np.abs(table[1, :, 0] - 0.02).max() < 0.02 and np.abs(table[0, :, 0] - 0.7).max() < 0.08, "accuracies are estimated"


def test_no_bad_class_among_good_documents():
    """Stray bad votes alone make no class: all documents are good."""
    r = np.random.default_rng(1)
    votes = np.where(r.random((5000, len(weak_labels.LABELLERS))) < 0.004, 0, 1)
    patterns, counts = np.unique(weak_labels.packed(votes), return_counts=True)
    good, share, _ = weak_labels.expectation_maximisation(patterns, counts)
    assert share == 1.0 and (good == 1).all()


def naive_estimation(votes, rounds=200):
    """Expectation-maximisation document by document, with loops."""
    n, many = len(votes), len(votes[0])
    good = [(sum(v == 1 for v in row) + 1) / (sum(v != 2 for v in row) + 2) for row in votes]
    good = [0.1 if g < 0.85 else 0.9 for g in good]
    for _ in range(rounds):
        share = sum(good) / n
        bad_rate = []
        for weight in ([1 - g for g in good], good):
            said = [[sum(w for w, row in zip(weight, votes, strict=True) if row[k] == vote) + 0.5 for vote in (0, 1)] for k in range(many)]
            bad_rate.append([a / (a + b) for a, b in said])
        new = []
        for row in votes:
            odds = np.log(share / (1 - share))
            for k, v in enumerate(row):
                if v != 2:
                    a, b = bad_rate[1][k], bad_rate[0][k]
                    odds += np.log((a if v == 0 else 1 - a) / (b if v == 0 else 1 - b))
            new.append(1 / (1 + np.exp(-odds)))
        good = new
    return good


def test_quality_classifier_matches_brute_force(spark):
    """Votes by plain text handling, posteriors by the naive estimation, scores gram by gram."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = weak_labels.fit(docs)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    votes = []
    for r in rows:
        text, words = r.text or "", SPACED.findall(r.text or "")
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        ascii_letters = [c for c in text if c in string.ascii_letters]
        short = sum(len(w.encode()) <= 4 for w in words)
        ended = sum(x[-1] in ".!?;:\"')" for x in text.split("\n") if x)
        per = lambda a, b: a / max(b, 1)
        value = {
            "symbols": per(len(re.findall(r"[#*$%&|<>]", text)), len(words)), "pipes": per(words.count("|"), len(words)), "repeats": per(len(again), len(words)),
            "duplicate_lines": per(len(lines) - len(set(lines)), len(lines)), "capitals": per(sum(c.isupper() for c in ascii_letters), len(ascii_letters)),
            "few_short_words": -per(short, len(words)), "unended_lines": -per(ended, len(lines)), "few_words": -len(words), "word_length": per(sum(map(len, words)), len(words)),
        }
        votes.append([0 if value[name] >= bad else 1 if value[name] <= best else 2 for name, _, _, bad, best in weak_labels.LABELLERS])
    got = {r.doc_id: r for r in weak_labels.classify(docs).collect()}
    want = naive_estimation(votes)
    for r, row, good in zip(rows, votes, want, strict=True):
        assert got[r.doc_id].bad_votes == ",".join(name for (name, *_), v in zip(weak_labels.LABELLERS, row, strict=True) if v == 0)
        assert abs(got[r.doc_id].soft_label - good) < 1e-3
    for r in rows[:12]:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        index = weak_labels.grams(data)[: max(len(data) - 3, 0)]
        place = weak_labels.bins(weak_labels.measures(data, np.array([0, len(data)])))[0]
        logit = model.scorer.bias + 60 * sum(float(model.scorer.weights[k]) for k in index) / max(len(index), 1) + sum(float(model.scorer.weights[k]) for k in place)
        assert abs(got[r.doc_id].quality - 1 / (1 + np.exp(-logit))) < 1e-4 and got[r.doc_id].kept == (got[r.doc_id].quality >= 0.5)


def test_quality_classifier_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = weak_labels.classify(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "good"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.good) for r in found]) > 0.97


def test_language_fusion(spark):
    docs = spark.createDataFrame([(t, lang) for lang, words in (("en", "the and of with that this"), ("de", "der und die mit das nicht")) for t in [words] * 20], "text string, lang string")
    pages = [
        (1, "http://a.example.com/x", "<html lang='en'><script>der und die</script><p>the and of with that this</p></html>"),
        (2, "http://a.example.com/x", "<html lang='en'><p>der und die mit das nicht</p></html>"),
        (3, "http://b.example.de/", "<html></html>"),
        (4, None, None),
        (5, "http://b.example.de/1", "<p>der und die mit</p>"),
    ]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == 5 and got[1].lang == "en" and got[2].text_lang == "de" and got[3].lang == "de" and got[5].lang == "de" and got[3].named == "de" and got[4].lang in ("en", "de")


def naive_languages(pages, docs):
    """lang and confidence of each page, with loops."""
    names = sorted({r.lang for r in docs if r.lang and r.text is not None})
    grams = lambda text: [(int(i), ok) for i, ok in zip(*(x[: max(len(text.encode()) - 2, 0)] for x in language_id.trigrams(np.frombuffer(text.encode(), np.uint8))), strict=True)]
    count = {n: collections.Counter() for n in names}
    for r in docs:
        if r.lang and r.text is not None:
            count[r.lang].update(i for i, ok in grams(r.text) if ok)
    total = {n: sum(count[n].values()) + 0.1 * 2**language_id.BITS for n in names}
    normal = lambda logs: (lambda e: e / e.sum())(np.exp(np.array(logs) - max(logs)))
    found = []
    for p in pages:
        html = p.html or ""
        text = re.sub(r"&[a-zA-Z#0-9]{1,10};", " ", re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", html)))
        solid = [i for i, ok in grams(text) if ok]
        weight = language_id.WORTH * min(len(solid), language_id.ENOUGH) / max(len(solid), 1)
        logs = [weight * sum(np.log((count[n][i] + 0.1) / total[n]) for i in solid) for n in names]
        host = (re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", p.url or "") or [None, ""])[1].lower()
        labels = host.split(".")
        tag = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", html) or re.search(r"(?is)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([a-zA-Z]{2,3})\b", html)
        said = tag[1].lower() if tag and tag[1].lower() in names else None
        path = re.match(rf"(?i)[a-z][a-z0-9+.\-]*://[^/?#]*/(?:[^?#]*/)?({'|'.join(map(re.escape, names))})(?:[/?#]|$)", p.url or "")
        named = language_id.SUFFIXES.get(labels[-1])
        named = named if named in names else path[1].lower() if path else None
        found.append({"id": p.page_id, "host": host, "domain": ".".join(labels[-2:]), "suffix": labels[-1], "said": said, "named": named, "log": np.array(logs) - max(logs), "p": normal(logs)})
    size = len(names)

    def reliability(column):
        sums = {n: sum([f["p"] for f in found if f[column] == n], np.zeros(size)) for n in names}
        table = np.array([[sums[v][k] + (2.0 if v == names[k] else 0.5) for k in range(size)] for v in names])
        return dict(zip(names, np.log(table / table.sum(0)), strict=True))

    said, named = reliability("said"), reliability("named")
    add = lambda by, value: (sum(1 for f in found if f[by] == value), sum([f["p"] for f in found if f[by] == value], np.zeros(size)))
    whole = (sum(f["p"] for f in found) + 1.0) / (len(found) + size)
    out = {}
    for f in found:
        prior, s = whole, language_id.SMOOTHING
        for by in ("suffix", "domain"):
            n, sums = add(by, f[by])
            prior = (sums + s * prior) / (n + s)
        n, sums = add("host", f["host"])
        prior = (np.maximum(sums - f["p"], 0) + s * prior) / (n - 1 + s)
        zero = np.zeros(size)
        posterior = normal(f["log"] + (said[f["said"]] if f["said"] else zero) + (named[f["named"]] if f["named"] else zero) + np.log(prior))
        out[f["id"]] = (names[int(posterior.argmax())], posterior.max(), names[int(f["p"].argmax())], f["said"], f["named"], f["host"])
    return out


@pytest.mark.parametrize("hot_share", [1e-4, 0.1])
def test_languages_match_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(language_id, "HOT_SHARE", hot_share)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    odd = spark.createDataFrame([("some words (c of odd names", "c("), ("more such words", "c(")], "text string, lang string")
    docs = docs.unionByName(odd)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionByName(spark.createDataFrame([(-1, None, None), (-2, "http://x.example.fr/de/a?b", ""), (-3, "no address", "<html lang=EN>")], "page_id long, url string, html string"))
    want = naive_languages(pages.collect(), docs.collect())
    rows = language_id.identify(pages, docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        lang, confidence, text_lang, said, named, host = want[r.page_id]
        assert (r.lang, r.text_lang, r.declared, r.named, r.host) == (lang, text_lang, said, named, host) and abs(r.confidence - confidence) < 1e-4


def test_mixing_query_matches_its_sql(spark):
    import harness

    from tapeframe.llm import queries

    sf = "/root/testdata/sf0.01"
    for name, sql in queries.oracle_sql().items():
        assert harness.mismatch(spark, harness.oracle(sf), queries.queries()[name], sql, sf) == ""


def test_pipeline_stages(spark, docs):
    """The stages on real rows, on rows with nulls, ties and repeats, and on no rows."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.select(corpus_pipeline.COLUMNS)
    odd = odd.unionByName(odd.selectExpr("doc_id", "concat(text, ' more of it')", "lang", "source", "n_chars").toDF(*corpus_pipeline.COLUMNS))
    for rows in (real, odd, real.limit(0)):
        at, some = rows, not rows.isEmpty()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = common.cut_lineage(stage(spark, at, sf))
            assert left.columns == corpus_pipeline.COLUMNS, name
            if rows is real:
                assert not left.isEmpty(), name
            at = rows if left.isEmpty() and some else left  # the odd rows meet every stage
        coded = corpus_pipeline.STAGES[-1][1](spark, at, sf)
        assert coded.filter("not intact").isEmpty() and coded.count() == at.count() and (at.isEmpty() != some)


def test_pipeline_decides_as_its_operators(spark):
    """What run() gives against the operators' own verdicts, stage by stage, on plain collections."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    left = docs.filter(F.col("doc_id").isin(sorted(judged)))
    good = {r.doc_id for r in weak_labels.classify(left).filter("kept").collect()}
    rows = sorted((r.doc_id, r.text or "") for r in left.collect() if r.doc_id in good)
    label = classes_of([t for _, t in rows])
    kept = {rows[k][0] for k in set(label)}
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mixed_documents(docs.filter(F.col("doc_id").isin(sorted(kept)))).collect()}
    found = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
    times = {k: t // n + (2 * (t % n) >= n and t % n > 0) for k, (t, n) in taken.items()}
    assert found == {k: n for k, n in times.items() if n}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ValueError):
        common.shared_folder(Session())
