"""Lexical search, collocations and line removal against brute force, and kernels on very long texts."""

import collections
import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from tapeframe.llm import bpe, collocations, common, lexical_search, line_dedup, near_dedup, quality_rules, toxicity, weak_labels

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, h string, n long, rank int, score double, kept string, dropped int, n_lines int"


def prose(seed, n, letters="abcd", most=2):
    r = random.Random(seed)
    return "".join("".join(r.choice(letters) for _ in range(r.randint(1, most))) + r.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\t"]) for _ in range(n))


def edge_docs(spark):
    """Nulls in any column, empty, white and long texts, ties, repeated rows, clashing extra columns."""
    more = ("x", 1, 1, 0.5, "k", 1, 1)
    rows = [(k, prose(k, 60), ["en", "de", None][k % 3], "s", *more) for k in range(60)]
    rows += [(100, None, None, None, *[None] * 7), (101, "", "en", "s", *more), (102, " \n\t\n ", "en", "s", *more), (None, "ab cd\nab", "en", None, *more)]
    rows += [(103, prose(1, 60), "en", "s", *more)] * 3 + [(104, prose(9, 4000), "en", "s", *more), (105, "É é ÀB àb Ab.aB\x0bab;ab ab ab", "fr", "s", *more)]
    rows += [(200 + k, f"  Shared Line\x0c\nown {k}\nSHARED line\n\nTail é" + "\n" * (k % 3), "en", "s", *more) for k in range(12)]
    rows += [(300 + k, "we may say so now, " * 3 + "we may say it", "en", "s", *more) for k in range(5)]
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


# ---------------------------------------------------------------- lines


def naive_lines(rows, limit):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = collections.Counter(k for text in rows for k in {key(x) for x in (text or "").split("\n")} if k)
    out = []
    for text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if found[key(x)] < limit]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("limit", "batches"), [(10, 4), (2, 1), (3, 7)])
def test_lines_match_brute_force(spark, limit, batches):
    df, rows = edge_docs(spark)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.deduplicated(df, limit=limit, batches=batches).collect()]
    want = [(row[0], *x) for row, x in zip(rows, naive_lines([r[1] for r in rows], limit), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.report(df.limit(0)).collect() == []
    assert {r.kept_sha256 for r in line_dedup.report(df, limit=limit).collect()} == {hashlib.sha256(x[3].encode()).hexdigest() for x in want}


def test_lines_beyond_the_broadcast_bound(spark, monkeypatch):
    """With few rows allowed for broadcast, hot lines and others take different ways to the same result."""
    monkeypatch.setattr(line_dedup, "SMALL_ROWS", 3)
    df, rows = edge_docs(spark)
    got = sorted((r.n_lines, r.n_dropped, r.kept) for r in line_dedup.deduplicated(df, limit=2).collect())
    assert got == sorted(naive_lines([r[1] for r in rows], 2))


def test_line_runs_are_compacted_and_leave_settled_hashes_out(spark, tmp_path):
    store = line_dedup.LineRuns(spark, str(tmp_path / "runs"), limit=3, fanout=2)
    batches = [[(1, 5), (2, 1)], [(1, 4), (2, 1), (3, 1)], [(2, 1), (3, 1)], [(1, 9), (4, 2)], [(3, 1)]]
    for rows in batches:
        store.add(spark.createDataFrame([(h, -h, n) for h, n in rows], "h long, g long, n long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    (whole,) = store.levels[2]
    assert {r.h: r.n for r in spark.table(whole).collect()} == {1: 5, 2: 3, 3: 2, 4: 2}, "the later documents of hash 1 are left out"
    assert {r.h for r in store.common().collect()} == {1, 2, 3}
    plan = spark.table(whole).join(spark.table(whole).hint("merge"), ["h", "g"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    store.close()


# ---------------------------------------------------------------- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def naive_search(docs, items, k=10):
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // n_all
            s = sum(times * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in collections.Counter(TERM.findall((text or "").translate(LOWER))).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def items_of(spark):
    rows = [(k, prose(900 + k, n)) for k, n in enumerate([1, 2, 5, 30, 300])] + [(7, None), (8, ""), (9, "zz zz nowhere"), (None, "ab a ab"), (10, "É é"), (10, "É é")]
    return spark.createDataFrame([(*r, 1, 1) for r in rows], "item_id long, text string, rank int, item int"), rows


@pytest.mark.parametrize(("shard", "walk"), [(1 << 18, 1 << 19), (60, 40)])
def test_search_equals_brute_force(spark, monkeypatch, shard, walk):
    monkeypatch.setattr(lexical_search, "WALK_POSTINGS", walk)
    df, rows = edge_docs(spark)
    items, asked = items_of(spark)
    size = lexical_search.corpus_size(df)
    index = common.cut_lineage(lexical_search.index(df, size, shard_postings=shard))
    assert (index.count() > 10) == (shard < 100)
    got = [tuple(r) for r in lexical_search.search(index, size[0], items).collect()]
    assert sorted(got, key=repr) == sorted(naive_search([r[:2] for r in rows], asked), key=repr)


def test_search_of_empty_tables_and_in_blocks(spark, monkeypatch):
    df, rows = edge_docs(spark)
    items, asked = items_of(spark)
    assert lexical_search.ranked(df.limit(0), items).collect() == [] == lexical_search.ranked(df, items.limit(0)).collect()
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 50)
    got = [tuple(r) for r in lexical_search.ranked(df, items, k=3).collect()]
    assert sorted(got, key=repr) == sorted(naive_search([r[:2] for r in rows], asked, 3), key=repr)


def test_treaps_are_trees_by_document_and_heaps_by_impact():
    r = random.Random(3)
    docs, impacts, ends = [], [], []
    for n in (1, 2, 50, 400):
        docs += sorted(r.sample(range(1000), n))
        impacts += [r.choice([5, 5, 5, 9, r.randint(1, 20)]) for _ in range(n)]
        ends.append(len(docs))
    docs, impacts, ends = np.array(docs, np.int32), np.array(impacts, np.int32), np.array(ends, np.int32)
    left, right, tops = lexical_search.treaps(docs, impacts, ends)

    def check(at, low, high):
        if at < 0:
            return 0, 0
        assert low < docs[at] < high
        below = [check(left[at], low, docs[at]), check(right[at], docs[at], high)]
        assert all(impacts[c] <= impacts[at] for c in (left[at], right[at]) if c >= 0)
        return 1 + sum(b[0] for b in below), 1 + max(b[1] for b in below)

    found = [check(int(t), -1, 1000) for t in tops]
    assert [n for n, _ in found] == [1, 2, 50, 400] and found[-1][1] < 60, "equal impacts make no chains"


def test_the_walk_leaves_most_postings_out():
    """A query whose best documents stand out is answered from a small part of its postings."""
    r = random.Random(4)
    n = 4000
    docs = np.tile(np.arange(n, dtype=np.int32), 3)
    impacts = np.array([r.randint(1, 100) for _ in range(3 * n)], np.int32)
    for d in (17, 901, 3333):
        impacts[[d, n + d, 2 * n + d]] = 5000
    ends = np.array([n, 2 * n, 3 * n])
    left, right, tops = lexical_search.treaps(docs, impacts, ends)
    steps, within = [], lexical_search._within

    def counted(at, *rest):
        steps.append(len(at))
        return within(at, *rest)

    lexical_search._within = counted
    try:
        best = lexical_search.walk(np.zeros(3, np.int64), tops, np.array([3, 2, 1]), np.zeros(1, np.int64), 3, n, docs, impacts, left, right)
    finally:
        lexical_search._within = within
    assert best.doc.tolist() == [17, 901, 3333] and sum(steps) < n / 10


# ---------------------------------------------------------------- phrases


def naive_phrases(rows, least, longest, top):
    counts, sizes = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    common = {p: a for p, a in counts.items() if a >= least}
    out = []
    for lang in sizes:
        found = []
        for (of, words), a in common.items():
            if of != lang or len(words) < 2:
                continue
            cuts = [(1000 * a * sizes[lang] // (common[lang, words[:k]] * common[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: B023, E731
            if not any(o == lang and len(w) > len(words) and b >= a and inside(w) for (o, w), b in common.items()):
                found.append((-score, -a, " ".join(words).encode(), common[lang, words[:k]], common[lang, words[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, sizes[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return out


@pytest.mark.parametrize(("shard", "group", "merged"), [(1 << 20, 1 << 17, 1 << 21), (64, 10, 20)])
def test_collocations_equal_brute_force(spark, monkeypatch, shard, group, merged):
    for name, value in (("SHARD", shard), ("GROUP", group), ("MERGED", merged)):
        monkeypatch.setattr(collocations, name, value)
    df, rows = edge_docs(spark)
    got = [tuple(r) for r in collocations.collocations(df, least=6, top=300).collect()]
    want = naive_phrases([(r[1], r[2]) for r in rows], 6, 5, 300)
    assert sorted(got) == sorted(want) and {len(r[2].split()) for r in want} >= {2, 3, 5}
    assert collocations.collocations(df.limit(0)).collect() == []


def test_a_sieve_that_lets_all_through_changes_nothing(spark, monkeypatch):
    df, rows = edge_docs(spark)
    monkeypatch.setattr(collocations.Sieve, "has", lambda self, keys: np.ones(len(keys), bool))
    got = [tuple(r) for r in collocations.collocations(df.filter("lang = 'en'"), least=12, top=50).collect()]
    assert sorted(got) == sorted(naive_phrases([(r[1], r[2]) for r in rows if r[2] == "en"], 12, 5, 50))


def test_bitmaps_of_a_shard():
    r = np.random.default_rng(5)
    codes = r.integers(0, 4, 500).astype(np.int32)
    counts = collections.Counter()
    hashes = np.arange(4, dtype=np.uint64)
    collocations.grow(codes, 480, hashes, 4, lambda k, whole, tail, n, chain: [counts.update({tuple(c): x}) for c, x in zip(chain.tolist(), n.tolist(), strict=True)] and np.ones(len(n), bool))
    want = collections.Counter()
    for k in range(1, 5):
        for i in range(480):
            if (phrase := tuple(codes[i : i + k].tolist())) and len(phrase) == k and all(phrase):
                want[phrase] += 1
    assert counts == want


# ---------------------------------------------------------------- very long texts


def test_hashed_runs_in_segments(monkeypatch):
    solid = np.ones(256, bool)
    solid[[0x20, 0x0A]] = False
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "bc", " ", "\n", "x" * 40, "é" * 9]) for _ in range(r.randint(0, 60))).encode() for _ in range(50)] + [b"y" * 500, b"", b" ", b"z" * 64]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = common.hashed_runs(data, offsets, solid)
    spans = [(s + a, s + b) for s, t in zip(offsets, texts, strict=False) for a, b in (m.span() for m in re.finditer(rb"[^ \n]+", t))]
    assert list(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == spans
    by = collections.defaultdict(set)
    for (a, b), h in zip(spans, whole[2].tolist(), strict=True):
        by[data[a:b].tobytes()].add(h)
    assert all(len(h) == 1 for h in by.values()) and len({next(iter(h)) for h in by.values()}) == len(by)
    monkeypatch.setattr(common, "SLICE_BYTES", 32)
    monkeypatch.setattr(common, "_powers", {})
    for a, b in zip(whole, common.hashed_runs(data, offsets, solid), strict=True):
        assert (a == b).all()
    assert (common.tally(data, offsets, solid) == [sum(c not in b" \n" for c in t) for t in texts]).all()


def test_kernels_need_little_memory_on_a_long_text():
    """20 MB of text in each kernel: at most 20 bytes for each byte, and the worker keeps no table of that size."""
    import tracemalloc

    word = np.frombuffer(prose(1, 200_000, string.ascii_lowercase, 9).encode(), np.uint8)
    data = np.tile(word, -(-20_000_000 // len(word)))
    offsets = np.array([0, len(data)])
    kernels = [
        lambda: quality_rules.measured(data, offsets),
        lambda: weak_labels.measures(data, offsets),
        lambda: weak_labels.Scorer(np.zeros((1 << weak_labels.BITS) + weak_labels.BINS * len(weak_labels.LABELLERS), np.float32), 0.0).logits(data, offsets),
        lambda: near_dedup.samples(near_dedup.labelled(near_dedup.shingled(*near_dedup.worded(data, offsets))[0])),
        lambda: lexical_search.n_terms(data, offsets),
    ]
    for run in kernels:
        tracemalloc.start()
        run()
        kept, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < 20 * len(data) and kept < 40 << 20
    assert all(len(p) <= common.SLICE_BYTES + 1 for p in common._powers.values())


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as P

    return bpe.Coder(bpe.rank_table(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.mark.parametrize("n", [1_000_000, 5_000_000])
@pytest.mark.parametrize("blank", [" ", "\n", "\t"])
def test_millions_of_blanks_are_encoded(coder, blank, n):
    tail = coder.encode(blank + "!")
    for before, after in (("", ""), ("", "!"), ("a b", ""), ("a b", "!")):
        text = before + blank * n + after
        ids = coder.encode(text)
        assert coder.decode(ids) == text.encode()
        assert not after or ids[-len(tail) :] == tail


def test_blank_runs_are_the_pattern_s_matches(coder, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_BLANK", 3)
    monkeypatch.setattr(bpe, "_BLANK", re.compile(f"(?<![{bpe._WHITE}])[{bpe._WHITE}]{{3,}}"))
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice(["a", "B", "'s", " ", "  ", "\n", "\t", "9", "é", "\x1c", "\x85", "　", "   ", "!", "😀"]) for _ in range(r.randint(0, 40)))
        assert coder.encode(text) == coder._encode(text)


def test_exception_phrases_in_linear_time():
    import time

    model = toxicity.Model({" trash": 1.0, " idio": 1.0, " can ": 1.0})
    tree = model.automaton()
    text = toxicity.folded("trash can idiot trash idiot proof clown can " * 70_000)
    began = time.time()
    found = toxicity.hits(tree, text)
    assert len(text) > 3_000_000 and time.time() - began < 10
    r = random.Random(1)
    for _ in range(300):
        said = toxicity.folded(" ".join(r.choice(["trash", "can", "idiot", "proof", "idiots", "light"]) for _ in range(r.randint(0, 12))))
        exempt = [(e - n + 1, e + 1) for e, (k, n) in tree.iter(said) if k < 0]
        want = [k for e, (k, n) in tree.iter(said) if k >= 0 and not any(x <= e - n + 1 and e - n + 2 < y for x, y in exempt)]
        assert toxicity.hits(tree, said) == want
    assert found


def test_queries_of_the_new_operators(spark, tmp_path):
    from tapeframe.llm import queries

    df, rows = edge_docs(spark)
    items, asked = items_of(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op13_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.n_lines, r.n_dropped) for r in found) == sorted(x[:2] for x in naive_lines([r[1] for r in rows], 10))
    got = [tuple(r) for r in queries.op11_lexical_search(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(naive_search([r[:2] for r in rows], asked), key=repr)
    df.crossJoin(spark.range(12)).drop("id").write.parquet(f"{tmp_path}/twelve/documents.parquet")
    got = [tuple(r) for r in queries.op12_collocations(spark, f"{tmp_path}/twelve").collect()]
    assert sorted(got) == sorted(naive_phrases([(r[1], r[2]) for r in rows] * 12, 100, 5, 2000)) and got
