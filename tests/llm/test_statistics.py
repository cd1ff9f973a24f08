"""Repeated passages, source divergence and collocations against plain counting."""

import collections
import hashlib
import itertools
import re
import timeit

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.llm import collocations, repeated_passages
from likeness.llm.collocations import radix_order
from likeness.llm.divergence import divergence
from likeness.llm.repeated_passages import SuffixAutomaton, without_repeats
from likeness.operators import joins
from tests.llm.fixtures import DOC_SCHEMA, odd_docs

# Repeated passages.


def _without_repeats(rows, length=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for j in range(length)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def _passage_rows():
    r = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in r.integers(0, 400, n)]
    shared = [word(n) for n in (13, 14, 40, 200, 12)]
    rows = []
    for i in range(120):
        parts = [word(int(r.integers(0, 60)))]
        for p in r.choice(5, int(r.integers(0, 4))):
            parts += [shared[p], word(int(r.integers(0, 30)))]
        rows.append((i, " ".join(itertools.chain(*parts))))
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(300, "ab " * 300), (301, "ab " * 300 + "cd " * 13), (302, "cd " * 14), (303, None), (304, ""), (305, " \t\n"), (306, "one"), (None, rows[0][1]), (None, None)]
    rows += [(3, rows[3][1]), (3, rows[7][1]), (310, " ".join(word(5000))), (311, "né x  y " * 20), (312, "né x  y " * 20), (-5, rows[9][1])]
    return rows


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC_SCHEMA).repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_repeated_passages_equal_plain_search(spark, monkeypatch, small):
    if small:  # many shards, salts, grams that go window by window or are set apart, joins without broadcasts
        for name, value in (("SHARD_ROWS", 20), ("STREAM_ROWS", 30), ("HOT_KEYS", 50), ("BROADCAST_IDS", 10)):
            monkeypatch.setattr(repeated_passages, name, value)
        monkeypatch.setattr(joins, "HOT_ROWS", 20)
    rows = _passage_rows()
    got = without_repeats(_docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == _without_repeats(rows)


def test_repeated_passages_of_odd_rows_and_lengths(spark):
    odd = odd_docs(spark).withColumn("spans", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("marks", F.lit(3))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, without_repeats(odd).collect()), key=repr) == _without_repeats(rows)
    assert sorted(map(tuple, without_repeats(odd, length=3).collect()), key=repr) == _without_repeats(rows, 3)
    assert without_repeats(odd.limit(0)).collect() == []


def test_automaton_knows_every_run_and_its_first_document():
    r = np.random.default_rng(0)
    passages = [(r.integers(0, 3, int(r.integers(1, 12))).tolist(), int(d)) for d in r.permutation(40)]
    automaton = SuffixAutomaton()
    for words, doc in passages:
        automaton.add(words, doc)
    automaton.close()
    for length in (1, 3, 5):
        for words in [w for w, _ in passages] + [r.integers(0, 4, 20).tolist() for _ in range(20)]:
            want = []
            for end in range(1, len(words) + 1):
                run = words[max(0, end - length) : end]
                has = [d for w, d in passages if any(w[k : k + length] == run for k in range(len(w) - length + 1))] if len(run) == length else []
                want.append(min(has, default=None))
            assert list(automaton.matches(words, length)) == want


def test_words_of_many_texts_are_hashed_together():
    long = b"y" * 700
    texts = [b"\t a  b\r\n" + long + b" a", None, b"", b" \x0b ", b"a b " + long + b"z", "né x".encode(), *(b" ".join(b"w%d" % (k * j % 17) for k in range(40)) for j in range(1, 6))]
    data, begins, ends, first = repeated_passages._words(texts)
    words = [[data[a:b] for a, b in zip(begins[i:j].tolist(), ends[i:j].tolist())] for i, j in itertools.pairwise(first.tolist())]
    assert words == [(t or b"").split() for t in texts]
    codes = repeated_passages._codes(data, begins, ends)
    assert len(set(zip(itertools.chain(*words), codes.tolist()))) == len(set(itertools.chain(*words))) == len(set(codes.tolist()))
    least, at, of = repeated_passages.least_grams(codes, first, 13, 5)
    assert [(i, int(first[i]) + k) for i, w in enumerate(words) for k in range(len(w) - 12)] == list(zip(of.tolist(), at.tolist()))
    by_words = collections.defaultdict(set)
    for k, i, gram in zip(at.tolist(), of.tolist(), least.tolist()):
        by_words[tuple(words[i][k - first[i] : k - first[i] + 13])].add(gram)
    assert all(len(grams) == 1 for grams in by_words.values())


def test_least_grams_of_many_distinct_words_cost_little_more_than_splitting():
    """More words than a table holds: looked up one by one they took some eight times the time."""
    text = b" ".join(b"w%d" % n for n in np.random.default_rng(0).permutation(600_000))

    def hashed():
        data, begins, ends, first = repeated_passages._words([text])
        repeated_passages.least_grams(repeated_passages._codes(data, begins, ends), first, 13, 5)

    assert min(timeit.repeat(hashed, number=1, repeat=5)) < 5 * min(timeit.repeat(text.split, number=1, repeat=5))


def test_closing_looks_at_long_runs_alone():
    r = np.random.default_rng(0)
    passages = [(r.integers(0, 50, 17).tolist(), int(d)) for d in r.permutation(200)]
    passages += [(words[2:] + [99], doc - 1000) for words, doc in passages[:30]]
    for length in (1, 13):
        automaton = SuffixAutomaton()
        for words, doc in passages:
            automaton.add(words, doc)
        automaton.close(length)
        for words, _ in passages:
            want = [min(d for w, d in passages if any(w[k : k + length] == words[end - length : end] for k in range(len(w) - length + 1))) for end in range(length, len(words) + 1)]
            assert list(automaton.matches(words, length)) == [None] * (length - 1) + want


# Divergence of sources.


def _divergence(rows, least, most):
    langs = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    held = collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        langs[lang or ""][source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang, groups in langs.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), collections.Counter()))
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, bound in (("pair", pairs, 10**9), ("term", terms, most)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:bound]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_equals_plain_counting(spark):
    r = np.random.default_rng(2)
    words = ["The", "the", "naïve", "ÉTÉ", "été", "a1b", "x-y", "日本", "zeta", "Zeta", "q"]
    rows = [(l, s, " ".join(r.choice(words, int(r.integers(0, 30))))) for l, s in [("en", "a"), ("en", "b"), ("en", "c"), ("de", "a"), (None, None), ("en", None), ("fr", "x"), ("fr", "y")] for _ in range(12)]
    rows += [("en", "a", None), ("it", "empty", ""), ("it", "also", "12 34"), ("en", "a", "the " * 5000), ("pt", "alone", "q")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("rank", F.lit(1)).repartition(3)
    for least, most in ((5, 3), (1, 50), (1000, 50)):
        assert sorted(map(tuple, divergence(df, least, most).collect())) == _divergence(rows, least, most)
    assert divergence(df.limit(0)).collect() == []
    assert "Arrow" not in divergence(df)._jdf.queryExecution().toString() and "Python" not in divergence(df)._jdf.queryExecution().toString()


# Collocations.


def _collocations(rows, least, longest, percent, most):
    langs = collections.defaultdict(list)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        langs["und" if lang is None else lang] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]
    out = []
    for lang, pieces in langs.items():
        n = sum(map(len, pieces))
        f = collections.Counter(tuple(p[i : i + m]) for p in pieces for m in range(1, longest + 1) for i in range(len(p) - m + 1))
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        inner = collections.defaultdict(int)
        for w, a in candidates.items():
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    inner[w[i : i + size]] = max(inner[w[i : i + size]], a)
        found = []
        for w, a in candidates.items():
            if 100 * inner[w] >= percent * a:
                continue
            score, k = min((1000 * a * n // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), " ".join(w), a, f[w[:k]], f[w[k:]], n, score))
        out += [(lang, k, *row[3:]) for k, row in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def _texts():
    r = np.random.default_rng(6)
    words = ["New", "york", "city", "of", "the", "naïve", "日本", "a", "b", "c\x00d"]
    rows = [(lang, "".join(x + str(r.choice([" ", "  ", "\t", ", ", ".", "\n", " "])) for x in r.choice(words, int(r.integers(0, 120))))) for lang in ("en", "de", None, "und") for _ in range(40)]
    return [*rows, ("en", None), ("fr", ""), ("en", "New york city of the " * 400), ("it", "x " * 300), ("it", "!?."), (None, None)]


@pytest.mark.parametrize("broadcast_words, buffer", [(500_000, 1 << 20), (0, 1 << 20), (500_000, 50), (0, 50)])
def test_collocations_equal_plain_counting(spark, monkeypatch, broadcast_words, buffer):
    monkeypatch.setattr(collocations, "BUFFER", buffer)
    monkeypatch.setattr(joins, "HOT_ROWS", 10_000 if buffer > 50 else 5)
    rows = _texts()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, key int, n int").repartition(3)
    cases = [(20, 5, 100, 2000), (3, 3, 60, 7)] if broadcast_words else [(5, 5, 100, 2000)]
    for case in cases:
        want = _collocations(rows, *case)
        assert want and sorted(map(tuple, collocations.collocations(df, *case, broadcast_words=broadcast_words).collect())) == want
    assert collocations.collocations(df.limit(0), broadcast_words=broadcast_words).collect() == []


def test_radix_order_sorts():
    keys = np.random.default_rng(0).integers(0, 2**32, (3, 500), dtype=np.uint64).astype(np.uint32) >> np.uint32(8)
    keys[0] %= 3
    assert keys[:, radix_order(keys)].T.tolist() == sorted(keys.T.tolist())


def test_digests_of_the_query(spark, sf_dir):
    from likeness.llm.catalog import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {i: hashlib.sha256(kept.encode()).hexdigest() for i, _, _, kept in _without_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])}
    assert {r.doc_id: r.kept_sha256 for r in QUERIES["op11_repeated_passages"](spark, sf_dir).collect()} == want
