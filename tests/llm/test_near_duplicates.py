import random

import numpy as np
import pytest

from likeness.llm import near_duplicates as D
from likeness.llm.common import table
from likeness.sources.scratch import Scratch
from likeness.operators.components import components
from tests.llm.fixtures import odd_docs

SPACE = " \t\n\r\x0b\x0c"


def _words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def _set(text, width):
    words = _words(text)
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def _brute(rows, width, percent=80):
    """{doc_id: (size, smallest reachable id)} by comparing all pairs."""
    sets, up = {i: _set(t, width) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(s), top(i)) for i, s in sets.items()}


def _compare(docs, width):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None]
    want = _brute(rows, width)
    got = D.near_duplicates(docs, width).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


@pytest.mark.parametrize("width", [4, 5])
def test_table(spark, sf_dir, width):
    _compare(table(spark, sf_dir, "documents"), width)


def test_odd_texts(spark):
    _compare(odd_docs(spark).withColumnRenamed("n_chars", "n_shingles").withColumnRenamed("source", "label"), 4)


def _clusters(seed, loose):
    """A large group of copies of one text with edits, chains of edits, a shared passage, short texts."""
    r = random.Random(seed)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, passage, out = text(200), text(60), []
    for _ in range(120):
        own = list(base)
        for _ in range(r.randrange(0, loose)):
            own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
        out.append(own)
    chain = text(100)
    for _ in range(25):
        chain = list(chain)
        for _ in range(2):
            chain[r.randrange(len(chain))] = f"c{r.randrange(10**6)}"
        out.append(chain)
    out += [text(80) + passage + text(r.randrange(200)) for _ in range(60)]
    out += [[r.choice("abc") for _ in range(r.randrange(1, 6))] for _ in range(40)]
    out += [list(base) for _ in range(30)]
    r.shuffle(out)
    return [(i * 3 - 50, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("seed", "loose", "short"), [(1, 4, 32), (2, 9, 2), (3, 14, 8), (4, 9, 1000)])
def test_clusters(spark, seed, loose, short, monkeypatch):
    monkeypatch.setattr(D, "SHORT_LIST", short)
    monkeypatch.setattr(D, "BLOCK", 16)
    monkeypatch.setattr(D, "BROADCAST_IDS", 10)
    _compare(spark.createDataFrame(_clusters(seed, loose), "doc_id long, text string"), 4)


def test_one_of_each_stays(spark):
    rows = _clusters(5, 6)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows] + [(None, rows[0][1], None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = D.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in _brute(rows, 5).items() if i == c}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_empty(spark):
    assert D.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_match_threshold_misses_rarely():
    assert 30 <= D.match_threshold(64, 80) <= 40
    r, sign, low = np.random.default_rng(0), D.Signer(64), []
    for _ in range(200):
        common, a, b = (r.integers(-(2**63), 2**63 - 1, n) for n in (800, 100, 100))
        low.append(int((sign(np.concatenate([common, a])) == sign(np.concatenate([common, b]))).sum()))
    assert min(low) >= D.match_threshold(64, 80) and 48 < np.mean(low) < 54


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200 + i, 300) for i in range(50)] + [(7, 7), (None, 3), (500, 499)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert all(got[i] == 0 for i in range(101)) and all(got[200 + i] == 200 for i in range(50)) and got[300] == 200 and got[500] == 499 and 7 in got and len(got) == 101 + 51 + 2


def _component_of_rows(rows, width=4, percent=80):
    """{doc_id: smallest reachable id} where rows that share an id are one document."""
    ids = {i for i, _ in rows}
    label, moved = {i: i for i in ids}, True
    sets = [(i, _set(t, width)) for i, t in rows]
    links = [(i, j) for i, x in sets for j, y in sets if x and y and 100 * len(x & y) >= percent * len(x | y)]
    while moved:
        moved = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                moved = True
    return label


A, B, C = ("one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen fifteen sixteen")


@pytest.mark.parametrize("rows", [
    [(5, A), (3, A), (5, B), (9, B)],
    [(5, ""), (5, B), (3, B), (8, None), (8, "")],
    [(7, A), (7, B), (7, C), (2, C), (9, A), (4, "x")],
    [(7, A), (7, A), (7, None)],
    [(1, A), (2, A), (2, B), (3, B), (3, C), (4, C), (4, ""), (5, "")],
])
def test_rows_that_share_an_id_are_one_document(spark, rows, monkeypatch):
    for bound in (1_000_000, 0):
        monkeypatch.setattr(D, "BROADCAST_IDS", bound)
        docs = spark.createDataFrame([*rows, (None, A)], "doc_id long, text string")
        want, got = _component_of_rows(rows), D.near_duplicates(docs, 4).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (want[r.doc_id], want[r.doc_id] == r.doc_id))
        kept = D.keep_one_of_each(docs, 4).collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i, c in want.items() if i == c) and sum(r.doc_id is None for r in kept) == 1
