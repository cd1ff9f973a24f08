import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from likeness.llm import packing, pretokens
from likeness.llm.common import table
from likeness.llm.marked_words import crossing_pieces, encode_and_decode
from likeness.llm.packing import BestFit, encode_pieces, pack_documents
from likeness.llm.token_counts import count_tokens
from tests.llm.fixtures import odd_docs

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(params=["odd", "table"])
def docs(request, spark, sf_dir):
    return odd_docs(spark) if request.param == "odd" else table(spark, sf_dir, "documents")


def test_whole_tokens_are_proven(tokenizer):
    whole = pretokens.whole_tokens(BYTE_BPE)
    assert len(whole) > 40_000
    some = list(whole.items())[::97]
    assert all(tokenizer.encode(t).ids == [i] for t, i in some)


def test_code_points_that_split_differently_are_all_left_to_the_library(tokenizer):
    """Between the pattern's library and the vocabulary's only code points new to Python may differ."""
    split, unsure = regex.compile(pretokens.PATTERN), regex.compile(pretokens._unassigned())
    for code in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000), *range(0x323A0, 0x323C0)]:
        text = f"a{chr(code)}1{chr(code)} {chr(code)}?"
        if [m.span() for m in split.finditer(text)] != [o for _, o in tokenizer.pre_tokenizer.pre_tokenize_str(text)]:
            assert unsure.search(chr(code)), hex(code)


def test_near_pattern_splits_as_the_full_one():
    import re

    near, full = re.compile(pretokens.near_pattern()), regex.compile(pretokens.PATTERN)
    for code in range(pretokens.NEAR + 1):
        c = chr(code)
        for text in (f"a{c}1{c} {c}?{c}", f"{c}{c} {c}x  {c}\n{c}", f"don't{c}'s 9{c}"):
            assert near.findall(text) == full.findall(text), hex(code)


def test_counts_equal_the_library(docs, tokenizer):
    got = count_tokens(docs.withColumn("n_tokens", F.lit(1)), BYTE_BPE, 100).toPandas()
    want = docs.select("doc_id", "text").toPandas()
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in want.text]
    assert got.n_tokens.tolist() == n
    assert got.n_bytes.tolist() == [len((t or "").encode()) for t in want.text]
    assert got.over_limit.tolist() == [x > 100 for x in n]


def test_table_is_bounded(tokenizer):
    table_ = pretokens.PretokenTable(BYTE_BPE, pretokens.whole_tokens(BYTE_BPE), len, entries=10)
    text = " ".join(f"zqx{i}yw" for i in range(500))
    assert sum(table_.values(text)) == len(tokenizer.encode(text).ids)
    table_.trim()
    assert sum(table_.values(text)) == len(tokenizer.encode(text).ids)


def _check_packing(got, want_ids, size):
    for doc_id, ids in want_ids.items():
        own = got[got.doc_id == doc_id].sort_values("piece")
        lengths = own.length.tolist()
        assert sum(lengths) == len(ids) and lengths[1:] == [size] * (len(lengths) - 1)
        for r in own.itertuples():
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        assert rows.length.sum() <= size


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_is_gapless_and_complete(docs, tokenizer, size):
    got = pack_documents(docs, BYTE_BPE, size).toPandas()
    rows = docs.select("doc_id", "text").dropDuplicates().toPandas()
    rows = rows[rows.doc_id.notna() & (rows.doc_id != 5)]
    ids = {int(i): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(rows.doc_id, rows.text)}
    _check_packing(got, ids, size)
    assert len(got[got.doc_id.isna()]) == docs.filter("doc_id is null").count()


def test_packing_is_close_to_the_bound(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('the cat ', cast(1 + xxhash64(id) % 300 + 300 as int)) text")
    got = pack_documents(docs, BYTE_BPE).toPandas()
    least = -(-got.length.sum() // 2048)
    assert got.sequence_id.nunique() <= least * 1.02 + 3


def test_pieces_carry_their_ids(spark, tokenizer):
    got = encode_pieces(odd_docs(spark).filter("doc_id = 25"), BYTE_BPE, 100, 0, True).orderBy("piece").toPandas()
    ids = [i for part in got.ids for i in part]
    assert ids == [*tokenizer.encode("ab " * 9000).ids, 0] and set(got.length[1:]) == {100}


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = BestFit(10, 2)
    assert fit.place(4) == (0, 0) and fit.place(7) == (1, 0)
    assert fit.place(3) == (1, 7)
    assert fit.place(8) == (2, 0)
    assert fit.place(9) == (3, 0)  # the bin with 2 free closes
    assert fit.place(2) == (0, 4)
    free = defaultdict(int)
    assert all(v >= 0 for v in free.values()) and fit.n_open == 2


def _plain_best_fit(lengths, size, open_bins):
    """The same by looking at every open bin: tightest fit (the newest of equals), fullest closes first."""
    free, made, out = {}, 0, []  # sequence -> (free space, when it was last filled)
    for at, length in enumerate(lengths):
        fitting = [(room, -when, n) for n, (room, when) in free.items() if room >= length]
        if fitting:
            room, _, n = min(fitting)
            del free[n]
        else:
            room, n, made = size, made, made + 1
        out.append((n, size - room))
        if room > length:
            if len(free) >= open_bins:
                del free[min((r, -when, k) for k, (r, when) in free.items())[2]]
            free[n] = (room - length, at)
    return out


@pytest.mark.parametrize(("size", "open_bins"), [(20, 1), (50, 4), (50, 1000), (2048, 30)])
def test_best_fit_equals_a_linear_scan(size, open_bins):
    r = np.random.default_rng(size + open_bins)
    lengths = r.integers(1, size + 1, 1500).tolist()
    fit = BestFit(size, open_bins)
    assert [fit.place(n) for n in lengths] == _plain_best_fit(lengths, size, open_bins)


def test_copies_and_missing_ids_spread_over_packers(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACKED_BY_TASK", 50)
    docs = spark.range(400).selectExpr("if(id % 2 = 0, null, 7) doc_id", "'the same text' text")
    got = pack_documents(docs, BYTE_BPE, 8).toPandas()
    by_packer = (got.sequence_id // (1 << 36)).value_counts()
    assert len(got) == 400 and len(by_packer) == 8 and by_packer.max() < 100


def test_marked_words_equal_the_library(docs):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = encode_and_decode(docs, PIECE_BPE).toPandas()
    for text, r in zip(docs.select("text").toPandas().text, got.itertuples()):
        ids = processor.encode(text or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()


def test_no_piece_crosses_white_space():
    assert crossing_pieces(PIECE_BPE) == []


def test_empty_tables(spark):
    none = odd_docs(spark).limit(0)
    assert count_tokens(none, BYTE_BPE).count() == 0
    assert encode_and_decode(none, PIECE_BPE).count() == 0
    assert pack_documents(none, BYTE_BPE).count() == 0
