"""Substring deduplication: words in passages that an earlier document has, too, go; by suffix automata.

A window is ``length`` consecutive words of one document; a word goes if a window covers it whose words
also stand in a document with a smaller id, as the input has them.

1. Every window is known by its least gram (the smallest hash of its runs of ``GRAM`` words), which
   equal windows share. Grams of one document alone need no further look.
2. Stretches of windows with one shared least gram become passages, a few words longer than a window.
   They are dealt by the gram's hash to reference shards; a gram of more than ``SHARD_ROWS`` documents
   is dealt window by window, by a hash of all its words, so that no shard follows one gram.
3. A shard's reference is its distinct passages with the smallest document of each (copies combine
   before the shuffle). Its suffix automaton has the smallest document of every run of words in it.
   The shard is copied to as many salts as its documents' passages need, so one passage that a third
   of all documents share is spread; a task holds an automaton and its share of passages. The
   reference grows with the corpus, so it is sent to its shards' salts and not to every task.
4. Documents' passages stream through the automaton for their matching statistics: at each word the
   state of the longest match, of which ``length`` words are asked for, tells the first document that
   has them. Where that is an earlier one, the window's words go; adjoining windows make maximal spans.

Hashes only choose where passages meet; equality is that of the words themselves.

Defined results: null and empty texts have no words; rows without id lose nothing and are nobody's
earlier document; rows that share an id count as one document's, so none is earlier than the other;
further columns, also of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from likeness.llm.common import in_small_batches
from likeness.operators.joins import join_unique
from likeness.sources.scratch import Scratch

LENGTH = 13
GRAM = 5
#: Passages of a shard's reference, and of documents that one task streams past it, about.
SHARD_ROWS = 8192
STREAM_ROWS = 65_536

#: Grams that are set apart as the most frequent ones, at most; ids that are broadcast, beyond which a shuffle joins them.
HOT_KEYS = 10_000
BROADCAST_IDS = 1_000_000

#: Bytes of texts that are hashed together, about; beyond so many bytes of a word another hash takes over.
BLOCK_BYTES = 1 << 19
LONG_WORD = 256

_NONE = 1 << 63
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, each with one space behind it; where words begin and end there; the number of each
    text's first word, and of one after the last."""
    data = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside[:-1]])
    offsets = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    first = np.searchsorted(np.flatnonzero(inside & ~before), offsets)
    kept = inside | before
    ends = np.flatnonzero(~inside[kept])
    return np.where(inside, data, 32)[kept].astype(np.uint8).tobytes(), np.append(0, ends + 1)[: len(ends)], ends, first


def _codes(data: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; of what is beyond ``LONG_WORD`` bytes by another hash."""
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    word, at, left = np.arange(len(begins)), begins, ends - begins
    codes = left.astype(np.uint64)
    for _ in range(LONG_WORD // 8):
        if not len(word):
            break
        mixed = (codes[word] ^ (eight[at] & _FIRST_BYTES[np.minimum(left, 8)])) * _MULTIPLIER
        codes[word] = mixed ^ (mixed >> np.uint64(29))
        more = left > 8
        word, at, left = word[more], at[more] + 8, left[more] - 8
    for w, a, n in zip(word.tolist(), at.tolist(), left.tolist()):
        codes[w] ^= np.uint64(xxhash.xxh64_intdigest(data[a : a + n]))
    return codes


def least_grams(codes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in the texts: the smallest hash of a run of ``gram`` words (signed), the number of the
    window's first word, and its text."""
    windows = np.maximum(np.diff(first) - length + 1, 0)
    of = np.repeat(np.arange(len(windows)), windows)
    if not len(of):
        return np.empty(0, np.int64), np.empty(0, np.int64), of
    mixed = np.full(len(codes) - gram + 1, gram, np.uint64)
    for i in range(gram):
        mixed = (mixed ^ codes[i : len(codes) - gram + 1 + i]) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    width, have, least = length - gram + 1, 1, mixed
    while have < width:  # minima of twice as many, then of what is still missing
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = np.arange(len(of)) + np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows)
    return least[at].view(np.int64), at, of


def _stretches(least: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of windows of one text with one least gram begin and end."""
    new = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
    begins = np.flatnonzero(np.concatenate([[True], new])) if len(least) else np.empty(0, np.int64)
    return begins, np.append(begins[1:], len(least))[: len(begins)]


def _blocks(texts: list[bytes | None]):
    """From and to of consecutive texts of about ``BLOCK_BYTES``."""
    begin = size = 0
    for k, t in enumerate(texts, 1):
        size += len(t or b"")
        if size >= BLOCK_BYTES or k == len(texts):
            yield begin, k
            begin, size = k, 0


def _ids(docs: DataFrame) -> DataFrame:
    """doc_id, text, and of_text, which tells rows that share an id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("of_text"))


def _postings(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, grams: each document's distinct least grams."""

    def run(batches):
        for batch in batches:
            texts, grams, counts = batch.column("text").to_pylist(), [np.empty(0, np.int64)], [[0]]
            for i, j in _blocks(texts):
                data, begins, ends, first = _words(texts[i:j])
                least, _, of = least_grams(_codes(data, begins, ends), first, length, gram)
                at = _stretches(least, of)[0]
                least, of = least[at], of[at]
                order = np.lexsort((least, of))
                least, of = least[order], of[order]
                at = _stretches(least, of)[0]
                grams.append(least[at])
                counts.append(np.bincount(of[at], minlength=j - i))
            offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams)))], ["doc_id", "grams"])

    return in_small_batches(_ids(docs).drop("of_text").filter("doc_id is not null")).mapInArrow(run, "doc_id long, grams array<long>")


def _hot(postings: DataFrame) -> np.ndarray:
    """Grams of a share of more than 2 / ``HOT_KEYS`` of all postings and ``SHARD_ROWS`` of them (some of half
    as many, too), sorted; no more than ``HOT_KEYS``.

    Each task names the grams with at least a share of 1 / ``HOT_KEYS`` of its own postings; what such a
    gram has in other tasks is too little to matter.
    """

    def run(batches):
        own = [b.column("grams").flatten().to_numpy() for b in batches]
        grams, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.empty(0, np.int64),) * 2
        kept = n >= max(2, n.sum() / HOT_KEYS)
        yield pa.RecordBatch.from_arrays([pa.array(grams[kept]), pa.array(n[kept])], ["gram", "n"])

    total = postings.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    least = max(SHARD_ROWS // 2, total // HOT_KEYS)
    found = postings.select("grams").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r[0] for r in found.filter(F.col("n") >= least).select("gram").collect()], np.int64))


def _marks(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, gram, split: the documents' shared grams, and which of them go window by window."""
    hot = _hot(postings)
    shared_hot = postings.sparkSession.sparkContext.broadcast(hot)

    def deal(batches):
        for b in batches:
            lists = b.column("grams")
            doc = np.repeat(b.column("doc_id").to_numpy(), pc.list_value_length(lists).to_numpy())
            gram = lists.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(gram), pa.array(np.isin(gram, shared_hot.value))], ["doc_id", "gram", "split"])

    def shared(batches):
        """Of rows in order the grams of several documents; a gram with null as document once it has more than a shard holds."""
        gram = first = None
        n, several = 0, False
        for b in batches:
            d, g = b.column("doc_id").to_numpy(), b.column("gram").to_numpy()
            if not len(g):
                continue
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sizes = np.diff(np.append(starts, len(g)))
            firsts, before = d[starts], np.zeros(len(starts), np.int64)
            goes_on = g[0] == gram
            if goes_on:
                firsts[0], before[0] = first, n
            many = firsts != d[starts + sizes - 1]
            many[0] |= goes_on and several
            kept = np.repeat(many, sizes)
            docs, grams = [pa.array(d[kept])], [g[kept]]
            if goes_on and many[0] and not several:
                docs.append(pa.array([first], pa.int64()))
                grams.append(g[:1])
            large = (before <= SHARD_ROWS) & (before + sizes > SHARD_ROWS)
            docs.append(pa.nulls(int(large.sum()), pa.int64()))
            grams.append(g[starts[large]])
            gram, first, several, n = g[-1], firsts[-1], many[-1], before[-1] + sizes[-1]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(np.concatenate(grams))], ["doc_id", "gram"])

    dealt = postings.mapInArrow(deal, "doc_id long, gram long, split boolean")
    cold = dealt.filter("not split").select("doc_id", "gram").repartition("gram").sortWithinPartitions("gram", "doc_id")
    cold = scratch.keep(cold.mapInArrow(shared, "doc_id long, gram long"))
    large = cold.filter("doc_id is null").select("gram", F.lit(True).alias("split"))
    marks = cold.filter("doc_id is not null")
    if not large.isEmpty():
        marks = marks.join(large, "gram", "left")
    marks = marks.withColumn("split", F.coalesce("split", F.lit(False))) if "split" in marks.columns else marks.withColumn("split", F.lit(False))
    return marks.unionByName(dealt.filter("split"))


def cut(begins: np.ndarray, ends: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where passages begin and end: stretches in parts of each one's ``steps`` windows at most; and their stretch."""
    parts = -(-(ends - begins) // steps)
    of = np.repeat(np.arange(len(begins)), parts)
    cuts = begins[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * steps[of]
    return cuts, np.minimum(cuts + steps[of], ends[of]), of


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether each value is one of those held."""
    held = np.unique(held)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values if len(held) else np.zeros(len(values), bool)


def _passages(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """route, doc_id, of_text, start, passage of documents (doc_id, of_text, text, marks). Whether a gram is
    shared, or split, is the same for all documents, so a block looks them up together."""

    def run(batches):
        for batch in batches:
            texts, marks = batch.column("text").to_pylist(), batch.column("marks")
            size = np.append(0, np.cumsum(pc.list_value_length(marks).to_numpy(zero_copy_only=False)))
            grams, split = (x.to_numpy(zero_copy_only=False) for x in (marks.flatten().field("gram"), marks.flatten().field("split")))
            for i, j in _blocks(texts):
                data, begins, ends, first = _words(texts[i:j])
                least, at, of = least_grams(_codes(data, begins, ends), first, length, gram)
                here, single = grams[size[i] : size[j]], split[size[i] : size[j]].astype(bool)
                low, high = _stretches(least, of)
                shared = _among(least[low], here)
                low, high = low[shared], high[shared]
                alone = _among(least[low], here[single])
                low, high, of_stretch = cut(low, high, np.where(alone, 1, length - gram + 1))
                passages = [data[a:b] for a, b in zip(begins[at[low]].tolist(), ends[at[high - 1] + length - 1].tolist())]
                route = least[low]
                for k in np.flatnonzero(alone[of_stretch]).tolist():
                    route[k] = xxhash.xxh64_intdigest(passages[k]) - (1 << 63)
                rows = pa.array(i + of[low])
                columns = [pa.array(route), batch.column("doc_id").take(rows), batch.column("of_text").take(rows), pa.array(at[low] - first[of[low]]), pa.array(passages, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["route", "doc_id", "of_text", "start", "passage"])

    return in_small_batches(docs).mapInArrow(run, "route long, doc_id long, of_text long, start long, passage binary")


class SuffixAutomaton:
    """All runs of words in the passages added, each with the smallest document that has it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [_NONE]

    def _state(self, size: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.first.append(_NONE)
        return len(self.size) - 1

    def _split_off(self, p: int, q: int, word) -> int:
        """A state for the runs of q that are no longer than p's with the word."""
        own = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        self.link[q] = own
        return own

    def add(self, words, document: int) -> None:
        following, link, size, first = self.next, self.link, self.size, self.first
        last = 0
        for word in words:
            p, q, own = last, following[last].get(word), len(size)
            if q is not None:
                last = q if size[q] == size[p] + 1 else self._split_off(p, q, word)
            else:
                self._state(size[p] + 1, {}, 0)
                while p >= 0 and (q := following[p].setdefault(word, own)) == own:
                    p = link[p]
                if p >= 0:
                    link[own] = q if size[q] == size[p] + 1 else self._split_off(p, q, word)
                last = own
            if document < first[last]:
                first[last] = document

    def close(self, length: int = 1) -> None:
        """After the last passage: what a run of ``length`` words or more has, its ends of as many have, too."""
        size, link = np.array(self.size), np.array(self.link)
        states = np.flatnonzero((link >= 0) & (size[link] >= length))
        for state in states[np.argsort(-size[states], kind="stable")].tolist():
            up = self.link[state]
            self.first[up] = min(self.first[up], self.first[state])

    def matches(self, words, length: int):
        """For each word the smallest document that has the ``length`` words up to it; None without any."""
        following, link, size, first = self.next, self.link, self.size, self.first
        state = matched = 0
        for word in words:
            onward = following[state].get(word, 0)
            while state and not onward:
                state = link[state]
                matched = size[state]
                onward = following[state].get(word, 0)
            state = onward
            matched = matched + 1 if state else 0
            if matched < length:
                yield None
                continue
            while size[link[state]] >= length:  # more than is asked for need not match
                state = link[state]
            matched = min(matched, size[state])
            yield first[state]


def runs_of(firsts, length: int) -> list[tuple[int, int, int]]:
    """From and to (words) and first document of adjoining windows that end where ``firsts`` tells one document."""
    runs: list[list[int]] = []
    for end, first in enumerate(firsts, 1):
        if first is None:
            continue
        if runs and runs[-1][1] == end - 1 and runs[-1][2] == first:
            runs[-1][1] = end
        else:
            runs.append([end - length, end, first])
    return runs


def _spans(passages: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """doc_id, of_text, start, stop: the words (from, to) of each document that an earlier one has, too."""
    reference = scratch.keep(passages.groupBy("route", "passage").agg(F.min("doc_id").alias("first")))
    shards = max(1, -(-reference.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")
    counts = scratch.keep(passages.groupBy(shard).agg(F.count("*").alias("_n")))
    salts = counts.select("shard", F.ceil(F.col("_n") / STREAM_ROWS).cast("int").alias("salts"))
    streamed = join_unique(passages.select(shard, "doc_id", "of_text", "start", "passage"), salts, "shard", counts)
    streamed = streamed.select("shard", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int").alias("salt"), "doc_id", "of_text", "start", "passage")
    sent = reference.select(shard, "passage", "first").join(salts, "shard")
    sent = sent.select(F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("to"), F.col("passage").alias("held"), "first")

    def find(own: pa.Table, others: pa.Table) -> pa.Table:
        automaton, found = SuffixAutomaton(), [[], [], [], []]
        held = others["held"].combine_chunks()
        parts = pc.split_pattern(held, " ")
        words = parts.flatten().dictionary_encode().indices.to_pylist()
        ends = np.cumsum(pc.list_value_length(parts).to_numpy()).tolist()
        spans = list(zip([0, *ends], ends))
        for (a, b), first in zip(spans, others["first"].to_pylist()):
            automaton.add(words[a:b], first)
        automaton.close(length)
        at, known = {passage: k for k, passage in enumerate(held.to_pylist())}, {}  # the reference has every passage
        for doc_id, of_text, start, passage in zip(*(own[c].to_pylist() for c in ("doc_id", "of_text", "start", "passage"))):
            k = at[passage]
            if k not in known:
                a, b = spans[k]
                known[k] = runs_of(automaton.matches(words[a:b], length), length)
            stop = -1
            for begin, end, first in known[k]:
                if first < doc_id:
                    if start + begin > stop:
                        for column, value in zip(found, (doc_id, of_text, start + begin, start + end)):
                            column.append(value)
                    found[3][-1] = stop = start + end
        return pa.table([pa.array(c, pa.int64()) for c in found], ["doc_id", "of_text", "start", "stop"])

    return streamed.groupBy("shard", "salt").cogroup(sent.groupBy("of", "to")).applyInArrow(find, "doc_id long, of_text long, start long, stop long")


def _with(docs: DataFrame, by_doc: DataFrame, key: list[str], all_rows: bool) -> DataFrame:
    """``docs`` with the columns of a written table by ``key``; of all rows or of those that it has alone.
    Others' texts stay where they are as long as the ids are few enough to be broadcast."""
    if by_doc.count() > BROADCAST_IDS:
        return docs.join(by_doc, key, "left" if all_rows else "inner")
    ids = F.broadcast(by_doc.select(key))
    met = docs.join(ids, key, "left_semi").join(by_doc, key)
    return met.unionByName(docs.join(ids, key, "left_anti"), allowMissingColumns=True) if all_rows else met


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, of_text, spans (array of start, stop: words): what an earlier document has, too, for the documents that
    have such words. Reads tables of ``scratch``."""
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    postings = scratch.keep(_postings(docs, length, min(gram, length)))
    marks = _marks(postings, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("gram", "split")).alias("marks"))
    marks = scratch.keep(marks)
    scratch.drop(postings)
    passages = scratch.keep(_passages(_with(_ids(docs), marks, ["doc_id"], False), length, min(gram, length)))
    scratch.drop(marks)
    return _spans(passages, length, scratch).groupBy("doc_id", "of_text").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words, joined by one space) for every row."""
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    spans = scratch.keep(repeated_spans(docs, length, gram, scratch))

    def run(batches):
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words, kept, at = (text or b"").split(), [], 0
                for span in spans or ():
                    kept += words[at : span["start"]]
                    at = max(at, span["stop"])
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return in_small_batches(_with(_ids(docs), spans, ["doc_id", "of_text"], True)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
