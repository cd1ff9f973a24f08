"""Collocations: phrases whose words stand together more often than their parts alone suggest.

1. Words are counted by language. Those frequent enough to be part of a candidate get ids of 32 bits
   that are unique over (language, word).
2. Texts become id sequences that break at the ends of pieces and at all other words. A dictionary of up
   to ``BROADCAST_WORDS`` words is broadcast; a larger one meets the words in a shuffle join.
3. The phrase that begins at a place, up to ``LONGEST`` words, is one binary key of fixed width: its ids,
   big-endian, filled up with zeros. Tasks sort what they have by radix and count runs, so a frequent
   phrase costs a row for each ``BUFFER`` places; the keys go to range partitions, are sorted by radix and
   counted again. As shorter phrases are prefixes of the keys, one sort counts those of all lengths;
   only a partition's first and last run of each length can go on in another.
4. Counts of both parts of every cut come by joins on the keys, in which very frequent parts are set
   apart; scores are exact divisions of decimals.

Defined results: a null text is empty, a null language is ``und`` (and one with the language ``und``);
words are whatever stands between blanks, control characters too; a row is a document, repeated ones
too; further columns, also of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.llm.common import in_small_batches
from likeness.operators.joins import join_unique
from likeness.sources.scratch import Scratch

LEAST = 100
LONGEST = 5
PERCENT = 100
MOST = 2000
#: Words of a dictionary that is broadcast.
BROADCAST_WORDS = 500_000
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 1 << 17
#: Places that a task sorts at a time, and keys of a range partition.
BUFFER = 1 << 20
#: Documents, about, whose keys show where to cut the range of all keys into parts.
BOUND_DOCUMENTS = 2000
SALTS = 64

# Bytes between words and between pieces; 0xFF occurs in no UTF-8 text.
_BREAK = b"\xff"
_BLANKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b" " * 11)
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n."""

    def run(batches):
        counts, held = defaultdict(Counter), 0

        def rows():
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = counts[lang]
                held -= len(own)
                own.update((text or b"").lower().translate(_BLANKS).split())
                held += len(own)
                if held > COUNTED_WORDS:
                    yield from rows()
                    held = 0
        yield from rows()

    counted = in_small_batches(_named(docs)).mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of a written table plus id, from 1 without gaps."""
    placed = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dict(placed.groupBy("_part").count().collect())  # a number for each partition
    first, pairs = 1, []
    for part in sorted(sizes):
        pairs += [F.lit(part), F.lit(first).cast("long")]
        first += sizes[part]
    if first > 1 << 32:
        raise ValueError(f"{first - 1} frequent words don't fit ids of 32 bits")
    ids = F.element_at(F.create_map(*pairs), F.col("_part")) + F.col("_at") if pairs else F.lit(0).cast("long")
    return scratch.keep(placed.select("lang", "word", "n", ids.alias("id")))


def grams(ids: np.ndarray, width: int) -> np.ndarray:
    """One column for each place where at least two ids stand together: these and those that follow, up to
    ``width``, zeros behind. Zeros among ``ids`` are breaks."""
    padded = np.concatenate([ids, np.zeros(width, np.uint32)])
    rows = [padded[: len(ids)]]
    for k in range(1, width):
        rows.append(np.where(rows[-1] > 0, padded[k : k + len(ids)], np.uint32(0)))
    return np.stack(rows)[:, rows[1] > 0]


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts columns of 32-bit numbers, least significant digit (16 bits) first."""
    order = np.arange(keys.shape[1])
    for row in keys[::-1]:
        for digit in ((row & np.uint32(0xFFFF)).astype(np.uint16), (row >> np.uint32(16)).astype(np.uint16)):
            if digit.any():
                order = order[np.argsort(digit[order], kind="stable")]  # by radix for 16 bits
    return order


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal columns begin."""
    return np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))


def _binary(keys: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(keys.T.astype(">u4"))
    ends = np.arange(keys.shape[1] + 1, dtype=np.int32) * np.int32(4 * keys.shape[0])
    return pa.Array.from_buffers(pa.binary(), keys.shape[1], [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(">u4").reshape(len(column), width).T.astype(np.uint32)


def _fixed(keys: np.ndarray) -> np.ndarray:
    """Columns of numbers as byte strings, which sort alike."""
    return np.ascontiguousarray(keys.T.astype(">u4")).view(f"S{4 * keys.shape[0]}").ravel()


def _combined(sequences, width: int, bounds: np.ndarray):
    """Batches of part (how many bounds are not above the key), key and n of id sequences, combined for each
    ``BUFFER`` places."""
    held: list[np.ndarray] = []
    size = 0

    def batches():
        keys = grams(np.concatenate(held), width)
        held.clear()
        if keys.shape[1]:
            keys = keys[:, radix_order(keys)]
            starts = _starts(keys)
            n = np.diff(np.append(starts, keys.shape[1]))
            part = np.searchsorted(bounds, _fixed(keys[:, starts]), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), _binary(keys[:, starts]), pa.array(n, pa.int64())], ["part", "key", "n"])

    for ids in sequences:
        held += [ids, np.zeros(1, np.uint32)]
        size += len(ids)
        if size >= BUFFER:
            yield from batches()
            size = 0
    if held:
        yield from batches()


class _Ids(dict):
    """Word -> id; 0 for all others."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _split(text: bytes | None) -> list[bytes]:
    """The words of a text, with breaks between its pieces."""
    return (text or b"").lower().translate(_PIECES).replace(_BREAK, b" " + _BREAK + b" ").split()


_KEYS = "part int, key binary, n long"


def _keys_by_broadcast(docs: DataFrame, shared, width: int, bounds: np.ndarray) -> DataFrame:

    def run(batches):
        tables = defaultdict(_Ids)
        for lang, word, i in zip(*(c.to_pylist() for c in shared.value.columns)):
            tables[lang][word.encode()] = i

        def sequences():
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    words = _split(text) if lang in tables else []
                    yield np.fromiter(map(tables[lang].__getitem__, words), np.uint32, len(words)) if words else np.empty(0, np.uint32)

        yield from _combined(sequences(), width, bounds)

    return in_small_batches(_named(docs)).mapInArrow(run, _KEYS)


def _keys_by_join(docs: DataFrame, dictionary: DataFrame, width: int, bounds: np.ndarray, scratch: Scratch) -> DataFrame:
    """The same keys with the dictionary joined to the words, for dictionaries of any size."""

    def words(batches):
        for batch in batches:
            for row, lang, text in zip(*(batch.column(c).to_pylist() for c in ("row", "lang", "text"))):
                found = _split(text)
                kept = [(at, w) for at, w in enumerate(found) if w != _BREAK]
                at, own = zip(*kept) if kept else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.int64()), pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own, pa.binary()).cast(pa.string())], ["row", "lang", "at", "word"])

    def run(batches):
        def sequences():
            for batch in batches:
                for found in batch.column("found").to_pylist():
                    at = np.array([f["at"] for f in found])
                    ids = np.zeros(at[-1] - at[0] + 1, np.uint32)
                    ids[at - at[0]] = [f["id"] for f in found]
                    yield ids

        yield from _combined(sequences(), width, bounds)

    rows = in_small_batches(_named(docs).withColumn("row", F.monotonically_increasing_id()))
    rows = scratch.keep(rows.mapInArrow(words, "row long, lang string, at long, word string"))
    key = F.struct("lang", "word").alias("word")
    met = join_unique(rows.select("row", "at", key), dictionary.select(key, "id"), "word")
    return met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("found")).select("found").mapInArrow(run, _KEYS)


def _bounds(keys: DataFrame, n_parts: int, width: int) -> np.ndarray:
    """Keys between which the parts' lie, from the keys of some documents: they decide how even the parts
    are and nothing else."""
    some = keys.filter(F.pmod(F.xxhash64("key"), F.lit(16)) == 0).select("key").toArrow()["key"].combine_chunks()
    if not len(some) or n_parts < 2:
        return np.empty(0, f"S{4 * width}")
    found = np.sort(_fixed(_numbers(some, width)))
    return found[np.arange(1, n_parts) * len(found) // n_parts]


def _counted(keys: DataFrame, n_parts: int, width: int, least: int) -> DataFrame:
    """key (of 2 to ``width`` ids), a: the phrases that occur often enough."""

    def run(batches):
        found = [(_numbers(b.column("key"), width), b.column("n").to_numpy()) for b in batches if len(b)]
        if not found:
            return
        own, n = (np.concatenate(c, axis=-1) for c in zip(*found))
        order = radix_order(own)
        own, n = own[:, order], n[order]
        for size in range(2, width + 1):
            starts = _starts(own[:size])
            a = np.add.reduceat(n, starts)
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True  # these may go on in another partition
            kept = (own[size - 1, starts] > 0) & ((a >= least) | edge)
            yield pa.RecordBatch.from_arrays([_binary(own[:size, starts[kept]]), pa.array(a[kept], pa.int64())], ["key", "a"])

    counted = keys.repartitionById(n_parts, F.col("part")).select("key", "n").mapInArrow(run, "key binary, a long")
    return counted.groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _part(start: Column | int, n: Column) -> Column:
    """``n`` ids of a key from the given one (0-based)."""
    return F.substring("key", 1 + 4 * (F.lit(start) if isinstance(start, int) else start), 4 * n)


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, most: int = MOST, broadcast_words: int = BROADCAST_WORDS, scratch: Scratch | None = None
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases. The result reads tables
    of ``scratch``. ``percent`` (1 to 100): a phrase goes if a longer one has that share of its count."""
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    counts = scratch.keep(word_counts(docs))
    totals = scratch.keep(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = scratch.keep(counts.filter(F.col("n") >= least))
    dictionary = _numbered(frequent, scratch)
    known = dictionary.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("places")).first()
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known["places"] // BUFFER))
    if known["words"] <= broadcast_words:
        shared = docs.sparkSession.sparkContext.broadcast(dictionary.select("lang", "word", "id").toArrow())
        keys_of = lambda some, bounds: _keys_by_broadcast(some, shared, longest, bounds)
    else:
        keys_of = lambda some, bounds: _keys_by_join(some, dictionary, longest, bounds, scratch)
    share = min(1.0, BOUND_DOCUMENTS / max(1, docs.count()))
    bounds = _bounds(keys_of(docs.sample(share, seed=1), np.empty(0, f"S{4 * longest}")), n_parts, longest)
    keys = keys_of(docs, bounds)
    size = (F.length("key") / 4).cast("int")
    phrases = scratch.keep(_counted(keys, n_parts, longest, least))

    # Phrases inside one that is as frequent. Counts never rise with the length, so where a longer
    # phrase has the share, one of just one word more has it, too.
    inner = phrases.filter(size > 2).select(F.explode(F.array(_part(0, size - 1), _part(1, size - 1))).alias("key"), F.col("a").alias("longer"))
    inner = inner.groupBy("key").agg(F.max("longer").alias("longer"))
    left = phrases.join(inner, "key", "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")
    left = scratch.keep(left)

    words = scratch.keep(left.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.conv(F.hex(_part(i, F.lit(1))), 16, 10).cast("long"))).alias("at", "id")))
    words = join_unique(words, dictionary.select("id", "lang", "word"), "id")
    named = words.groupBy("key").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    named = join_unique(scratch.keep(named), totals, "lang")

    cuts = left.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = F.inline(F.array(F.struct(F.lit(0).alias("side"), _part(0, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), _part(F.col("k"), size - F.col("k")).alias("part"))))
    sides = scratch.keep(cuts.select("key", "a", "k", sides))
    alone = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    known = phrases.select(F.col("key").alias("part"), F.col("a").alias("f")).unionByName(dictionary.select(alone.alias("part"), F.col("n").alias("f")))
    of_side = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    cuts = join_unique(sides, known, "part").groupBy("key", "a", "k").agg(of_side(0).alias("l"), of_side(1).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), exact("l") * exact("r"))
    scored = cuts.join(named, "key").select("lang", "phrase", "a", "l", "r", "n", "k", score.alias("score"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
