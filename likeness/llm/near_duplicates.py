"""Near-duplicate documents by a signature-coordinate inverted join.

1. Every document becomes its set of distinct word shingles, of which a digest of the whole set and a
   MinHash signature are kept. Documents with equal sets are one class; its id is its smallest doc_id.
2. Classes are posted under each coordinate-value pair of their signature. A pair of classes counts
   as similar enough for confirmation if it collides in ``matches`` coordinates, a bound that a pair
   at the similarity limit misses with a probability of ``MISS``.
3. Prefix: with coordinates ordered by rising frequency, two classes that collide ``matches`` times
   share one of all but the ``matches - 1`` most frequent of each. Pairs that occur once need no
   posting; very frequent ones (passages that many documents share) come last and are mostly skipped.
4. Skip merging: within a posting list, classes are first held against the list's most central class
   (the one whose coordinates are the most frequent), the best such pair of each class alone; what
   that links needs no further comparison, and lists within one component are skipped. Of lists that
   still span several components the short ones are merged pair by pair. The members of long ones
   that stand outside their group's largest component are counted against the group in blocks, on
   signatures of ``WIDE`` coordinates with a bound of its own; only pairs above that bound become
   rows. So a list of n copies makes rows in proportion to n, and no link between components is
   passed over.
5. Candidates are confirmed on the full shingle sets; components of the confirmed links follow.

Defined results: texts that are null, empty or blank have an empty set (n_shingles 0) and are linked
with nothing; with fewer words than a shingle the whole sequence is the one shingle; rows without id
have no component and are kept; rows that share an id count as one document, whatever their texts,
and so have one component, which reaches all that any of their texts is linked with; repeated rows
give repeated results, but of a kept document's rows :func:`keep_one_of_each` leaves one (that with
the smallest text); further input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from likeness.llm.common import TaskTable, in_small_batches
from likeness.sources.scratch import Scratch
from likeness.operators.components import components

WIDTH = 5
PERCENT = 80
COORDINATES = 64
MISS = 1e-6
#: Lists up to this long are merged pair by pair, longer ones in blocks.
SHORT_LIST = 32
WIDE = 512
#: Members and shingles of a block.
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
#: Ids are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(TaskTable):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        return self.put(word, xxhash.xxh64_intdigest(word))


def shingle_set(text: str | None, width: int, table: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; A-Z lower-cased."""
    words = text.encode("utf-8").lower().split() if text else []
    table.trim()
    codes = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    if not width:
        return np.empty(0, np.int64)
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ codes[i : len(words) - width + 1 + i]) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


class Signer:
    """MinHash signatures of shingle sets, as signed 32-bit integers."""

    def __init__(self, coordinates: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 31, coordinates, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = r.integers(0, 1 << 32, coordinates, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray, block: int = 2048) -> np.ndarray:
        x = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        out = None
        for i in range(0, len(x), block):
            least = (x[None, i : i + block] * self.a + self.b).min(axis=1)
            out = least if out is None else np.minimum(out, least)
        return out.view(np.int32)


def match_threshold(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The most collisions that a pair at the limit reaches but with probability ``miss``."""
    p, below = percent / 100, 0.0
    for n in range(coordinates + 1):
        below += math.comb(coordinates, n) * p**n * (1 - p) ** (coordinates - n)
        if below > miss:
            return max(1, n)
    return coordinates


def _signed(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, high and low half of the set's digest, signature."""

    def run(batches):
        table, sign = WordHashes(), Signer(coordinates)
        for batch in batches:
            n, high, low, signatures = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, width, table)
                n.append(len(shingles))
                if len(shingles):
                    digest = xxhash.xxh3_128_digest(shingles.tobytes())
                    high.append(int.from_bytes(digest[:8], "big", signed=True))
                    low.append(int.from_bytes(digest[8:], "big", signed=True))
                    signatures.append(sign(shingles))
                else:
                    high.append(None), low.append(None), signatures.append(None)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "high", "low", "signature"])

    return in_small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, high long, low long, signature array<int>")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents with the given ids."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.selectExpr("cast(doc_id as bigint) id", "text").join(ids, "id", "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, width: int, wide: bool = False) -> DataFrame:
    """id, shingles (sorted hashes) and, if asked for, wide (the lower 16 bits of ``WIDE``
    coordinates) of the documents with the given ids."""

    def run(batches):
        table, sign = WordHashes(), Signer(WIDE, seed=2)
        for batch in batches:
            sets = [shingle_set(text, width, table) for text in batch.column("text").to_pylist()]
            columns = [batch.column("id"), pa.array(sets, pa.list_(pa.int64()))]
            if wide:
                columns.append(pa.array([sign(x).astype("<u2").tobytes() for x in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "shingles", "wide"][: len(columns)])

    return _texts(docs, ids).mapInArrow(run, "id long, shingles array<long>" + (", wide binary" if wide else ""))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


class _Join:
    """One run: the postings and what has been confirmed so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, coordinates: int, scratch: Scratch):
        self.docs, self.classes, self.width, self.percent, self.scratch = docs, classes, width, percent, scratch
        self.matches = match_threshold(coordinates, percent)
        self.labels: DataFrame | None = None
        posted = classes.select("id", F.posexplode("signature").alias("at", "value"))
        posted = posted.select("id", (F.col("at").cast("long") * (1 << 32) + F.col("value").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
        shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        own = posted.join(shared, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"), F.sum(F.log2("n")).alias("central"))
        prefix = own.filter(F.size("own") >= self.matches).select("id", "central", F.explode(F.slice("own", F.lit(1), F.size("own") - (self.matches - 1))).alias("one"))
        self.postings = scratch.keep(prefix.select("id", "central", F.col("one.key").alias("key")))

    def _open(self) -> DataFrame:
        """Postings with their component, their list's length and central class, of lists that span several."""
        rows = self.postings
        if self.labels is None:
            rows = rows.withColumn("label", F.col("id"))
        else:
            rows = rows.join(self.labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        central = F.max_by("id", F.struct("central", -F.col("id"))).alias("pivot")
        lists = rows.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("n"), central).filter("first <> last")
        return self.scratch.keep(rows.join(lists.select("key", "n", "pivot"), "key").select("key", "n", "pivot", "id", "label"))

    def _colliding(self, pairs: DataFrame) -> DataFrame:
        """a, b, collisions of the pairs that collide often enough."""
        own = self.classes.select("id", "signature")
        a, b = own.withColumnsRenamed({"id": "a", "signature": "sa"}), own.withColumnsRenamed({"id": "b", "signature": "sb"})
        same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return pairs.join(a, "a").join(b, "b").select("a", "b", same.alias("collisions")).filter(F.col("collisions") >= self.matches)

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """a, b of the candidates that are links by their full sets."""
        pairs = self.scratch.keep(pairs.select("a", "b"))
        ids = self.scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sets = self.scratch.keep(_sets(self.docs, ids, self.width))
        a, b = sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), sets.withColumnsRenamed({"id": "b", "shingles": "sb"})
        common = F.size(F.array_intersect("sa", "sb"))
        links = pairs.join(a, "a").join(b, "b").withColumn("common", common).filter(100 * F.col("common") >= self.percent * (F.size("sa") + F.size("sb") - F.col("common")))
        links = self.scratch.keep(links.select("a", "b"))
        for used in (pairs, ids, sets):
            self.scratch.drop(used)
        return links

    def merge(self, links: DataFrame) -> None:
        """Merge the components that links join."""
        if self.labels is None:
            self.labels = components(links, self.scratch)
            return
        for end in "ab":
            own = self.labels.select(F.col("node").alias(end), F.col("label").alias("to"))
            links = links.join(own, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        merged = components(links, self.scratch)
        through = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
        old = self.labels.join(through, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        self.labels = self.scratch.keep(old.unionByName(merged).groupBy("node").agg(F.min("label").alias("label")))

    def _central_pairs(self, open_: DataFrame) -> DataFrame:
        """Each class's best-colliding pair with the central class of one of its lists."""
        pairs = open_.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
        best = self._colliding(pairs).groupBy("a").agg(F.max_by("b", F.struct("collisions", -F.col("b"))).alias("b"))
        return best

    def _short_pairs(self, open_: DataFrame) -> DataFrame:
        """Colliding pairs across components in short lists."""
        rows = open_.filter(F.col("n") <= SHORT_LIST)
        one = rows.select("key", F.col("id").alias("a"), F.col("label").alias("la"))
        two = rows.select("key", F.col("id").alias("b"), F.col("label").alias("lb"))
        return self._colliding(one.join(two, "key").filter("a < b and la <> lb").select("a", "b").distinct()).select("a", "b")

    def _long_links(self, open_: DataFrame) -> DataFrame:
        """Links across components in long lists, found in blocks: for each member outside its group's
        largest component one with each other component. Lists with one central class are one group."""
        rows = open_.filter(F.col("n") > SHORT_LIST).select("pivot", "id", "label").distinct()
        sets = self.scratch.keep(_sets(self.docs, rows.select("id").distinct(), self.width, wide=True))
        rows = self.scratch.keep(rows.join(sets.select("id", F.size("shingles").cast("long").alias("w")), "id"))
        sizes = rows.groupBy("pivot", "label").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
        groups = sizes.groupBy("pivot").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max_by(F.struct("label", "n", "w"), F.struct("n", -F.col("label"))).alias("main"))
        parts = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
        groups = groups.select("pivot", F.col("main.label").alias("main"), parts(F.col("n"), F.col("w")).alias("blocks"), parts(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("outer_blocks"))
        groups = self.scratch.keep(groups.filter("outer_blocks > 0"))
        groups = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups  # a group may hold a third of all rows
        rows = rows.drop("w").join(groups, "pivot").join(sets, "id")
        at = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
        each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        inner = rows.withColumn("block", at("blocks")).withColumn("outer", each("outer_blocks"))
        outer = rows.filter("label <> main").withColumn("outer", at("outer_blocks")).withColumn("block", each("blocks"))
        keys, least, percent = ["pivot", "outer", "block"], match_threshold(WIDE, self.percent), self.percent

        def find(own: pa.Table, others: pa.Table) -> pa.Table:
            pairs: list[list] = [[], []]
            if len(own) and len(others):
                x, y = (np.frombuffer(b"".join(t["wide"].to_pylist()), "<u2").reshape(len(t), WIDE) for t in (own, others))
                own_sets, other_sets = own["shingles"].combine_chunks(), others["shingles"].combine_chunks()
                ids, labels = others["id"].to_numpy(), others["label"].to_numpy()
                for k, (i, label) in enumerate(zip(own["id"].to_pylist(), own["label"].to_pylist())):
                    collisions = (y == x[k]).sum(axis=1)
                    near = np.flatnonzero((collisions >= least) & (labels != label))
                    mine, met = own_sets[k].values.to_numpy(), set()
                    for j in near[np.argsort(-collisions[near], kind="stable")].tolist():
                        if labels[j] not in met and linked(mine, other_sets[j].values.to_numpy(), percent):
                            met.add(labels[j])
                            pairs[0].append(i)
                            pairs[1].append(int(ids[j]))
            return pa.table([pa.array(c, pa.int64()) for c in pairs], ["a", "b"])

        columns = [*keys, "id", "label", "wide", "shingles"]
        own, others = outer.select(columns).toDF(*columns), inner.select(columns)
        return own.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(find, "a long, b long")

    def run(self) -> None:
        """Find ``labels``: node, label of the classes that are linked with others; None if there are none."""
        open_ = self._open()
        if open_.isEmpty():
            return
        self.merge(self._confirmed(self._central_pairs(open_)))
        self.scratch.drop(open_)
        open_ = self._open()
        if not open_.isEmpty():
            self.merge(self._confirmed(self._short_pairs(open_)).unionByName(self._long_links(open_)))
        self.scratch.drop(open_)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept, for every row. The result
    reads tables of ``scratch``."""
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    signed = scratch.keep(_signed(docs, width, coordinates))
    sets = signed.filter("doc_id is not null and high is not null")
    classes = scratch.keep(sets.groupBy("high", "low").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")))
    join = _Join(docs, classes, width, percent, coordinates, scratch)
    join.run()
    scratch.drop(join.postings)
    of_class = classes.select("high", "low", "id")
    several = _of_several_sets(signed, scratch)
    if several is not None:
        own = signed.join(several, "doc_id", "left_semi").filter("high is not null").select("doc_id", "high", "low").distinct()
        join.merge(scratch.keep(own.join(of_class, ["high", "low"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    labels = join.labels
    if labels is not None:
        of_class = of_class.join(labels.withColumnRenamed("node", "id"), "id", "left").select("high", "low", F.coalesce("label", "id").alias("id"))
    found = signed.select("doc_id", "n_shingles", "high", "low").join(of_class, ["high", "low"], "left")
    if several is not None:
        own = several.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("of_rows"))
        found = found.join(own, "doc_id", "left").withColumn("id", F.coalesce("of_rows", "id"))
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _of_several_sets(signed: DataFrame, scratch: Scratch) -> DataFrame | None:
    """doc_id of the documents whose rows have different sets, an empty one included; None without any."""
    digest = F.struct("high", "low")
    own = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("first"), F.max(digest).alias("last"))
    several = scratch.keep(own.filter(~F.col("first").eqNullSafe(F.col("last"))).select("doc_id"))
    if not several.isEmpty():
        return F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    scratch.drop(several)
    return None


def _repeated_once(docs: DataFrame, signed_ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with one row of each id that occurs in several; rows without id all stay."""
    repeated = scratch.keep(signed_ids.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        scratch.drop(repeated)
        return docs
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    one = docs.join(repeated, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_doc_id")).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("_row"))
    return docs.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one.select("_row.*"))


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, without those that are not the first of their component."""
    scratch, inner = Scratch(docs.sparkSession, "dropped"), Scratch(docs.sparkSession, "near-duplicates")
    found = scratch.keep(near_duplicates(docs, width, percent, scratch=inner).select("doc_id", "kept"))
    inner.clear()
    gone = scratch.keep(found.filter("not kept").select("doc_id").distinct())
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    return _repeated_once(left, found.filter("kept").select("doc_id"), scratch)
