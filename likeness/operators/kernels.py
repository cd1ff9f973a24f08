"""Arrow kernels for what column expressions do slowly: rows against many targets, all pairs in blocks.

Targets (concept prototypes, reference faces) are user-made and few; they are collected in blocks of
``TARGET_BLOCK`` rows, each a pass with its own bounded broadcast, so any number of them works. A task
holds ``CELLS`` scores at a time, whatever the batch.

Defined results: null vectors take no part (:func:`best_target` gives them no row); vectors of another
dimension than the targets', or of several within them, raise; vectors with NaN never match; repeated
or null ids of targets each count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from likeness.operators.components import smallest_reached
from likeness.sources.scratch import Scratch

TARGET_BLOCK = 8192
#: Scores or distances that a task computes at once.
CELLS = 1 << 21
#: Data of a block in all-pairs comparisons, and its rows where that keeps more tasks busy.
BLOCK_BYTES = 4 << 20
PAIR_BLOCK = 2048


def matrix(column, dimension: int | None = None) -> np.ndarray:
    """A list column without nulls as a matrix of doubles; lists of different lengths raise."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, dimension or 0))
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1 or sizes[0] is None or sizes[0] != (dimension or sizes[0]):
        raise ValueError(f"vectors of {sorted(n or 0 for n in sizes)} dimensions" + f" against targets of {dimension}" * bool(dimension))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.ones((0, 1))
    return np.divide(x, size, out=x.copy(), where=size > 0)


def _blocks(targets: DataFrame, block: int):
    """Blocks of target rows, one at a time on the driver. What fits one block is read at once. More is dealt by
    the row's place in a written table, so equal and null ids can't fall between two blocks; that table goes
    once the last block has been read."""
    some = targets.filter("prototype is not null")
    rows = some.limit(block + 1).toArrow()
    if len(rows) <= block:
        if len(rows):
            yield rows.sort_by("target_id")
        return
    scratch = Scratch(targets.sparkSession, "targets")
    kept = scratch.keep(some)
    n = -(-kept.count() // block)
    placed = kept.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    for i in range(n):
        rows = placed.filter(F.col("_block") == i).drop("_block").orderBy("target_id").toArrow()
        if len(rows):
            yield rows
    scratch.clear()


def _slices(x: np.ndarray, width: int):
    """Where slices of rows begin, and their matrices, so that ``CELLS`` scores fit one."""
    step = max(1, CELLS // max(1, width))
    return ((i, x[i : i + step]) for i in range(0, len(x), step))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_targets(rows: DataFrame, targets: DataFrame, group: str = "file_id", vector: str = "vector", block: int = TARGET_BLOCK) -> DataFrame:
    """``group``, target_id, score: the largest cosine of each group's vectors to each target at or
    above the target's ``cutoff``. ``targets``: target_id long, prototype, cutoff double.

    One pass over the vectors for all targets of a block; maxima combine within a batch, before the
    shuffle.
    """
    spark, parts = rows.sparkSession, []
    rows = rows.filter(F.col(vector).isNotNull())
    for own in _blocks(targets.select("target_id", "prototype", "cutoff"), block):
        shared = spark.sparkContext.broadcast((own["target_id"].combine_chunks(), unit(matrix(own["prototype"])), own["cutoff"].to_numpy()))

        def run(batches, shared=shared):
            ids, prototypes, cutoffs = shared.value
            for b in batches:
                found = []
                for begin, x in _slices(matrix(b.column(1), prototypes.shape[1]), len(ids)):
                    scores = unit(x) @ prototypes.T
                    at, target = np.nonzero(scores >= cutoffs[None])
                    found.append(pa.table([b.column(0).take(pa.array(begin + at)), ids.take(pa.array(target)), pa.array(scores[at, target])], ["g", "t", "s"]))
                if found:
                    best = pa.concat_tables(found).group_by(["g", "t"]).aggregate([("s", "max")]).select(["g", "t", "s_max"])
                    yield from best.rename_columns([group, "target_id", "score"]).to_batches()

        kind = rows.schema[group].dataType.simpleString()
        parts.append(rows.select(group, vector).mapInArrow(run, f"{group} {kind}, target_id long, score double"))
    if not parts:
        return rows.select(group, F.lit(0).cast("long").alias("target_id"), F.lit(0.0).alias("score")).limit(0)
    return _union(parts).groupBy(group, "target_id").agg(F.max("score").alias("score"))


def best_target(rows: DataFrame, targets: DataFrame, key: str, vector: str = "vector", block: int = TARGET_BLOCK) -> DataFrame:
    """``key``, target_id, score: for each row the target with the largest cosine, ties to smaller ids."""
    spark, parts = rows.sparkSession, []
    rows = rows.filter(F.col(vector).isNotNull())
    for own in _blocks(targets.select("target_id", "prototype").filter("target_id is not null"), block):
        shared = spark.sparkContext.broadcast((own["target_id"].to_numpy(), unit(matrix(own["prototype"]))))

        def run(batches, shared=shared):
            ids, prototypes = shared.value
            for b in batches:
                for begin, x in _slices(matrix(b.column(1), prototypes.shape[1]), len(ids)):
                    scores = unit(x) @ prototypes.T
                    best = scores.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(x)), pa.array(ids[best], pa.int64()), pa.array(scores[np.arange(len(best)), best])], [key, "target_id", "score"])

        kind = rows.schema[key].dataType.simpleString()
        parts.append(rows.select(key, vector).mapInArrow(run, f"{key} {kind}, target_id long, score double"))
    if not parts:
        return rows.select(key, F.lit(0).cast("long").alias("target_id"), F.lit(0.0).alias("score")).limit(0)
    if len(parts) == 1:
        return parts[0]
    best = F.max_by(F.struct("target_id", "score"), F.struct("score", -F.col("target_id")))
    return _union(parts).groupBy(key).agg(best.alias("best")).select(key, "best.*")


def score_buckets(rows: DataFrame, targets: DataFrame, buckets: int, vector: str = "vector", skip: str = "skip", block: int = TARGET_BLOCK) -> DataFrame:
    """target_id, bucket, n, top, bottom: the cosines of rows (``vector``; ``skip``: an array of target ids
    that the row doesn't count for, or null) to each target (target_id, prototype, cutoff), by equal
    buckets from -1 to 1: how many and the ends of those up to the target's cutoff; bucket null has the
    number of all. Counts and ends combine in each batch, so a task passes on ``buckets`` rows a target.
    """
    spark, parts = rows.sparkSession, []
    rows = rows.filter(F.col(vector).isNotNull())
    for own in _blocks(targets.select("target_id", "prototype", "cutoff"), block):
        shared = spark.sparkContext.broadcast((own["target_id"].to_numpy(), unit(matrix(own["prototype"])), own["cutoff"].to_numpy()))

        def run(batches, shared=shared):
            ids, prototypes, cutoffs = shared.value
            place = {t: k for k, t in enumerate(ids.tolist())}
            every = np.zeros(len(ids), np.int64)
            for b in batches:
                skipped = b.column(1).to_pylist()
                for begin, x in _slices(matrix(b.column(0), prototypes.shape[1]), len(ids)):
                    scores = unit(x) @ prototypes.T
                    for i, out in enumerate(skipped[begin : begin + len(x)]):
                        if out:
                            scores[i, [place[t] for t in out if t in place]] = np.nan
                    every += (~np.isnan(scores)).sum(axis=0)
                    at, target = np.nonzero(scores <= cutoffs[None])
                    value = scores[at, target]
                    bucket = np.clip(np.floor((value + 1) * (buckets / 2)), 0, buckets - 1).astype(np.int32)
                    found = pa.table([pa.array(ids[target]), pa.array(bucket), pa.array(value)], ["t", "b", "s"])
                    found = found.group_by(["t", "b"]).aggregate([("s", "count"), ("s", "max"), ("s", "min")]).select(["t", "b", "s_count", "s_max", "s_min"])
                    yield from found.rename_columns(["target_id", "bucket", "n", "top", "bottom"]).to_batches()
            empty = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(empty, pa.int32()), pa.array(every), pa.array(empty, pa.float64()), pa.array(empty, pa.float64())], ["target_id", "bucket", "n", "top", "bottom"])

        parts.append(rows.select(vector, skip).mapInArrow(run, "target_id long, bucket int, n long, top double, bottom double"))
    if not parts:
        return spark.createDataFrame([], "target_id long, bucket int, n long, top double, bottom double")
    return _union(parts).groupBy("target_id", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.min("bottom").alias("bottom"))


def forest(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs those that keep what they connect: for each component its smallest node with every other one,
    and the largest value of the component's pairs. As many as nodes at most."""
    nodes, labels = smallest_reached(a, b)
    roots, own = np.unique(labels[np.searchsorted(nodes, a)], return_inverse=True)
    most = np.full(len(roots), -np.inf)
    np.maximum.at(most, own, value)
    rest = nodes != labels
    return labels[rest], nodes[rest], most[np.searchsorted(roots, labels[rest])]


def _reported(chunks, value_type: str, connect: bool) -> pa.Table:
    """Pairs (a, b, value) as a table; with ``connect`` their forest, of which a task holds little more than
    ``CELLS`` pairs at a time."""
    held, size = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    gathered = lambda: tuple(np.concatenate(c) for c in zip(*held))
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk[0])
        if connect and size > CELLS:
            held = [forest(*gathered())]
            size = len(held[0][0])
    a, b, value = gathered()
    if connect and len(a):
        a, b, value = forest(a, b, value)
    kind = {"double": pa.float64(), "int": pa.int32()}[value_type]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.asarray(value, float)).cast(kind)], ["a", "b", "value"])


def _compared(x, y, x_ids: np.ndarray, y_ids: np.ndarray, kernel: Callable, same: bool):
    """Chunks of the pairs of ids that ``kernel`` keeps; of one block with itself each pair once."""
    for i, j, value in kernel(x, y) if len(x_ids) and len(y_ids) else ():
        a, b = x_ids[i], y_ids[j]
        fine = a < b if same else a != b
        yield np.minimum(a, b)[fine], np.maximum(a, b)[fine], np.asarray(value)[fine]


def block_pairs(rows: DataFrame, kernel: Callable, value_type: str, width: int, block: int | None = None, connect: bool = False) -> DataFrame:
    """a, b, value of the pairs a < b of ``rows`` (id long and ``data``, ``width`` bytes each) that
    ``kernel`` reports. Rows whose data is null take no part.

    Rows are dealt by a hash of the id into blocks of ``BLOCK_BYTES`` at most (smaller ones, but of
    ``PAIR_BLOCK`` rows, where there would be too few tasks); each pair of blocks meets in one task,
    which holds two blocks. ``kernel(x, y)`` takes two columns of data and yields the positions in x,
    in y and the values of the pairs to keep. Every pair is compared: exact, with work that grows with
    the square of the rows and copies that grow with the number of blocks; only the kept pairs become
    rows, or with ``connect`` the :func:`forest` of each task's, where only what is connected matters.
    """
    rows = rows.filter("id is not null and data is not null")
    count = rows.count()
    if block is None:
        busy = int((4 * rows.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1
        block = max(1, min(BLOCK_BYTES // width, max(PAIR_BLOCK, -(-count // busy))))
    n = max(1, -(-count // block))
    own = rows.select("id", "data", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    left = own.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(n - 1))))
    right = own.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("block")))).select(F.col("id").alias("id_"), F.col("data").alias("data_"), "first", F.col("block").alias("last"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        same = len(x) and x["block"][0].as_py() == x["other"][0].as_py()
        return _reported(_compared(x["data"], y["data_"], x["id"].to_numpy(), y["id_"].to_numpy(), kernel, same), value_type, connect)

    return left.groupBy("block", "other").cogroup(right.groupBy("first", "last")).applyInArrow(compare, f"a long, b long, value {value_type}")


def _in_slices(x, y, pairs: Callable):
    """Positions and values of ``pairs`` (a matrix of x's slice against y, and which of its cells to keep)."""
    for begin, some in _slices(x, len(y)):
        values, keep = pairs(some, y)
        i, j = np.nonzero(keep)
        yield i + begin, j, values[i, j]


def cosine_kernel(threshold: float) -> Callable:
    def pairs(x, y):
        scores = x @ y.T
        return scores, scores >= threshold

    return lambda x, y: _in_slices(unit(matrix(x)), unit(matrix(y)), pairs)


def hamming_kernel(most: int) -> Callable:
    """For data of 64-bit words (arrays of longs)."""

    def words(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)

    def pairs(x, y):
        distance = np.zeros((len(x), len(y)), np.int32)
        for k in range(x.shape[1]):
            distance += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
        return distance, distance <= most

    return lambda x, y: _in_slices(words(x), words(y), pairs)


#: Files from which the index is worth its groups; below, all pairs are compared in blocks.
INDEX_FROM = 80_000
#: Rows of a group of the index that one task holds of either side.
INDEX_BLOCK = 1 << 16


def close_values(values: np.ndarray, others: np.ndarray | None = None, equal: bool = True):
    """Chunks of positions (i, j) of values (0 to 255) that differ in one bit, or in none if ``equal``:
    each pair within ``values`` once, or all pairs of ``values`` and ``others``."""
    same = others is None
    others = values if same else others
    order = np.argsort(others, kind="stable")
    ends = np.cumsum(np.bincount(others, minlength=256))
    sizes = np.diff(np.concatenate([[0], ends]))
    for flip in ([0] if equal else []) + [1 << k for k in range(8)]:
        wanted = values ^ flip
        own = np.flatnonzero(wanted >= values) if same else np.arange(len(values))  # each pair of values once
        n = sizes[wanted[own]]
        at = 0
        while at < len(own):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), CELLS, side="right")) + at)
            some, count = own[at:upto], n[at:upto]
            i = np.repeat(some, count)
            ramp = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            j = order[np.repeat(ends[wanted[some]] - count, count) + ramp]
            if same and flip == 0:
                i, j = i[i < j], j[i < j]
            yield i, j
            at = upto


def indexed_hamming_pairs(rows: DataFrame, most: int, words: int, block: int = INDEX_BLOCK, connect: bool = False) -> DataFrame:
    """a, b, value: the pairs a < b of ``rows`` (id long, ``data``: an array of ``words`` longs) that differ in
    ``most`` bits or fewer, by an index of segments; exact for ``most`` below twice the segments.

    Data of 64 bits is four segments of 16. Where fewer bits differ than twice the segments, one segment
    differs in one bit or none, and so one of its two bytes is equal. Rows are posted under each byte (a
    group: segment, which byte, value) and compared with those of their group whose other byte differs in
    one bit or none: about one in 256 * 256 / 17 of random pairs for each segment. A pair is reported
    by the first segment that is close, so once. A group of more than ``block`` rows, as of a value that
    many files share, is cut into blocks whose pairs meet in tasks of their own. ``connect``: as in
    :func:`block_pairs`.
    """
    segments = 4 * words
    if most >= 2 * segments:
        raise ValueError(f"{most} bits may leave no segment of {segments} close")
    rows = rows.filter("id is not null and data is not null").select("id", "data")

    def post(batches):
        for b in batches:
            data = b.column("data").flatten().to_numpy().view(np.uint8).reshape(len(b), 8 * words)
            place = np.arange(8 * words)
            group = (place[None] * 256 + data).astype(np.int32)  # a byte's place names its segment and which byte it is
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("data"), pa.array(list(group), pa.list_(pa.int32()))], ["id", "data", "groups"])

    posted = rows.mapInArrow(post, "id long, data array<long>, groups array<int>")
    # As many groups at most as there are values of all bytes.
    sizes = posted.select(F.explode("groups").alias("group")).groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = posted.select("id", "data", F.explode("groups").alias("group")).join(F.broadcast(sizes), "group")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("id", "data", "group", "block", other)
    dealt = dealt.select("id", "data", "group", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))

    def compare(own: pa.Table) -> pa.Table:
        place, first, second = own["group"][0].as_py() // 256, own["first"][0].as_py(), own["second"][0].as_py()
        segment, varied = place // 2, place ^ 1  # bytes of a word are little-endian, so a segment's are neighbours
        data = own["data"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(own), words)
        ids, block, value = own["id"].to_numpy(), own["block"].to_numpy(), data.view(np.uint8)[:, varied]
        x = np.flatnonzero(block == first)
        y = x if first == second else np.flatnonzero(block == second)

        def chunks():
            # Equal segments are left to the group of the lower byte.
            for i, j in close_values(value[x], None if first == second else value[y], equal=place % 2 == 0):
                i, j = x[i], y[j]
                distance = np.zeros(len(i), np.int64)
                for k in range(words):
                    distance += np.bitwise_count(data[i, k] ^ data[j, k])
                near = np.flatnonzero((distance <= most) & (ids[i] != ids[j]))
                i, j, distance = i[near], j[near], distance[near]
                apart = np.bitwise_count(data[i].view(np.uint16) ^ data[j].view(np.uint16)) <= 1
                fine = apart.argmax(axis=1) == segment if len(i) else np.empty(0, bool)
                yield np.minimum(ids[i], ids[j])[fine], np.maximum(ids[i], ids[j])[fine], distance[fine]

        return _reported(chunks(), "int", connect)

    return dealt.groupBy("group", "first", "second").applyInArrow(compare, "a long, b long, value int")


#: Vectors that all others' angles are taken to; blocks at most, which have an interval of angles to each.
PIVOTS = 64
MOST_BLOCKS = 16_384
#: Vectors from which pruning is worth its passes; below, all blocks meet.
PRUNE_FROM = 50_000


def meeting(low: np.ndarray, high: np.ndarray, of: np.ndarray, angle: float):
    """For blocks ``of`` those from themselves on that may hold a vector within ``angle``: by the triangle
    inequality none does if its angles to some pivot are further away."""
    for k in of.tolist():
        apart = np.maximum(low[k:] - high[k], low[k] - high[k:]).max(axis=1)
        yield k, k + np.flatnonzero(apart <= angle)


def _cells(rows: DataFrame, block: int, pivots: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The vectors (id, data) with their block, and each block's least and largest angle to every pivot. A
    vector belongs to its nearest pivot, and there to a ring of angles; rings of more than twice ``block``
    vectors, as of many equal ones, are cut by a hash."""
    spark = rows.sparkSession
    drawn = rows.select("id", "data").orderBy(F.xxhash64("id")).limit(pivots).toArrow()
    if not len(drawn):
        return rows.select("id", "data", F.lit(0).alias("block")), np.empty((0, 1)), np.empty((0, 1))
    centres = unit(matrix(drawn["data"]))
    angles = lambda data: np.arccos(np.clip(unit(matrix(data, centres.shape[1])) @ centres.T, -1, 1))

    def deal(batches):
        for b in batches:
            own = angles(b.column("data"))
            cell = own.argmin(axis=1) if len(own) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("data"), pa.array(cell, pa.int32()), pa.array(own[np.arange(len(own)), cell])], ["id", "data", "cell", "angle"])

    kind = rows.schema["data"].dataType.simpleString()
    dealt = scratch.keep(rows.select("id", "data").mapInArrow(deal, f"id long, data {kind}, cell int, angle double"))
    sizes = dict(dealt.groupBy("cell").count().collect())  # a number for each pivot
    rings = {c: max(1, -(-n // block)) for c, n in sizes.items()}
    most = max(rings.values())
    cuts = dict(dealt.groupBy("cell").agg(F.percentile_approx("angle", [k / most for k in range(1, most)] or [0.5]).alias("cuts")).collect())
    edges = {c: [cuts[c][k * most // n - 1] for k in range(1, n)] for c, n in rings.items()}
    firsts = dict(zip(rings, np.cumsum([0, *rings.values()]).tolist()))

    def ring(b) -> np.ndarray:
        cell, angle = b.column("cell").to_numpy(), b.column("angle").to_numpy()
        out = np.empty(len(cell), np.int32)
        for c in np.unique(cell).tolist():
            own = cell == c
            out[own] = firsts[c] + np.searchsorted(edges[c], angle[own], side="right")
        return out

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("data"), pa.array(ring(b))], ["id", "data", "ring"])

    def measured(batches):
        """ring, n, low, high of what a task has."""
        found: dict[int, list] = {}
        for b in batches:
            own, at = angles(b.column("data")), ring(b)
            for k in np.unique(at).tolist():
                some = own[at == k]
                n, low, high = found.get(k, (0, some[0], some[0]))
                found[k] = n + len(some), np.minimum(low, some.min(axis=0)), np.maximum(high, some.max(axis=0))
        rows = [(k, *v) for k, v in found.items()]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["ring", "n", "low", "high"])

    each = F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "x")
    spans = dealt.mapInArrow(measured, "ring int, n long, low array<double>, high array<double>").select("ring", "n", each)
    spans = spans.groupBy("ring", "pivot").agg(F.sum("n").alias("n"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    spans = spans.orderBy("ring", "pivot").toArrow()  # MOST_BLOCKS * PIVOTS rows at most, about
    of = spans["ring"].to_numpy().reshape(-1, len(centres))[:, 0]
    n, low, high = (spans[c].to_numpy().reshape(-1, len(centres)) for c in ("n", "low", "high"))
    parts = np.maximum(1, -(-n[:, 0] // (2 * block)))
    begins = np.cumsum(parts) - parts
    table = spark.createDataFrame(list(zip(of.tolist(), begins.tolist(), parts.tolist())), "ring int, begin int, parts int")
    with_ring = dealt.mapInArrow(placed, f"id long, data {kind}, ring int").join(F.broadcast(table), "ring")
    block_ = (F.col("begin") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block")
    return scratch.keep(with_ring.select("id", "data", block_)), np.repeat(low, parts, axis=0), np.repeat(high, parts, axis=0)


def pruned_cosine_pairs(rows: DataFrame, threshold: float, scratch: Scratch, block: int | None = None, pivots: int = PIVOTS, connect: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pairs that ``block_pairs(rows, cosine_kernel(threshold), "double")`` gives, for a threshold above 0, and the
    pairs of blocks (first, second) that met for them.

    Vectors are dealt to blocks by their nearest pivot and their angle to it. Each block knows its interval of
    angles to every pivot, and angles between vectors obey the triangle inequality, so two blocks whose
    intervals to some pivot are further apart than the threshold's angle never meet. Exact; how much is
    saved depends on how the vectors cluster. A task holds two blocks.
    """
    if threshold <= 0:
        raise ValueError("a threshold that vectors at a right angle reach excludes nothing")
    rows = rows.filter("id is not null and data is not null")
    size = F.aggregate("data", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.filter((size > 0) & (size < float("inf")))  # zero and endless vectors match none
    if block is None:
        first = rows.select(F.size("data")).head(1)
        block = max(PAIR_BLOCK, min(BLOCK_BYTES // (8 * max(1, first[0][0] if first else 1)), 8192), -(-rows.count() // (MOST_BLOCKS // 2)))
    placed, low, high = _cells(rows, block, pivots, scratch)
    shared, angle = rows.sparkSession.sparkContext.broadcast((low, high)), float(np.arccos(min(1.0, threshold))) + 1e-6

    def meet(batches):
        for b in batches:
            for k, others in meeting(*shared.value, b.column("id").to_numpy(), angle):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), k), pa.int32()), pa.array(others, pa.int32())], ["first", "second"])

    met = scratch.keep(rows.sparkSession.range(len(low)).mapInArrow(meet, "first int, second int"))
    left = placed.join(met, placed["block"] == met["first"]).select("id", "data", "first", "second")
    right = placed.join(met, placed["block"] == met["second"]).select(F.col("id").alias("id_"), F.col("data").alias("data_"), F.col("first").alias("a"), F.col("second").alias("b"))
    kernel = cosine_kernel(threshold)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        same = len(x) and x["first"][0].as_py() == x["second"][0].as_py()
        return _reported(_compared(x["data"], y["data_"], x["id"].to_numpy(), y["id_"].to_numpy(), kernel, same), "double", connect)

    return left.groupBy("first", "second").cogroup(right.groupBy("a", "b")).applyInArrow(compare, "a long, b long, value double"), met
