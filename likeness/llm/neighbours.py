"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample drawn by a hash of the id (``SAMPLE`` vectors on average): the sample's
neighbour graph is cut into equal parts by recursive bisection (a smoothed random vector split at
its median, then swaps that keep the balance and cut fewer edges); a small classifier learns, from a
vector, the parts of its neighbours. Indexing: the classifier puts every vector into its most
probable part. Searching: a query goes to its most probable parts, as many as sample vectors that
the classifier hasn't learned from need for a recall of ``RECALL``; there its distances are computed
exactly. Each part's vectors and the queries that come to it are dealt in blocks of ``BLOCK_BYTES``,
so a part that holds a third of all vectors is many tasks, and a task holds two blocks; a vector is
copied once for each query block of its own part. There are ``MOST_PARTS`` parts at most, as the
sample is bounded; in a larger table parts grow, and with them the work of a query.

Vectors keep their element type (float, double; other numbers become doubles). Those that are null,
zero, hold null or non-finite components, have no id, or differ in length from most take no part.
Ties go to smaller ids; rows that share a query's id are its own; with no vectors or no queries the
result is empty; repeated candidates are each found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.sources.scratch import Scratch

SAMPLE = 4096
SAMPLE_NEIGHBOURS = 10
ROWS_BY_PART = 1024
HIDDEN = 64
RECALL = 0.94
#: Sample vectors that a part has to have, and so the most parts there can be.
SAMPLE_BY_PART = 64
MOST_PARTS = SAMPLE // SAMPLE_BY_PART
#: Vectors of a block, as doubles.
BLOCK_BYTES = 16 << 20
#: Distances that a task holds at once.
DISTANCES = 1 << 21


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the rows that can be among its k nearest: all within the k-th distance, up to
    rounding. ``skip`` marks pairs to leave out."""
    d = (rows**2).sum(1)[None] - 2 * (queries @ rows.T)
    if skip is not None:
        d[skip] = np.inf
    k = min(k, d.shape[1])
    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    slack = 1e-9 * (1 + np.abs(limit) + (queries**2).sum(1))
    return [np.flatnonzero(row <= most) for row, most in zip(d, limit + slack)]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest others."""
    out = np.empty((len(x), k), np.int64)
    norms = (x**2).sum(1)
    for i in range(0, len(x), 1024):
        d = norms[None] - 2 * (x[i : i + 1024] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[i : i + 1024] = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
    return out


def bisect(edges: np.ndarray, n: int, r: np.random.Generator, smoothing: int = 40, swaps: int = 12) -> np.ndarray:
    """A balanced side (bool) for each of n nodes that cuts few of the edges (pairs, both ways)."""
    degree = np.maximum(np.bincount(edges[:, 0], minlength=n), 1)
    around = lambda v: np.bincount(edges[:, 0], weights=v[edges[:, 1]], minlength=n)
    v = r.standard_normal(n)
    for _ in range(smoothing):
        v = 0.5 * v + 0.5 * around(v) / degree
        v -= v.mean()
        v /= np.linalg.norm(v) or 1
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(swaps):
        other = around(np.where(side, 1.0, -1.0)) * np.where(side, -1.0, 1.0)  # edges to the other side less own
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-other[a], kind="stable")], b[np.argsort(-other[b], kind="stable")]
        m = min(len(a), len(b))
        good = np.flatnonzero(other[a[:m]] + other[b[:m]] > 0)
        some = good[: max(1, len(good) // 4)] if len(good) else good
        if not len(some):
            break
        side[a[some]], side[b[some]] = True, False
    return side


def balanced_parts(graph: np.ndarray, levels: int, seed: int = 3) -> np.ndarray:
    """A part from 0 to 2**levels - 1 for each node; sizes differ by the rounding of halves."""
    r, n = np.random.default_rng(seed), len(graph)
    parts = np.zeros(n, np.int64)
    source = np.repeat(np.arange(n), graph.shape[1])
    edges = np.concatenate([np.stack([source, graph.ravel()], 1), np.stack([graph.ravel(), source], 1)])
    for _ in range(levels):
        new = parts * 2
        for p in np.unique(parts):
            own = np.flatnonzero(parts == p)
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            inner = at[edges]
            new[own] += bisect(inner[(inner >= 0).all(1)], len(own), r)
        parts = new
    return parts


class Router:
    """A two-layer classifier: vector -> probability of each part."""

    def __init__(self, state: dict):
        self.s = state

    @classmethod
    def learn(cls, x: np.ndarray, targets: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 5) -> Router:
        r = np.random.default_rng(seed)
        scale = x.std() or 1.0
        s = {"m": x.mean(0), "a": r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "v": r.normal(0, HIDDEN**-0.5, (HIDDEN, targets.shape[1])), "c": np.zeros(targets.shape[1])}
        z, names = (x - s["m"]) / scale, ("a", "b", "v", "c")
        m, v, t = {k: np.zeros_like(s[k]) for k in names}, {k: np.zeros_like(s[k]) for k in names}, 0
        for epoch in range(epochs):
            order = r.permutation(len(z))
            for i in range(0, len(z), batch):
                xs, ys = z[order[i : i + batch]], targets[order[i : i + batch]]
                h = np.maximum(xs @ s["a"] + s["b"], 0)
                q = cls._softmax(h @ s["v"] + s["c"]) - ys
                q /= len(xs)
                back = (q @ s["v"].T) * (h > 0)
                t += 1
                for k, g in (("a", xs.T @ back + 1e-4 * s["a"]), ("b", back.sum(0)), ("v", h.T @ q + 1e-4 * s["v"]), ("c", q.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    s[k] = s[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        s["a"] = s["a"] / scale
        return cls(s)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.s
        return self._softmax(np.maximum((x - s["m"]) @ s["a"] + s["b"], 0) @ s["v"] + s["c"])


def fit(x: np.ndarray, n: int, k: int, recall: float = RECALL) -> tuple[dict, int]:
    """The router's state and the number of parts to search, from a sample ``x`` of ``n`` vectors."""
    levels = int(max(0, min(round(np.log2(max(1, n / ROWS_BY_PART))) + 1, np.log2(max(1, len(x) / SAMPLE_BY_PART)))))
    if not levels:
        return {"m": np.zeros(x.shape[1]), "a": np.zeros((x.shape[1], 1)), "b": np.zeros(1), "v": np.zeros((1, 1)), "c": np.zeros(1)}, 1
    near = neighbour_graph(x, min(SAMPLE_NEIGHBOURS, len(x) - 1))
    parts, n_parts = balanced_parts(near, levels), 2**levels
    targets = np.zeros((len(x), n_parts))
    np.add.at(targets, (np.repeat(np.arange(len(x)), near.shape[1]), parts[near].ravel()), 1)
    np.add.at(targets, (np.arange(len(x)), parts), 1)
    targets /= targets.sum(1, keepdims=True)
    held = np.random.default_rng(9).random(len(x)) < 0.2
    router = Router.learn(x[~held], targets[~held])
    p = router.probabilities(x)
    put, ranks = p.argmax(1), np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(ranks[held], put[near[held]], 1)  # the rank at which each true neighbour is met
    found = [(needed < m).mean() for m in range(1, n_parts + 1)]
    return router.s, 1 + next((i for i, f in enumerate(found) if f >= recall), n_parts - 1)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def valid(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """id, v of the vectors that take part."""
    v = F.col("v")
    kind = vectors.schema[vector_name].dataType.elementType.simpleString()
    of = F.col(vector_name) if kind in ("float", "double") else F.col(vector_name).cast("array<double>")
    own = vectors.select(F.col(id_name).cast("long").alias("id"), of.alias("v")).filter("id is not null and v is not null")
    fine = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    own = own.filter(fine & F.exists(v, lambda x: x != 0))
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return own.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _by_part(numbers: dict[int, int]) -> Column:
    """A number for each part, null for others."""
    return F.create_map(*[F.lit(x).cast("int") for pair in numbers.items() for x in pair])[F.col("part")]


def search(vectors: DataFrame, is_query, k: int = 10, id_name: str = "vec_id", vector_name: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest found for every
    row that the column ``is_query`` (of ``id``) marks, among all other rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    own = valid(vectors, id_name, vector_name)
    n = own.count()
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    sample = own.filter(share).orderBy("id", F.xxhash64("v")).toArrow()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(sample["v"].combine_chunks())
    state, probes = fit(x, n, k, recall)
    block_rows, kind = max(1, BLOCK_BYTES // (8 * x.shape[1])), own.schema["v"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(state)

    def assign(batches):
        router = Router(shared.value)
        for b in batches:
            x = _matrix(b.column("v"))
            put = router.probabilities(x).argmax(1) if len(x) else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(put, pa.int32())], ["id", "v", "part"])

    indexed = scratch.keep(own.mapInArrow(assign, f"id long, v {kind}, part int"))
    counts, some_query = {}, False
    for r in indexed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect():  # a row per part
        counts[r["part"]], some_query = r["n"], some_query or r["q"] > 0
    if not some_query:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Even the smallest parts together have to hold k others.
    for probes in range(probes, len(state["c"]) + 1):
        smallest = sorted(counts.get(p, 0) for p in range(len(state["c"])))[:probes]
        if sum(smallest) > k:
            break

    def route(batches):
        router = Router(shared.value)
        for b in batches:
            x = _matrix(b.column("v"))
            best = np.argsort(-router.probabilities(x), axis=1, kind="stable")[:, :probes].tolist() if len(x) else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(best, pa.list_(pa.int32()))], ["id", "v", "parts"])

    routed = indexed.filter(is_query).select("id", "v").mapInArrow(route, f"id long, v {kind}, parts array<int>")
    routed = scratch.keep(routed.select("id", "v", F.explode("parts").alias("part")))
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}  # a row per part
    n_blocks = _by_part({p: -(-c // block_rows) for p, c in counts.items()})
    n_query_blocks = _by_part({p: -(-c // block_rows) for p, c in asked.items()})
    block = lambda of, most: F.pmod(F.xxhash64("id", F.lit(of)), most).cast("int")
    each = lambda most: F.explode(F.sequence(F.lit(0), most - 1))
    candidates = indexed.filter(n_query_blocks.isNotNull()).withColumn("block", block("candidate", n_blocks)).withColumn("query_block", each(n_query_blocks))
    routed = routed.filter(n_blocks.isNotNull()).withColumn("query_block", block("query", n_query_blocks)).withColumn("block", each(n_blocks))
    keys = ["part", "block", "query_block"]

    def rerank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(rows) and len(queries):
            x, q = _matrix(rows["v"].combine_chunks()), _matrix(queries["v"].combine_chunks())
            ids, query_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
            step = max(1, min(256, DISTANCES // len(x)))
            for i in range(0, len(q), step):
                some = q[i : i + step]
                skip = query_ids[i : i + step, None] == ids[None]
                for j, near in enumerate(nearest(some, x, k, skip)):
                    near = near[~skip[j, near]]
                    d = np.sqrt(((x[near] - some[j]) ** 2).sum(1))
                    first = np.lexsort((ids[near], d))[:k]
                    out[0] += [query_ids[i + j]] * len(first)
                    out[1] += ids[near[first]].tolist()
                    out[2] += d[first].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = candidates.select(*keys, "id", "v").groupBy(*keys).cogroup(routed.select(*keys, "id", "v").groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
