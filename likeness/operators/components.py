"""Connected components of an edge table.

Up to ``SMALL`` edges are labelled in one task. More are rewritten in rounds of alternating stars: the
large star hangs every larger neighbour of a node below the smallest node around it, the small star
does so with the node itself and its smaller neighbours. Each keeps the components as they are, and the
edges end as stars around the smallest nodes, after a number of rounds that grows with the logarithm of
the nodes. Minima combine before they are shuffled, and nodes with very many edges (a hub, the smallest
node of a giant component) are set apart from the joins that hand their minimum to each of their edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from likeness.operators.joins import join_unique
from likeness.sources.scratch import Scratch

#: Edges that one task labels: 16 bytes each.
SMALL = 1_000_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node that each reaches, by minima around them and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)  # a whole star follows its root
        np.minimum.at(label, label[y], least)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return nodes, nodes[label]


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches):
        found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if len(b)]
        if found:
            nodes, labels = smallest_reached(*(np.concatenate(c) for c in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])

    return links.coalesce(1).mapInArrow(run, "node long, label long")


def _minima(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (a, b) the smallest b of each a, and how many it has."""
    found = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    return found.select("a", "m"), found.select("a", "_n")


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    both = scratch.keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    minima, counts = _minima(both)
    minima = scratch.keep(minima.join(counts, "a"))
    hung = join_unique(both, minima.select("a", F.least("a", "m").alias("m")), "a", minima.select("a", "_n"))
    out = scratch.keep(hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    scratch.drop(both)
    scratch.drop(minima)
    return out


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Of edges (a, b), a > b."""
    minima, counts = _minima(links)
    minima = scratch.keep(minima.join(counts, "a"))
    hung = join_unique(links, minima.select("a", "m"), "a", minima.select("a", "_n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = scratch.keep(hung.unionByName(minima.select("a", F.col("m").alias("b"))).distinct())
    scratch.drop(minima)
    return out


def components(edges: DataFrame, scratch: Scratch, small: int | None = None) -> DataFrame:
    """node, label for every node of ``edges`` (a, b: long): label is the smallest node it reaches. Edges with a
    null end and loops are ignored. Rounds are written to the shared folder and end when no edge changes."""
    both = edges.filter("a is not null and b is not null and a <> b")
    links = scratch.keep(both.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    sign = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    before = sign(links)
    if before[0] <= (SMALL if small is None else small):
        labels = scratch.keep(_in_one_task(links))
        scratch.drop(links)
        return labels
    while True:
        wide = _large_star(links, scratch)
        scratch.drop(links)
        links = _small_star(wide, scratch)
        scratch.drop(wide)
        after = sign(links)
        if after == before:
            labels = scratch.keep(links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))))
            scratch.drop(links)
            return labels
        before = after
