import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import faces, joins, kernels
from likeness.operators.components import components, smallest_reached
from likeness.sources.scratch import Scratch


def _plain_labels(edges):
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("small", [0, None])
def test_components_equal_plain_labels(spark, small, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    r = np.random.default_rng(0)
    edges = [e for e in r.integers(0, 400, (330, 2)).tolist() if e[0] != e[1]] + [[500, 500 + k] for k in range(1, 60)] + [[700 + k, 701 + k] for k in range(40)] + [[-5, 3]]
    df = spark.createDataFrame([*edges, *edges[:5], [7, 7], [None, 3], [4, None], [9999, 9999]], "a long, b long")
    want = _plain_labels(edges)
    assert dict(map(tuple, components(df, Scratch(spark, "t"), small).collect())) == want
    assert components(df.limit(0), Scratch(spark, "t"), small).collect() == []
    a, b = np.array(edges).T
    assert dict(zip(*(x.tolist() for x in smallest_reached(a, b)))) == want


def test_long_chains_and_large_stars_take_few_rounds(spark):
    order = np.random.default_rng(1).permutation(2000).tolist()
    chain = spark.createDataFrame(list(zip(order[:-1], order[1:])), "a long, b long")
    for edges, n, most in ((chain, 2000, 14), (spark.range(1, 300_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), 300_000, 2)):
        scratch = Scratch(spark, "t")
        got = components(edges, scratch, 0)
        assert got.count() == n and got.filter("label <> 0").isEmpty() and scratch.made <= 2 + 5 * most


@pytest.mark.parametrize("hot", [10_000, 3])
def test_join_unique(spark, hot, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 1, k) for k in range(60)] + [(None, 5), (99, 6)], "key long, n long")
    unique = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "key long, v string")
    want = sorted(map(tuple, rows.join(unique, "key").select("key", "n", "v").collect()))
    assert sorted(map(tuple, joins.join_unique(rows, unique, "key").select("key", "n", "v").collect())) == want


def test_forest_keeps_what_pairs_connect():
    a, b, value = np.array([1, 1, 2, 8]), np.array([2, 3, 3, 9]), np.array([5.0, 1.0, 7.0, 2.0])
    assert sorted(zip(*(c.tolist() for c in kernels.forest(a, b, value)))) == [(1, 2, 7.0), (1, 3, 7.0), (8, 9, 2.0)]


def _clustered(n, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.15 * r.standard_normal(16)).tolist()) for i in range(n)]
    rows += [(n + i, centres[0].tolist()) for i in range(n // 3)]  # many equal ones
    return [*rows, (n * 2, [0.0] * 16), (n * 2 + 1, [float("nan")] * 16), (None, centres[0].tolist()), (n * 2 + 2, None)]


def test_pruning_leaves_no_pair_out_and_skips_blocks(spark):
    df = spark.createDataFrame(_clustered(600), "id long, data array<double>")
    want = sorted((r.a, r.b) for r in kernels.block_pairs(df, kernels.cosine_kernel(0.9), "double", 128).collect())
    found, met = kernels.pruned_cosine_pairs(df, 0.9, Scratch(spark, "t"), block=20, pivots=10)
    got = sorted((r.a, r.b) for r in found.collect())
    n_blocks = met.agg(F.max("second")).first()[0] + 1
    assert want and got == want and n_blocks > 30
    assert met.count() < 0.5 * n_blocks * (n_blocks + 1) / 2
    with pytest.raises(ValueError):
        kernels.pruned_cosine_pairs(df, 0.0, Scratch(spark, "t"))
    assert kernels.pruned_cosine_pairs(df.limit(0), 0.9, Scratch(spark, "t"))[0].collect() == []


def test_clusters_by_pruning_are_those_by_all_pairs(spark):
    rows = [(i, i // 2, None, v) for i, v in _clustered(150, 3) if i is not None and (v is None or v[0] == v[0])]
    df = spark.createDataFrame(rows, "id long, file_id long, person_id long, vector array<float>")
    all_pairs, pruned = (sorted(map(tuple, faces.cluster_members(df, 0.95, prune_from=n).collect())) for n in (10**9, 1))
    assert all_pairs == pruned and len(all_pairs) == len(rows)
    assert max(sum(c == k for _, _, c in pruned) for k in {c for _, _, c in pruned}) >= 50
