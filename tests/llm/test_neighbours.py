import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.llm import neighbours as N
from likeness.llm.common import table


def _exact(ids, x, query, k):
    d = np.sqrt(((x - x[query]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_recall_and_scores(spark, sf_dir):
    vectors = table(spark, sf_dir.replace("0.001", "0.1"), "embeddings")
    got = N.search(vectors, F.col("id") % 20 == 0).toPandas()
    rows = vectors.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    at = {i: n for n, i in enumerate(ids)}
    hits = total = 0
    for query, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        for r in own.itertuples():
            assert r.score == pytest.approx(float(np.sqrt(((x[at[r.vec_id]] - x[at[query]]) ** 2).sum())), abs=1e-12)
        assert own.sort_values(["score", "vec_id"]).vec_id.tolist() == own.vec_id.tolist()
        want = {i for i, _ in _exact(ids, x, at[query], 10)}
        hits, total = hits + len(want & set(own.vec_id)), total + 10
    assert hits / total >= 0.9


def test_odd_vectors_take_no_part_and_ties_go_to_smaller_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [])]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = N.search(frame, F.col("id") <= 3, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 1)]
    few = N.search(frame.filter("vec_id < 2"), F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in few] == [(1, 0.0)]
    assert N.search(frame.limit(0), F.col("id") == 0).count() == 0
    assert N.search(frame, F.col("id") == 99).count() == 0


@pytest.mark.parametrize("kind", ["double", "int", "decimal(6,2)"])
def test_other_element_types_are_kept(spark, kind):
    x = [1e-9, 1.0] if kind == "double" else [3, 1]
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, [float(v) for v in x]), (2, [5.0, 5.0])], "vec_id long, embedding array<double>")
    rows = rows.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    got = N.search(rows, F.col("id") == 0, k=2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2] and got[0].score == (1e-9 if kind == "double" else 3.0)


def test_parts_are_balanced_and_cut_fewer_edges_than_chance():
    r = np.random.default_rng(0)
    centres = r.standard_normal((8, 16)) * 3
    x = np.concatenate([c + r.standard_normal((100, 16)) for c in centres])
    graph = N.neighbour_graph(x, 10)
    parts = N.balanced_parts(graph, 3)
    assert np.bincount(parts).tolist() == [100] * 8
    assert (parts[graph] != parts[:, None]).mean() < 0.35


def test_clustered_vectors_need_few_parts():
    r = np.random.default_rng(1)
    centres = r.standard_normal((64, 16)) * 4
    x = np.concatenate([c + r.standard_normal((64, 16)) for c in centres])
    state, probes = N.fit(x, 32 * N.ROWS_BY_PART, 10)
    assert len(state["c"]) >= 16 and probes <= len(state["c"]) // 2


def test_a_hot_vector_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 64)
    frame = spark.range(600).selectExpr("id vec_id", "if(id % 3 = 0, array(1f, 2f), array(cast(id as float), cast(id * id % 17 as float))) embedding")
    got = N.search(frame, F.col("id") % 30 == 0, k=5).toPandas()
    same = got[got.query_id % 3 == 0].sort_values(["query_id", "rank"])
    for query, own in same.groupby("query_id"):
        assert own.vec_id.tolist() == [i for i in range(0, 21, 3) if i != query][:5] and set(own.score) == {0.0}
