import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.functions import hashing
from likeness.operators import companions, components, duplicates, faces, kernels, learn, score, search, tags
from likeness.sources.scratch import Scratch

EMB = "id long, file_id long, vector array<float>"


def _unit(r, n, d=16):
    x = r.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_ranking_takes_the_best_vector_drops_nan_and_breaks_ties_by_id(spark):
    e = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 1.0]), (4, 3, [1.0, 1.0]), (5, 4, [float("nan"), 1.0]), (6, 5, [0.0, 0.0])], EMB)
    got = [(r.file_id, round(r.score, 4)) for r in search.by_vector(e, [1.0, 0.0], 10).collect()]
    assert got == [(1, 1.0), (2, 0.7071), (3, 0.7071), (5, 0.0)]
    assert [r.file_id for r in search.by_vector(e, [1.0, 0.0], 2, 0.5).collect()] == [1, 2]
    concepts = spark.createDataFrame([("a", [1.0, 0.0], 0.8)], "name string, prototype array<double>, threshold double")
    assert [r.file_id for r in search.by_concept(e, concepts, "a").collect()] == [1]
    assert len(search.by_concept(e, concepts, "a", threshold=0.5).collect()) == 3
    with pytest.raises(KeyError):
        search.by_concept(e, concepts, "b")
    with pytest.raises(ValueError):
        search.by_examples(e, e.limit(0))


def test_verify_ranks_candidates_again_and_failures_last(spark):
    e = spark.createDataFrame([(i, i, [1.0, i / 10]) for i in range(5)] + [(9, 9, [-1.0, 0.0])], EMB)
    got = [(r.file_id, r.verified) for r in search.verify(e, [1.0, 0.0], F.when(F.col("file_id") != 2, F.col("file_id") / 10)).collect()]
    assert got == [(4, 0.4), (3, 0.3), (1, 0.1), (0, 0.0), (2, 0.0)]


def test_verifiers_are_asked_in_batches_and_failures_count_as_zero(spark):
    from likeness.sources.plugins import verify_with

    class Fussy:
        def verify(self, paths, phrase):
            if "/3" in paths:
                raise OSError("unreadable")
            if len(paths) > 1 and "/4" in paths:
                return []
            return [(float("nan"), "1,1,2,2") if p == "/2" else (int(p[1:]) / 10, phrase) for p in paths]

    e = spark.createDataFrame([(i, i, [1.0, i / 10]) for i in range(6)] + [(9, 9, [-1.0, 0.0])], EMB)
    files = spark.createDataFrame([(i, f"/{i}") for i in range(10) if i != 5], "id long, path string")
    found = search.verify_files(e, files, [1.0, 0.0], verify_with(Fussy(), "cat", batch=2))
    got = {r.file_id: (r.verified, r.box, r.error) for r in found.collect()}
    assert got == {0: (0.0, "cat", None), 1: (0.1, "cat", None), 2: (0.0, None, "no finite score"), 3: (0.0, None, "unreadable"), 4: (0.4, "cat", None)}
    assert [r.file_id for r in found.collect()] == [4, 1, 0, 2, 3] and search.verify_files(e, files.limit(0), [1.0, 0.0], verify_with(Fussy(), "cat")).count() == 0


def test_one_pass_scores_equal_single_searches_in_any_blocks(spark):
    r = np.random.default_rng(0)
    x, p = _unit(r, 200), _unit(r, 7)
    e = spark.createDataFrame([(i, i // 3, x[i].tolist()) for i in range(200)], EMB)
    targets = spark.createDataFrame([(i, p[i].tolist(), 0.2) for i in range(7)], "target_id long, prototype array<float>, cutoff double")
    want = {}
    for i in range(200):
        for t in range(7):
            s = float(x[i].astype(float) @ p[t].astype(float))
            if s >= 0.2:
                want[i // 3, t] = max(s, want.get((i // 3, t), -1))
    for block in (3, 7, 100):
        got = {(r.file_id, r.target_id): r.score for r in kernels.score_targets(e, targets, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
        best = {r.id: r.target_id for r in kernels.best_target(e, targets, "id", block=block).collect()}
        assert best == dict(enumerate((x @ p.T).argmax(1).tolist()))
    assert kernels.score_targets(e, targets.limit(0)).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        kernels.score_targets(e, spark.createDataFrame([(1, [1.0], 0.0)], targets.schema)).collect()


def test_odd_vectors_and_targets(spark, monkeypatch):
    monkeypatch.setattr(kernels, "CELLS", 5)
    nan = float("nan")
    e = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, None), (3, 2, [0.0, 1.0]), (4, None, [1.0, 0.0]), (5, 3, [nan, 1.0]), (6, 4, [0.0, 0.0])], EMB)
    rows = [(7, [1.0, 0.0], 0.5), (7, [0.0, 1.0], 0.5), (None, [1.0, 1.0], 0.7), (None, [-1.0, 0.0], 0.9), (8, None, 0.0)] + [(7, [-1.0, -1.0], 0.5)] * 5
    targets = spark.createDataFrame(rows, "target_id long, prototype array<float>, cutoff double")
    for block in (1, 3, 100):
        got = {(r.file_id, r.target_id): round(r.score, 6) for r in kernels.score_targets(e, targets, block=block).collect()}
        assert got == {(1, 7): 1.0, (2, 7): 1.0, (None, 7): 1.0, (1, None): 0.707107, (2, None): 0.707107, (None, None): 0.707107}
        best = {r.id: r.target_id for r in kernels.best_target(e.filter("id <> 5"), targets.filter("target_id is not null"), "id", block=block).collect()}
        assert best == {1: 7, 3: 7, 4: 7, 6: 7}
    ragged = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0, 2.0, 3.0])], EMB)
    for run in (lambda: kernels.score_targets(ragged, targets), lambda: kernels.best_target(ragged, targets.limit(2), "id"), lambda: kernels.score_targets(e, spark.createDataFrame([(1, [1.0], 0.0), (2, [1.0, 2.0, 3.0], 0.0)], targets.schema))):
        with pytest.raises(Exception, match="dimensions"):
            run().collect()


@pytest.mark.parametrize("block", [7, 1000, None])
def test_block_pairs_compare_everything_once(spark, block, monkeypatch):
    monkeypatch.setattr(kernels, "CELLS", 100)
    monkeypatch.setattr(kernels, "PAIR_BLOCK", 10)
    r = np.random.default_rng(1)
    x = _unit(r, 60, 6)
    rows = spark.createDataFrame([(i * 2, x[i].tolist()) for i in range(60)] + [(1, None), (None, [1.0] * 6)], "id long, data array<float>")
    got = sorted((r.a, r.b) for r in kernels.block_pairs(rows, kernels.cosine_kernel(0.5), "double", 48, block).collect())
    s = x.astype(float) @ x.astype(float).T
    assert got == [(i * 2, j * 2) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5]
    h = r.integers(0, 2**16, (60, 2))
    rows = spark.createDataFrame([(i, h[i].tolist()) for i in range(60)], "id long, data array<long>")
    got = sorted((r.a, r.b, r.value) for r in kernels.block_pairs(rows, kernels.hamming_kernel(12), "int", 16, block).collect())
    bits = lambda i, j: sum(bin(int(a ^ b)).count("1") for a, b in zip(h[i], h[j]))
    assert got == [(i, j, bits(i, j)) for i in range(60) for j in range(i + 1, 60) if bits(i, j) <= 12]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 1)], "a long, b long")
    got = dict(components.components(edges, Scratch(spark, "t")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def _calibrated(spark, positives, library, floor=0.6):
    frame = lambda xs: spark.createDataFrame([(1, float(x)) for x in xs], "concept_id long, score double")
    least = learn.least_scores(frame(positives))
    return learn.calibrate(least, learn.bucketed(frame(library), least), floor=floor).first()


def _reference_threshold(positives, library, floor=0.6):
    low = float(np.percentile(positives, 10))
    fallback = max(low, floor)
    band = np.sort(np.array([x for x in library if x <= low]))[::-1]
    if len(library) < 8 or len(band) < 2:
        return fallback
    gaps = band[:-1] - band[1:]
    i = int(np.argmax(gaps))
    return fallback if gaps[i] < 0.02 else min(max((band[i] + band[i + 1]) / 2, floor), fallback)


@pytest.mark.parametrize(
    ("positives", "library"),
    [
        ([0.99, 0.98, 0.97], [0.9, 0.89, 0.88, 0.7, 0.69, 0.5, 0.4, 0.3, 0.2]), ([0.9, 0.91], [0.5] * 7), ([0.9, 0.91], list(np.linspace(0.2, 0.9, 200))), ([0.65, 0.7], [0.1, 0.11, 0.12, 0.13, 0.14, 0.6, 0.61, 0.62]),
        ([0.5, 0.4], [0.1] * 20), ([0.857, 0.86, 0.87, 0.88, 0.889], [0.716, 0.71, 0.7, 0.69, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.254]), ([0.9], [0.95] * 10), ([0.9], [0.3, 0.3, 0.5, 0.5, 0.7, 0.7, 0.9, 0.9]),
    ],
)
def test_calibration(spark, positives, library):
    assert _calibrated(spark, positives, library).threshold == pytest.approx(_reference_threshold(positives, library))


def test_widest_gaps_equal_plain_sorting(spark):
    r = np.random.default_rng(2)
    rows = [(int(k), float(x)) for k, x in zip(r.integers(0, 3, 400), r.random(400))] + [(3, 0.5), (4, 0.25), (4, 0.25), (5, 0.5), (5, 0.50001)]
    least = spark.createDataFrame([(0, 0.9), (1, 2.0), (2, 0.3), (3, 1.0), (4, 1.0), (5, 1.0)], "concept_id long, least double")
    want = {k: (None, None) for k in (3, 4, 5)}
    for k, most in ((0, 0.9), (1, 2.0), (2, 0.3)):
        s = sorted((x for c, x in rows if c == k and x <= most), reverse=True)
        want[k] = max((a - b, a, b) for a, b in zip(s, s[1:]))[1:]
    found = learn.bucketed(spark.createDataFrame(rows, "concept_id long, score double"), least)
    got = {r.concept_id: (r.n, r.upper, r.lower) for r in learn.widest_gaps(found).collect()}
    assert {k: v[1:] for k, v in got.items()} == want and got[4][0] == 2


def test_library_buckets_equal_buckets_of_all_scores(spark):
    r = np.random.default_rng(8)
    x, p = _unit(r, 300), _unit(r, 3)
    e = spark.createDataFrame([(i, i // 3, x[i].tolist()) for i in range(300)] + [(999, 5, None)], EMB)
    protos = spark.createDataFrame([(k, p[k].tolist()) for k in range(3)], "concept_id long, prototype array<float>")
    least = spark.createDataFrame([(0, 0.3), (1, 0.0), (2, 1.0)], "concept_id long, least double")
    without = spark.createDataFrame([(0, 4), (0, 4), (0, 7), (2, 4), (1, None)], "concept_id long, file_id long")
    rows = [(k, float(s)) for i in range(300) for k, s in enumerate(x[i].astype(float) @ p.astype(float).T) if (k, i // 3) not in {(0, 4), (0, 7), (2, 4)}]
    want = learn.bucketed(spark.createDataFrame(rows, "concept_id long, score double"), least)
    key = lambda r: (r.concept_id, -1 if r.bucket is None else r.bucket)
    for got, other in zip(sorted(learn.library_buckets(e, protos, least, exclude=without).collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert key(got) == key(other) and got.n == other.n and (got.top is None or (got.top, got.bottom) == pytest.approx((other.top, other.bottom), abs=1e-6))


def test_teaching_excludes_its_examples_and_respects_negatives(spark):
    r = np.random.default_rng(3)
    base = _unit(r, 1)[0]
    near = [(base + 0.05 * v).tolist() for v in _unit(r, 6)]
    far = _unit(r, 40).tolist()
    e = spark.createDataFrame([(i, i, v) for i, v in enumerate(near + far)], EMB)
    examples = e.filter("id < 4").select(F.lit(1).cast("long").alias("concept_id"), "file_id", "vector")
    got = learn.teach(e, examples).first()
    assert got.n_examples == 4 and got.cohesion > 0.95 and 0.6 <= got.threshold <= 1
    hits = search.by_vector(e, got.prototype, None, got.threshold).collect()
    assert {r.file_id for r in hits} >= {4, 5}
    negatives = e.filter("id = 5").select(F.lit(1).cast("long").alias("concept_id"), "vector")
    assert learn.teach(e, examples, negatives).first().threshold >= got.threshold


CONCEPTS = [(0, "clay"), (1, "outdoor")]


def _tagged(spark):
    fc = spark.createDataFrame([(0, 0, 0.9), (1, 0, 0.7), (1, 1, 0.8), (2, 1, 0.6)], "file_id long, concept_id long, score double")
    return fc, spark.createDataFrame(CONCEPTS, "id long, name string")


def test_any_and_all(spark):
    fc, c = _tagged(spark)
    files = lambda *a: {r.file_id for r in tags.matching(fc, c, *a).collect()}
    assert files(["clay", "outdoor"]) == {0, 1, 2} and files(["clay", "outdoor", "clay"], "all") == {1} and files([]) == set() and files(["clay", "none"], "all") == set()
    with pytest.raises(ValueError):
        files(["clay"], "some")


def test_corrections_win(spark):
    fc, c = _tagged(spark)
    log = spark.createDataFrame([(0, 0, "on", 1), (0, 0, "off", 2), (2, 0, "on", 1), (1, 1, "off", 1), (1, 1, None, 2), (7, 1, "on", 1)], "file_id long, concept_id long, state string, n int")
    overrides = tags.latest_overrides(log, ["n"])
    got = {(r.file_id, r.concept_id) for r in tags.effective(fc, overrides).collect()}
    assert got == {(1, 0), (1, 1), (2, 1), (2, 0), (7, 1)}
    with pytest.raises(ValueError):
        tags.set_override(log, log.limit(1).withColumn("state", F.lit("maybe")))


def test_client_filter(spark):
    rows = spark.createDataFrame([(1, "Beach.jpg", ["clay", "outdoor"]), (2, "cat.jpg", ["clay"]), (3, "dog.jpg", ["outdoor"]), (4, "egg.jpg", [])], "id long, name string, tags array<string>")
    got = lambda **k: [r.id for r in rows.filter(tags.library_filter(F.col("name"), F.col("tags"), **k)).collect()]
    assert got() == [1, 2, 3, 4] and got(text=" BEA ") == [1] and got(untagged=True) == [4] and got(selected=["clay", "outdoor"]) == [1, 2, 3] and got(selected=["clay", "outdoor"], mode="all") == [1]


def test_faces(spark):
    r = np.random.default_rng(5)
    v = _unit(r, 3)
    rows = [(i, i // 2, None, None, 0.0, (v[i % 2] + 0.02 * _unit(r, 1)[0]).tolist()) for i in range(6)] + [(9, 9, 1, 0.5, 0.0, v[0].tolist())]
    f = spark.createDataFrame(rows, "id long, file_id long, person_id long, score double, frame_time double, vector array<float>")
    refs = spark.createDataFrame([(2, 7, v[0].tolist(), "s"), (1, 8, v[0].tolist(), "s"), (3, 9, v[2].tolist(), "s")], "id long, person_id long, vector array<float>, source string")
    got = {r.id: (r.person_id, r.ref_id) for r in faces.match(f, refs, 0.9).collect()}
    assert {i: got[i] for i in (0, 2, 4)} == {0: (8, 1), 2: (8, 1), 4: (8, 1)} and 1 not in got
    again = {r.id: (r.person_id, r.score) for r in faces.rematch(f, refs, 0.9).collect()}
    assert again[9] == (1, 0.5) and again[0][0] == 8 and again[1] == (None, None)
    clusters = faces.cluster_unnamed(f, 0.9).orderBy("cluster").collect()
    assert [(c.cluster, c.size, c.files, list(c.face_ids), c.sample_file_id) for c in clusters] == [(0, 3, 3, [0, 2, 4], 0), (1, 3, 3, [1, 3, 5], 0)]
    named, more = faces.name_cluster(f, refs, [1, 3, 5], 4)
    assert {r.id for r in named.filter("person_id = 4 and score = 1").collect()} == {1, 3, 5} and sorted(r.id for r in more.collect()) == [1, 2, 3, 4, 5, 6]
    assert faces.register(refs, 7, refs.limit(0), "replace").count() == 2
    with pytest.raises(ValueError):
        faces.register(refs, 7, refs, "other")


FILES = "id long, path string, content_hash binary, pixels long, size long, mtime_ns long, phash binary"


def _hash(*flipped):
    bits = np.zeros(256, np.uint8)
    bits[list(flipped)] = 1
    return np.packbits(bits).tobytes()


def test_duplicates(spark):
    rows = [
        (1, "/a/sunset.png", b"h1", 100, 10, 5, _hash()), (2, "/a/sunset copy.png", b"h1", 100, 10, 1, _hash()), (3, "/a/sunset_small.png", b"h2", 50, 9, 1, _hash(*range(10))),
        (4, "/a/sunset_bright.png", b"h3", 100, 12, 1, _hash(*range(1, 32))), (5, "/a/far.png", b"h4", 100, 10, 1, _hash(*range(100, 180))), (6, "/a/none.png", None, None, None, None, None), (7, "/a/empty.png", b"", 1, 1, 1, None), (8, "/a/chain.png", b"h5", 1, 1, 1, _hash(*range(100, 149))),
    ]
    f = spark.createDataFrame(rows, FILES)
    exact = duplicates.exact_groups(f).collect()
    assert [(r.keeper, list(r.redundant)) for r in exact] == [("/a/sunset.png", ["/a/sunset copy.png"])]
    near = duplicates.near_groups(f).orderBy("group").collect()
    assert [(r.group, r.keeper, r.n, round(r.distance * 255)) for r in near] == [(1, "/a/sunset.png", 4, 31), (5, "/a/far.png", 2, 31)]
    both = duplicates.combine(duplicates.exact_groups(f), duplicates.near_groups(f)).collect()
    assert sorted(r.kind for r in both) == ["exact", "near", "near"]
    only = duplicates.combine(duplicates.exact_groups(f), duplicates.near_groups(f.filter("id < 3"))).collect()
    assert [r.kind for r in only] == ["exact"]
    assert {(r.keeper, r.path) for r in duplicates.redundant_files(duplicates.exact_members(f)).collect()} == {("/a/sunset.png", "/a/sunset copy.png")}
    assert hashing.cutoff() == 31


def test_companions(spark):
    listing = spark.createDataFrame([(p,) for p in ("/d/IMG_1.HEIC", "/d/img_1.mov", "/d/IMG_1.aae", "/d/other.txt", "/e/IMG_1.mov", "/d/x.jpg")], "path string")
    got = {r.primary: list(r.members) for r in companions.groups(listing).collect()}
    assert got == {"/d/IMG_1.HEIC": ["/d/IMG_1.HEIC", "/d/img_1.mov", "/d/IMG_1.aae"], "/e/IMG_1.mov": ["/e/IMG_1.mov"], "/d/x.jpg": ["/d/x.jpg"]}
    found = {r.path for r in companions.find(listing.filter("path = '/d/img_1.mov'"), listing).collect()}
    assert found == {"/d/IMG_1.HEIC", "/d/img_1.mov", "/d/IMG_1.aae"}
    own = spark.createDataFrame([("/d/IMG_1.HEIC", ["a"]), ("/d/img_1.mov", ["b"])], "path string, tags array<string>")
    assert {r.path: list(r.tags) for r in companions.primary_tags(companions.members(listing), own).collect()} == {"/d/IMG_1.HEIC": ["a"], "/d/img_1.mov": ["a"], "/d/IMG_1.aae": ["a"], "/e/IMG_1.mov": [], "/d/x.jpg": []}


def test_scores_by_file(spark):
    fc, c = _tagged(spark)
    assert {r.file_id: r.scores for r in score.scores_by_file(fc, c).collect()} == {0: {"clay": 0.9}, 1: {"clay": 0.7, "outdoor": 0.8}, 2: {"outdoor": 0.6}}
