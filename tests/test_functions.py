import hashlib
from pathlib import PurePosixPath

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.functions import boxes, hashing, naming, paths, vectors

PATHS = ["/a/b.jpg", "/a/b.tar.gz", "/a/.hidden", "/a/.x.JPG", "noext", "/a/IMG_1 copy 2.png", "x.MOV", "/a.b/c", "/a/name. ", "/a/b.txt", "/p/É.heic"]


def _one(spark, *columns, rows=None):
    return spark.createDataFrame(rows, "p string").select(*columns).collect()


def test_parts_of_paths(spark):
    got = _one(spark, "p", paths.name(F.col("p")), paths.stem(F.col("p")), paths.suffix(F.col("p")), paths.parent(F.col("p")), rows=[(p,) for p in PATHS if p != "/a/name. "])
    for path, name, stem, suffix, parent in got:
        p = PurePosixPath(path)
        assert (name, stem, suffix) == (p.name, p.stem, p.suffix), path
        assert parent == ("" if str(p.parent) == "." else str(p.parent))


def test_kinds_ranks_and_markers(spark):
    p = F.col("p")
    got = {r[0]: tuple(r)[1:] for r in _one(spark, "p", paths.kind(p), paths.primary_rank(p), paths.is_sidecar(p), paths.looks_like_copy(p), rows=[(x,) for x in [*PATHS, "/a/DSC (3).jpg", "/a/duplicate.jpg", "/a/IMG_0001.png", "/a/copycat.jpg"]])}
    assert got["/a/b.jpg"] == ("image", 2, False, False) and got["x.MOV"][:2] == ("video", 8) and got["/a/b.txt"][:3] == (None, 13, True)
    assert [got[k][3] for k in ("/a/IMG_1 copy 2.png", "/a/DSC (3).jpg", "/a/duplicate.jpg", "/a/IMG_0001.png", "/a/copycat.jpg")] == [True, True, True, True, False]


def test_containment_is_by_segments(spark):
    roots = F.array(F.lit("/lib/a"), F.lit("/b"))
    got = [r[0] for r in _one(spark, paths.within(F.col("p"), roots), rows=[("/lib/a",), ("/lib/a/x",), ("/lib/ab",), ("/b/c/d",), ("/",)])]
    assert got == [True, True, False, True, False]


def test_sample_times(spark):
    rows = spark.createDataFrame([(100.0, 8), (100.0, 1), (0.0, 8), (-2.0, 4), (10.0, 2)], "d double, n int").select(paths.sample_times(F.col("d"), F.col("n")).alias("t")).collect()
    assert rows[0].t == pytest.approx([5 + 90 * i / 7 for i in range(8)]) and [list(r.t) for r in rows[1:4]] == [[50.0], [0.0], [0.0]] and rows[4].t == pytest.approx([0.5, 9.5])


KNOWN = ["Clay", "a.b", "two words"]


@pytest.mark.parametrize(
    ("name", "tags", "want", "found"),
    [
        ("trip [2] [clay].jpg", ["Clay"], "trip [2] [Clay].jpg", ["Clay"]), ("x[CLAY][a.b] y.png", [], "x y.png", ["Clay", "a.b"]), ("[clay].jpg", [], "[clay].jpg", ["Clay"]),
        ("x [axb].jpg", ["two words", "Clay"], "x [axb] [Clay] [two words].jpg", []), ("x [ two words ].tar.gz", ["Clay", "a.b", "Clay"], "x.tar [a.b] [Clay].gz", ["two words"]), ("plain", None, "plain", []),
    ],
)
def test_retagging(spark, name, tags, want, found):
    row = spark.createDataFrame([(name, tags)], "name string, tags array<string>")
    got = row.select(naming.retag(F.col("name"), F.col("tags"), KNOWN).alias("n"), naming.tags_in(paths.stem(F.col("name")), KNOWN).alias("t")).first()
    assert got.n == want and got.t == found
    again = spark.createDataFrame([(got.n, tags)], "name string, tags array<string>").select(naming.retag(F.col("name"), F.col("tags"), KNOWN).alias("n")).first()
    assert again.n == got.n


def test_clean_tags(spark):
    got = [r[0] for r in _one(spark, naming.clean_tag(F.col("p")), rows=[("  a \t b ",), ("",), ("a[b",), ("a/b",), ("a\\b",), (".x",), (None,), ("ok,comma",)])]
    assert got == ["a b", None, None, None, None, None, None, "ok,comma"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.normalize(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0].n == pytest.approx([0.6, 0.8]) and got[0].c == pytest.approx(0.96) and got[1].n == [0.0, 0.0] and got[1].c == 0.0
    back = df.select(vectors.from_blob(vectors.to_blob("a")).alias("a")).collect()
    assert [list(r.a) for r in back] == [[3.0, 4.0], [0.0, 0.0]]


def test_centroid_is_the_normalized_mean_of_normalized_rows(spark):
    rows = [(1, [2.0, 0.0]), (1, [0.0, 0.5]), (2, [0.0, 3.0])]
    got = dict(vectors.centroid(spark.createDataFrame(rows, "k int, vector array<float>"), "k").collect())
    assert got[1] == pytest.approx([2**-0.5, 2**-0.5]) and got[2] == pytest.approx([0.0, 1.0])


def test_hashes(spark):
    r = np.random.default_rng(0)
    smooth = np.cumsum(np.cumsum(r.standard_normal((64, 64)), 0), 1)
    images = np.stack([smooth, smooth * 1.3 + 20, smooth + r.standard_normal((64, 64)) * 0.1, np.cumsum(np.cumsum(r.standard_normal((64, 64)), 0), 1)])
    packed = hashing.perceptual(images)
    apart = lambda i: int(np.unpackbits(packed[0] ^ packed[i]).sum())
    assert packed.shape == (4, 32) and apart(1) == 0 and apart(2) <= hashing.cutoff() < apart(3) and packed[0][0] < 128
    df = spark.createDataFrame([(bytes(packed[0]), bytes(packed[3]), b"x")], "a binary, b binary, c binary")
    got = df.select(hashing.hamming(hashing.words(F.col("a")), hashing.words(F.col("b"))).alias("d"), hashing.content_hash("c").alias("h")).first()
    assert got.d == apart(3) and bytes(got.h) == hashlib.blake2b(b"x", digest_size=16).digest()
    assert hashing.cutoff(0.12) == 31 and hashing.cutoff(2.5 / 255) == 2
    pixels = spark.createDataFrame([(images[0].ravel().tolist(),), (None,)], "p array<double>").select(hashing.perceptual_hash("p").alias("h")).collect()
    assert bytes(pixels[0].h) == bytes(packed[0]) and pixels[1].h is None


def test_boxes(spark):
    df = spark.createDataFrame([(100.0, 200.0, 150.0, 260.0), (5.0, 5.0, 5.0, 5.0)], "left double, top double, right double, bottom double")
    got = df.select(boxes.box_text(boxes.body_box(F.struct("left", "top", "right", "bottom"), F.lit(400), F.lit(500))).alias("b")).collect()
    assert [r.b for r in got] == ["45,164,205,500", "3,4,6,9"]
