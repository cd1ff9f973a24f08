import hashlib
import sys

import numpy as np
import pytest

from likeness.functions import hashing
from likeness.functions.paths import sample_times
from likeness.operators import duplicates, kernels
from likeness.service import Service
from likeness.sources import images, reading
from likeness.sources.catalog import Catalog
from likeness.sources.scratch import Scratch
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that the models below travel with the plan


def _pgm(value, height=100, width=120):
    return b"P5\n# made here\n%d %d 255\n" % (width, height) + bytes([value]) * (height * width)


class Pixels:
    dimension = 3

    def embed_pixels(self, batch):
        if len(batch) > 4:
            raise AssertionError("a batch has its bound")
        if any(p[0, 0, 0] == 77 for p in batch):
            raise ValueError("no vector for this one")
        return np.array([[p[0, 0, 0], *p.shape[:2]] for p in batch])

    def embed_paths(self, paths):
        raise AssertionError("pixels are given")

    def embed_text(self, prompt):
        return np.ones(3)


class Faces:
    def faces_in(self, pixels):
        if pixels[0, 0, 0] == 9:
            raise OSError("no faces here")
        return [((10, 10, 50, 50), np.array([1.0, 0, 0])), ((0, 0, 5, 5), np.array([0, 1.0, 0]))]


class Frames:
    def duration(self, path):
        return 10.0

    def frame(self, path, seconds):
        if "bad" in path or seconds > 9:
            raise OSError(path)
        return np.full((100, 120, 3), int(seconds))


def _files(spark, folder, names):
    return spark.createDataFrame([(f"{folder}/{n}", "video" if n.endswith(".mov") else "image") for n in names], "path string, kind string")


def test_netpbm():
    assert reading.netpbm(b"P6 2 1 255\n" + bytes(range(6))).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    assert reading.netpbm(_pgm(5)).shape == (100, 120, 3) and reading.netpbm(b"\x89PNG") is None
    with pytest.raises(ValueError):
        reading.netpbm(b"P5 1 1 65535\n..")
    with pytest.raises(ValueError):
        reading.decoded(b"what is this")


def test_frame_times_are_those_of_the_column_function(spark):
    for duration, samples in ((10.0, 8), (3.7, 2), (5.0, 1), (0.0, 8), (-1.0, 4)):
        want = spark.range(1).select(sample_times(F.lit(duration), F.lit(samples)).alias("t")).first().t
        assert reading.frame_times(duration, samples) == pytest.approx(want, abs=1e-12)


def test_each_level_has_its_errors(spark, tmp_path):
    for name, data in (("a.pgm", _pgm(5)), ("faceless.pgm", _pgm(9)), ("broken.pgm", b"P5 9"), ("odd.pgm", _pgm(77)), ("unknown.xyz", b"?")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "v.mov").write_bytes(b"film")
    names = ["a.pgm", "faceless.pgm", "broken.pgm", "odd.pgm", "unknown.xyz", "gone.pgm", "v.mov", "bad.mov"]
    found = reading.read_media(_files(spark, tmp_path, names), Pixels(), Frames(), Faces(), 3, crops=True, batch=4)
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(rows) == set(names)
    a, v = rows["a.pgm"], rows["v.mov"]
    # The small face counts for nothing.
    assert a.boxes == [None]  # 94 pixels are too few for a crop
    assert a.vectors[0] == [5, 100, 120] and [f.bbox for f in a.faces] == ["10,10,50,50"] and a.error is None
    assert a.content_hash == hashlib.blake2b(_pgm(5), digest_size=16).digest() and a.pixels == 12000
    assert (v.frames, v.failed_frames) == (2, 1) and [t for t, b in zip(v.frame_times, v.boxes) if b is None] == [0.5, 5.0] and len(v.faces) == 2
    assert rows["faceless.pgm"].face_error and rows["faceless.pgm"].vectors == [[9, 100, 120]] and not rows["faceless.pgm"].faces
    assert rows["odd.pgm"].error == "no image could be embedded" and rows["bad.mov"].error == "no frame could be read" and rows["bad.mov"].failed_frames == 3
    assert all(rows[n].error and not rows[n].vectors for n in ("broken.pgm", "unknown.xyz", "gone.pgm"))
    assert rows["gone.pgm"].content_hash is None and rows["unknown.xyz"].content_hash is not None
    alone = reading.read_media(_files(spark, tmp_path, ["v.mov"]), Pixels()).first()
    assert alone.error == "ValueError: no frame source is plugged in"


def test_batches_mix_files_and_hold_few_images(spark, tmp_path):
    for k in range(11):
        (tmp_path / f"{k}.pgm").write_bytes(_pgm(k))
    rows = reading.read_media(_files(spark, tmp_path, [f"{k}.pgm" for k in range(11)]).coalesce(1), Pixels(), batch=4).collect()
    assert sorted(r.vectors[0][0] for r in rows) == list(range(11))
    rows = reading.read_media(_files(spark, tmp_path, [f"{k}.pgm" for k in range(11)]).coalesce(1), Pixels(), batch=99, batch_bytes=3 * 36000).collect()
    assert len(rows) == 11 and not any(r.error for r in rows)


def test_only_changed_files_are_opened(spark, tmp_path):
    folder, opened = tmp_path / "lib", tmp_path / "opened"
    folder.mkdir(), opened.mkdir()
    for k in range(4):
        (folder / f"{k}.png").write_bytes(_pgm(k))  # a decoder goes by what is inside

    class Noted(Pixels):
        def embed_pixels(self, batch):
            for p in batch:
                (opened / str(p[0, 0, 0])).write_text("")
            return super().embed_pixels(batch)

    service = Service(Catalog(spark, f"file://{tmp_path}/tables"), Noted(), analyzer=Faces(), frames=Frames())
    first = service.index(str(folder), crops=True)
    assert (first["indexed"], first["faces"], first["named"], first["failed_faces"]) == (4, 4, 0, 0) and len(list(opened.iterdir())) == 4
    for f in opened.iterdir():
        f.unlink()
    (folder / "new.png").write_bytes(_pgm(200))
    (folder / "1.png").write_bytes(_pgm(201, 110))
    (folder / "film.mov").write_bytes(b"x")
    again = service.index(str(folder), samples=2)
    assert (again["scanned"], again["indexed"], again["unchanged"], again["frames"], again["failed_frames"]) == (6, 3, 3, 3, 1)
    assert {f.name for f in opened.iterdir()} == {"200", "201", "0"}
    files = {r.path.rsplit("/", 1)[1]: r for r in service.catalog.read("files").collect()}
    assert files["1.png"].pixels == 110 * 120 and files["new.png"].content_hash is not None and files["film.mov"].phash is not None
    assert service.catalog.read("embeddings").filter("box is null or box = ''").count() == 4 + 1 + 1


def test_a_pass_that_ends_half_way_keeps_its_batches(spark, tmp_path):
    from likeness.sources.plugins import HashEmbedder, embed_with
    from likeness.streaming.ingest import index_pass

    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    found = spark.createDataFrame([(f"/lib/{k}.jpg", "image", 10, k) for k in range(9)], "path string, kind string, size long, mtime_ns long")
    embed, calls, told = embed_with(HashEmbedder()), [], []

    def failing(files):
        calls.append(sorted(r.path for r in files.collect()))
        if len(calls) == 3:
            raise OSError("the machine stops")
        return embed(files)

    with pytest.raises(Exception, match="the machine stops"):
        index_pass(catalog, found, failing, batch=3, report=lambda done, of: told.append((done, of)))
    kept = {r.path for r in catalog.read("files").collect()}
    assert len(calls) == 3 and kept == {p for c in calls[:2] for p in c} and 0 < len(kept) < 9 and [d for d, _ in told] == [1, 2]
    calls.append(None)
    again = index_pass(catalog, found, failing, batch=2)
    assert {p for c in calls[4:] for p in c} == {r.path for r in found.collect()} - kept
    assert (again["scanned"], again["indexed"], again["unchanged"]) == (9, 9 - len(kept), len(kept)) and catalog.read("embeddings").count() == 9
    more = found.unionByName(spark.createDataFrame([(f"/lib/more{k}.jpg", "image", 10, k) for k in range(6)], found.schema))
    stopped = index_pass(catalog, more, embed, batch=2, stop=lambda: catalog.read("files").count() > 9)
    assert stopped["indexed"] < 6 and catalog.read("files").count() == 9 + stopped["indexed"]


def test_jobs_tell_how_far_they_are(spark):
    import time

    from likeness.jobs import JobRunner

    def slow(batches):
        for b in batches:
            time.sleep(0.3)
            yield b

    runner, seen = JobRunner(spark), []
    job = runner.submit("count", lambda job: spark.range(0, 40, 1, 20).mapInArrow(slow, "id long").count())
    while runner.poll(job).state == "running":
        seen.append((job.current, job.total))
        time.sleep(0.1)
    assert job.result == 40 and seen == sorted(seen) and any(0 < c < t for c, t in seen) and job.as_dict()["message"] == "tasks"
    assert job.current == job.total >= 20
    steps = runner.submit("steps", lambda job: job.report(2, 5, "files"))
    runner.wait()
    assert (runner.poll(steps).total, steps.message, steps.state) == (5, "files", "done")


def test_command_line_prints_whole_tables(spark, tmp_path, capsys):
    from likeness.__main__ import main

    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    for k in range(3):
        catalog.upsert_person(f"p{k}")
    people = catalog.read("people")
    catalog.write("people", people.limit(1).crossJoin(spark.range(60).withColumnRenamed("id", "k")).select((F.col("k") + 1).alias("id"), F.format_string("p%02d", "k").alias("name"), *[c for c in people.columns if c not in ("id", "name")]))
    assert main(["--library", f"file://{tmp_path}/tables", "people"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 60


def test_embedders_of_paths_read_no_videos_unless_they_say_so(spark, tmp_path):
    class Paths:
        dimension = 2

        def embed_paths(self, paths):
            return paths, np.ones((len(paths), 2), np.float32)

    (tmp_path / "lib").mkdir()
    for name in ("a.png", "b.mov"):
        (tmp_path / "lib" / name).write_bytes(b"x")
    service = Service(Catalog(spark, f"file://{tmp_path}/tables"), Paths())
    counts = [service.index(str(tmp_path / "lib")) for _ in range(2)]
    assert [[c[k] for k in ("indexed", "failed", "unchanged")] for c in counts] == [[1, 1, 0], [0, 1, 1]]


def test_fingerprints_open_the_given_files_alone(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_pgm(3))
    (tmp_path / "[b] {c}.png").write_bytes(images.png(np.full((30, 40, 3), 8, np.uint8)))
    (tmp_path / "no.jpg").write_bytes(b"no image")
    (tmp_path / "clip.mov").write_bytes(b"clip")
    files = _files(spark, tmp_path, ["a.png", "[b] {c}.png", "no.jpg", "clip.mov", "gone.png"])
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.fingerprints(files, Scratch(spark, "test")).collect()}
    assert rows["a.png"].pixels == 12000 and rows["[b] {c}.png"].pixels == 1200 and rows["no.jpg"].phash is None and rows["no.jpg"].content_hash
    assert rows["clip.mov"].pixels is None and rows["clip.mov"].content_hash and rows["gone.png"].content_hash is None
    listed = images.hashed_in_tasks(files.filter("path like '%.pgm' or path like '%a.png'")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in listed] == ["a.png"]


def test_orientation_far_behind_the_beginning():
    filler = b"\xff\xe2\xff\xff" + bytes(65533)
    tiff = b"II*\0" + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + (0x0112).to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + (6).to_bytes(4, "little")
    exif = b"\xff\xe1" + (len(tiff) + 8).to_bytes(2, "big") + b"Exif\0\0" + tiff
    assert images.orientation_of(b"\xff\xd8" + filler * 3 + exif + b"\xff\xda\0\2") == 6
    assert images.orientation_of(b"\xff\xd8" + filler * 3) == images.orientation_of(b"\xff\xd8\xff") == 1


# The index of hashes.


def _hashes(n, seed=0):
    r = np.random.default_rng(seed)
    base, rows = r.integers(-(2**63), 2**63 - 1, (n // 5, 4)), []
    for i in range(n):
        words = base[i % len(base)].copy().view(np.uint64)
        for bit in r.choice(256, r.integers(0, 34), replace=False):
            words[bit // 64] ^= np.uint64(1 << int(bit % 64))
        if i % 3 == 0:
            words[1] = np.uint64(7)  # a word that a third of all files share
        rows.append((i, [int(w) for w in words.view(np.int64)]))
    return [*rows, (None, rows[0][1]), (n, None), (0, rows[0][1])]


@pytest.mark.parametrize("block", [1 << 16, 60])
def test_index_finds_the_pairs_that_all_comparisons_find(spark, block):
    df = spark.createDataFrame(_hashes(700), "id long, data array<long>")
    want = sorted(map(tuple, duplicates.hamming_pairs(df, 31, [F.col("data")[k] for k in range(4)], index_from=10**9).collect()))
    got = sorted(map(tuple, kernels.indexed_hamming_pairs(df, 31, 4, block).collect()))
    assert want and got == want
    with pytest.raises(ValueError):
        kernels.indexed_hamming_pairs(df, 32, 4)
    assert kernels.indexed_hamming_pairs(df.limit(0), 31, 4).collect() == []


def test_index_compares_few_of_all_pairs():
    n, compared = 4000, 0
    data = np.random.default_rng(3).integers(0, 256, (n, 32), dtype=np.uint8)
    for place in range(32):
        for byte in range(256):
            own = data[data[:, place] == byte]
            compared += sum(len(i) for i, _ in kernels.close_values(own[:, place ^ 1], equal=place % 2 == 0))
    assert compared < 0.005 * n * (n - 1) / 2


def test_close_values():
    r = np.random.default_rng(1)
    x, y = r.integers(0, 256, 300).astype(np.uint8), r.integers(0, 256, 200).astype(np.uint8)
    bits = np.bitwise_count(x[:, None] ^ y[None])
    for equal in (True, False):
        got = sorted((i, j) for a, b in kernels.close_values(x, y, equal) for i, j in zip(a.tolist(), b.tolist()))
        assert got == sorted(zip(*(c.tolist() for c in np.nonzero((bits == 1) | (equal & (bits == 0))))))
        own = sorted(tuple(sorted(p)) for a, b in kernels.close_values(x, None, equal) for p in zip(a.tolist(), b.tolist()))
        near = np.bitwise_count(x[:, None] ^ x[None])
        assert own == sorted((i, j) for i, j in zip(*(c.tolist() for c in np.nonzero((near == 1) | (equal & (near == 0))))) if i < j)


def test_copies_of_a_hash_are_one_group(spark):
    rows = [(i, f"/a/{i}.jpg", b"\1" * 32, 5, 10, i) for i in range(50)] + [(50, "/a/near.jpg", b"\1" * 31 + b"\0", 5, 10, 9), (51, "/a/far.jpg", b"\xfe" * 32, 5, 10, 9)]
    files = spark.createDataFrame(rows, "id long, path string, phash binary, pixels long, size long, mtime_ns long")
    got = duplicates.near_groups(files).collect()
    assert [(r.n, r.keeper, round(r.distance * hashing.BITS)) for r in got] == [(51, "/a/0.jpg", 1)]
