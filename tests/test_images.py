import struct
import zlib

import numpy as np
import pytest

from likeness.functions import hashing, vectors
from likeness.service import Service
from likeness.sources import images
from likeness.sources.catalog import Catalog
from likeness.sources.plugins import HashEmbedder


def _png(pixels):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _exif(orientation, order="<"):
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def _scene(seed, height=90, width=120):
    r = np.random.default_rng(seed)
    coarse = r.integers(0, 256, (9, 12, 3)).astype(np.uint8)
    return np.repeat(np.repeat(coarse, height // 9, 0), width // 12, 1)


@pytest.mark.parametrize("order", ["<", ">"])
def test_orientations(order):
    assert [images.orientation_of(b"\xff\xd8\xff\xe0\0\4ab" + _exif(k, order)) for k in (1, 3, 6, 8, 9)] == [1, 3, 6, 8, 1]
    assert images.orientation_of(b"\x89PNG") == images.orientation_of(b"") == images.orientation_of(b"\xff\xd8\xff\xe1\0\50Exif\0\0II") == 1
    seen = np.arange(6).reshape(2, 3)  # as it is meant to be seen
    stored = {1: seen, 2: seen[:, ::-1], 3: seen[::-1, ::-1], 4: seen[::-1], 5: seen.T, 6: np.rot90(seen, 1), 7: seen[::-1, ::-1].T, 8: np.rot90(seen, -1)}
    for k, pixels in stored.items():
        assert images.upright(pixels, k).tolist() == seen.tolist(), k


def test_grey_squares_are_means_of_equal_parts():
    r = np.random.default_rng(1)
    big = r.integers(0, 256, (128, 192, 3))
    want = (big @ np.array([0.299, 0.587, 0.114])).reshape(64, 2, 64, 3).mean(axis=(1, 3))
    assert np.allclose(images.grey_square(big), want)
    assert np.allclose(images.grey_square(np.full((10, 7, 3), 50)), 50)


def test_indexed_photographs_are_found_as_duplicates(spark, tmp_path):
    folder = tmp_path / "lib"
    folder.mkdir()
    a, b = _scene(1), _scene(2)
    (folder / "a.png").write_bytes(_png(a))
    (folder / "a copy.png").write_bytes(_png(a))
    (folder / "bright.png").write_bytes(_png((a.astype(int) * 0.9 + 12).astype(np.uint8)))
    (folder / "b.png").write_bytes(_png(b))
    (folder / "broken.png").write_bytes(b"not an image")
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(str(folder / "b.png")))
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(folder / "b.jpg")))
    plain = (folder / "b.jpg").read_bytes()
    (folder / "b.jpg").write_bytes(plain[:2] + _exif(1) + plain[2:])
    found = {r.path.rsplit("/", 1)[1]: r for r in images.load_images(spark, str(folder)).collect()}
    assert set(found) == {"a.png", "a copy.png", "bright.png", "b.png", "b.jpg"}
    assert np.frombuffer(found["a.png"].rgb, np.uint8).reshape(90, 120, 3).tolist() == a.tolist()
    (folder / "turned.jpg").write_bytes(plain[:2] + _exif(6) + plain[2:])
    turned = {r.path.rsplit("/", 1)[1]: (r.height, r.width) for r in images.load_images(spark, str(folder)).collect()}
    assert turned["turned.jpg"] == (120, 90) and turned["b.jpg"] == (90, 120)
    service = Service(Catalog(spark, f"file://{tmp_path}/tables"), HashEmbedder())
    assert service.index(str(folder))["indexed"] == 7
    files = {r.path.rsplit("/", 1)[1]: r for r in service.catalog.read("files").collect()}
    assert files["a.png"].pixels == 90 * 120 and files["broken.png"].phash is None and files["broken.png"].content_hash is not None
    assert files["a.png"].phash == hashing.perceptual(images.grey_square(a)[None])[0].tobytes()
    groups = sorted((r.kind, r.keeper.rsplit("/", 1)[1], r.n) for r in service.duplicates().collect())
    assert groups == [("exact", "a.png", 2), ("near", "a.png", 3), ("near", "b.jpg", 2)]


def test_indexing_after_hashes_were_used_in_the_session(spark, tmp_path):
    one = spark.createDataFrame([(b"x", [0.0] * 4096, [1.0])], "c binary, p array<double>, v array<float>")
    one.select(hashing.content_hash("c"), hashing.perceptual_hash("p"), vectors.from_blob(vectors.to_blob("v"))).collect()
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.png").write_bytes(_png(_scene(1)))
    assert Service(Catalog(spark, f"file://{tmp_path}/tables"), HashEmbedder()).index(str(tmp_path / "lib"))["indexed"] == 1


def test_thumbnails(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_png(_scene(3)))
    (tmp_path / "no.png").write_bytes(b"x")
    for side, size in ((60, (45, 60)), (500, (90, 120))):
        (tmp_path / "small.png").write_bytes(images.thumbnail(spark, str(tmp_path / "a.png"), side))
        found = images.load_images(spark, str(tmp_path / "small.png")).first()
        assert (found.height, found.width) == size
    assert found.rgb == _scene(3).tobytes()
    for name in ("no.png", "a.mov"):
        with pytest.raises(ValueError):
            images.thumbnail(spark, str(tmp_path / name))


def test_video_frames(spark):
    class Source:  # local, so that it travels with the plan
        def duration(self, path):
            if "bad" in path:
                raise OSError(path)
            return 10.0

        def frame(self, path, seconds):
            if seconds > 9:
                raise OSError(path)
            return np.full((2, 3, 3), int(seconds))

    videos = spark.createDataFrame([("/a.mov",), ("/bad.mov",)], "path string")
    got = images.video_frames(videos, Source(), 3).orderBy("frame").collect()
    assert [(r.path, r.frame, r.frame_time, r.rgb[0], len(r.rgb)) for r in got] == [("/a.mov", 0, 0.5, 0, 18), ("/a.mov", 1, 5.0, 5, 18)]
    poster = images.poster_frames(videos, Source()).collect()
    assert [(r.path, r.frame_time, r.height, r.width) for r in poster] == [("/a.mov", 5.0, 2, 3)]


def test_ffmpeg_is_called(tmp_path, monkeypatch):
    frame = tmp_path / "frame"
    frame.write_bytes(bytes(range(18)))
    for name, body in (("ffprobe", 'echo \'{"streams": [{"width": 3, "height": 2}], "format": {"duration": "4.5"}}\''), ("ffmpeg", f"cat {frame}")):
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)
    with pytest.raises(FileNotFoundError):
        images.Ffmpeg("no-such-program")
    source = images.Ffmpeg(str(tmp_path / "ffmpeg"), str(tmp_path / "ffprobe"))
    assert source.duration("x") == 4.5 and source.frame("x", 1.0).tolist() == np.arange(18).reshape(2, 3, 3).tolist()
