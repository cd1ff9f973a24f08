"""Images and video frames as pixels, and the fingerprints of files that duplicates are found by.

Tasks open the files they are given by path and decode what :mod:`likeness.sources.reading` has decoders
for. Other images are decoded by the JVM (Spark's image source), which is given their paths alone; tasks
turn those upright by their EXIF orientation. Video frames come from a backend that plugs in;
:class:`Ffmpeg` is one. Contents are hashed in chunks, so a file of any length costs a chunk of memory.

Defined results: a file that can't be decoded has no pixels and no perceptual hash, a file that can't be
read no content hash; either is null and stops nothing. An orientation that isn't 1 to 8 counts as 1.
"""

from __future__ import annotations

import json
import re
import shutil
import struct
import subprocess
import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from likeness.functions import paths
from likeness.functions.hashing import grey_square, perceptual, shares
from likeness.sources.discovery import SAMPLES, _opened
from likeness.sources.reading import DECODERS, content_digest, read_whole
from likeness.sources.scratch import Scratch

#: Paths that the JVM's decoder is given at a time.
LISTED = 4096

# Fixed values of the EXIF format: the tag of the orientation.
_ORIENTATION = 0x0112


def orientation(read) -> int:
    """The EXIF orientation (1 to 8) of a JPEG file, wherever its segment lies; 1 without one. ``read(at, n)``
    gives n bytes from a place."""
    if read(0, 2) != b"\xff\xd8":
        return 1
    at = 2
    try:
        while True:
            mark, kind, size = struct.unpack(">BBH", read(at, 4))
            if mark != 0xFF or kind in (0xD9, 0xDA):
                return 1
            if kind == 0xE1 and read(at + 4, 6) == b"Exif\0\0":
                tiff = read(at + 10, size - 8)
                order = "<" if tiff[:2] == b"II" else ">"
                (first,) = struct.unpack_from(order + "I", tiff, 4)
                (entries,) = struct.unpack_from(order + "H", tiff, first)
                for k in range(entries):
                    tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, first + 2 + 12 * k)
                    if tag == _ORIENTATION and kind == 3:
                        return value if 1 <= value <= 8 else 1
                return 1
            at += 2 + size
    except struct.error:  # the file ends before
        return 1


def orientation_of(data: bytes) -> int:
    """The EXIF orientation in the bytes of a JPEG file."""
    return orientation(lambda at, n: data[at : at + n])


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels (rows, columns, ...) as they are meant to be seen."""
    if orientation >= 5:
        pixels = pixels.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def _orientation_at(path: str) -> int:
    files, base, _ = _opened(path)
    with files.open_input_file(base) as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        return orientation(read)


_PIXELS = "path string, height int, width int, rgb binary"


def load_images(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """path, height, width, rgb (rows of bytes) of the images under a folder, or of listed files, upright."""

    def run(batches):
        for b in batches:
            rows = []
            for path, height, width, channels, data in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                own = np.repeat(own, 3, axis=2) if channels == 1 else own[..., 2::-1]  # the source's order is blue, green, red
                try:
                    own = upright(own, _orientation_at(path))
                except OSError:
                    pass
                rows.append((path, own.shape[0], own.shape[1], np.ascontiguousarray(own).tobytes()))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["path", "height", "width", "rgb"])

    found = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root if isinstance(root, str) else [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in root]).select("image.*")
    path = F.regexp_replace(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")  # the source gives urls
    return found.filter("height > 0").select(path.alias("path"), "height", "width", "nChannels", "data").mapInArrow(run, _PIXELS)


def with_hashes(images: DataFrame) -> DataFrame:
    """path, phash, pixels of decoded images."""

    def run(batches):
        for b in batches:
            shapes = zip(b.column("height").to_pylist(), b.column("width").to_pylist(), b.column("rgb").to_pylist())
            squares = [grey_square(np.frombuffer(rgb, np.uint8).reshape(h, w, 3)) for h, w, rgb in shapes]
            hashes = [h.tobytes() for h in perceptual(np.stack(squares))] if squares else []
            size = [h * w for h, w in zip(b.column("height").to_pylist(), b.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(hashes, pa.binary()), pa.array(size, pa.int64())], ["path", "phash", "pixels"])

    return images.mapInArrow(run, "path string, phash binary, pixels long")


def content_hashes(files: DataFrame) -> DataFrame:
    """path, content_hash (BLAKE2b of 128 bits) of files, read in chunks."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([content_digest(p) for p in b.column("path").to_pylist()], pa.binary())], ["path", "content_hash"])

    return files.select("path").mapInArrow(run, "path string, content_hash binary")


def hashed_in_tasks(files: DataFrame, decoders=DECODERS, kind: str | None = None) -> DataFrame:
    """path, content_hash, phash, pixels, undecoded (whether no decoder knows an image's format) of files
    (path): each is opened by its path and decoded, turned and hashed in one stage. ``kind``: of all files,
    else it follows from their names."""

    def one(path: str, kind: str | None) -> tuple:
        digest = content_digest(path)
        if digest is None or kind != "image":
            return path, digest, None, None, False
        data = read_whole(path)
        for decode in decoders:
            try:
                pixels = decode(data)
            except Exception:  # a damaged file has no pixels
                return path, digest, None, None, False
            if pixels is not None:
                return path, digest, perceptual(grey_square(pixels)[None])[0].tobytes(), pixels.shape[0] * pixels.shape[1], False
        return path, digest, None, None, True

    def run(batches):
        for b in batches:
            rows = [one(*r) for r in zip(b.column("path").to_pylist(), b.column("kind").to_pylist())]
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["path", "content_hash", "phash", "pixels", "undecoded"])

    own = files.select("path", (F.lit(kind) if kind else paths.kind(F.col("path"))).alias("kind"))
    return own.mapInArrow(run, "path string, content_hash binary, phash binary, pixels long, undecoded boolean")


def fingerprints(files: DataFrame, scratch: Scratch, decoders=DECODERS) -> DataFrame:
    """path, content_hash, phash, pixels of files (path); these alone are opened. What no decoder in the tasks
    knows goes to the JVM's by ``LISTED`` paths at a time. Reads tables of ``scratch``."""
    found = scratch.keep(hashed_in_tasks(files, decoders))
    parts, some = [], []
    rest = found.filter("undecoded").select("path")
    for row in rest.toLocalIterator():
        some.append(row["path"])
        if len(some) == LISTED:
            parts.append(scratch.keep(with_hashes(load_images(files.sparkSession, some))))
            some = []
    if some:
        parts.append(scratch.keep(with_hashes(load_images(files.sparkSession, some))))
    found = found.drop("undecoded")
    if not parts:
        return found
    more = parts[0]
    for part in parts[1:]:
        more = more.unionByName(part)
    more = more.toDF("path", "more_phash", "more_pixels")
    both = found.join(more, "path", "left")
    return both.select("path", "content_hash", F.coalesce("phash", "more_phash").alias("phash"), F.coalesce("pixels", "more_pixels").alias("pixels"))


def png(rgb: np.ndarray) -> bytes:
    """Pixels (rows x columns x 3 bytes) as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width = rgb.shape[:2]
    lines = np.zeros((height, 1 + 3 * width), np.uint8)  # each row begins with filter 0
    lines[:, 1:] = rgb.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def thumbnail(spark: SparkSession, path: str, side: int = 256, source: FrameSource | None = None) -> bytes:
    """A PNG file of an image, or of the middle of a video where a frame source is given, ``side`` pixels
    wide or high at most. What can't be decoded raises ValueError."""
    one = spark.createDataFrame([(path,)], "path string").withColumn("kind", paths.kind(F.col("path")))
    video = one.first()["kind"] == "video"
    if video and source is None:
        raise ValueError("no frame source is plugged in")
    found = (poster_frames(one, source) if video else load_images(spark, path)).select("height", "width", "rgb").head(1)
    if not found:
        raise ValueError(f"{path} can't be decoded")
    height, width = found[0]["height"], found[0]["width"]
    pixels = np.frombuffer(found[0]["rgb"], np.uint8).reshape(height, width, 3).astype(np.float64)
    scale = min(1.0, side / max(height, width))
    rows, columns = shares(height, max(1, round(height * scale))), shares(width, max(1, round(width * scale)))
    small = np.einsum("ah,hwc,bw->abc", rows, pixels, columns, optimize=True)
    return png(np.clip(np.rint(small), 0, 255).astype(np.uint8))


class FrameSource(Protocol):
    """How long a video is, and a frame of it as rows x columns x 3 bytes."""

    def duration(self, path: str) -> float: ...

    def frame(self, path: str, seconds: float) -> np.ndarray: ...


class Ffmpeg:
    """Frames by the ffmpeg and ffprobe programs, where they are installed."""

    def __init__(self, ffmpeg: str = "ffmpeg", ffprobe: str = "ffprobe"):
        for program in (ffmpeg, ffprobe):
            if shutil.which(program) is None:
                raise FileNotFoundError(program)
        self.ffmpeg, self.ffprobe = ffmpeg, ffprobe

    def _probe(self, path: str) -> dict:
        command = [self.ffprobe, "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height:format=duration", "-of", "json", path]
        return json.loads(subprocess.run(command, capture_output=True, check=True, timeout=120).stdout)

    def duration(self, path: str) -> float:
        return float(self._probe(path).get("format", {}).get("duration") or 0)

    def frame(self, path: str, seconds: float) -> np.ndarray:
        stream = self._probe(path)["streams"][0]
        command = [self.ffmpeg, "-v", "error", "-noautorotate", "-ss", f"{seconds:.3f}", "-i", path, "-frames:v", "1", "-f", "rawvideo", "-pix_fmt", "rgb24", "-"]
        data = subprocess.run(command, capture_output=True, check=True, timeout=120).stdout
        return np.frombuffer(data, np.uint8).reshape(stream["height"], stream["width"], 3)


def video_frames(videos: DataFrame, source: FrameSource, samples: int = SAMPLES) -> DataFrame:
    """path, frame, frame_time, height, width, rgb: evenly spaced frames of videos (path); a frame or a
    file that can't be read gives no row."""

    def durations(batches):
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                try:
                    found.append(float(source.duration(path)))
                except Exception:  # one unreadable file doesn't stop the others
                    found.append(None)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.float64())], ["path", "duration"])

    def read(batches):
        for b in batches:
            for path, frame, seconds in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    own = np.asarray(source.frame(path, seconds), np.uint8)
                except Exception:  # as above
                    continue
                row = [[path], [frame], [seconds], [own.shape[0]], [own.shape[1]], [own.tobytes()]]
                kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["path", "frame", "frame_time", "height", "width", "rgb"])

    timed = videos.select("path").mapInArrow(durations, "path string, duration double").filter("duration is not null")
    times = timed.select("path", F.posexplode(paths.sample_times(F.col("duration"), F.lit(samples))).alias("frame", "frame_time"))
    return times.mapInArrow(read, "path string, frame int, frame_time double, height int, width int, rgb binary")


def poster_frames(videos: DataFrame, source: FrameSource) -> DataFrame:
    """path, frame_time, height, width, rgb: the frame in the middle of each video."""
    return video_frames(videos, source, 1).drop("frame")
