"""Media read by path: each file that an index pass has to read is opened once, in a task, and goes from
file to frames, faces, body crops and vectors in one Arrow stage.

Pixels never leave the task. Frames and crops of several files are embedded together, in batches of
``BATCH`` images and ``BATCH_BYTES`` bytes of pixels at most, whatever files they come from; a file's row
goes out once all its pixels have their vectors. A task holds such a batch and the file it is reading.

Errors belong to a level. A file of which no frame can be read is an error (``error``) and has no vectors; a
frame that can't be read is left out and counted (``failed_frames``); faces that can't be found
(``face_error``) cost a file its faces alone; a content that can't be hashed is null. An embedder that fails
on a batch is asked for its images one by one, so that only those that it fails on are left out.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from likeness.functions.boxes import BODY_ABOVE, BODY_BELOW, BODY_WIDTH, LEAST_CROP, LEAST_FACE
from likeness.functions.hashing import grey_square, perceptual
from likeness.sources.discovery import SAMPLES, _opened

BATCH = 32
BATCH_BYTES = 64 << 20
CHUNK = 1 << 20


class PixelEmbedder(Protocol):
    """Vectors of images given as rows x columns x 3 bytes."""

    dimension: int

    def embed_pixels(self, images: list[np.ndarray]) -> np.ndarray: ...


class PixelAnalyzer(Protocol):
    """Faces in an image: boxes (left, top, right, bottom) and vectors."""

    def faces_in(self, pixels: np.ndarray) -> list[tuple[tuple[float, float, float, float], np.ndarray]]: ...


def netpbm(data: bytes) -> np.ndarray | None:
    """Pixels of a binary PGM or PPM file of 8 bits; None for others."""
    if data[:2] not in (b"P5", b"P6"):
        return None
    numbers, at = [], 2
    while len(numbers) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    width, height, top = numbers
    depth = 3 if data[:2] == b"P6" else 1
    if top != 255:
        raise ValueError(f"{top + 1} grey levels")
    pixels = np.frombuffer(data, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)
    return np.repeat(pixels, 3, axis=2) if depth == 1 else pixels


def pillow(data: bytes) -> np.ndarray | None:
    """Pixels by Pillow, upright, where it is installed (HEIC with pillow_heif); None otherwise or for formats it doesn't know."""
    try:
        from PIL import Image, ImageOps, UnidentifiedImageError
    except ImportError:
        return None
    try:
        import pillow_heif

        pillow_heif.register_heif_opener()
    except ImportError:
        pass
    try:
        return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(data))).convert("RGB"))
    except UnidentifiedImageError:
        return None


#: Decoders (bytes -> pixels, or None for a format of others), asked in this order.
DECODERS: tuple[Callable[[bytes], np.ndarray | None], ...] = (netpbm, pillow)


def decoded(data: bytes, decoders=DECODERS) -> np.ndarray:
    for decode in decoders:
        pixels = decode(data)
        if pixels is not None:
            return pixels
    raise ValueError("no decoder knows the format")


def read_whole(path: str) -> bytes:
    files, base, _ = _opened(path)
    with files.open_input_stream(base) as f:
        return f.read()


def content_digest(path: str) -> bytes | None:
    """BLAKE2b of 128 bits, read in chunks; None for a file that can't be read."""
    digest = hashlib.blake2b(digest_size=16)
    try:
        files, base, _ = _opened(path)
        with files.open_input_stream(base) as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
    except OSError:
        return None
    return digest.digest()


def body_of(face, width: int, height: int) -> tuple[int, int, int, int]:
    """The body below a face, cut to the image and to whole pixels."""
    left, top, right, bottom = face
    w, h = max(1, right - left), max(1, bottom - top)
    middle = (left + right) / 2
    return (
        int(max(0, middle - w * BODY_WIDTH / 2)), int(max(0, top - h * BODY_ABOVE)),
        int(min(width, middle + w * BODY_WIDTH / 2)), int(min(height, bottom + h * BODY_BELOW)),
    )


def frame_times(duration: float, samples: int) -> list[float]:
    """As :func:`likeness.functions.paths.sample_times` has them."""
    if duration <= 0 or samples <= 1:
        return [max(duration, 0.0) / 2]
    return [duration * 0.05 + duration * (1 - 2 * 0.05) * k / (samples - 1) for k in range(samples)]


class _File:
    """What is known of one file while its images wait for their vectors."""

    def __init__(self, path: str):
        self.path, self.error, self.face_error = path, None, None
        self.failed_frames = self.frames = 0
        self.digest = self.phash = self.pixels = None
        self.faces: list[tuple] = []
        self.images: list[tuple[float, str | None]] = []  # (time, box) of what was sent to the embedder
        self.vectors: dict[int, np.ndarray] = {}
        self.waiting = 0

    def row(self) -> tuple:
        made = [k for k in range(len(self.images)) if k in self.vectors]
        if self.error is None and not made:
            self.error = "no image could be embedded"
        fine = self.error is None
        made = made if fine else []
        faces = [{"bbox": b, "frame_time": t, "side": s, "vector": v} for b, t, s, v in self.faces] if fine else []
        return (
            self.path, [self.vectors[k].tolist() for k in made], [self.images[k][0] for k in made], [self.images[k][1] for k in made], self.error,
            self.frames, self.failed_frames, faces, self.face_error, self.digest, self.phash, self.pixels,
        )


_FACE = pa.struct([("bbox", pa.string()), ("frame_time", pa.float64()), ("side", pa.float64()), ("vector", pa.list_(pa.float32()))])
_ROW = pa.schema([
    ("path", pa.string()), ("vectors", pa.list_(pa.list_(pa.float32()))), ("frame_times", pa.list_(pa.float64())), ("boxes", pa.list_(pa.string())), ("error", pa.string()),
    ("frames", pa.int32()), ("failed_frames", pa.int32()), ("faces", pa.list_(_FACE)), ("face_error", pa.string()), ("content_hash", pa.binary()), ("phash", pa.binary()), ("pixels", pa.int64()),
])
#: The columns of :func:`read_media`.
SCHEMA = (
    "path string, vectors array<array<float>>, frame_times array<double>, boxes array<string>, error string, frames int, failed_frames int, "
    "faces array<struct<bbox string, frame_time double, side double, vector array<float>>>, face_error string, content_hash binary, phash binary, pixels long"
)


class _Embedding:
    """Images of many files on their way through the embedder."""

    def __init__(self, embedder: PixelEmbedder, batch: int, batch_bytes: int):
        self.embedder, self.bounds = embedder, (batch, batch_bytes)
        self.held: list[tuple[_File, int, np.ndarray]] = []
        self.bytes = 0

    def add(self, file: _File, pixels: np.ndarray, time: float, box: str | None) -> bool:
        """Whether a batch is full."""
        self.held.append((file, len(file.images), pixels))
        file.images.append((time, box))
        file.waiting += 1
        self.bytes += pixels.nbytes
        return len(self.held) >= self.bounds[0] or self.bytes >= self.bounds[1]

    def _vectors(self, images: list[np.ndarray]) -> list:
        try:
            return list(np.asarray(self.embedder.embed_pixels(images), np.float32))
        except Exception:  # one image must not cost the others their vectors
            return [None] if len(images) == 1 else [v for image in images for v in self._vectors([image])]

    def run(self) -> None:
        for (file, k, _), vector in zip(self.held, self._vectors([p for *_, p in self.held]) if self.held else []):
            if vector is not None:
                file.vectors[k] = vector
            file.waiting -= 1
        self.held, self.bytes = [], 0


def read_media(
    files: DataFrame, embedder: PixelEmbedder, frames=None, analyzer: PixelAnalyzer | None = None, samples: int = SAMPLES, crops: bool = False, decoders=DECODERS, least_face: float = LEAST_FACE,
    batch: int = BATCH, batch_bytes: int = BATCH_BYTES, read: Callable[[str], bytes] = read_whole, digest: Callable[[str], bytes | None] = content_digest,
) -> DataFrame:
    """A row of :data:`SCHEMA` for each of ``files`` (path, kind): vectors of its frames (without a box) and, with
    ``crops``, of the bodies of its faces (with theirs); its faces of at least ``least_face`` pixels; its
    fingerprints, of the first frame that could be read. ``frames`` reads videos (:class:`likeness.sources.images.FrameSource`);
    without one a video is an error."""

    def of_file(path: str, kind: str, own: _File):
        """Times and pixels of a file's frames."""
        if kind != "video":
            yield 0.0, decoded(read(path), decoders)
            return
        if frames is None:
            raise ValueError("no frame source is plugged in")
        for seconds in frame_times(float(frames.duration(path)), samples):
            try:
                pixels = np.asarray(frames.frame(path, seconds), np.uint8)
            except Exception:  # a frame that can't be read
                own.failed_frames += 1
                continue
            yield seconds, pixels

    def faces_of(pixels: np.ndarray, seconds: float, own: _File):
        """Body crops of a frame's faces, which are noted."""
        found = analyzer.faces_in(pixels) if analyzer is not None and own.face_error is None else []
        for box, vector in found:
            side = float(min(box[2] - box[0], box[3] - box[1]))
            if side >= least_face:
                own.faces.append((",".join(str(int(x)) for x in box), seconds, side, [float(x) for x in vector]))
                left, top, right, bottom = body = body_of(box, pixels.shape[1], pixels.shape[0])
                if crops and min(right - left, bottom - top) >= LEAST_CROP:
                    yield ",".join(map(str, body)), np.ascontiguousarray(pixels[top:bottom, left:right])

    def run(batches):
        embedding, waiting = _Embedding(embedder, batch, batch_bytes), []

        def ready():
            rows = [f.row() for f in waiting if not f.waiting]
            waiting[:] = [f for f in waiting if f.waiting]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)

        for b in batches:
            for path, kind in zip(b.column("path").to_pylist(), b.column("kind").to_pylist()):
                own = _File(path)
                own.digest = digest(path)
                try:
                    for seconds, pixels in of_file(path, kind, own):
                        own.frames += 1
                        if own.frames == 1:
                            own.phash, own.pixels = perceptual(grey_square(pixels)[None])[0].tobytes(), pixels.shape[0] * pixels.shape[1]
                        full = embedding.add(own, pixels, seconds, None)
                        try:
                            for box, crop in faces_of(pixels, seconds, own):
                                full |= embedding.add(own, crop, seconds, box)
                        except Exception as e:  # faces that can't be found cost the file its faces alone
                            own.face_error, own.faces = f"{type(e).__name__}: {e}", []
                        if full:
                            embedding.run()
                            yield from ready()
                    if not own.frames:
                        own.error = "no frame could be read"
                except Exception as e:  # one unreadable file doesn't stop the others
                    own.error = f"{type(e).__name__}: {e}"
                waiting.append(own)
            yield from ready()
        embedding.run()
        yield from ready()

    return files.select("path", "kind").mapInArrow(run, SCHEMA)
