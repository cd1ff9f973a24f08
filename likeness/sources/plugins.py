"""What models plug in: embedders, face analyzers and verifiers, and a deterministic stand-in."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Vectors of images and texts. Unreadable images are left out and the rest stays aligned. One that has
    ``embed_pixels`` (:class:`likeness.sources.reading.PixelEmbedder`), too, is given pixels: of images, of
    the frames of videos and of bodies. One without it is given paths, of videos only if it says
    ``reads_videos``."""

    dimension: int

    def embed_paths(self, paths: list[str]) -> tuple[list[str], np.ndarray]: ...

    def embed_text(self, prompt: str) -> np.ndarray: ...


class FaceAnalyzer(Protocol):
    """Faces of an image: boxes and vectors."""

    def faces(self, path: str) -> list[tuple[tuple[float, float, float, float], np.ndarray]]: ...


class Verifier(Protocol):
    """For each of several images a score from 0 to 1 for how well it fits a phrase, and where (a box as text,
    or None). Models load when first asked, in the task."""

    def verify(self, paths: list[str], phrase: str) -> list[tuple[float, str | None]]: ...


class HashEmbedder:
    """A stand-in whose vectors follow from the path or prompt alone."""

    reads_videos = True

    def __init__(self, dimension: int = 16):
        self.dimension = dimension

    def _vector(self, text: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
        v = np.random.default_rng(seed).standard_normal(self.dimension).astype(np.float32)
        return v / np.linalg.norm(v)

    def embed_paths(self, paths: list[str]) -> tuple[list[str], np.ndarray]:
        return list(paths), np.stack([self._vector(p) for p in paths]) if paths else np.empty((0, self.dimension), np.float32)

    def embed_text(self, prompt: str) -> np.ndarray:
        return self._vector(prompt)


def embed_with(embedder: Embedder):
    """An ``embed`` function for index passes: Arrow batches, one model per task, errors as rows."""
    import pyarrow as pa

    videos = getattr(embedder, "reads_videos", False)
    names = pa.schema([("path", pa.string()), ("vectors", pa.list_(pa.list_(pa.float32()))), ("frame_times", pa.list_(pa.float64())), ("boxes", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches):
        for b in batches:
            paths = b.column("path").to_pylist()
            given = [p for p, kind in zip(paths, b.column("kind").to_pylist()) if kind != "video" or videos]
            kept, vectors = embedder.embed_paths(given)
            by_path, known = dict(zip(kept, vectors)), set(given)
            rows = [(p, [by_path[p].tolist()], [0.0], [None], None) if p in by_path else (p, [], [], [], "unreadable" if p in known else "the embedder reads no videos") for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, names)], schema=names)

    return lambda files: files.select("path", "kind").mapInArrow(run, "path string, vectors array<array<float>>, frame_times array<double>, boxes array<string>, error string")


def verify_with(verifier: Verifier, phrase: str, batch: int = 16):
    """file_id, path -> file_id, verified, box, error: the files scored ``batch`` at a time, in tasks. Where a
    batch fails its files are asked one by one, and one that fails by itself, or gets no finite number, has a
    score of 0, no box and its error."""
    import pyarrow as pa

    names = pa.schema([("file_id", pa.int64()), ("verified", pa.float64()), ("box", pa.string()), ("error", pa.string())])

    def ask(paths: list[str]) -> list[tuple[float, str | None, str | None]]:
        try:
            answers = list(verifier.verify(paths, phrase))
            if len(answers) != len(paths):
                raise ValueError(f"{len(answers)} answers for {len(paths)} files")
            found = [(float(score), box and str(box)) for score, box in answers]
        except Exception as e:  # one unreadable file doesn't stop the others
            return [(0.0, None, str(e) or type(e).__name__)] if len(paths) == 1 else [a for p in paths for a in ask([p])]
        return [(s, box, None) if np.isfinite(s) else (0.0, None, "no finite score") for s, box in found]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                answers = ask(some.column("path").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("file_id"), *[pa.array(c, f.type) for c, f in zip(zip(*answers), list(names)[1:])]], schema=names)

    return lambda files: files.select(F.col("file_id").cast("long"), "path").mapInArrow(run, "file_id long, verified double, box string, error string")


def detect(files, analyzer: FaceAnalyzer, least: float):
    """file_id, seq, frame_time, bbox, side, vector of the faces in files (file_id, path) whose short
    side has ``least`` pixels; a file that fails gives no rows."""
    import pyarrow as pa

    names = pa.schema([("file_id", pa.int64()), ("seq", pa.int32()), ("frame_time", pa.float64()), ("bbox", pa.string()), ("side", pa.float64()), ("vector", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            rows = []
            for file_id, path in zip(b.column("file_id").to_pylist(), b.column("path").to_pylist()):
                try:
                    found = analyzer.faces(path)
                except Exception:  # one unreadable file doesn't stop the others
                    continue
                for seq, (box, vector) in enumerate(found):
                    side = min(box[2] - box[0], box[3] - box[1])
                    if side >= least:
                        rows.append((file_id, seq, 0.0, ",".join(str(int(x)) for x in box), float(side), [float(x) for x in vector]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, names)], schema=names)

    return files.select("file_id", "path").mapInArrow(run, "file_id long, seq int, frame_time double, bbox string, side double, vector array<float>")
