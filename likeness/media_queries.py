"""Registered queries over media that are planted from the tables' rows: images opened by path, files read to
frames, faces and bodies, near hashes of 240 bits and more."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from likeness.operators import duplicates, faces
from likeness.queries import query
from likeness.sources.catalog import Catalog
from likeness.sources.discovery import _opened
from likeness.sources.images import hashed_in_tasks
from likeness.sources.reading import read_media
from likeness.sources.scratch import Scratch
from likeness.streaming.ingest import index_batch

# Hashes of four words.

_LEVELS = (-0.1, -0.03, 0.03, 0.1)


def _word(vector, level):
    bits = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.when(vector[i].cast("double") > level, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)


_WORDS = ", ".join(
    f"xor(list_sum(list_transform(range(63), lambda i: CASE WHEN b.embedding[i + 1]::DOUBLE > {level}::DOUBLE THEN 1::HUGEINT << i ELSE 0 END))::BIGINT, "
    f"CASE WHEN e.vec_id % 3 > 0 THEN (e.vec_id * 40503 + {977 * k}) % 65536 ELSE 0 END) AS w{k}"
    for k, level in enumerate(_LEVELS)
)
_APART = " + ".join(f"bit_count(xor(a.w{k}, b.w{k}))::INT" for k in range(4))


@query(f"""WITH hashed AS MATERIALIZED (SELECT e.vec_id AS id, {_WORDS} FROM embeddings e JOIN embeddings b ON b.vec_id = e.vec_id - e.vec_id % 3)
SELECT a.id AS a, b.id AS b, CAST({_APART} AS INTEGER) AS value FROM hashed a JOIN hashed b ON a.id < b.id AND {_APART} <= 31""")
def indexed_hash_pairs(lib):
    """Hashes of four words, found through the index of segments: each three rows have their first one's
    vector, two of them with bits turned."""
    rows = lib.embeddings.select("id", (F.col("id") - F.col("id") % 3).alias("base"))
    bases = lib.embeddings.select(F.col("id").alias("base"), *[_word(F.col("vector"), level).alias(f"w{k}") for k, level in enumerate(_LEVELS)])
    turned = lambda k: F.when(F.col("id") % 3 > 0, (F.col("id") * 40503 + 977 * k) % 65536).otherwise(F.lit(0).cast("long"))
    own = rows.join(bases, "base").select("id", *[F.col(f"w{k}").bitwiseXOR(turned(k)).alias(f"w{k}") for k in range(4)])
    return duplicates.hamming_pairs(own, 31, [F.col(f"w{k}") for k in range(4)], index_from=1)


# Images opened by path.


def _planted(lib):
    """A grey image file for each vector, written by tasks to the shared folder: id, path."""
    scratch = Scratch(lib.spark, "planted")
    folder = f"{scratch.root}/images"

    def run(batches):
        files, base, _ = _opened(folder)
        files.create_dir(base, recursive=True)
        for b in batches:
            found = []
            for i, vector in zip(b.column("id").to_pylist(), b.column("vector").to_pylist()):
                v, n = np.floor(np.array(vector, np.float32).astype(float) * 1000).astype(np.int64), np.arange(64)
                pixels = np.abs(v[:, None] * (n[None] + 1) + v[None] * 2 + n[:, None] * n[None]) % 256
                with files.open_output_stream(f"{base}/{i}.pgm") as f:
                    f.write(b"P5\n64 64\n255\n" + pixels.astype(np.uint8).tobytes())
                found.append(f"{folder}/{i}.pgm")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.string())], ["id", "path"])

    return scratch.keep(lib.embeddings.select("id", "vector").mapInArrow(run, "id long, path string"))


@query("""WITH basis AS (SELECT list_transform(range(16), lambda k: list_transform(range(64), lambda n: CASE WHEN k = 0 THEN sqrt(1 / 64) ELSE sqrt(2 / 64) END * cos(pi() * (2 * n + 1) * k / 128))) AS b),
whole AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT) AS v FROM embeddings WHERE vec_id % 2 = 1),
image AS (SELECT id, list_transform(range(64), lambda i: list_transform(range(64), lambda j: (abs(v[i + 1] * (j + 1) + v[j + 1] * 2 + i * j) % 256)::DOUBLE)) AS p FROM whole),
half AS (SELECT id, list_transform(b, lambda c: list_transform(p, lambda r: list_dot_product(r, c))) AS h, b FROM image, basis),
low AS (SELECT id, flatten(list_transform(b, lambda c: list_transform(h, lambda r: list_dot_product(r, c)))) AS f FROM half)
SELECT id, 4096::BIGINT AS pixels, array_to_string(list_transform(range(256), lambda i: CASE WHEN i > 0 AND f[i + 1] > list_median(f[2:]) THEN '1' ELSE '0' END), '') AS bits FROM low""")
def images_by_path(lib):
    """Planted images of which every second one is known: the others are opened, decoded and hashed in tasks."""
    own = _planted(lib).filter("id % 2 = 1")
    found = hashed_in_tasks(own, kind="image").join(own, "path").withColumn("h", F.hex("phash"))
    return found.select("id", "pixels", F.concat(*[F.lpad(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(8)]).alias("bits"))


# From files to frames, faces and bodies.


def _number(path: str) -> int:
    return int(path.rsplit("_", 1)[1].split(".")[0])


class _Frames:
    """Videos of 2 to 8 seconds; one in three can't be opened, and frames at some times can't be read."""

    def duration(self, path: str) -> float:
        if _number(path) % 30 == 0:
            raise OSError(path)
        return 2.0 + _number(path) % 7

    def frame(self, path: str, seconds: float) -> np.ndarray:
        if int(seconds * 10) % 4 == 3:
            raise OSError(path)
        return np.full((240, 320, 3), _number(path) % 251, np.uint8)


class _Faces:
    """Up to two faces whose place and size follow from the image's brightness, which some don't allow."""

    def faces_in(self, pixels: np.ndarray) -> list:
        u = int(pixels[0, 0, 0])
        if u % 9 == 4:
            raise ValueError("no faces here")
        boxes = [(20 * k + u % 50, 30, 20 * k + u % 50 + 35 + u % 30, 75) for k in range(u % 3)]
        return [(box, np.array([u, k + 1, 1], float)) for k, box in enumerate(boxes)]


class _Pixels:
    dimension = 3

    def embed_pixels(self, images: list) -> np.ndarray:
        return np.array([[p[0, 0, 0], *p.shape[:2]] for p in images], np.float32)


def _image(path: str) -> bytes:
    if _number(path) % 20 == 3:
        raise OSError(path)
    return b"P5 320 240 255\n" + bytes([_number(path) % 251]) * (320 * 240)


def _read(files, **more):
    return read_media(files, _Pixels(), _Frames(), _Faces(), 8, crops=True, read=_image, digest=lambda path: hashlib.md5(path.encode()).digest(), **more)


_MEDIA = """media AS (SELECT vec_id AS id, vec_id % 251 AS u, vec_id % 10 = 0 AS video, '/lib/L' || label || '/IMG_' || printf('%04d', vec_id) || CASE WHEN vec_id % 10 = 0 THEN '.mov' ELSE '.jpg' END AS path FROM embeddings),
times AS (SELECT *, CASE WHEN NOT video THEN 0::DOUBLE ELSE d * 0.05::DOUBLE + d * (1 - 2 * 0.05::DOUBLE) * k / 7 END AS t
    FROM (SELECT *, (2 + id % 7)::DOUBLE AS d, unnest(CASE WHEN video THEN range(8) ELSE [0] END) AS k FROM media WHERE NOT (video AND id % 30 = 0) AND NOT (NOT video AND id % 20 = 3))),
shots AS MATERIALIZED (SELECT *, video AND floor(t * 10)::BIGINT % 4 = 3 AS failed, u % 9 = 4 AS faceless FROM times),
found AS MATERIALIZED (SELECT *, 20 * n + u % 50 AS l, 20 * n + u % 50 + 35 + u % 30 AS r, 35 + u % 30 AS w FROM (SELECT *, unnest(range(u % 3)) AS n FROM shots WHERE NOT failed AND NOT faceless) WHERE u % 30 >= 5),
bodies AS (SELECT *, trunc(greatest(0, (l + r) / 2 - w * 3.2::DOUBLE / 2))::INT AS bl, trunc(least(320, (l + r) / 2 + w * 3.2::DOUBLE / 2))::INT AS br FROM found),
pictures AS (SELECT id, k, -1 AS n, t, '-' AS box FROM shots WHERE NOT failed UNION ALL SELECT id, k, n, t, bl || ',3,' || br || ',240' FROM bodies WHERE br - bl >= 96),
by_file AS (SELECT id, string_agg(round(t * 1000)::BIGINT || ':' || box, '|' ORDER BY k, n) AS images, count(*) FILTER (n >= 0) AS regions FROM pictures GROUP BY id),
of_faces AS (SELECT id, string_agg(round(t * 1000)::BIGINT || ':' || l || ',30,' || r || ',75', '|' ORDER BY k, n) AS faces, count(*) AS n_faces, count(*) FILTER (u / sqrt(u * u + (n + 1) * (n + 1) + 1) >= 0.9999) AS named FROM found GROUP BY id),
of_shots AS (SELECT id, count(*) FILTER (NOT failed) AS frames, count(*) FILTER (failed) AS failed_frames, bool_or(faceless AND NOT failed) AS face_error FROM shots GROUP BY id),
read AS (SELECT media.id, path, coalesce(frames, 0) = 0 AS error, coalesce(frames, 0)::INT AS frames, coalesce(failed_frames, 0)::INT AS failed_frames, coalesce(face_error, false) AS face_error, images, faces, coalesce(regions, 0) AS regions, coalesce(n_faces, 0) AS n_faces, coalesce(named, 0) AS named
    FROM media LEFT JOIN of_shots USING (id) LEFT JOIN by_file USING (id) LEFT JOIN of_faces USING (id))"""


@query(f"WITH {_MEDIA} SELECT path, error, frames, failed_frames, face_error, coalesce(images, '') AS images, coalesce(faces, '') AS faces FROM read")
def read_files(lib):
    """Every file to its frames, faces and bodies, with an error for each level."""
    found = _read(lib.files.select("path", "kind"))
    at = lambda x: F.round(x * 1000).cast("long").cast("string")
    pictures = F.transform(F.arrays_zip("frame_times", "boxes"), lambda x: F.concat_ws(":", at(x["frame_times"]), F.coalesce(x["boxes"], F.lit("-"))))
    own = F.transform("faces", lambda x: F.concat_ws(":", at(x["frame_time"]), x["bbox"]))
    return found.select("path", F.col("error").isNotNull().alias("error"), "frames", "failed_frames", F.col("face_error").isNotNull().alias("face_error"), F.array_join(pictures, "|").alias("images"), F.array_join(own, "|").alias("faces"))


@query(f"""WITH {_MEDIA} SELECT count(*) AS scanned, count(*) FILTER (NOT error) AS indexed, count(*) FILTER (error) AS failed, sum(frames)::BIGINT AS frames, sum(regions)::BIGINT AS regions,
sum(n_faces)::BIGINT AS faces, sum(named)::BIGINT AS named, 0::BIGINT AS unchanged, sum(failed_frames)::BIGINT AS failed_frames, count(*) FILTER (face_error) AS failed_faces FROM read""")
def index_counts(lib):
    """The counts of an index pass over the same files: all of them computed from what it read."""
    scratch = Scratch(lib.spark, "counts")
    person = lib.spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0])], "id long, person_id long, vector array<float>")
    name = lambda found: faces.match(found, person, 0.9999)
    counts = index_batch(Catalog(lib.spark, scratch.root), lib.files.select("path", "kind", "size", "mtime_ns"), _read, 8, name=name)
    scratch.clear()
    return lib.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))
