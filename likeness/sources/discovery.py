"""Finding media files and what has changed among them."""

from __future__ import annotations

import os
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from likeness.functions import paths
from likeness.sources.scratch import Scratch

SAMPLES = 8


_ENTRY = "path string, size long, mtime_ns long, folder boolean"


def _inside(found, prefix: str):
    """Arrow columns of :data:`_ENTRY` for what a file system reports; symbolic links that lead nowhere are left out."""
    rows = [(prefix + i.path, i.size or 0, i.mtime_ns, i.type == fs.FileType.Directory) for i in found if i.type in (fs.FileType.File, fs.FileType.Directory)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], [f.split()[0] for f in _ENTRY.split(", ")])


def _opened(uri: str):
    """File system, path and what stands before paths in it (nothing for local ones)."""
    files, base = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + quote(os.path.abspath(uri.removeprefix("file:"))))
    return files, base, "" if isinstance(files, fs.LocalFileSystem) else uri[: uri.index("://") + 3]


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size, mtime_ns of all files under a folder (or of one file), without reading contents and
    whatever their names begin with. Folders are listed level by level, each level's by many tasks."""
    files, base, prefix = _opened(root.rstrip("/") or "/")
    first = files.get_file_info(base)
    if first.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    scratch = Scratch(spark, "listing")
    level = spark.createDataFrame(pa.Table.from_batches([_inside([first], prefix)]).to_pylist(), _ENTRY)
    levels = [level]

    def children(batches):
        for b in batches:
            for folder in b.column("path").to_pylist():
                files, base, prefix = _opened(folder)
                yield _inside(files.get_file_info(fs.FileSelector(base, allow_not_found=True)), prefix)

    while not level.filter("folder").isEmpty() and (recursive or len(levels) == 1):
        level = scratch.keep(level.filter("folder").select("path").repartition("path").mapInArrow(children, _ENTRY))
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.filter("not folder").drop("folder")


def media(files: DataFrame, root: str) -> DataFrame:
    """path, kind, size, mtime_ns of the media files of a listing: no hidden files or folders below
    the root, nothing inside packages, known suffixes alone."""
    path = F.col("path")
    base = root.rstrip("/")
    relative = F.when(path == base, paths.name(path)).otherwise(F.substring(path, F.lit(len(base) + 2), F.length(path)))
    found = files.filter(~paths.hidden(relative) & ~paths.in_package(relative)).withColumn("kind", paths.kind(path))
    return found.filter("kind is not null").select("path", "kind", "size", "mtime_ns")


def example_images(files: DataFrame, root: str) -> DataFrame:
    """The images under a folder, in order; none raises."""
    found = media(files, root).filter("kind = 'image'")
    if found.isEmpty():
        raise ValueError(f"no images in {root}")
    return found.orderBy("path")


def wanted_samples(kind: Column, samples: int = SAMPLES) -> Column:
    return F.when(kind == "video", F.lit(samples)).otherwise(1)


def unchanged(found: DataFrame, files: DataFrame, embeddings: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The found files that need no work: known by path, size and time, with at least the wanted
    samples and an embedding."""
    known = files.join(embeddings.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
    known = known.select(F.col("path").alias("k_path"), F.col("size").alias("k_size"), F.col("mtime_ns").alias("k_mtime"), F.col("samples").alias("k_samples"))
    same = (F.col("path") == F.col("k_path")) & (F.col("size") == F.col("k_size")) & (F.col("mtime_ns") == F.col("k_mtime")) & (F.col("k_samples") >= wanted_samples(F.col("kind"), samples))
    return found.join(known, same, "left_semi")


def changed(found: DataFrame, files: DataFrame, embeddings: DataFrame, samples: int = SAMPLES, force: bool = False) -> DataFrame:
    """The found files that an index pass has to read."""
    return found if force else found.join(unchanged(found, files, embeddings, samples).select("path"), "path", "left_anti")


def missing(files: DataFrame, found: DataFrame) -> DataFrame:
    """Indexed files that a listing no longer has."""
    return files.join(found.select("path"), "path", "left_anti")


def frames(files: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """path, frame, frame_time: a row per frame to take from each file (path, kind, duration)."""
    times = F.when(F.col("kind") == "video", paths.sample_times(F.col("duration"), F.lit(samples))).otherwise(F.array(F.lit(0.0)))
    return files.select("path", F.posexplode(times).alias("frame", "frame_time"))
