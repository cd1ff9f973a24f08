"""Incremental work: new files into the index, corrections into the overrides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from likeness.sources.catalog import Catalog
from likeness.sources.discovery import changed, wanted_samples
from likeness.sources.scratch import Scratch


#: Files that a pass indexes between two commits.
BATCH_FILES = 5000


def index_batch(
    catalog: Catalog, found: DataFrame, embed: Callable[[DataFrame], DataFrame], samples: int = 8, fingerprint: Callable[[DataFrame, Scratch], DataFrame] | None = None, name: Callable[[DataFrame], DataFrame] | None = None
) -> dict:
    """Index the changed files of a batch (path, kind, size, mtime_ns); no others are opened.

    ``embed`` turns files (path, kind) into path, vectors, frame_times, boxes and error; a file with an error
    is counted as failed and not indexed. It may give more (:func:`likeness.sources.reading.read_media` does):
    content_hash, phash and pixels, else ``fingerprint`` finds them; faces, which ``name`` (id, vector ->
    id, person_id, score) matches to people; failed_frames and face_error, which are counted. All that a batch
    writes becomes visible in one step. Returns counts.
    """
    scratch = Scratch(found.sparkSession, "index")
    found = scratch.keep(found.dropDuplicates(["path"]))
    todo = scratch.keep(changed(found, catalog.read("files"), catalog.read("embeddings"), samples))
    done = scratch.keep(embed(todo.select("path", "kind")))
    fine = done.filter("error is null")
    rows = todo.join(fine.select("path"), "path", "left_semi").withColumn("samples", wanted_samples(F.col("kind"), samples)).withColumn("indexed_at", F.current_timestamp())
    if "phash" in done.columns:
        rows = rows.join(fine.select("path", "content_hash", "phash", "pixels"), "path", "left")
    elif fingerprint is not None:
        rows = rows.join(scratch.keep(fingerprint(rows.select("path"), scratch)), "path", "left")
    n_faces = n_named = 0
    with catalog.change():
        ids = catalog.upsert_files(rows).select("path", F.col("id").alias("file_id"))
        catalog.add_embeddings(fine.join(ids, "path").select("file_id", "vectors", "frame_times", "boxes"))
        if "faces" in done.columns:
            faces = fine.select("path", F.explode("faces").alias("f")).join(ids, "path").select("file_id", "f.bbox", "f.frame_time", "f.vector")
            faces = scratch.keep(faces)
            n_faces = faces.count()
            if n_faces and name is not None:
                keyed = faces.withColumn("id", F.monotonically_increasing_id())  # of a written table
                faces = scratch.keep(keyed.join(name(keyed).select("id", "person_id", "score"), "id", "left").drop("id"))
                n_named = faces.filter("person_id is not null").count()
            if n_faces:
                catalog.add_faces(faces)
    whole = F.size(F.filter("boxes", lambda b: b.isNull() | (b == "")))  # vectors of whole frames have no box
    known = F.col("error").isNull()
    optional = lambda column, value: F.coalesce(F.sum(value), F.lit(0)) if column in done.columns else F.lit(0)
    n = done.agg(
        F.count("*").alias("n"), F.count("error").alias("failed"), F.coalesce(F.sum(F.when(known, whole)), F.lit(0)).alias("frames"),
        F.coalesce(F.sum(F.when(known, F.size("vectors") - whole)), F.lit(0)).alias("regions"),
        optional("failed_frames", F.col("failed_frames") if "failed_frames" in done.columns else None).alias("failed_frames"),
        optional("face_error", F.col("face_error").isNotNull().cast("long") if "face_error" in done.columns else None).alias("failed_faces")).first()
    scanned = found.count()
    counts = {"scanned": scanned, "indexed": n["n"] - n["failed"], "failed": n["failed"], "frames": n["frames"], "regions": n["regions"], "faces": n_faces, "named": n_named, "unchanged": scanned - todo.count()}
    if "face_error" in done.columns:
        counts |= {"failed_frames": n["failed_frames"], "failed_faces": n["failed_faces"]}
    scratch.clear()
    return counts


def index_pass(
    catalog: Catalog, found: DataFrame, embed: Callable[[DataFrame], DataFrame], samples: int = 8, fingerprint=None, name=None, batch: int = BATCH_FILES,
    stop: Callable[[], bool] = lambda: False, report: Callable[[int, int], None] = lambda done, of: None,
) -> dict:
    """Index the changed files of a listing, ``batch`` files at a time, each batch committed by itself: a pass that
    ends half-way keeps its batches, and the next one reads the rest alone. The batches are a stream over the
    written listing. ``stop`` is asked before each of them, ``report`` told how many are done. Returns the
    counts of :func:`index_batch` for what was done, with scanned and unchanged of the whole listing."""
    spark, scratch = found.sparkSession, Scratch(found.sparkSession, "pass")
    found = scratch.keep(found.dropDuplicates(["path"]))
    scanned, todo = found.count(), scratch.keep(changed(found, catalog.read("files"), catalog.read("embeddings"), samples))
    n = todo.count()
    n_batches = max(1, -(-n // batch))
    if n_batches == 1:
        done = index_batch(catalog, found, embed, samples, fingerprint, name)
        report(1, 1)
        scratch.clear()
        return done
    totals: dict[str, int] = {}
    listing = f"{scratch.root}/batches"
    todo.repartition(n_batches).write.option("maxRecordsPerFile", batch).parquet(listing)
    told = [0]

    def apply(rows: DataFrame, _: int) -> None:
        if stop():
            return  # what is left is found again by the next pass
        for k, v in index_batch(catalog, rows, embed, samples, fingerprint, name).items():
            totals[k] = totals.get(k, 0) + v
        told[0] += 1
        report(told[0], max(n_batches, told[0]))

    stream = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", 1).parquet(listing)
    query = stream.writeStream.option("checkpointLocation", f"{scratch.root}/progress").foreachBatch(apply).trigger(availableNow=True).start()
    query.awaitTermination()
    scratch.clear()
    return totals | {"scanned": scanned, "unchanged": scanned - n} | ({} if "failed" in totals else dict.fromkeys(("indexed", "failed", "frames", "regions", "faces", "named"), 0))


def index_stream(stream: DataFrame, catalog: Catalog, embed: Callable[[DataFrame], DataFrame], checkpoint: str, samples: int = 8, fingerprint=None, name=None, available_now: bool = False):
    """A query that indexes a stream of listings; its checkpoint is what an index pass resumes from. Each
    batch is committed by itself. Applying a batch again changes nothing: files that are known and
    unchanged are skipped. ``available_now``: it ends when what is there has been indexed."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: index_batch(catalog, batch, embed, samples, fingerprint, name) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def correct_stream(stream: DataFrame, catalog: Catalog, checkpoint: str):
    """A query that applies a stream of corrections (file_id, concept_id, state, ts, event_id) to the
    catalogue, batch by batch: of each pair the latest entry counts. What is known of a pair lies in the
    catalogue's log of corrections and not in the query's state, so that doesn't grow, however late an
    event is; an entry older than the one that holds changes nothing, so batches can be applied again."""

    def apply(batch: DataFrame, _: int) -> None:
        catalog.log_overrides(batch.select("file_id", "concept_id", "state", "ts", "event_id"))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def activity(stream: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """start, state, n: corrections by window of event time, closed once the delay has passed."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "state").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "state", "n")
