"""Faces: matching to known people, clusters of unknown ones, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from likeness.operators.components import components
from likeness.operators.kernels import PRUNE_FROM, best_target, block_pairs, cosine_kernel, pruned_cosine_pairs
from likeness.sources.scratch import Scratch, numbered

THRESHOLD = 0.38
CLUSTER_THRESHOLD = 0.5
CLUSTER_SIZE = 3


def match(faces: DataFrame, references: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, person_id, ref_id, score: the closest reference (id, person_id, vector) of each face at or
    above the threshold; among equals the smallest reference id."""
    targets = references.select(F.col("id").cast("long").alias("target_id"), F.col("vector").alias("prototype"))
    best = best_target(faces, targets, "id").filter(F.col("score") >= threshold)
    return best.join(references.select(F.col("id").alias("target_id"), "person_id"), "target_id").select("id", "person_id", F.col("target_id").alias("ref_id"), "score")


def rematch(file_faces: DataFrame, references: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The faces with those still unassigned matched; assigned ones keep person and score."""
    new = match(file_faces.filter("person_id is null"), references, threshold)
    new = new.select("id", F.col("person_id").alias("new_person"), F.col("score").alias("new_score"))
    out = file_faces.join(new, "id", "left")
    out = out.withColumns({"score": F.when(F.col("new_person").isNotNull(), F.col("new_score")).otherwise(F.col("score")), "person_id": F.coalesce("new_person", "person_id")})
    return out.select(file_faces.columns)


def cluster_members(file_faces: DataFrame, threshold: float = CLUSTER_THRESHOLD, scratch: Scratch | None = None, prune_from: int = PRUNE_FROM) -> DataFrame:
    """id, file_id, cluster of unassigned faces: chains of similar pairs join a cluster, whose name is its
    smallest face id. A row per face, so a cluster may hold any share of them; equal vectors are compared as
    one, and tasks pass on what their pairs connect, not the pairs. From ``prune_from`` vectors blocks that
    can't hold similar ones don't meet. The result reads tables of ``scratch``."""
    scratch = scratch or Scratch(file_faces.sparkSession, "clusters")
    faces = file_faces.filter("person_id is null")
    vectors = scratch.keep(faces.filter("vector is not null and id is not null").select("id", F.col("vector").alias("data")))
    distinct = scratch.keep(vectors.groupBy("data").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    if threshold > 0 and distinct.limit(prune_from).count() == prune_from:
        pairs, _ = pruned_cosine_pairs(distinct, threshold, scratch, connect=True)
    else:
        first = distinct.select(F.size("data")).head(1)
        pairs = block_pairs(distinct, cosine_kernel(threshold), "double", 8 * max(1, first[0][0] if first else 1), connect=True)
    zero = F.aggregate("data", F.lit(True), lambda s, x: s & (x == 0))  # these match none, so not each other either
    copies = vectors.join(distinct.filter("n > 1").filter(~zero).select("data", F.col("id").alias("first")), "data").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    labels = components(pairs.select("a", "b").unionByName(copies), scratch).withColumnRenamed("node", "id")
    return faces.select("id", "file_id").join(labels, "id", "left").select("id", "file_id", F.coalesce("label", "id").alias("cluster"))


def cluster_unnamed(file_faces: DataFrame, threshold: float = CLUSTER_THRESHOLD, least: int = CLUSTER_SIZE) -> DataFrame:
    """cluster, size, files, face_ids, sample_file_id of groups of unassigned faces, for people to look at."""
    groups = cluster_members(file_faces, threshold).groupBy("cluster").agg(
        F.count("*").alias("size"), F.countDistinct("file_id").alias("files"), F.array_sort(F.collect_list("id")).alias("face_ids"), F.min_by("file_id", "id").alias("sample_file_id"))
    return groups.filter(F.col("size") >= least)


def name_cluster(file_faces: DataFrame, references: DataFrame, face_ids: DataFrame | list[int], person_id: int, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The faces (those of the cluster, a list or a table of ids, assigned with score 1) and the references with
    the cluster's faces added, numbered on by their ids. Reads tables of ``scratch``."""
    spark = file_faces.sparkSession
    ids = face_ids if isinstance(face_ids, DataFrame) else spark.createDataFrame([(i,) for i in face_ids], "id long")
    first = references.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    chosen = numbered((scratch or Scratch(spark, "named")), ids.select("id").distinct(), ["id"], first)
    own = file_faces.join(chosen, "id", "left")
    added = own.filter("number is not null").select(F.col("number").alias("id"), F.lit(person_id).cast("long").alias("person_id"), "vector", F.lit("cluster").alias("source"))
    is_own = F.col("number").isNotNull()
    faces = own.withColumns({"person_id": F.when(is_own, F.lit(person_id)).otherwise(F.col("person_id")), "score": F.when(is_own, F.lit(1.0)).otherwise(F.col("score"))}).select(file_faces.columns)
    return faces, references.unionByName(added)


def largest_face(faces: DataFrame, by: str = "file_id", size: Column | None = None, least: float = 40.0) -> DataFrame:
    """The largest face (by its short side) of each image, of those large enough; the first of equals."""
    size = F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) if size is None else size
    sized = faces.withColumn("side", size).filter(F.col("side") >= least)
    best = F.max_by(F.struct(*[c for c in sized.columns if c != by]), F.struct("side", -F.col("id"))).alias("best")
    return sized.groupBy(by).agg(best).select(by, "best.*")


def register(references: DataFrame, person_id: int, faces: DataFrame, mode: str = "extend") -> DataFrame:
    """A person's references with further ones (id, vector, source), or with those alone."""
    if mode not in ("extend", "replace"):
        raise ValueError(f"mode must be extend or replace, got {mode!r}")
    kept = references if mode == "extend" else references.filter(F.col("person_id") != person_id)
    return kept.unionByName(faces.select("id", F.lit(person_id).cast("long").alias("person_id"), "vector", "source"))
