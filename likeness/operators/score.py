"""Scoring a library against concepts and storing the matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from likeness.operators.kernels import score_targets


def score_library(embeddings: DataFrame, concepts: DataFrame) -> DataFrame:
    """file_id, concept_id, score of every match of every concept (id, prototype, threshold), in one
    pass over the embeddings."""
    targets = concepts.select(F.col("id").cast("long").alias("target_id"), "prototype", F.col("threshold").cast("double").alias("cutoff"))
    return score_targets(embeddings, targets).withColumnRenamed("target_id", "concept_id")


def apply_concept(embeddings: DataFrame, concepts: DataFrame, name: str, threshold: float | None = None) -> DataFrame:
    """file_id, concept_id, score of one concept's matches."""
    own = concepts.filter(F.col("name") == name)
    return score_library(embeddings, own if threshold is None else own.withColumn("threshold", F.lit(threshold)))


def scores_by_file(file_concepts: DataFrame, concepts: DataFrame) -> DataFrame:
    """file_id, scores (map of concept name to score)."""
    named = file_concepts.join(concepts.select(F.col("id").alias("concept_id"), "name"), "concept_id")
    return named.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "score")))).alias("scores"))
