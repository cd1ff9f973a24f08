"""Ranking files against a query vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from likeness.functions.vectors import centroid, cosine, literal

LIMIT = 50
BOUNDARY_LIMIT = 12
CANDIDATES = 200


def best_per_file(scored: DataFrame, key: str = "file_id") -> DataFrame:
    """The largest score of each file; NaN never counts."""
    return scored.filter(~F.isnan("score")).groupBy(key).agg(F.max("score").alias("score"))


def by_vector(embeddings: DataFrame, query, limit: int | None = LIMIT, threshold: float | None = None) -> DataFrame:
    """file_id, score: cosine to ``query`` (numbers or a column), the best per file, at or above the
    threshold, ranked; ties go to the smaller id. One shuffle of one row per file and task."""
    query = query if isinstance(query, Column) else literal(query)
    hits = best_per_file(embeddings.select("file_id", cosine(F.col("vector"), query).alias("score")))
    hits = hits if threshold is None else hits.filter(F.col("score") >= threshold)
    return hits if limit is None else hits.orderBy(F.desc("score"), "file_id").limit(limit)


def path_of(files: DataFrame, ids: DataFrame) -> DataFrame:
    """id, path of the files with the given ids."""
    return files.join(ids.select("id").distinct(), "id", "left_semi").select("id", "path")


def id_of(files: DataFrame, names: DataFrame) -> DataFrame:
    """path, id of the files with the given paths."""
    return files.join(names.select("path").distinct(), "path", "left_semi").select("path", "id")


def prototype_of(concepts: DataFrame, name: str):
    """Prototype and threshold of a concept; an unknown name raises."""
    found = concepts.filter(F.col("name") == name).select("prototype", "threshold").head(1)
    if not found:
        raise KeyError(name)
    return found[0]


def by_concept(embeddings: DataFrame, concepts: DataFrame, name: str, limit: int | None = LIMIT, threshold: float | None = None) -> DataFrame:
    """Search with a stored concept, at its own threshold unless another is given."""
    prototype, own = prototype_of(concepts, name)
    return by_vector(embeddings, prototype, limit, own if threshold is None else threshold)


def by_examples(embeddings: DataFrame, examples: DataFrame, limit: int | None = LIMIT, threshold: float | None = None) -> DataFrame:
    """Search with the centroid of example vectors."""
    found = centroid(examples.select(F.lit(0).alias("one"), "vector"), "one").head(1)
    if not found:
        raise ValueError("no examples")
    return by_vector(embeddings, found[0]["prototype"], limit, threshold)


def by_person(file_faces: DataFrame, people: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """file_id, score: the best face of a person in each file; a face without score counts as 0."""
    own = file_faces.join(F.broadcast(people.filter(F.col("name") == name).select(F.col("id").alias("person_id")).limit(1)), "person_id", "left_semi")
    hits = own.groupBy("file_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), "file_id").limit(limit)


def stored_matches(file_concepts: DataFrame, concepts: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """file_id, score of a concept's stored matches."""
    own = concepts.filter(F.col("name") == name).select(F.col("id").alias("concept_id"))
    hits = file_concepts.join(F.broadcast(own.limit(1)), "concept_id", "left_semi").select("file_id", "score")
    return hits if limit is None else hits.orderBy(F.desc("score"), "file_id").limit(limit)


def boundary(embeddings: DataFrame, prototype, threshold: float, limit: int = BOUNDARY_LIMIT) -> DataFrame:
    """file_id, score, matching, distance of the files closest to a concept's threshold."""
    hits = by_vector(embeddings, prototype, None)
    hits = hits.withColumns({"matching": F.col("score") >= threshold, "distance": F.abs(F.col("score") - threshold)})
    return hits.orderBy("distance", "file_id").limit(limit)


def phrase(explicit: Column, stored: Column, name: Column) -> Column:
    """What a verifier is asked: the given phrase, the stored one, or the name with spaces."""
    empty = F.lit("")
    return F.coalesce(F.when(explicit != empty, explicit), F.when(stored != empty, stored), F.replace(name, F.lit("-"), F.lit(" ")))


#: Candidates of a verification that a task scores at least.
VERIFY_ROWS = 16


def verify_files(embeddings: DataFrame, files: DataFrame, prototype, scorer, limit: int = CANDIDATES) -> DataFrame:
    """file_id, path, score, verified, box, error: the best candidates (cosine of 0 or more) ranked again by a model
    (``scorer`` as :func:`likeness.sources.plugins.verify_with` makes it), which several tasks ask at once.
    Candidates whose file isn't known are left out."""
    candidates = by_vector(embeddings, prototype, limit, 0.0)
    known = candidates.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    tasks = max(1, min(limit // VERIFY_ROWS, embeddings.sparkSession.sparkContext.defaultParallelism))
    found = scorer(known.select("file_id", "path").repartition(tasks))
    return known.join(found, "file_id").orderBy(F.desc("verified"), "file_id")


def verify(embeddings: DataFrame, prototype, scorer: Column, limit: int = CANDIDATES) -> DataFrame:
    """file_id, score, verified: the best candidates (cosine of 0 or more) ranked again by an external
    scorer (a column of ``file_id``, such as a pandas UDF); what it can't score counts as 0."""
    candidates = by_vector(embeddings, prototype, limit, 0.0)
    return candidates.withColumn("verified", F.coalesce(scorer.cast("double"), F.lit(0.0))).orderBy(F.desc("verified"), "file_id")
