"""Tags of files: matches, corrections that win over them, views and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATES = ("on", "off")


def latest_overrides(log: DataFrame, order: list[str]) -> DataFrame:
    """file_id, concept_id, state: the last entry of each pair of an append-only log; null clears."""
    last = F.max_by(F.struct("state"), F.struct(*order)).alias("last")
    return log.groupBy("file_id", "concept_id").agg(last).select("file_id", "concept_id", "last.state")


def set_override(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with further entries; a state other than on, off and null (clear) raises."""
    bad = entries.filter(F.col("state").isNotNull() & ~F.col("state").isin(*STATES)).head(1)
    if bad:
        raise ValueError(f"state must be one of {STATES} or null, got {bad[0]['state']!r}")
    return log.unionByName(entries)


def effective(file_concepts: DataFrame, overrides: DataFrame) -> DataFrame:
    """file_id, concept_id: matches without those switched off, and those switched on."""
    off = overrides.filter("state = 'off'").select("file_id", "concept_id")
    on = overrides.filter("state = 'on'").select("file_id", "concept_id")
    kept = file_concepts.select("file_id", "concept_id").join(off, ["file_id", "concept_id"], "left_anti")
    return kept.union(on).distinct()


def with_names(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    return pairs.join(concepts.select(F.col("id").alias("concept_id"), "name"), "concept_id")


def by_file(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """file_id, tags: each file's tag names in order."""
    return with_names(pairs, concepts).groupBy("file_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))


def matching(file_concepts: DataFrame, concepts: DataFrame, names: list[str], mode: str = "any", limit: int | None = None) -> DataFrame:
    """file_id, score, tags of the files that have any or all of the named tags, ranked. For effective
    instead of stored matches pass :func:`effective` with its scores."""
    if mode not in ("any", "all"):
        raise ValueError(f"mode must be any or all, got {mode!r}")
    wanted = concepts.filter(F.col("name").isin(list(names))) if names else concepts.limit(0)
    hits = with_names(file_concepts, wanted).groupBy("file_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("name")).alias("tags"))
    if mode == "all":
        hits = hits.filter(F.size("tags") == len(set(names)))
    return hits if limit is None else hits.orderBy(F.desc("score"), "file_id").limit(limit)


def library_view(files: DataFrame, pairs: DataFrame, concepts: DataFrame, file_faces: DataFrame, people: DataFrame) -> DataFrame:
    """id, path, kind, tags, people of every file; both lists are aggregated before they are joined."""
    named = file_faces.join(people.select(F.col("id").alias("person_id"), "name"), "person_id")
    faces = named.groupBy("file_id").agg(F.array_sort(F.collect_set("name")).alias("people"))
    own, none = F.col("id") == F.col("file_id"), F.array().cast("array<string>")
    out = files.select("id", "path", "kind").join(by_file(pairs, concepts), own, "left").drop("file_id").join(faces, own, "left").drop("file_id")
    return out.withColumns({"tags": F.coalesce("tags", none), "people": F.coalesce("people", none)})


def library_filter(name: Column, tags: Column, text: str = "", untagged: bool = False, selected: list[str] | None = None, mode: str = "any") -> Column:
    """Files by a part of their name, without tags, or with any or all of the selected tags."""
    fine = F.lower(name).contains(text.strip().lower())
    if untagged:
        fine = fine & (F.size(tags) == 0)
    if selected:
        wanted = F.array(*map(F.lit, selected))
        fine = fine & (F.arrays_overlap(tags, wanted) if mode == "any" else F.size(F.array_except(wanted, tags)) == 0)
    return fine


def tag_counts(view: DataFrame) -> DataFrame:
    """tag, files over a library view."""
    return view.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("files"))


def concept_counts(concepts: DataFrame, file_concepts: DataFrame) -> DataFrame:
    """Every concept with its number of stored matches."""
    n = file_concepts.groupBy("concept_id").agg(F.count("*").alias("matches"))
    return concepts.join(n, F.col("id") == F.col("concept_id"), "left").drop("concept_id").withColumn("matches", F.coalesce("matches", F.lit(0)))


def people_counts(people: DataFrame, file_faces: DataFrame) -> DataFrame:
    """Every person with the number of files that show them."""
    n = file_faces.filter("person_id is not null").groupBy("person_id").agg(F.countDistinct("file_id").alias("files"))
    return people.join(n, F.col("id") == F.col("person_id"), "left").drop("person_id").withColumn("files", F.coalesce("files", F.lit(0)))


def status(files: DataFrame, embeddings: DataFrame, concepts: DataFrame, file_faces: DataFrame) -> DataFrame:
    """One row of counts."""
    by_kind = files.agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"))
    faces = file_faces.agg(F.count("*").alias("faces"), F.count("person_id").alias("named_faces"))
    return by_kind.join(embeddings.agg(F.count("*").alias("embeddings"))).join(concepts.agg(F.count("*").alias("concepts"))).join(faces)
