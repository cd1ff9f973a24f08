"""Files that belong together: one stem, one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from likeness.functions import paths


def members(files: DataFrame) -> DataFrame:
    """path, dir, stem, rank, primary: a row per member, with its group's primary (the first in order of rank,
    then path, that isn't a sidecar); groups of sidecars alone are left out."""
    path = F.col("path")
    own = files.select(path, paths.parent(path).alias("dir"), F.lower(paths.stem(path)).alias("stem"), paths.primary_rank(path).alias("rank"), paths.is_sidecar(path).alias("sidecar")).distinct()
    first = own.filter("not sidecar").groupBy("dir", "stem").agg(F.min(F.struct("rank", "path"))["path"].alias("primary"))
    return own.drop("sidecar").join(first, ["dir", "stem"])


def groups(files: DataFrame) -> DataFrame:
    """dir, stem, primary, members (in order of rank, then path): each group of :func:`members` in one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda m: m["path"]).alias("members")
    return members(files).groupBy("dir", "stem", "primary").agg(ordered)


def find(chosen: DataFrame, listing: DataFrame) -> DataFrame:
    """The chosen paths and every path of the listing that shares folder and stem with one."""
    path = F.col("path")
    key = [paths.parent(path).alias("dir"), F.lower(paths.stem(path)).alias("stem")]
    found = listing.select(path, *key).join(chosen.select(*key).distinct(), ["dir", "stem"], "left_semi").select("path")
    return found.union(chosen.select("path")).distinct()


def primary_tags(members: DataFrame, tags: DataFrame) -> DataFrame:
    """path, primary, tags: every member (path, primary) gets its primary's tags (``tags``: path, tags), and
    only those."""
    own = members.select("path", "primary").join(tags.select(F.col("path").alias("primary"), "tags"), "primary", "left")
    return own.select("path", "primary", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
