"""Exact and near duplicates of files, the copy to keep and what is redundant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from likeness.functions import hashing, paths
from likeness.operators.components import components
from likeness.operators.kernels import INDEX_FROM, block_pairs, hamming_kernel, indexed_hamming_pairs
from likeness.sources.scratch import Scratch


def keeper_order(path: Column, pixels: Column, size: Column, mtime_ns: Column, group_stems: Column | None = None) -> Column:
    """Sorts the copy to keep first: most pixels, a name that isn't a copy's, isn't derived from
    another of the group and is short, then most bytes, the oldest, the smallest path."""
    zero, own = F.lit(0), paths.stem(path)
    derived = F.lit(False) if group_stems is None else paths.derived_name(own, group_stems)
    return F.struct(
        (-F.coalesce(pixels, zero)).alias("pixels"), paths.looks_like_copy(path).alias("copy"), derived.alias("derived"), F.length(paths.name(path)).alias("length"),
        (-F.coalesce(size, zero)).alias("size"), F.coalesce(mtime_ns, zero).alias("mtime"), path.alias("path"),
    )


def with_keeper(members: DataFrame, group: str = "group") -> DataFrame:
    """Members (``group``, path, pixels, size, mtime_ns) plus keeper: a row per member, so that a group may
    hold any share of the files.

    Whether a stem extends another of its group is found by joining each stem's proper prefixes with
    the group's stems, so no member sees the whole group's list.
    """
    own = members.withColumn("stem", paths.stem(F.col("path")))
    stems = own.select(group, "stem").distinct()
    prefixes = stems.select(group, "stem", F.explode(F.transform(F.sequence(F.lit(0), F.length("stem")), lambda i: F.substring(F.col("stem"), F.lit(1), i))).alias("prefix")).filter("prefix <> stem")
    derived = prefixes.join(stems.select(group, F.col("stem").alias("prefix")), [group, "prefix"], "left_semi").select(group, "stem").distinct().withColumn("derived", F.lit(True))
    own = own.join(derived, [group, "stem"], "left")
    order = keeper_order(F.col("path"), F.col("pixels"), F.col("size"), F.col("mtime_ns"))
    order = order.withField("derived", F.coalesce("derived", F.lit(False)))
    keepers = own.groupBy(group).agg(F.min_by("path", order).alias("keeper"))
    return members.join(keepers, group)


def as_groups(members: DataFrame, group: str = "group") -> DataFrame:
    """``group``, keeper, n, paths, redundant: the members of each group in one row, for groups that a
    person looks at."""
    own = members.groupBy(group, "keeper").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    return own.withColumn("redundant", F.array_remove("paths", F.col("keeper")))


def exact_members(files: DataFrame) -> DataFrame:
    """group (the content hash), path, keeper of the files whose content another file has, too."""
    some = files.filter("content_hash is not null and length(content_hash) > 0")
    repeated = some.groupBy("content_hash").count().filter("count > 1").select("content_hash")
    members = some.join(repeated, "content_hash").withColumn("group", F.col("content_hash"))
    return with_keeper(members).select("group", "path", "keeper")


def exact_groups(files: DataFrame) -> DataFrame:
    """kind, content_hash, keeper, n, paths, redundant of files with equal content, two or more."""
    return as_groups(exact_members(files)).select(F.lit("exact").alias("kind"), F.col("group").alias("content_hash"), "keeper", "n", "paths", "redundant")


def hamming_pairs(files: DataFrame, most: int, words: list[Column], index_from: int = INDEX_FROM, connect: bool = False) -> DataFrame:
    """a, b, value: pairs of file ids whose hashes (as 64-bit words) differ in ``most`` bits or fewer. From
    ``index_from`` files an index of the hashes' segments saves nearly all comparisons, where ``most`` allows
    one (it does for the usual cutoff); the pairs are the same. ``connect``: where only what is connected
    matters, a task's pairs become the forest of what they connect, with each component's largest value."""
    whole = words[0].isNotNull()
    for w in words[1:]:
        whole = whole & w.isNotNull()
    rows = files.select("id", F.when(whole, F.array(*words)).alias("data"))  # a file without a hash takes no part
    if most < 8 * len(words) and rows.limit(index_from).count() == index_from:
        return indexed_hamming_pairs(rows, most, len(words), connect=connect)
    return block_pairs(rows, hamming_kernel(most), "int", 8 * len(words), connect=connect)


def near_members(files: DataFrame, most: int | None = None, words: list[Column] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """group, path, keeper, distance (share of bits, of the group's worst pair within the cutoff) of the
    files that chains of similar hashes join. Files without a hash take no part. Files of one hash are
    compared as one, so that copies don't become pairs of each with each. The result reads tables of ``scratch``."""
    most = hashing.cutoff() if most is None else most
    words = hashing.words(F.col("phash")) if words is None else words
    some = files.filter(F.coalesce(*[w.isNotNull() for w in words[:1]], F.lit(False)))
    scratch = scratch or Scratch(files.sparkSession, "near-groups")
    hashes = scratch.keep(some.select("id", F.array(*words).alias("data")))
    distinct = scratch.keep(hashes.groupBy("data").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    pairs = hamming_pairs(distinct, most, [F.col("data")[k] for k in range(len(words))], connect=True)
    copies = hashes.join(distinct.filter("n > 1").select("data", F.col("id").alias("first")), "data").filter("id <> first")
    pairs = scratch.keep(pairs.unionByName(copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("value"))))
    labels = components(pairs, scratch).withColumnsRenamed({"node": "id", "label": "group"})
    worst = pairs.join(labels, pairs["a"] == labels["id"]).groupBy("group").agg((F.max("value") / hashing.BITS).alias("distance"))
    return with_keeper(some.join(labels, "id")).join(worst, "group").select("group", "path", "keeper", "distance")


def near_groups(files: DataFrame, most: int | None = None, words: list[Column] | None = None) -> DataFrame:
    """group, kind, distance, keeper, n, paths, redundant of :func:`near_members`."""
    members = near_members(files, most, words)
    distances = members.groupBy("group").agg(F.max("distance").alias("distance"))
    return as_groups(members).join(distances, "group").select("group", F.lit("near").alias("kind"), "distance", "keeper", "n", "paths", "redundant")


def combine(exact: DataFrame, near: DataFrame) -> DataFrame:
    """Exact groups and the near groups with a member that is in no exact group."""
    covered = exact.select(F.explode("paths").alias("path")).distinct()
    new = near.select("group", F.explode("paths").alias("path")).join(covered, "path", "left_anti").select("group").distinct()
    columns = ["kind", "distance", "keeper", "n", "paths", "redundant"]
    return exact.withColumn("distance", F.lit(0.0)).select(columns).unionByName(near.join(new, "group", "left_semi").select(columns))


def combined_members(exact: DataFrame, near: DataFrame) -> DataFrame:
    """path, keeper of the exact groups' members and of those near groups that have a member in none."""
    new = near.join(exact.select("path").distinct(), "path", "left_anti").select("group").distinct()
    return exact.select("path", "keeper").unionByName(near.join(new, "group", "left_semi").select("path", "keeper"))


def redundant_files(members: DataFrame) -> DataFrame:
    """keeper, path of the members that aren't their group's keeper."""
    return members.filter("path <> keeper").select("keeper", "path")
