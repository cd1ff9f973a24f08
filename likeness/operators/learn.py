"""Learning concepts: prototypes, cohesion and calibrated thresholds for many concepts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from likeness.functions.vectors import centroid, cosine
from likeness.operators.kernels import score_buckets

FLOOR = 0.60
PERCENTILE = 0.10
MARGIN = 0.01
LEAST_LIBRARY = 8
LEAST_GAP = 0.02


def prototypes(examples: DataFrame, by: str = "concept_id") -> DataFrame:
    return centroid(examples, by)


def example_scores(examples: DataFrame, protos: DataFrame, by: str = "concept_id") -> DataFrame:
    """``by``, score: cosine of each example to its own prototype."""
    return examples.join(protos, by).select(by, cosine(F.col("vector"), F.col("prototype")).alias("score"))


def cohesion(examples: DataFrame, protos: DataFrame, by: str = "concept_id") -> DataFrame:
    """``by``, n_examples, cohesion, least (the examples' 10th percentile, interpolated)."""
    scores = example_scores(examples, protos, by)
    return scores.groupBy(by).agg(F.count("*").alias("n_examples"), F.avg("score").alias("cohesion"), F.expr(f"percentile(score, {PERCENTILE}D)").alias("least"))


def positive_threshold(least):
    """With examples alone: their percentile, at least the floor."""
    return F.greatest(least, F.lit(FLOOR))


def negative_threshold(most_negative, least, margin: float = MARGIN):
    """With counter-examples: just above the most similar one, at most the percentile, without floor."""
    return F.least(most_negative + margin, least)


def retighten(threshold, most_negative, margin: float = MARGIN):
    """Counter-examples alone raise a stored threshold and never lower it."""
    return F.greatest(threshold, most_negative + margin, F.lit(FLOOR))


#: Buckets of scores from -1 to 1. Gaps narrower than one aren't told apart; ``LEAST_GAP`` is 41 times as wide.
BUCKETS = 4096


def bucketed(scores: DataFrame, least: DataFrame, by: str = "concept_id") -> DataFrame:
    """``by``, bucket, n, top, bottom of plain rows (``by``, score), as :func:`library_buckets`."""
    own = scores.select(by, F.col("score").cast("double").alias("score")).filter("score is not null and not isnan(score)").join(least.select(by, "least"), by)
    place = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((F.col("score") + 1) * (BUCKETS / 2)))).cast("int")
    bands = own.filter("score <= least").groupBy(by, place.alias("bucket")).agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("score").alias("bottom"))
    every = own.groupBy(by).agg(F.count("*").alias("n")).select(by, F.lit(None).cast("int").alias("bucket"), "n", F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("bottom"))
    return bands.unionByName(every)


def widest_gaps(buckets: DataFrame, by: str = "concept_id") -> DataFrame:
    """``by``, n, upper, lower: the widest gap between neighbouring scores of each concept; among equals
    the highest.

    A gap of a bucket's width or more lies between two buckets, so the buckets' ends tell it exactly: at
    most ``BUCKETS`` rows a concept are ordered, however many scores there are. Where no gap is as wide
    as that, upper and lower are null.
    """
    ends = buckets.filter("bucket is not null").withColumn("next", F.lead("top").over(Window.partitionBy(by).orderBy(F.desc("bucket"))))
    wide = F.when(F.col("bottom") - F.col("next") >= 2 / BUCKETS, F.struct(F.col("bottom").alias("upper"), F.col("next").alias("lower")))
    best = F.max_by(wide, F.when(wide.isNotNull(), F.struct(F.col("bottom") - F.col("next"), F.col("bottom"))))
    return ends.groupBy(by).agg(F.sum("n").alias("n"), best.alias("gap")).select(by, "n", "gap.upper", "gap.lower")


def least_scores(positives: DataFrame, by: str = "concept_id") -> DataFrame:
    """``by``, least: the percentile of the examples' scores."""
    return positives.groupBy(by).agg(F.expr(f"percentile(score, {PERCENTILE}D)").alias("least"))


def calibrate(least: DataFrame, library: DataFrame, by: str = "concept_id", floor: float = FLOOR) -> DataFrame:
    """``by``, least, upper, lower, threshold from the examples' percentile (:func:`least_scores`) and the
    library's scores in buckets (:func:`library_buckets`, :func:`bucketed`).

    The threshold is the middle of the widest gap between library scores at or below the examples'
    percentile, kept between the floor and the fallback; without enough scores or a wide enough gap
    it is the fallback, the percentile but at least the floor.
    """
    sizes = library.filter("bucket is null").select(by, F.col("n").alias("size"))
    out = least.join(sizes, by, "left").join(widest_gaps(library, by), by, "left")
    fallback = F.greatest(F.col("least"), F.lit(floor))
    gap = F.col("upper") - F.col("lower")
    wide = (F.coalesce("size", F.lit(0)) >= LEAST_LIBRARY) & (gap >= LEAST_GAP)
    middle = F.least(F.greatest((F.col("upper") + F.col("lower")) / 2, F.lit(floor)), fallback)
    return out.select(by, "least", "upper", "lower", F.when(wide, middle).otherwise(fallback).alias("threshold"))


def library_buckets(embeddings: DataFrame, protos: DataFrame, least: DataFrame, by: str = "concept_id", exclude: DataFrame | None = None) -> DataFrame:
    """``by``, bucket, n, top, bottom: how the scores of all embeddings (not only the best per file) to each
    prototype spread, without the embeddings of excluded files (``by``, file_id). One pass with the
    prototypes broadcast in blocks; what is shuffled follows concepts and tasks, not embeddings."""
    targets = protos.join(least, by).select(F.col(by).cast("long").alias("target_id"), "prototype", F.col("least").alias("cutoff"))
    pool = embeddings.select("file_id", "vector")
    if exclude is None:
        pool = pool.withColumn("skip", F.lit(None).cast("array<long>"))
    else:
        skip = exclude.filter("file_id is not null").groupBy("file_id").agg(F.collect_set(F.col(by).cast("long")).alias("skip"))
        pool = pool.join(skip, "file_id", "left")
    return score_buckets(pool, targets, BUCKETS).withColumnRenamed("target_id", by)


def teach(embeddings: DataFrame, examples: DataFrame, negatives: DataFrame | None = None, by: str = "concept_id") -> DataFrame:
    """Concepts from example rows (``by``, file_id, vector): ``by``, prototype, n_examples, cohesion,
    threshold; negatives (``by``, vector) hold the threshold below them as :func:`negative_threshold`."""
    protos = prototypes(examples, by)
    quality = cohesion(examples, protos, by)
    least = least_scores(example_scores(examples, protos, by), by)
    calibrated = calibrate(least, library_buckets(embeddings, protos, least, by, examples), by)
    out = protos.join(quality.drop("least"), by).join(calibrated.select(by, "least", "threshold"), by)
    if negatives is not None:
        most = example_scores(negatives, protos, by).groupBy(by).agg(F.max("score").alias("most_negative"))
        out = out.join(most, by, "left").withColumn("threshold", F.when(F.col("most_negative").isNull(), F.col("threshold")).otherwise(negative_threshold(F.col("most_negative"), F.col("least"))))
    return out.select(by, "prototype", "n_examples", "cohesion", "threshold")
