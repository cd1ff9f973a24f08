"""Vector columns (arrays of numbers), computed in double precision inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def centroid(df: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """``by`` and prototype: the normalized mean of the normalized vectors of each group.

    Means combine before the shuffle, so a group of any size costs one row per task and position.
    """
    positions = df.select(by, F.posexplode(normalize(F.col(vector))).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return positions.groupBy(by).agg(ordered.alias("mean")).select(by, normalize(F.col("mean")).alias("prototype"))


def from_blob(blobs: Column) -> Column:
    """Raw little-endian float32 bytes as an array; null for null."""

    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(blobs)


def to_blob(vectors: Column) -> Column:
    """An array as raw little-endian float32 bytes; null for null."""

    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(run, T.BinaryType())(vectors)
