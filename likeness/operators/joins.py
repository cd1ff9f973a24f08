"""Joins whose keys may be very frequent on one side."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a key that a shuffle join takes into one task, and keys above that at most.
HOT_ROWS = 10_000
HOT_KEYS = 100_000


def local_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table of the driver's values. It goes over as Arrow: lists of rows would start a second set of
    Python processes on every executor, which stay."""
    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(kinds)), kinds)


def join_unique(rows: DataFrame, unique: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` (a written table, any number of rows a key) with ``unique`` (one row a key).

    Keys of more than ``HOT_ROWS`` rows, or a share of 1 / ``HOT_KEYS`` of all, are broadcast with their row
    of ``unique``: that many keys have so many rows at most. All others are joined by a shuffle.
    ``counts``: ``key`` and its rows as _n, where they are known.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts
    bound = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = [r[0] for r in counts.filter(F.col("_n") > bound).select(key).collect()]
    if not hot:
        return rows.join(unique, key)
    kind = rows.schema[key].dataType.simpleString()
    keys = F.broadcast(local_table(rows.sparkSession, {key: hot}, f"`{key}` {kind}"))
    cold = rows.join(keys, key, "left_anti").join(unique, key)
    return rows.join(F.broadcast(unique.join(keys, key, "left_semi")), key).select(cold.columns).unionByName(cold)
