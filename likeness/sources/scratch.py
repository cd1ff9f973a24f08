"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder if driver and executors are one
    machine (tests), else an error: executors don't see each other's disks."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="likeness-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/likeness/{purpose}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._likeness_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that :meth:`keep` wrote and that nothing reads any more."""
        path = getattr(df, "_likeness_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Delete all tables; nothing may read them any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def numbered(scratch: Scratch, rows: DataFrame, order: list[str], first: int = 1, name: str = "number") -> DataFrame:
    """The rows plus their place in the given order, from ``first`` without gaps: sorted by ranges, each of which
    one task numbers, after those before it."""
    ranged = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dict(ranged.groupBy("_part").count().collect())  # a number for each range
    begins, pairs = first, []
    for part in sorted(sizes):
        pairs += [F.lit(part), F.lit(begins).cast("long")]
        begins += sizes[part]
    number = F.element_at(F.create_map(*pairs), F.col("_part")) + F.col("_at") if pairs else F.lit(0).cast("long")
    return ranged.withColumn(name, number).drop("_part", "_at")
