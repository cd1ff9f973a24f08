"""The library's tables, built from the driver's parquet files (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from likeness.functions.vectors import centroid


class Library:
    """Logical tables over a folder of parquet files: a file has four vectors, a concept is a label."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 4").alias("file_id"), (F.col("vec_id") % 4).cast("double").alias("frame_time"), "label", F.col("embedding").alias("vector"))

    @property
    def vectors(self) -> DataFrame:
        """One vector a file."""
        return self.embeddings.withColumn("file_id", F.col("id"))

    @property
    def files(self) -> DataFrame:
        """One file a vector."""
        v = self.table("embeddings")
        path = F.format_string("/lib/L%d/IMG_%04d.%s", F.col("label"), F.col("vec_id"), F.when(F.col("vec_id") % 10 == 0, "mov").otherwise("jpg"))
        size = (F.col("vec_id") * 7919 % 100_003).alias("size")
        return v.select(F.col("vec_id").alias("id"), path.alias("path"), F.when(F.col("vec_id") % 10 == 0, "video").otherwise("image").alias("kind"), size, (F.col("vec_id") * 1000).alias("mtime_ns"), F.lit(1).alias("samples"), "label", F.col("embedding").alias("vector"))

    @property
    def examples(self) -> DataFrame:
        return self.embeddings.filter("id < 100").select(F.col("label").cast("long").alias("concept_id"), "file_id", "vector")

    def concepts(self, threshold: float) -> DataFrame:
        protos = centroid(self.examples, "concept_id")
        return protos.select(F.col("concept_id").alias("id"), F.format_string("tag%d", F.col("concept_id")).alias("name"), F.lit(threshold).alias("threshold"), "prototype")

    @property
    def override_log(self) -> DataFrame:
        state = F.when(F.col("event_type") == "click", "on").when(F.col("event_type") == "error", "off")
        some = self.table("events").filter(F.col("event_type").isin("click", "error", "view"))
        return some.select(F.col("user_id").alias("file_id"), (F.col("event_id") % 10).alias("concept_id"), state.alias("state"), "ts", "event_id")

    @property
    def references(self) -> DataFrame:
        return self.embeddings.filter("id < 50").select("id", F.col("label").cast("long").alias("person_id"), "vector", F.lit("fixture").alias("source"))

    @property
    def faces(self) -> DataFrame:
        return self.embeddings.filter("id >= 50").select("id", "file_id", F.lit(None).cast("long").alias("person_id"), F.lit(None).cast("double").alias("score"), "frame_time", "vector")

    @property
    def people(self) -> DataFrame:
        return self.references.select(F.col("person_id").alias("id"), F.format_string("person%d", F.col("person_id")).alias("name")).distinct()
