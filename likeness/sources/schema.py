"""Fixed schemas of the library's tables, and additive migration on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TABLES = {
    "meta": "key string, value string",
    "files": "id long, path string, kind string, size long, mtime_ns long, samples int, content_hash binary, phash binary, pixels long, indexed_at timestamp",
    "embeddings": "id long, file_id long, frame_time double, region string, box string, vector array<float>",
    "roots": "path string, added_at timestamp",
    "concepts": "id long, name string, threshold double, n_examples int, prototype array<float>, destination string, verify_phrase string, inverse_destination string, created_at timestamp",
    "file_concepts": "file_id long, concept_id long, score double",
    "concept_overrides": "file_id long, concept_id long, state string",
    "override_times": "file_id long, concept_id long, state string, ts timestamp, event_id long",
    "concept_rejections": "concept_id long, path string",
    "people": "id long, name string, n_examples int, created_at timestamp",
    "person_faces": "id long, person_id long, vector array<float>, source string",
    "file_faces": "id long, file_id long, person_id long, score double, frame_time double, bbox string, vector array<float>",
    "rename_batches": "batch_id long, seq int, source string, target string, done boolean",
}
DEFAULTS = {("files", "samples"): 1, ("embeddings", "frame_time"): 0.0, ("embeddings", "region"): "frame"}


def migrate(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order; those that an older version lacks get their default or null."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(TABLES[table]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS.get((table, f.name)))).cast(f.dataType).alias(f.name) for f in fields])
