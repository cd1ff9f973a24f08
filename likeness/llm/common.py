"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to Python, about. A batch ends with the row that passes it.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by a reader that also opens remote stores."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, or one that begins with further underscores where a column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; from here on its session sends Python batches of ``BATCH_BYTES``, so that a task's
    memory follows bytes and not 10,000 rows of any length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


class TaskTable(dict):
    """A table that one task fills as it goes; :meth:`trim` empties it beyond its bounds, so only the
    entries of one text can come on top of them."""

    def __init__(self, entries: int = 1 << 18, characters: int = 1 << 23):
        super().__init__()
        self._bounds, self._characters = (entries, characters), 0

    def put(self, key, value):
        self[key] = value
        self._characters += len(key)
        return value

    def trim(self) -> bool:
        """Whether the table has been emptied."""
        over = len(self) > self._bounds[0] or self._characters > self._bounds[1]
        if over:
            self.clear()
            self._characters = 0
        return over
