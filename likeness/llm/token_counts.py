"""Token counts of whole texts by the whole-token shortcut (see ``pretokens``).

No shuffle: one pass over the files. A task holds one Arrow batch of texts and a bounded table.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows
give repeated rows; further input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from likeness.llm.common import in_small_batches
from likeness.llm.pretokens import PretokenTable, whole_tokens

LIMIT = 1024


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row of ``docs``."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))

    def run(batches):
        table = PretokenTable(vocabulary, whole.value, len)
        for batch in batches:
            texts = batch.column("text")
            counts = []
            for text in texts.to_pylist():
                counts.append(sum(table.values(text)) if text else 0)
                table.trim()
            n_tokens = pa.array(counts, pa.int64())
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n_tokens, pc.greater(n_tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return in_small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
