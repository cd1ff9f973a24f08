"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers with what follows up to the next marker. ``crossing_pieces``
proves offline that no piece of the model has a marker behind another character; merges then never
cross chunks, so each distinct marked word is segmented once per task and its ids are joined back by
position. The table is bounded (``TABLE_ENTRIES``) and a chunk longer than ``KEPT_LENGTH`` isn't kept.

No shuffle: joining the words of a corpus back through a distributed table would move every word
occurrence; a task's own table moves nothing.

Defined results: a null or empty text is begin and end id alone and decodes to ""; a null id stays
null; repeated rows give repeated rows; further input columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from likeness.llm.common import in_small_batches
from likeness.llm.pretokens import as_bytes

MARK = "▁"
TABLE_ENTRIES = 1 << 18
KEPT_LENGTH = 64


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def crossing_pieces(model: str) -> list[str]:
    """Pieces with a marker behind another character: the chunk table is exact if there is none."""
    processor = load(model)
    return [p for p in map(processor.id_to_piece, range(len(processor))) if re.search(f"[^{MARK}]{MARK}", p)]


class ChunkTable(dict):
    """Marked word -> ids, as little-endian 32-bit integers, for one task."""

    def __init__(self, processor, entries: int = TABLE_ENTRIES):
        super().__init__()
        self._processor = processor
        self._entries = entries
        self._chunks = re.compile(f"{MARK}+[^{MARK}]*").findall
        self._alone = as_bytes([processor.piece_to_id(MARK)])

    def __missing__(self, chunk: str) -> bytes:
        # The library puts a marker of its own in front of what it encodes.
        out = as_bytes(self._processor.encode(chunk[1:], num_threads=1)) if len(chunk) > 1 else self._alone
        if len(chunk) <= KEPT_LENGTH:
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, without begin and end."""
        if not text:
            return b""
        out = b"".join(map(self.__getitem__, self._chunks(MARK + text.replace(" ", MARK))))
        if len(self) > self._entries:
            self.clear()
        return out


def encode_and_decode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text."""
    if found := crossing_pieces(model):
        raise ValueError(f"pieces of this model cross white space, for one {found[0]!r}")
    extra = {"ids": pa.list_(pa.int64()), "decoded": pa.string()} if with_ids else {}

    def run(batches):
        processor = load(model)
        begin, end = as_bytes([processor.bos_id()]), as_bytes([processor.eos_id()])
        table = ChunkTable(processor)
        for batch in batches:
            n, ids_hex, text_hex, more = [], [], [], [[], []]
            for text in batch.column("text").to_pylist():
                ids = begin + table.encode(text or "") + end
                numbers = np.frombuffer(ids, "<u4").tolist()
                decoded = processor.decode(numbers)
                n.append(len(numbers))
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if extra:
                    more[0].append(numbers)
                    more[1].append(decoded)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            columns += [pa.array(c, k) for c, k in zip(more, extra.values())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *extra])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return in_small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
