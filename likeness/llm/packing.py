"""Bounded-space online best-fit packing of token sequences.

Every document is encoded, closed with an end id and, only if it is longer than a sequence, cut into
full pieces of which the first may be shorter. The pieces' figures (not their ids) are written to the
shared folder and dealt by a hash of their place there to packers, so that no repeated document or
missing id makes one of them larger. A packer keeps a fixed number of open bins in a bitset keyed by free space: the
lowest set bit at or above a piece's length is the best fit; if nothing fits, a new bin opens, and
past the bound the fullest bin closes first. A full piece is a sequence by itself.

The number of packers follows the number of pieces (``PACKED_BY_TASK``), so what the last open
bins waste is a fixed share; a packer streams and holds ``OPEN_BINS`` numbers.

Defined results: a null or empty text is its end id alone; a null id stays null; repeated rows are
packed each; further input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from likeness.llm.common import in_small_batches
from likeness.llm.pretokens import PretokenTable, as_bytes, whole_tokens
from likeness.sources.scratch import Scratch

SIZE = 2048
END_ID = 0
OPEN_BINS = 1024
PACKED_BY_TASK = 200_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encode_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))
    end = as_bytes([end_id])
    wide = 4 * size

    def run(batches):
        table = PretokenTable(vocabulary, whole.value, as_bytes)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = b"".join(table.values(text or "")) + end
                table.trim()
                begin, stop = 0, len(ids) % wide or wide
                piece = 0
                while begin < len(ids):
                    part = ids[begin:stop]
                    row = (doc_id, piece, begin // 4, len(part) // 4, zlib.crc32(part), list(memoryview(part).cast("I")) if with_ids else None)
                    for column, value in zip(rows, row):
                        column.append(value)
                    begin, stop, piece = stop, stop + wide, piece + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names[: len(rows)])

    return in_small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, _PIECE + (", ids array<long>" if with_ids else ""))


class BestFit:
    """Open bins as a bitset over free space; ``open_bins`` of them at most."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that a piece of this length goes to, and its offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.size - free


def pack(pieces: DataFrame, n_packers: int, size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (any columns, with length) plus sequence_id and offset. ``pieces`` has to be read from
    a table: a task that is run again deals its rows alike only if it reads them in the same order."""
    names = pieces.columns

    def run(batches):
        fit = BestFit(size, open_bins)
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [fit.place(length) for length in batch.column("length").to_pylist()]
            columns = batch.columns[: len(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([first + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = pieces.withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    dealt = placed.repartition(n_packers, "_at").sortWithinPartitions("_at")
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = Scratch(docs.sparkSession, "pieces").keep(encode_pieces(docs, vocabulary, size, end_id))
    n_packers = max(1, -(-pieces.count() // PACKED_BY_TASK))
    return pack(pieces, n_packers, size, open_bins)
