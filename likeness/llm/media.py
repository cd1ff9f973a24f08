"""Media columns: content-addressed payloads in tar shards, with metadata from header-only reads.

Writing: each text's payload is stored once per task as an 8-bit grey PNG under its SHA-256 in a tar
shard of bounded size in a folder that all executors share; rows carry digest, shard, offset and
length. Copies in other tasks' shards resolve to one place per digest (the smallest shard and
offset), so equal payloads have equal values. Reading: rows are dealt by shard and sorted by offset;
a read of the header's bytes alone fills width, height and depth, and a range read of the payload
gives the rest. Neither texts nor payloads are shuffled.

A task that is run again writes new shards under new names and its rows name those; shards of lost
tasks are left behind unreferenced.

Defined results: a null or empty text is a payload of padding alone; a null id stays null; repeated
rows give repeated results; further input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from likeness.llm.common import in_small_batches
from likeness.sources.scratch import Scratch

WIDTH = 576
PAD = 255
SHARD_BYTES = 64 << 20
LEVEL = 1
#: Digests that a task remembers; copies beyond are stored again and resolve to the same place.
REMEMBERED = 1 << 20

# Fixed values of the PNG format: its signature; where the header chunk's data ends.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def payload_of(text: str | None) -> bytes:
    """UTF-8 padded with 255 to a positive multiple of the width."""
    data = (text or "").encode("utf-8")
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, bytes([PAD]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """Lossless 8-bit grey image, one byte a sample, ``WIDTH`` samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first ``HEADER_BYTES`` of an image."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples of an image that :func:`encode_png` made."""
    width, height, _ = read_header(data)
    at, parts = HEADER_BYTES, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only rows without a filter are read")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, mean sample and a 64-bit hash: which of 64 equal parts are lighter than the whole."""
    samples = np.frombuffer(payload, np.uint8)
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(parts * 64 > parts.sum()).tobytes().hex()
    return f"{WIDTH}x{len(samples) // WIDTH};mean={parts.sum() / len(samples):.4f};hash={bits}"


class ShardWriter:
    """Appends entries to tar shards of at most about ``SHARD_BYTES``."""

    def __init__(self, root: str):
        self._files, self._root = fs.FileSystem.from_uri(root)
        self._files.create_dir(self._root, recursive=True)
        self._out = None

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of the entry's data."""
        if self._out is None:
            self._name, self._at = f"{uuid.uuid4().hex}.tar", 0
            self._out = self._files.open_output_stream(f"{self._root}/{self._name}")
        entry = tarfile.TarInfo(name)
        entry.size = len(data)
        head = entry.tobuf(tarfile.USTAR_FORMAT)
        place = self._name, self._at + len(head), len(data)
        self._out.write(head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE))
        self._at = place[1] + len(data) + -len(data) % tarfile.BLOCKSIZE
        if self._at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self._out is not None:
            self._out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            self._out.close()
            self._out = None


_PLACE = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, root: str) -> DataFrame:
    """Write payloads to shards under ``root``: doc_id, n_bytes, digest, shard, offset, length.

    Write the result to a table before reading it twice: each run writes new shards.
    """

    def run(batches):
        writer, places = ShardWriter(root), {}
        try:
            for batch in batches:
                rows = []
                for text in batch.column("text").to_pylist():
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in places:
                        if len(places) >= REMEMBERED:
                            places.clear()
                        places[digest] = writer.add(f"{digest}.png", encode_png(payload))
                    rows.append((len((text or "").encode("utf-8")), digest, *places[digest]))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.split()[0] for f in _PLACE.split(", ")])
        finally:
            writer.close()

    return in_small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, _PLACE)


def places(stored: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place per digest."""
    one = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return one.select("digest", "place.*")


def _read(located: DataFrame, root: str, of_entry, schema: str) -> DataFrame:
    """digest and what ``of_entry(read, shard, offset, length)`` gives, shard after shard, in order."""

    def run(batches):
        files, base = fs.FileSystem.from_uri(root)
        name, source = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != name:
                    if source:
                        source.close()
                    name, source = shard, files.open_input_file(f"{base}/{shard}")
                rows.append((digest, *of_entry(source.read_at, shard, offset, length)))
            out = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64()}[f.split()[1]]) for f in schema.split(", ")])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(out), out)], schema=out)
        if source:
            source.close()

    ordered = located.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(run, schema)


def metadata(located: DataFrame, root: str) -> DataFrame:
    """digest, width, height, depth from header-only range reads."""
    return _read(located, root, lambda read, shard, offset, length: read_header(read(HEADER_BYTES, offset)), "digest string, width long, height long, depth long")


def features(located: DataFrame, root: str) -> DataFrame:
    """Per digest: header metadata, then figures of the payload and of the stored form, read back, and its place."""

    def entry(read, shard, offset, length):
        width, height, depth = read_header(read(HEADER_BYTES, offset))
        media = read(length, offset)
        payload = decode_png(media)
        return width, height, depth, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload), shard, offset, length

    return _read(located, root, entry, "digest string, width long, height long, depth long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, length long")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text and return its media columns, read back from the shards, with digest, shard,
    offset and length of the stored form."""
    scratch = Scratch(docs.sparkSession, "media")
    root = f"{scratch.root}/shards"
    root = root if "://" in root else "file://" + root.removeprefix("file:")
    stored = scratch.keep(store(docs, root))
    found = scratch.keep(features(places(stored), root))
    wanted = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "digest", "shard", "offset", "length"]
    return stored.select("doc_id", "n_bytes", "digest").join(found, "digest").select("doc_id", *wanted)
