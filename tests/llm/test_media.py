import hashlib
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from likeness.llm import media as M
from likeness.llm.common import table
from likeness.sources.scratch import Scratch
from tests.llm.fixtures import odd_docs


def _samples(image):
    """Width, height and samples of a grey 8-bit PNG with any filters, by the format's definition alone."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", image, at + 8 + n) == (zlib.crc32(kind + body),)
        chunks.append((kind, body))
        at += 12 + n
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    width, height, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    assert (depth, colour, packing, filtering, interlace) == (8, 0, 0, 0, 0)
    raw, above, out = zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT")), bytes(width), b""
    assert len(raw) == height * (width + 1)
    for y in range(height):
        line = bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, nearest)[raw[y * (width + 1)]]) % 256
        above = bytes(line)
        out += above
    return width, height, out


def _plain_feature(payload):
    n = len(payload) // 64
    sums = [sum(payload[i * n : (i + 1) * n]) for i in range(64)]
    bits = int("".join(str(int(64 * s > sum(sums))) for s in sums), 2)
    return f"576x{len(payload) // 576};mean={sum(sums) / len(payload):.4f};hash={bits:016x}"


def test_stored_images_are_read_by_another_decoder(spark, tmp_path):
    docs = odd_docs(spark)
    stored = Scratch(spark, "t").keep(M.store(docs, f"file://{tmp_path}"))
    got = {r.doc_id: r for r in M.media_columns(docs).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    for r in stored.collect():
        with open(tmp_path / r.shard, "rb") as f:
            f.seek(r.offset)
            image = f.read(r.length)
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert _samples(image) == (576, len(payload) // 576, payload)
        own = got[r.doc_id]
        assert (own.media_bytes, own.media_sha256, own.feature) == (len(image), hashlib.sha256(image).hexdigest(), _plain_feature(payload))
        assert own.digest == hashlib.sha256(payload).hexdigest() == own.payload_sha256 and own.length == own.media_bytes and own.offset % 512 == 0 and own.shard.endswith(".tar")


@pytest.mark.parametrize("which", ["odd", "table"])
def test_payloads_come_back(spark, sf_dir, which):
    docs = odd_docs(spark) if which == "odd" else table(spark, sf_dir, "documents")
    got = M.media_columns(docs.withColumn("digest", F.lit("clash"))).toPandas()
    assert len(got) == docs.count()
    rows = {i: t for i, t in docs.select("doc_id", "text").collect()}
    for r in got[got.doc_id.notna()].itertuples():
        payload = M.payload_of(rows[r.doc_id])
        assert r.n_bytes == len((rows[r.doc_id] or "").encode()) and r.payload_bytes == len(payload) and len(payload) % 576 == 0 < len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = M.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.width, r.height, r.depth, r.feature) == (576, len(payload) // 576, 8, M.feature_of(payload))


def test_shards_are_plain_tar_files_with_one_entry_a_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BYTES", 4096)
    stored = Scratch(spark, "t").keep(M.store(odd_docs(spark).coalesce(1), f"file://{tmp_path}"))
    names = {}
    for shard in tmp_path.glob("*.tar"):
        with tarfile.open(shard) as f:
            for e in f.getmembers():
                payload = M.decode_png(f.extractfile(e).read())
                assert e.name == hashlib.sha256(payload).hexdigest() + ".png" and e.name not in names
                names[e.name] = (shard.name, e.offset_data, e.size)
    assert len(list(tmp_path.glob("*.tar"))) > 1
    for r in stored.collect():
        assert names[f"{r.digest}.png"] == (r.shard, r.offset, r.length)
    heads = M.metadata(M.places(stored), f"file://{tmp_path}").collect()
    assert len(heads) == len(names) and {(r.width, r.depth) for r in heads} == {(576, 8)}


def test_copies_in_several_shards_resolve_to_one_place(spark, tmp_path):
    docs = spark.range(40).selectExpr("id doc_id", "'same' text").repartition(4)
    stored = Scratch(spark, "t").keep(M.store(docs, f"file://{tmp_path}"))
    assert stored.select("shard").distinct().count() == 4 and M.places(stored).count() == 1


def test_empty(spark):
    assert M.media_columns(odd_docs(spark).limit(0)).count() == 0
