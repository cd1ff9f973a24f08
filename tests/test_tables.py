import os

import pytest
from pyspark.sql import Row, functions as F

from likeness.plans import renames
from likeness.sources import discovery, schema
from likeness.sources.catalog import Catalog
from likeness.sources.plugins import HashEmbedder, embed_with
from likeness.streaming import ingest

FOUND = "path string, kind string, size long, mtime_ns long"


def _files(spark, *rows):
    return spark.createDataFrame([(p, "video" if p.endswith("mov") else "image", s, t) for p, s, t in rows], FOUND)


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/library")


def test_upserts_keep_ids_and_corrections_and_clear_what_was_derived(spark, catalog):
    catalog.upsert_files(_files(spark, ("/b.jpg", 1, 1), ("/a.jpg", 2, 2)))
    ids = {r.path: r.id for r in catalog.read("files").collect()}
    assert ids == {"/a.jpg": 1, "/b.jpg": 2}
    catalog.add_embeddings(spark.createDataFrame([(1, [[1.0], [2.0]], [0.0, 1.0], ["", ""]), (2, [[3.0]], [0.0], [None])], "file_id long, vectors array<array<float>>, frame_times array<double>, boxes array<string>"))
    catalog.replace_matches([5], spark.createDataFrame([(1, 5, 0.5), (2, 5, 0.6)], schema.TABLES["file_concepts"]))
    catalog.set_overrides(spark.createDataFrame([(1, 5, "on"), (2, 5, "off")], schema.TABLES["concept_overrides"]))
    catalog.upsert_files(_files(spark, ("/a.jpg", 9, 9), ("/c.jpg", 3, 3)))
    assert {r.path: (r.id, r.size) for r in catalog.read("files").collect()} == {"/a.jpg": (1, 9), "/b.jpg": (2, 1), "/c.jpg": (3, 3)}
    assert [(r.id, r.file_id) for r in catalog.read("embeddings").collect()] == [(3, 2)]
    assert [r.file_id for r in catalog.read("file_concepts").collect()] == [2]
    assert catalog.read("concept_overrides").count() == 2
    catalog.set_overrides(spark.createDataFrame([(1, 5, None)], schema.TABLES["concept_overrides"]))
    assert [r.file_id for r in catalog.read("concept_overrides").collect()] == [2]
    assert catalog.forget(catalog.read("files").filter("path = '/b.jpg'")) == 1
    assert catalog.read("embeddings").count() == catalog.read("concept_overrides").count() == 0 and catalog.read("files").count() == 2
    catalog.rename_files(spark.createDataFrame([("/a.jpg", "/z.jpg")], "source string, target string"))
    assert {r.path for r in catalog.read("files").collect()} == {"/z.jpg", "/c.jpg"}
    with pytest.raises(ValueError):
        catalog.add_embeddings(spark.createDataFrame([(1, [[1.0]], [], [])], "file_id long, vectors array<array<float>>, frame_times array<double>, boxes array<string>"))


def _matches(spark, *rows):
    return spark.createDataFrame(list(rows), schema.TABLES["file_concepts"])


def test_changes_are_seen_whole_or_not_at_all(spark, catalog):
    catalog.upsert_files(_files(spark, ("/a.jpg", 1, 1)))
    with pytest.raises(RuntimeError, match="half way"), catalog.change():
        catalog.upsert_files(_files(spark, ("/b.jpg", 1, 1)))
        assert catalog.read("files").count() == 2 and Catalog(spark, catalog.root).read("files").count() == 1
        raise RuntimeError("half way")
    assert catalog.read("files").count() == 1
    with catalog.change(), pytest.raises(ValueError):
        catalog.set_overrides(spark.createDataFrame([(1, 1, "maybe")], schema.TABLES["concept_overrides"]))
    assert catalog.read("concept_overrides").count() == 0
    before = catalog.read("files")
    catalog.upsert_files(_files(spark, ("/a.jpg", 5, 5), ("/c.jpg", 1, 1)))
    assert before.count() == 1 and before.first()["size"] == 1  # what is being read stays
    other, number = Catalog(spark, catalog.root), catalog._manifests()[-1]
    with pytest.raises(RuntimeError, match="another writer"), catalog.change():
        catalog.set_setting("k", "v")
        other.set_setting("k", "w")
    assert catalog.setting("k") == "w" and catalog._manifests()[-1] == number + 1


def test_appends_and_replaced_matches_leave_other_parts_alone(spark, catalog):
    for n in range(3):
        catalog.add_embeddings(spark.createDataFrame([(n, [[1.0]], [0.0], [None])], "file_id long, vectors array<array<float>>, frame_times array<double>, boxes array<string>"))
    parts = catalog._state()["embeddings"]
    assert len(parts) == 3 and sorted(r.id for r in catalog.read("embeddings").collect()) == [1, 2, 3]
    catalog.replace_matches([1, 2], _matches(spark, (1, 1, 0.5), (1, 2, 0.6), (9, 3, 1.0)))
    held = catalog._state()["file_concepts"]
    catalog.replace_matches([2, 4], _matches(spark, (5, 2, 0.7), (5, 2, 0.8)))
    now = catalog._state()["file_concepts"]
    assert now["1"] == held["1"] and now["2"] != held["2"] and set(now) == {"1", "2"}
    assert {(r.file_id, r.concept_id, r.score) for r in catalog.read("file_concepts").collect()} == {(1, 1, 0.5), (5, 2, 0.8)}
    catalog.forget(spark.createDataFrame([(77,)], "id long"))
    assert catalog._state()["embeddings"] == parts
    assert catalog.vacuum(1) == 0
    catalog.replace_matches([1, 2], _matches(spark, (1, 1, 0.5)))
    assert catalog.vacuum(1) == 2 and catalog.read("file_concepts").count() == 1 and len(catalog._manifests()) == 1


def _written(spark, catalog, before, table):
    """Rows of a table's parts and keys that ``before`` (a manifest) doesn't name."""
    named = {p[0] for parts in before.values() for p in (parts.values() if isinstance(parts, dict) else parts)}
    new = [p for key in (table, f"{table}/hidden") for p in catalog._state().get(key, []) if p[0] not in named]
    return sum(spark.read.parquet(f"{catalog.root}/{p[0]}").count() for p in new)


def test_small_changes_write_little(spark, catalog):
    pair = (F.col("id").alias("file_id"), (F.col("id") % 7).alias("concept_id"))
    log = spark.range(20_000).select(*pair, F.lit("on").alias("state"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id").alias("event_id"))
    catalog.log_overrides(log)
    before = catalog._state()
    late = spark.range(5).select(*pair, F.when(F.col("id") < 2, "off").alias("state"), F.lit("2024-01-02").cast("timestamp").alias("ts"), F.col("id").alias("event_id"))
    catalog.log_overrides(late)
    assert _written(spark, catalog, before, "concept_overrides") == 5 + 2 and _written(spark, catalog, before, "override_times") == 5 + 5
    assert {r.state: r["count"] for r in catalog.read("concept_overrides").groupBy("state").count().collect()} == {"on": 19_995, "off": 2}
    catalog.upsert_files(spark.range(1000).select(F.concat(F.lit("/"), "id").alias("path"), F.lit("image").alias("kind"), F.lit(1).alias("size"), F.lit(1).alias("mtime_ns")))
    before = catalog._state()
    catalog.upsert_files(_files(spark, ("/7", 2, 2)))
    catalog.rename_files(spark.createDataFrame([("/8", "/9")], "source string, target string"))
    assert _written(spark, catalog, before, "files") == 2 + 3 and catalog.read("files").count() == 999
    assert catalog.forget(catalog.read("files").filter("path = '/9'")) == 1 and catalog.read("files").count() == 998


def test_many_small_changes_are_merged(spark, catalog, monkeypatch):
    from likeness.sources import catalog as module

    monkeypatch.setattr(module, "MOST_PARTS", 4)
    want, kind = {}, schema.TABLES["concept_overrides"]
    for n in range(11):
        rows = [((n * 5 + i * 3) % 11 or None, i % 2, ("on", "off", None)[(n + i) % 3]) for i in range(4)]
        rows = list({r[:2]: r for r in rows}.values())
        catalog.set_overrides(spark.createDataFrame(rows, kind))
        want = {k: v for k, v in (want | {r[:2]: r[2] for r in rows}).items() if v}
        if n == 9:
            catalog.delete("concept_overrides", spark.createDataFrame([(1,)], "concept_id long"), "concept_id")
            want = {k: v for k, v in want.items() if k[1] != 1}
        assert sorted(map(str, catalog.read("concept_overrides").collect())) == sorted(map(str, [Row(file_id=f, concept_id=c, state=s) for (f, c), s in want.items()]))
        assert len(catalog._state()["concept_overrides"]) <= 4 and all(len(p) <= 4 for p in catalog._hidden_by_keys("concept_overrides").values())
    monkeypatch.setattr(module, "FEW_KEYS", 0)
    catalog.delete("concept_overrides", spark.range(5000).select(F.col("id").alias("file_id")), "file_id")
    assert catalog.read("concept_overrides").count() == sum(f is None for f, _ in want) and not catalog._hidden("concept_overrides")


def test_tables_of_older_manifests_are_read(spark, catalog):
    catalog.set_setting("k", "v")
    with catalog.change():
        catalog._pending["meta"] = [p[:2] for p in catalog._pending["meta"]]
    assert catalog.setting("k") == "v"
    catalog.set_setting("k", "w")
    assert catalog.setting("k") == "w" and catalog.read("meta").count() == 1


def test_concepts(spark, catalog):
    kind = "name string, prototype array<float>, threshold double, n_examples int"
    catalog.save_concepts(spark.createDataFrame([("b", [1.0], 0.7, 3), ("a", [2.0], 0.8, 4)], kind))
    catalog.update_concept("a", destination="/out", verify_phrase="")
    catalog.save_concepts(spark.createDataFrame([("a", [3.0], 0.9, 5), ("c", [4.0], 0.6, 1)], kind))
    got = {r.name: (r.id, list(r.prototype), r.threshold, r.destination) for r in catalog.read("concepts").collect()}
    assert got == {"a": (1, [3.0], 0.9, "/out"), "b": (2, [1.0], 0.7, None), "c": (3, [4.0], 0.6, None)}
    catalog.replace_matches([1, 2], spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], schema.TABLES["file_concepts"]))
    catalog.replace_matches([1], spark.createDataFrame([], schema.TABLES["file_concepts"]))
    assert [r.concept_id for r in catalog.read("file_concepts").collect()] == [2]
    catalog.add_rejections(spark.createDataFrame([(1, "/x"), (1, "/x"), (2, "/y")], schema.TABLES["concept_rejections"]))
    catalog.clear_rejections(spark.createDataFrame([(2, "/y")], schema.TABLES["concept_rejections"]))
    assert catalog.read("concept_rejections").count() == 1
    assert catalog.delete_concept("a") and not catalog.delete_concept("a") and catalog.read("concept_rejections").count() == 0
    catalog.set_setting("k", "v")
    catalog.set_setting("k", "w")
    assert catalog.setting("k") == "w" and catalog.setting("none", "d") == "d"


def test_people(spark, catalog):
    catalog.append("people", spark.createDataFrame([(1, "ann", 0), (2, "bo", 0)], "id long, name string, n_examples int"))
    catalog.append("file_faces", spark.createDataFrame([(1, 1, 1, 0.5), (2, 1, 2, 0.6)], "id long, file_id long, person_id long, score double"))
    catalog.replace_references(1, spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vector array<float>"))
    assert {r.name: r.n_examples for r in catalog.read("people").collect()} == {"ann": 2, "bo": 0}
    assert catalog.delete_person("ann") and catalog.read("person_faces").count() == 0
    assert {r.id: (r.person_id, r.score) for r in catalog.read("file_faces").collect()} == {1: (None, 0.5), 2: (2, 0.6)}


def test_older_tables_get_new_columns(spark):
    old = spark.createDataFrame([(1, "/a")], "id long, path string")
    got = schema.migrate(old, "files").first()
    assert got.samples == 1 and got.phash is None and got.path == "/a"


def test_discovery(spark, tmp_path):
    for name in ("a.jpg", "b.MOV", "c.txt", ".hidden.jpg", "sub/d.png", "sub/.x/e.jpg", "My.photoslibrary/f.jpg"):
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    root = f"{tmp_path}/lib"
    files = discovery.media(discovery.listing(spark, root), root)
    assert {(os.path.relpath(r.path, root), r.kind, r.size) for r in files.collect()} == {("a.jpg", "image", 1), ("b.MOV", "video", 1), ("sub/d.png", "image", 1)}
    assert [os.path.basename(r.path) for r in discovery.example_images(discovery.listing(spark, root), root).collect()] == ["a.jpg", "d.png"]
    with pytest.raises(ValueError):
        discovery.example_images(discovery.listing(spark, root).filter("path like '%txt'"), root)


def _embed(embedder=None):
    return embed_with(embedder or HashEmbedder(4))


def test_index_passes_skip_what_is_unchanged(spark, catalog):
    class Picky(HashEmbedder):
        def embed_paths(self, paths):
            return HashEmbedder.embed_paths(self, [p for p in paths if "bad" not in p])

    first = _files(spark, ("/a.jpg", 1, 1), ("/bad.jpg", 1, 1), ("/c.mov", 1, 1))
    embed = _embed(Picky(4))
    assert ingest.index_batch(catalog, first, embed) == {"scanned": 3, "indexed": 2, "failed": 1, "frames": 2, "regions": 0, "faces": 0, "named": 0, "unchanged": 0}
    second = _files(spark, ("/a.jpg", 1, 1), ("/c.mov", 2, 1), ("/d.jpg", 1, 1))
    assert ingest.index_batch(catalog, second, embed) == {"scanned": 3, "indexed": 2, "failed": 0, "frames": 2, "regions": 0, "faces": 0, "named": 0, "unchanged": 1}
    assert catalog.read("embeddings").count() == 3
    assert discovery.changed(second, catalog.read("files"), catalog.read("embeddings"), samples=9).count() == 1
    assert discovery.changed(second, catalog.read("files"), catalog.read("embeddings"), force=True).count() == 3


def test_streams(spark, catalog, tmp_path):
    source = tmp_path / "in"
    _files(spark, ("/a.jpg", 1, 1), ("/b.jpg", 1, 1)).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema(FOUND).parquet(str(source))
    for n in (2, 3):
        q = ingest.index_stream(stream(), catalog, _embed(), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        assert catalog.read("files").count() == n
        _files(spark, ("/c.jpg", 1, 1)).write.mode("append").parquet(str(source))


def test_stream_of_corrections(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id file_id", "event_id % 10 concept_id", "case event_type when 'click' then 'on' when 'error' then 'off' end state", "cast(ts as timestamp) ts", "event_id")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    catalog = Catalog(spark, f"file://{tmp_path}/library")
    for _ in range(2):  # a second query over the same files applies each batch again
        q = ingest.correct_stream(stream, catalog, f"{tmp_path}/cp{_}")
        q.processAllAvailable()
        q.stop()
    from likeness.operators.tags import latest_overrides

    want = latest_overrides(events, ["ts", "event_id"]).filter("state is not null")
    assert sorted(map(str, catalog.read("concept_overrides").collect())) == sorted(map(str, want.collect()))
    late = events.limit(1).selectExpr("file_id", "concept_id", "'off' state", "timestamp '1999-01-01' ts", "event_id")
    catalog.log_overrides(late)
    assert catalog.read("concept_overrides").count() == want.count()
    q = ingest.activity(stream, "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()


def test_moves(spark):
    rows = [("/a/1.jpg", "/a/1.jpg", ["x", "y"]), ("/a/1.mov", "/a/1.jpg", ["x", "y"]), ("/a/2.jpg", "/a/2.jpg", []), ("/o/y/3.jpg", "/o/y/3.jpg", ["y"]), ("/a/4.jpg", "/a/4.jpg", ["z"])]
    tagged = spark.createDataFrame(rows, "path string, primary string, tags array<string>")
    folders = spark.createDataFrame([("x", "/o/x"), ("y", "/o/y"), ("w", "")], "tag string, folder string")
    scores = spark.createDataFrame([("/a/1.jpg", "y", 0.9), ("/a/1.jpg", "x", 0.3)], "path string, tag string, score double")
    inverse = spark.createDataFrame([("z", "/o/nz"), ("x", "/o/nx")], "tag string, folder string")
    got = {r.source: (r.target, r.claims, r.matched) for r in renames.plan_moves(tagged, folders, scores, inverse).collect()}
    assert got == {"/a/1.jpg": ("/o/y/1.jpg", 2, True), "/a/1.mov": ("/o/y/1.mov", 2, True), "/a/2.jpg": ("/o/nx/2.jpg", 2, False), "/a/4.jpg": ("/o/nx/4.jpg", 1, False)}
    plain = {r.source: r.target for r in renames.plan_moves(tagged, folders).collect()}
    assert plain["/a/1.jpg"] == "/o/x/1.jpg" and "/a/2.jpg" not in plain


def test_collisions(spark):
    plans = spark.createDataFrame([("/trip/1.jpg", "/o/1.jpg", b"a"), ("/photos/1.jpg", "/o/1.jpg", b"b"), ("/x/2.jpg", "/o/2.jpg", b"c"), ("/dcim/3.jpg", "/o/3.jpg", b"d")], "source string, target string, content_hash binary")
    held = spark.createDataFrame([("/o/2.jpg", b"c"), ("/o/3.jpg", b"z"), ("/o/1.jpg", b"q")], "path string, content_hash binary")
    rows = [(f"/{folder}/x.jpg", "/o/x.jpg", None) for folder in ("dcim", "temp", "trip", "photos", "trip2")] + [("/a/trip/x.jpg", "/o/x.jpg", None), ("/q/x (trip2).jpg", "/o/x (trip2).jpg", None), ("/q/x-3.jpg", "/o/x-3.jpg", None)]
    more = spark.createDataFrame(rows, plans.schema)
    names = [(r.source, r.target) for r in renames.resolve_collisions(more, spark.createDataFrame([("/o/x-2.jpg", None), ("/o/x-5.jpg", None)], held.schema)).collect()]
    assert len({t for _, t in names}) == len(names) == 8 and dict(names) == {
        "/a/trip/x.jpg": "/o/x.jpg", "/dcim/x.jpg": "/o/x-4.jpg", "/photos/x.jpg": "/o/x-6.jpg", "/temp/x.jpg": "/o/x-7.jpg", "/trip/x.jpg": "/o/x (trip).jpg", "/trip2/x.jpg": "/o/x-8.jpg",
        "/q/x (trip2).jpg": "/o/x (trip2).jpg", "/q/x-3.jpg": "/o/x-3.jpg",
    }
    got = {r.source: (r.target, r.filed) for r in renames.resolve_collisions(plans, held).collect()}
    assert got == {"/trip/1.jpg": ("/o/1 (trip).jpg", False), "/photos/1.jpg": ("/o/1-2.jpg", False), "/x/2.jpg": ("/o/2.jpg", True), "/dcim/3.jpg": ("/o/3-2.jpg", False)}
    assert {r.source for r in renames.blocked(spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")).collect()} == {"a"}


def test_rounds_end_at_files_that_stay(spark):
    pairs = [("kept", "kept"), ("a", "kept"), ("b", "a"), ("c", "b"), ("unnamed", None), ("d", "unnamed"), ("e", "f"), ("f", "free"), ("g", "h"), ("h", "g"), ("i", "g")]
    got = {r.source: (r.round, r.in_cycle) for r in renames.rounds(spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert got == {**dict.fromkeys("abcdi", (None, False)), **dict.fromkeys("gh", (None, True)), "e": (2, False), "f": (1, False)}


def test_renames_on_disk_and_back(tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    p = lambda n: str(tmp_path / n)
    dry = renames.apply_renames([(p("a"), p("b")), (p("b"), p("d"))], str(tmp_path), dry_run=True)
    assert (tmp_path / "a").exists() and len(dry["renamed"]) >= 1
    got = renames.apply_renames([(p("a"), p("b")), (p("b"), p("d")), (p("gone"), p("e"))], str(tmp_path))
    assert (tmp_path / "b").read_text() == "a" and (tmp_path / "d").read_text() == "b" and len(got["errors"]) == 1
    cycle = renames.apply_renames([(p("b"), p("c")), (p("c"), p("b"))], str(tmp_path))
    assert not cycle["renamed"] and len(cycle["errors"]) == 2
    renames.undo_last(str(tmp_path))
    assert [(tmp_path / n).read_text() for n in "ab"] == ["a", "b"] and renames.undo_last(str(tmp_path)) == []
    (tmp_path / renames.JOURNAL).write_text("{broken")
    assert renames.read_journal(str(tmp_path)) == []


def test_placing(tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "1.jpg").write_text(d)
    got = renames.place([str(tmp_path / "x/1.jpg"), str(tmp_path / "y/1.jpg"), "/none.jpg"], str(tmp_path / "out"), "copy")
    assert sorted(os.listdir(tmp_path / "out")) == ["1-2.jpg", "1.jpg"] and got["skipped"] == ["/none.jpg"]
    assert not renames.place([str(tmp_path / "x/1.jpg")], str(tmp_path / "dry"), dry_run=True)["skipped"] and not (tmp_path / "dry").exists()
    with pytest.raises(ValueError):
        renames.place([], str(tmp_path), "burn")
