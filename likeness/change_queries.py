"""Registered queries over tables before and after a change, and over what indexing and filing need."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from likeness.functions import hashing, naming, paths, vectors
from likeness.operators import companions, duplicates, faces, learn, search, tags
from likeness.plans import renames
from likeness.queries import _EMB, _EFFECTIVE, _FACES, _FILES, _HASHED, _LOG, _MATCHES, _NEGATIVE, _PAIRS, BITS_APART, FACE, MATCH, _hashed, _overrides, _pairs, query, rounded
from likeness.operators import score
from likeness.sources import discovery
from likeness.sources.catalog import Catalog
from likeness.sources.scratch import shared_dir
from likeness.streaming.ingest import correct_stream, index_batch


def _catalog(lib) -> Catalog:
    """An empty catalogue in the shared folder."""
    return Catalog(lib.spark, f"{shared_dir(lib.spark)}/likeness/catalog-{uuid.uuid4().hex}")


# Files.

_UPSERTS = _FILES + """,
first AS (SELECT path, row_number() OVER (ORDER BY path) AS id, files.id AS n, size FROM files WHERE files.id % 3 <> 0),
more AS (SELECT path, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY path) AS id, files.id AS n, size + 1 AS size FROM files WHERE files.id % 2 = 0 AND files.id % 3 = 0),
after AS (SELECT path, id, n, CASE WHEN n % 2 = 0 THEN size + 1 ELSE size END AS size FROM first UNION ALL FROM more)"""


def _upserted(lib) -> Catalog:
    """Two thirds of the files with a vector, a match and a correction each; then half of all, larger by a byte."""
    catalog, files = _catalog(lib), lib.files.select("path", "kind", "size", "mtime_ns", "samples", F.col("id").alias("n"))
    catalog.upsert_files(files.filter("n % 3 <> 0").drop("n"))
    with catalog.change():
        ids = catalog.read("files").select(F.col("id").alias("file_id"))
        one = [F.array(F.array(F.lit(1.0))).alias("vectors"), F.array(F.lit(0.0)).alias("frame_times"), F.array(F.lit("")).alias("boxes")]
        catalog.add_embeddings(ids.select("file_id", *one))
        catalog.replace_matches([7], ids.select("file_id", F.lit(7).cast("long").alias("concept_id"), F.lit(0.5).alias("score")))
        catalog.set_overrides(ids.select("file_id", F.lit(7).cast("long").alias("concept_id"), F.lit("on").alias("state")))
    catalog.upsert_files(files.filter("n % 2 = 0").withColumn("size", F.col("size") + 1).drop("n"))
    return catalog


@query(f"WITH {_UPSERTS} SELECT path, id, size, (n % 3 <> 0 AND n % 2 <> 0)::BIGINT AS vectors, (n % 3 <> 0 AND n % 2 <> 0)::BIGINT AS matches, (n % 3 <> 0)::BIGINT AS corrections FROM after")
def upserted_files(lib):
    catalog = _upserted(lib)
    out = catalog.read("files").select("path", F.col("id").alias("file_id"), "size")
    for table, name in (("embeddings", "vectors"), ("file_concepts", "matches"), ("concept_overrides", "corrections")):
        out = out.join(catalog.read(table).groupBy("file_id").agg(F.count("*").alias(name)), "file_id", "left")
    return out.fillna(0, ["vectors", "matches", "corrections"]).withColumnRenamed("file_id", "id")


@query(f"""WITH {_UPSERTS} SELECT 'files' AS name, count(*) AS n FROM after WHERE id % 5 <> 0 UNION ALL SELECT 'embeddings', count(*) FROM after WHERE n % 3 <> 0 AND n % 2 <> 0 AND id % 5 <> 0
UNION ALL SELECT 'file_concepts', count(*) FROM after WHERE n % 3 <> 0 AND n % 2 <> 0 AND id % 5 <> 0 UNION ALL SELECT 'concept_overrides', count(*) FROM after WHERE n % 3 <> 0 AND id % 5 <> 0""")
def forgotten_files(lib):
    catalog = _upserted(lib)
    catalog.forget(catalog.read("files").filter("id % 5 = 0"))
    counts = [catalog.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("files", "embeddings", "file_concepts", "concept_overrides")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"""WITH {_FILES}, held AS (SELECT row_number() OVER (ORDER BY path) AS id, path FROM files), moves AS (SELECT path AS source, '/new' || path AS target FROM held WHERE id % 4 = 0
    UNION ALL SELECT a.path, b.path FROM held a JOIN held b ON b.id = a.id + 1 WHERE a.id % 10 = 1)
SELECT id, coalesce(target, path) AS path FROM held LEFT JOIN moves ON path = source WHERE path NOT IN (SELECT target FROM moves) OR path IN (SELECT source FROM moves)""")
def renamed_files(lib):
    catalog = _catalog(lib)
    catalog.upsert_files(lib.files.select("path", "kind", "size", "mtime_ns", "samples"))
    held = catalog.read("files").select("id", "path")
    following = held.select((F.col("id") - 1).alias("id"), F.col("path").alias("target"))
    moves = held.filter("id % 4 = 0").select(F.col("path").alias("source"), F.concat(F.lit("/new"), "path").alias("target"))
    catalog.rename_files(moves.unionByName(held.filter("id % 10 = 1").join(following, "id").select(F.col("path").alias("source"), "target")))
    return catalog.read("files").select("id", "path")


@query("""WITH e AS (SELECT vec_id // 4 AS file_id, (vec_id % 4)::DOUBLE AS frame_time, embedding[1] AS x FROM embeddings)
SELECT row_number() OVER (ORDER BY file_id % 2, file_id, frame_time) AS id, file_id, frame_time, CASE WHEN frame_time = 2 THEN '1,2,3,4' END AS box, round(x::DOUBLE, 6) AS x FROM e""")
def appended_embeddings(lib):
    each = F.array_sort(F.collect_list(F.struct("frame_time", "vector")))
    rows = lib.embeddings.groupBy("file_id").agg(each.alias("e")).select("file_id", F.col("e.vector").alias("vectors"), F.col("e.frame_time").alias("frame_times"), F.transform("e.frame_time", lambda t: F.when(t == 2, "1,2,3,4")).alias("boxes"))
    catalog = _catalog(lib)
    for part in (0, 1):
        catalog.add_embeddings(rows.filter(F.col("file_id") % 2 == part))
    return catalog.read("embeddings").select("id", "file_id", "frame_time", "box", F.round(F.col("vector")[0].cast("double"), 6).alias("x"))


@query(f"WITH {_FILES} SELECT id, path, id AS found FROM files WHERE id % 37 = 5")
def point_lookups(lib):
    keys = lib.files.filter("id % 37 = 5")
    there = search.path_of(lib.files, keys.select("id"))
    return there.join(search.id_of(lib.files, there.select("path")).select("path", F.col("id").alias("found")), "path").select("id", "path", "found")


@query(f"""WITH {_FILES}, known AS (FROM files WHERE id % 3 <> 0)
SELECT (SELECT count(*) FROM files) AS scanned, count(*) FILTER (id % 11 <> 0) AS indexed, count(*) FILTER (id % 11 = 0) AS failed, coalesce(sum(CASE WHEN id % 11 <> 0 THEN 1 END), 0)::BIGINT AS frames,
    coalesce(sum(CASE WHEN id % 11 <> 0 AND id % 2 = 0 THEN 1 END), 0)::BIGINT AS regions, 0 AS faces, 0 AS named, (SELECT count(*) FROM files) - count(*) AS unchanged
FROM files WHERE id % 3 = 0 OR id % 10 = 0 OR id % 11 = 0 OR id % 7 = 0""")
def index_statistics(lib):
    """A first pass over two thirds of the files, then one over all, of which some have changed and some fail."""
    catalog, own = _catalog(lib), lib.files.select("path", "kind", "size", "mtime_ns", "id")

    def embed(files):
        n = F.regexp_extract("path", r"_(\d+)\.", 1).cast("long")
        failed, region = n % 11 == 0, n % 2 == 0
        times = lambda x: F.when(failed, F.array().cast("array<double>")).when(region, F.array(x, x)).otherwise(F.array(x))
        vector = F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")
        boxes = F.when(failed, F.array().cast("array<string>")).when(region, F.array(F.lit(""), F.lit("1,2,3,4"))).otherwise(F.array(F.lit("")))
        return files.select("path", F.transform(times(F.lit(0.0)), lambda t: vector).alias("vectors"), times(F.lit(0.0)).alias("frame_times"), boxes.alias("boxes"), F.when(failed, "unreadable").alias("error"))

    index_batch(catalog, own.filter("id % 3 <> 0").drop("id"), embed, 1)
    done = index_batch(catalog, own.withColumn("size", F.when(F.col("id") % 7 == 0, F.col("size") + 1).when(F.col("id") % 10 == 0, F.col("size") + 2).otherwise(F.col("size"))).drop("id"), embed, 1)
    return lib.spark.createDataFrame([tuple(done[c] for c in _STATISTICS)], ", ".join(f"{c} {'int' if c in ('faces', 'named') else 'long'}" for c in _STATISTICS))


_STATISTICS = ["scanned", "indexed", "failed", "frames", "regions", "faces", "named", "unchanged"]


@query("""WITH p AS (SELECT doc_id AS id, '/root/' || ['a/', '.hid/', 'b.photoslibrary/x/', 'c.App/', 'x.b/', '_u/'][doc_id % 6 + 1] || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || 'f' || doc_id || ['.jpg', '.MOV', '.txt', '', '.heic'][doc_id % 5 + 1] AS path FROM documents)
SELECT path, CASE WHEN id % 5 = 1 THEN 'video' ELSE 'image' END AS kind FROM p WHERE id % 6 IN (0, 4, 5) AND id % 7 <> 0 AND id % 5 IN (0, 1, 4)""")
def media_found(lib):
    return discovery.media(_listed(lib), "/root").select("path", "kind")


@query("""WITH p AS (SELECT doc_id AS id, '/root/' || ['a/', '.hid/', 'b.photoslibrary/x/', 'c.App/', 'x.b/', '_u/'][doc_id % 6 + 1] || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || 'f' || doc_id || ['.jpg', '.MOV', '.txt', '', '.heic'][doc_id % 5 + 1] AS path FROM documents)
SELECT path FROM p WHERE id % 6 = 5 AND id % 7 <> 0 AND id % 5 IN (0, 4)""")
def example_images(lib):
    return discovery.example_images(_listed(lib).filter("path like '/root/\\_u/%'"), "/root/_u").select("path")


def _listed(lib):
    n = F.col("doc_id")
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))
    path = F.concat(F.lit("/root/"), pick(["a/", ".hid/", "b.photoslibrary/x/", "c.App/", "x.b/", "_u/"]), F.when(n % 7 == 0, ".").otherwise(""), F.lit("f"), n.cast("string"), pick([".jpg", ".MOV", ".txt", "", ".heic"]))
    return lib.table("documents").select(path.alias("path"), F.lit(1).alias("size"), F.lit(1).alias("mtime_ns"))


# Concepts, corrections and people.


@query("""WITH a AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) AS id, n_nationkey / 100 AS threshold, n_regionkey AS n_examples FROM nation WHERE n_regionkey < 3),
b AS (SELECT n_name AS name, n_nationkey / 100 + 0.5 AS threshold, n_regionkey + 10 AS n_examples FROM nation WHERE n_regionkey >= 2)
SELECT a.name, a.id, round(coalesce(b.threshold, a.threshold), 6) AS threshold, coalesce(b.n_examples, a.n_examples)::INT AS n_examples, CASE WHEN a.name = 'CHINA' THEN '/out' END AS destination FROM a LEFT JOIN b USING (name)
UNION ALL SELECT name, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY name), round(threshold, 6), n_examples::INT, NULL FROM b WHERE name NOT IN (SELECT name FROM a)""")
def saved_concepts(lib):
    catalog = _catalog(lib)
    own = lambda more, count: lib.table("nation").select(F.col("n_name").alias("name"), F.array(F.lit(1.0)).alias("prototype"), (F.col("n_nationkey") / 100 + more).alias("threshold"), (F.col("n_regionkey") + count).alias("n_examples"), "n_regionkey")
    catalog.save_concepts(own(0, 0).filter("n_regionkey < 3"))
    catalog.update_concept("CHINA", destination="/out", verify_phrase="")
    catalog.save_concepts(own(0.5, 10).filter("n_regionkey >= 2"))
    return catalog.read("concepts").select("name", "id", rounded("threshold"), "n_examples", "destination")


def _scored(lib) -> Catalog:
    """A catalogue with the library's concepts, their matches, corrections and rejections."""
    catalog, concepts = _catalog(lib), lib.concepts(MATCH)
    with catalog.change():
        catalog.append("concepts", concepts)
        catalog.replace_matches(list(range(10)), score.score_library(lib.embeddings, concepts))
        catalog.set_overrides(_overrides(lib))
        rejected = lib.override_log.select("concept_id", F.concat(F.coalesce("state", F.lit("view")), F.lit("/"), F.col("file_id").cast("string")).alias("path"))
        catalog.add_rejections(rejected.filter("not path like 'view%'"))
        catalog.clear_rejections(rejected.filter("path like 'off%' and concept_id < 5"))
    return catalog


_REJECTED = """rejected AS (SELECT DISTINCT event_id % 10 AS concept_id, CASE event_type WHEN 'click' THEN 'on' ELSE 'off' END || '/' || user_id AS path FROM events WHERE event_type IN ('click', 'error') AND (event_type = 'click' OR event_id % 10 >= 5))"""


@query(f"WITH {_MATCHES} SELECT file_id, concept_id, round(score, 6) AS score FROM matches WHERE concept_id NOT IN (3, 4) OR (concept_id = 3 AND score >= 0.3)")
def replaced_matches(lib):
    catalog = _catalog(lib)
    found = score.score_library(lib.embeddings, lib.concepts(MATCH))
    catalog.replace_matches(list(range(10)), found)
    catalog.replace_matches([3, 4], found.filter("concept_id = 3 and score >= 0.3"))
    return catalog.read("file_concepts").select("file_id", "concept_id", rounded())


@query(f"WITH {_REJECTED} FROM rejected")
def rejections_kept(lib):
    return _scored(lib).read("concept_rejections").select("concept_id", "path")


@query(f"""WITH {_MATCHES}, {_LOG}, {_REJECTED} SELECT 'concepts' AS name, count(*) AS n FROM proto WHERE concept_id <> 3 UNION ALL SELECT 'file_concepts', count(*) FROM matches WHERE concept_id <> 3
UNION ALL SELECT 'concept_overrides', count(*) FROM latest WHERE state <> 'none' AND concept_id <> 3 UNION ALL SELECT 'concept_rejections', count(*) FROM rejected WHERE concept_id <> 3""")
def deleted_concept(lib):
    catalog = _scored(lib)
    catalog.delete_concept("tag3")
    counts = [catalog.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("concepts", "file_concepts", "concept_overrides", "concept_rejections")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"WITH {_LOG} SELECT file_id, concept_id, state FROM latest WHERE state <> 'none'")
def corrections_stream(lib):
    """The log of corrections as a stream, applied batch by batch."""
    catalog = _catalog(lib)
    log = lib.override_log.withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartitionByRange(4, "event_id").write.parquet(f"{catalog.root}/log")
    stream = lib.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{catalog.root}/log")
    running = correct_stream(stream, catalog, f"{catalog.root}/checkpoint")
    running.processAllAvailable()
    running.stop()
    return catalog.read("concept_overrides").select("file_id", "concept_id", "state")


@query(f"""WITH {_FACES}, held AS (SELECT e.id, e.file_id, f.person_id, f.score FROM (FROM emb WHERE id >= 50) e LEFT JOIN found f USING (id)),
numbered AS (SELECT row_number() OVER (ORDER BY file_id, id) AS n, * FROM held)
SELECT n AS id, file_id, CASE WHEN n = 2 THEN 8 WHEN n = 3 THEN NULL WHEN person_id <> 4 THEN person_id END AS person_id, round(CASE WHEN n = 2 THEN 0.75 WHEN n = 3 THEN NULL ELSE score END, 6) AS score FROM numbered""")
def stored_faces(lib):
    """Faces appended, two assigned by hand, one person deleted: their faces stay, with their scores."""
    catalog = _catalog(lib)
    found = faces.rematch(lib.faces, lib.references, FACE)
    catalog.add_faces(found.select("file_id", "person_id", "score", "frame_time", F.format_string("%08d", F.col("id")).alias("bbox"), "vector"))
    catalog.assign_face(2, 8, 0.75)
    catalog.assign_face(3, None)
    catalog.append("people", lib.people.select("id", "name", F.lit(0).alias("n_examples")))
    catalog.delete_person("person4")
    return catalog.read("file_faces").select("id", "file_id", "person_id", rounded())


@query("""WITH refs AS (SELECT vec_id AS id, label::BIGINT AS person_id FROM embeddings WHERE vec_id < 50), names AS (SELECT DISTINCT person_id FROM refs)
SELECT 'person' || person_id AS name, CASE person_id WHEN 2 THEN 7 WHEN 5 THEN (SELECT count(*) + 2 FROM refs WHERE person_id = 5) ELSE (SELECT count(*) FROM refs r WHERE r.person_id = names.person_id) END AS "references" FROM names
UNION ALL SELECT 'new', 0""")
def registered_people(lib):
    """References extended for one person and replaced for another; a new person without any."""
    own, extra = lib.references, lib.embeddings.filter("id between 60 and 66").select("id", "vector", F.lit("photo").alias("source"))
    both = faces.register(faces.register(own, 2, extra, "replace"), 5, extra.filter("id < 62"))
    catalog = _catalog(lib)
    catalog.append("people", lib.people.select("id", "name", F.lit(0).alias("n_examples")))
    catalog.upsert_person("new")
    catalog.upsert_person("person1")
    catalog.append("person_faces", both.filter("person_id <> 2"))
    catalog.replace_references(2, both.filter("person_id = 2"))
    counts = catalog.read("person_faces").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("references"))
    return catalog.read("people").join(counts, "id", "left").select("name", F.coalesce("references", F.lit(0)).alias("references"))


@query("""WITH f AS (SELECT vec_id AS id, label FROM embeddings WHERE vec_id >= 50)
SELECT 'face' AS kind, id, CASE WHEN id % 40 = 11 THEN 77 END AS person_id, CASE WHEN id % 40 = 11 THEN 1.0::DOUBLE END AS score FROM f
UNION ALL SELECT 'reference', vec_id, label::BIGINT, NULL FROM embeddings WHERE vec_id < 50 UNION ALL SELECT 'reference', 49 + row_number() OVER (ORDER BY id), 77, NULL FROM f WHERE id % 40 = 11""")
def named_cluster(lib):
    ids = lib.faces.filter("id % 40 = 11").select("id")
    found, references = faces.name_cluster(lib.faces, lib.references, ids, 77)
    more = references.select(F.lit("reference").alias("kind"), "id", "person_id", F.lit(None).cast("double").alias("score"))
    return found.select(F.lit("face").alias("kind"), "id", "person_id", "score").unionByName(more)


@query(f"""WITH {_NEGATIVE}, own2 AS (SELECT concept_id, count(*) AS n, avg(s) AS cohesion FROM own GROUP BY concept_id)
SELECT concept_id, n AS n_examples, round(cohesion, 6) AS cohesion, round(least(most + 0.01, least.least), 6) AS threshold FROM most JOIN least USING (concept_id) JOIN own2 USING (concept_id)""")
def taught_concepts(lib):
    negatives = lib.examples.select(((F.col("concept_id") + 9) % 10).alias("concept_id"), "vector")
    return learn.teach(lib.embeddings, lib.examples, negatives).select("concept_id", "n_examples", rounded("cohesion"), rounded("threshold"))


@query(f"WITH {_FILES} SELECT 'on' AS state, path FROM files WHERE id = 8 UNION ALL SELECT 'off', path FROM files WHERE id = 4 UNION ALL SELECT 'rejected', path FROM files WHERE id = 4")
def reviewed_files(lib):
    """Answers about files at a concept's boundary; the concept is learned again after each."""
    from likeness.service import Service

    catalog = _catalog(lib)
    with catalog.change():
        catalog.append("files", lib.files)
        catalog.append("embeddings", lib.vectors)
        catalog.append("concepts", lib.concepts(0.25))
    service = Service(catalog)
    path = {r["id"]: r["path"] for r in lib.files.filter("id in (4, 8)").select("id", "path").collect()}
    for file, match in ((8, True), (4, False)):
        service.review("tag1", path[file], match)
    files = catalog.read("files").select(F.col("id").alias("file_id"), "path")
    answers = catalog.read("concept_overrides").join(files, "file_id").select("state", "path")
    return answers.unionByName(catalog.read("concept_rejections").select(F.lit("rejected").alias("state"), "path"))


# Companions, names and moves.


@query(f"""WITH {_PAIRS}, keys AS (SELECT DISTINCT dir, stem FROM paths WHERE id % 9 = 4) SELECT DISTINCT path FROM paths SEMI JOIN keys USING (dir, stem) UNION SELECT '/elsewhere/x.jpg'""")
def companions_found(lib):
    own = _pairs(lib)
    chosen = own.filter("id % 9 = 4").select("path").unionByName(lib.spark.createDataFrame([("/elsewhere/x.jpg",)], "path string"))
    return companions.find(chosen, own.select("path"))


@query(f"""WITH {_PAIRS}, {_EFFECTIVE}, tagged AS (SELECT path, array_agg('tag' || concept_id ORDER BY 'tag' || concept_id) AS tags FROM (SELECT DISTINCT path, concept_id FROM paths JOIN effective ON effective.file_id = paths.id) GROUP BY path)
SELECT m.path, m."primary", coalesce(array_to_string(tagged.tags, ','), '') AS tags FROM (SELECT unnest(members) AS path, "primary" FROM groups) m LEFT JOIN tagged ON tagged.path = m."primary\"""")
def tagged_groups(lib):
    """Every file and companion with the corrected tags of its group's primary."""
    concepts, own = lib.concepts(MATCH), _pairs(lib)
    pairs = tags.effective(score.score_library(lib.embeddings, concepts), _overrides(lib))
    by_path = own.select(F.col("id").alias("file_id"), "path").join(tags.with_names(pairs, concepts), "file_id").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return companions.primary_tags(companions.members(own), by_path).select("path", "primary", F.array_join("tags", ",").alias("tags"))


_COLLISIONS = """plans AS (SELECT vec_id AS id, '/lib/' || ['trip', 'dcim', 'Photos', 'corfu', 'temp'][label % 5 + 1] || '/' || vec_id || '/f.jpg' AS unused,
    '/lib/' || vec_id || '/' || ['trip', 'dcim', 'Photos', 'corfu', 'temp'][label % 5 + 1] || '/f' || vec_id % 60 || '.jpg' AS source, '/out/f' || vec_id % 60 || '.jpg' AS target, md5((vec_id % 120)::VARCHAR) AS h,
    ['trip', NULL, NULL, 'corfu', NULL][label % 5 + 1] AS hint FROM embeddings),
listing AS (SELECT '/out/f' || k || '.jpg' AS path, md5(k::VARCHAR) AS held FROM range(0, 60, 3) t(k) UNION ALL SELECT '/out/f' || k || '-3.jpg', NULL FROM range(0, 60, 4) t(k) UNION ALL SELECT '/out/f' || k || ' (corfu).jpg', NULL FROM range(0, 60, 5) t(k)),
own AS (SELECT plans.*, held, path IS NOT NULL AS taken, coalesce(held = h, false) AS filed, row_number() OVER (PARTITION BY target ORDER BY source) AS place FROM plans LEFT JOIN listing ON path = target),
wanted AS (SELECT source, target, filed FROM own WHERE filed OR (NOT taken AND place = 1)),
rest AS (SELECT source, target, replace(target, '.jpg', ' (' || hint || ').jpg') AS hinted FROM own WHERE NOT (filed OR (NOT taken AND place = 1))),
by_folder AS (SELECT hinted, min(source) AS source FROM rest WHERE hinted NOT IN (SELECT path FROM listing) GROUP BY hinted),
numbered AS (SELECT source, target, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM rest WHERE source NOT IN (SELECT source FROM by_folder)),
free AS (SELECT target, k, row_number() OVER (PARTITION BY target ORDER BY k) AS n FROM (SELECT DISTINCT target FROM numbered), range(2, 3000) t(k) WHERE replace(target, '.jpg', '-' || k || '.jpg') NOT IN (SELECT path FROM listing))"""


@query(f"""WITH {_COLLISIONS} FROM wanted UNION ALL SELECT source, hinted, false FROM by_folder UNION ALL SELECT source, replace(target, '.jpg', '-' || k || '.jpg'), false FROM numbered JOIN free USING (target, n)""")
def resolve_collisions(lib):
    n = F.col("vec_id")
    folder = F.element_at(F.array(*map(F.lit, ["trip", "dcim", "Photos", "corfu", "temp"])), (F.col("label") % 5 + 1).cast("int"))
    plans = lib.table("embeddings").select(F.format_string("/lib/%d/%s/f%d.jpg", n, folder, n % 60).alias("source"), F.format_string("/out/f%d.jpg", n % 60).alias("target"), F.unhex(F.md5((n % 120).cast("string"))).alias("content_hash"))
    k, none = F.col("id"), F.lit(None).cast("binary").alias("content_hash")
    held = lib.spark.range(0, 60, 3).select(F.format_string("/out/f%d.jpg", k).alias("path"), F.unhex(F.md5(k.cast("string"))).alias("content_hash"))
    held = held.unionByName(lib.spark.range(0, 60, 4).select(F.format_string("/out/f%d-3.jpg", k).alias("path"), none)).unionByName(lib.spark.range(0, 60, 5).select(F.format_string("/out/f%d (corfu).jpg", k).alias("path"), none))
    return renames.resolve_collisions(plans, held)


@query("""SELECT vec_id AS id, CASE vec_id % 5 WHEN 0 THEN 'Corfu 2023' WHEN 4 THEN 'x' END AS hint FROM embeddings""")
def folder_hints(lib):
    folder = F.element_at(F.array(*map(F.lit, ["Corfu 2023", " Downloads ", "DCIM", "a" * 41, "x"])), (F.col("vec_id") % 5 + 1).cast("int"))
    return lib.table("embeddings").select(F.col("vec_id").alias("id"), paths.disambiguator(F.concat(F.lit("/a/"), folder, F.lit("/b.jpg"))).alias("hint"))


@query(f"""WITH {_FILES}, held AS (SELECT row_number() OVER (ORDER BY path) AS id, path FROM files),
first AS (SELECT id, CASE WHEN id % 3 = 0 THEN '/new' || path ELSE path END AS path, CASE WHEN id % 3 = 0 THEN path END AS before FROM held)
SELECT 'file' AS kind, id, path, NULL AS source FROM first UNION ALL SELECT 'rename', 1, path, before FROM first WHERE before IS NOT NULL""")
def journalled_renames(lib):
    """Three batches: one is carried out, the second one taken back, and of the third nothing happened."""
    catalog = _catalog(lib)
    catalog.upsert_files(lib.files.select("path", "kind", "size", "mtime_ns", "samples"))

    def plans(by, folder):
        held = catalog.read("files").filter(F.col("id") % by == 0)
        return held.select(F.col("id").alias("seq"), F.col("path").alias("source"), F.concat(F.lit(folder), "path").alias("target"))

    catalog.finish_renames(catalog.begin_renames(plans(3, "/new")), plans(3, "/new"))
    second = plans(5, "/old")
    number = catalog.begin_renames(second)
    catalog.finish_renames(number, catalog.open_renames())
    catalog.undo_renames(number)
    catalog.finish_renames(catalog.begin_renames(plans(7, "/never")), catalog.open_renames().limit(0))
    files, journal = catalog.read("files"), catalog.read("rename_batches")
    return files.select(F.lit("file").alias("kind"), "id", "path", F.lit(None).cast("string").alias("source")).unionByName(journal.select(F.lit("rename").alias("kind"), F.col("batch_id").alias("id"), F.col("target").alias("path"), "source"))


@query("""WITH RECURSIVE plans AS MATERIALIZED (SELECT vec_id AS source, CASE WHEN vec_id % 11 = 0 THEN vec_id * 3 % 700 WHEN vec_id % 11 < 9 THEN vec_id + 1 ELSE vec_id + 100000 END AS target FROM embeddings),
linked AS MATERIALIZED (SELECT a.source, a.target FROM plans a JOIN plans b ON a.target = b.source WHERE a.source <> a.target),
walk AS (SELECT source, 1 AS round FROM plans WHERE source <> target AND source NOT IN (SELECT source FROM linked)
    UNION ALL SELECT linked.source, round + 1 FROM walk JOIN linked ON linked.target = walk.source),
stuck AS MATERIALIZED (SELECT * FROM linked WHERE source NOT IN (SELECT source FROM walk)),
reach AS (SELECT source, target AS seen FROM stuck UNION SELECT reach.source, stuck.target FROM reach JOIN stuck ON reach.seen = stuck.source)
SELECT source, target, CAST(round AS INTEGER) AS round, (source, source) IN (SELECT (source, seen) FROM reach) AS in_cycle FROM plans LEFT JOIN walk USING (source) WHERE source <> target""")
def rename_rounds(lib):
    """The round in which each plan can be carried out, and which plans wait for themselves."""
    n = F.col("vec_id")
    target = F.when(n % 11 == 0, n * 3 % 700).when(n % 11 < 9, n + 1).otherwise(n + 100_000)
    return renames.rounds(lib.table("embeddings").select(n.alias("source"), target.alias("target")))


@query("SELECT vec_id AS source, vec_id * 3 % 700 AS target FROM embeddings WHERE vec_id * 3 % 700 IN (SELECT vec_id FROM embeddings) AND vec_id <> vec_id * 3 % 700")
def waiting_renames(lib):
    plans = lib.table("embeddings").select(F.col("vec_id").alias("source"), (F.col("vec_id") * 3 % 700).alias("target"))
    return renames.blocked(plans).select("source", "target")


@query("""SELECT doc_id AS id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda t: trim(t, ' ')), lambda t: t <> ''), '|') AS tags FROM documents""")
def split_lists(lib):
    return lib.table("documents").select(F.col("doc_id").alias("id"), F.array_join(naming.split_list(F.col("text")), "|").alias("tags"))


@query("""SELECT doc_id AS id, array_to_string(list_transform(list_sort(list_distinct(list_transform(l, lambda x: {'at': list_position(l, x), 'x': x}))), lambda p: p.x), '|') AS paths
FROM (SELECT doc_id, [source, lang, (n_chars % 4)::VARCHAR, lang, (doc_id % 4)::VARCHAR, source] AS l FROM documents)""")
def ordered_union(lib):
    d = lib.table("documents")
    own, more = F.array("source", "lang", (F.col("n_chars") % 4).cast("string")), F.array(F.col("lang"), (F.col("doc_id") % 4).cast("string"), F.col("source"))
    return d.select(F.col("doc_id").alias("id"), F.array_join(naming.ordered_union(own, more), "|").alias("paths"))


# Hashes and vectors.


@query("SELECT vec_id AS id, 256::INT AS bytes, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def blob_round_trip(lib):
    blob = vectors.to_blob("vector")
    back = lib.embeddings.select("id", F.length(blob).alias("bytes"), vectors.from_blob(blob).alias("v"))
    return back.select("id", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), F.round(F.col("v")[63].cast("double"), 6).alias("last"))


@query("SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY md5(text)")
def content_hashes(lib):
    """Texts with equal bytes have equal BLAKE2b hashes, others don't."""
    own = lib.table("documents").select("doc_id", hashing.content_hash(F.encode("text", "utf-8")).alias("h"))
    return own.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).select("first", "n")


_NEAR_ALL = "RECURSIVE " + _HASHED + f""",
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS seen FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.seen = links.a),
label AS (SELECT id, min(seen) AS g FROM reach GROUP BY id),
keyed AS (SELECT *, {{'a': -pixels, 'b': regexp_matches(parse_filename(path, true), '[-_ ]\\d+\\s*$'), 'd': length(parse_filename(path)), 'e': -size, 'f': mtime_ns, 'g': path}} AS k FROM hashed),
worst AS (SELECT g, max(value) / 255 AS distance FROM pairs JOIN label ON a = id GROUP BY g)"""


@query(f"""WITH {_NEAR_ALL} SELECT 'exact' AS kind, 0.0::DOUBLE AS distance, arg_min(path, k) AS keeper, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM keyed WHERE id % 50 = 0 HAVING count(*) > 1
UNION ALL SELECT 'near', round(any_value(distance), 6), arg_min(path, k), count(*), string_agg(path, '|' ORDER BY path) FROM keyed JOIN label USING (id) JOIN worst USING (g) GROUP BY g HAVING count(*) FILTER (id % 50 <> 0) > 0""")
def combined_duplicates(lib):
    hashed = _hashed(lib).withColumn("content_hash", F.when(F.col("id") % 50 == 0, F.lit(b"same")))
    both = duplicates.combine(duplicates.exact_groups(hashed), duplicates.near_groups(hashed, BITS_APART, [F.col("h")]))
    return both.select("kind", rounded("distance"), "keeper", "n", F.array_join("paths", "|").alias("paths"))


_COSINES = """basis AS (SELECT list_transform(range(16), lambda k: list_transform(range(64), lambda n: CASE WHEN k = 0 THEN sqrt(1 / 64) ELSE sqrt(2 / 64) END * cos(pi() * (2 * n + 1) * k / 128))) AS b),
image AS (SELECT vec_id AS id, list_transform(range(64), lambda i: list_transform(range(64), lambda j: v[i + 1] * 2 + v[j + 1] + v[(i * (j + 1) + 3 * j) % 64 + 1] * 3)) AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
half AS (SELECT id, list_transform(b, lambda c: list_transform(p, lambda r: list_dot_product(r, c))) AS h, b FROM image, basis),
low AS (SELECT id, flatten(list_transform(b, lambda c: list_transform(h, lambda r: list_dot_product(r, c)))) AS f FROM half)"""


@query(f"""WITH {_COSINES} SELECT id, array_to_string(list_transform(range(256), lambda i: CASE WHEN i > 0 AND f[i + 1] > list_median(f[2:]) THEN '1' ELSE '0' END), '') AS bits FROM low""")
def perceptual_hashes(lib):
    """Hashes of grey images whose values follow from a vector, as bits."""
    v = F.transform("vector", lambda x: x.cast("double"))
    side = F.sequence(F.lit(0), F.lit(63))
    pixels = F.flatten(F.transform(side, lambda i: F.transform(side, lambda j: F.get("v", i) * 2 + F.get("v", j) + F.get("v", (i * (j + 1) + 3 * j) % 64) * 3)))
    images = lib.embeddings.select("id", v.alias("v")).select("id", pixels.alias("pixels")).repartition("id")  # Python gets columns, not expressions with lambdas
    own = images.select("id", F.hex(hashing.perceptual_hash("pixels")).alias("h"))
    return own.select("id", F.concat(*[F.lpad(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(8)]).alias("bits"))
