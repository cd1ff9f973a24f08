"""Registered queries over the driver's tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from likeness.functions import boxes, hashing, naming, paths
from likeness.functions.vectors import cosine
from likeness.operators import companions, duplicates, faces, learn, score, search, tags
from likeness.plans import renames
from likeness.sources import discovery
from likeness.sources.library import Library
from likeness.sources.plugins import verify_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Random unit vectors of 64 dimensions are rarely close: thresholds far below the defaults.
MATCH = 0.20
FACE = 0.25
CLUSTER = 0.36
BITS_APART = 17


def query(sql: str = "") -> Callable:
    def register(f: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Library(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(name: str = "score"):
    return F.round(name, 6).alias(name)


_EMB = """emb AS (SELECT vec_id AS id, vec_id // 4 AS file_id, label, embedding::DOUBLE[] AS v FROM embeddings),
unit AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM emb),
mean AS (SELECT label, list(m ORDER BY pos) AS p FROM (
    SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM unit WHERE id < 100) GROUP BY label, pos) GROUP BY label),
proto AS (SELECT label::BIGINT AS concept_id, 'tag' || label AS name, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS p FROM mean)"""
_SCORED = _EMB + """,
scored AS (SELECT file_id, concept_id, name, max(list_cosine_similarity(v, p)) AS score FROM emb CROSS JOIN proto GROUP BY ALL)"""
_MATCHES = _SCORED + f""",
matches AS (SELECT * FROM scored WHERE score >= {MATCH})"""
_LOG = """log AS (SELECT user_id AS file_id, event_id % 10 AS concept_id, CASE event_type WHEN 'click' THEN 'on' WHEN 'error' THEN 'off' ELSE 'none' END AS state, ts, event_id
    FROM events WHERE event_type IN ('click', 'error', 'view')),
latest AS (SELECT file_id, concept_id, arg_max(state, {'ts': ts, 'event_id': event_id}) AS state FROM log GROUP BY ALL)"""
_EFFECTIVE = _MATCHES + ", " + _LOG + """,
effective AS (SELECT file_id, concept_id FROM matches ANTI JOIN (FROM latest WHERE state = 'off') USING (file_id, concept_id) UNION SELECT file_id, concept_id FROM latest WHERE state = 'on')"""
_FILES = """files AS (SELECT vec_id AS id, format('/lib/L{}/IMG_{:04d}.{}', label, vec_id, CASE WHEN vec_id % 10 = 0 THEN 'mov' ELSE 'jpg' END) AS path,
    CASE WHEN vec_id % 10 = 0 THEN 'video' ELSE 'image' END AS kind, vec_id * 7919 % 100003 AS size, vec_id * 1000 AS mtime_ns, label FROM embeddings)"""
_FACES = f"""emb AS (SELECT vec_id AS id, vec_id // 4 AS file_id, label, embedding::DOUBLE[] AS v FROM embeddings),
best AS (SELECT f.id, f.file_id, arg_max({{'r': r.id, 'p': r.label::BIGINT, 's': list_cosine_similarity(f.v, r.v)}}, {{'s': list_cosine_similarity(f.v, r.v), 'n': -r.id}}) AS b
    FROM (FROM emb WHERE id >= 50) f CROSS JOIN (FROM emb WHERE id < 50) r GROUP BY f.id, f.file_id),
found AS (SELECT id, file_id, b.p AS person_id, b.r AS ref_id, b.s AS score FROM best WHERE b.s >= {FACE})"""


# Search.


@query(f"WITH {_SCORED} SELECT file_id, round(score, 6) AS score FROM scored WHERE concept_id = 0 ORDER BY scored.score DESC, file_id LIMIT 25")
def search_by_concept_topk(lib):
    return search.by_concept(lib.embeddings, lib.concepts(-1.0), "tag0", 25).select("file_id", rounded())


@query(f"""WITH {_EMB}, m AS (SELECT list(m ORDER BY pos) AS p FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM unit WHERE id < 20) GROUP BY pos))
SELECT file_id, round(max(list_cosine_similarity(v, p)), 6) AS score FROM emb CROSS JOIN m GROUP BY file_id ORDER BY max(list_cosine_similarity(v, p)) DESC, file_id LIMIT 50""")
def search_by_examples(lib):
    return search.by_examples(lib.embeddings, lib.embeddings.filter("id < 20")).select("file_id", rounded())


@query(f"WITH {_SCORED} SELECT file_id, round(score, 6) AS score FROM scored WHERE concept_id = 3 AND score >= 0.25")
def search_threshold(lib):
    return search.by_concept(lib.embeddings, lib.concepts(0.25), "tag3", None).select("file_id", rounded())


@query("""WITH emb AS (SELECT vec_id // 4 AS file_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)
SELECT file_id, round(max(list_cosine_similarity(v, q)), 6) AS score FROM emb CROSS JOIN q GROUP BY file_id ORDER BY max(list_cosine_similarity(v, q)) DESC, file_id LIMIT 50""")
def search_by_text_vector(lib):
    vector = lib.embeddings.filter("id = 7").select("vector").first()[0]
    return search.by_vector(lib.embeddings, vector).select("file_id", rounded())


@query(f"""WITH {_SCORED}, d AS (SELECT *, abs(score - 0.25) AS distance FROM scored WHERE concept_id = 1)
SELECT file_id, round(score, 6) AS score, score >= 0.25 AS matching, round(distance, 6) AS distance FROM d ORDER BY d.distance, file_id LIMIT 12""")
def boundary_files(lib):
    found = search.prototype_of(lib.concepts(0.25), "tag1")
    return search.boundary(lib.embeddings, found[0], found[1]).select("file_id", rounded(), "matching", rounded("distance"))


@query(f"""WITH {_SCORED}, c AS (SELECT file_id, score FROM scored WHERE concept_id = 2 AND score >= 0 ORDER BY score DESC, file_id LIMIT 200)
SELECT file_id, round(score, 6) AS score, (file_id * 7919 % 1000) / 1000 AS verified FROM c""")
def verify_rerank(lib):
    scorer = (F.col("file_id") * 7919 % 1000) / 1000
    return search.verify(lib.embeddings, search.prototype_of(lib.concepts(0.0), "tag2")[0], scorer).select("file_id", rounded(), "verified")


class _Reader:
    """Scores and boxes from the number in a file's name; every seventh file can't be read."""

    def verify(self, paths: list[str], phrase: str) -> list[tuple[float, str | None]]:
        numbers = [int(p.rpartition("_")[2].partition(".")[0]) for p in paths]
        for n in numbers:
            if n % 7 == 0:
                raise OSError(f"{n} is unreadable")
        return [((n * 7919 + len(phrase)) % 1000 / 1000, None if n % 5 == 0 else f"{n % 64},{n % 48},{n % 64 + 10},{n % 48 + 12}") for n in numbers]


@query(f"""WITH {_SCORED}, {_FILES}, c AS (SELECT file_id, score FROM scored WHERE concept_id = 2 AND score >= 0 ORDER BY score DESC, file_id LIMIT 200)
SELECT file_id, path, round(score, 6) AS score, CASE WHEN file_id % 7 = 0 THEN 0 ELSE (file_id * 7919 + 9) % 1000 / 1000 END AS verified,
CASE WHEN file_id % 7 > 0 AND file_id % 5 > 0 THEN format('{{}},{{}},{{}},{{}}', file_id % 64, file_id % 48, file_id % 64 + 10, file_id % 48 + 12) END AS box,
CASE WHEN file_id % 7 = 0 THEN file_id || ' is unreadable' END AS error FROM c JOIN files ON files.id = file_id""")
def verify_boxes(lib):
    """Candidates ranked again by a model that is asked in batches, with boxes; unreadable files come last."""
    prototype = search.prototype_of(lib.concepts(0.0), "tag2")[0]
    found = search.verify_files(lib.embeddings, lib.files, prototype, verify_with(_Reader(), "a red cat"))
    return found.select("file_id", "path", rounded(), "verified", "box", "error")


@query(f"WITH {_MATCHES} SELECT file_id, round(score, 6) AS score FROM matches WHERE name = 'tag4' ORDER BY matches.score DESC, file_id LIMIT 20")
def stored_matches_topk(lib):
    concepts = lib.concepts(MATCH)
    return search.stored_matches(score.score_library(lib.embeddings, concepts), concepts, "tag4", 20).select("file_id", rounded())


@query("""SELECT doc_id AS id, coalesce(nullif(given, ''), nullif(stored, ''), replace(name, '-', ' ')) AS phrase
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '' END AS given, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' END AS stored, lang || '-' || source AS name FROM documents)""")
def verify_phrase(lib):
    n = F.col("doc_id")
    given, stored = F.when(n % 4 == 0, F.col("text")).when(n % 4 == 1, ""), F.when(n % 3 == 0, F.col("source")).when(n % 3 == 1, "")
    return lib.table("documents").select(n.alias("id"), search.phrase(given, stored, F.concat_ws("-", "lang", "source")).alias("phrase"))


# Learning and scoring.


@query(f"WITH {_SCORED} SELECT file_id, concept_id, round(score, 6) AS score FROM scored WHERE score >= 0.3")
def score_all_concepts(lib):
    return score.score_library(lib.embeddings, lib.concepts(0.3)).select("file_id", "concept_id", rounded())


@query(f"WITH {_SCORED} SELECT file_id, concept_id, round(score, 6) AS score FROM scored WHERE concept_id = 5 AND score >= 0.15")
def apply_one_concept(lib):
    return score.apply_concept(lib.embeddings, lib.concepts(0.9), "tag5", 0.15).select("file_id", "concept_id", rounded())


@query(f"WITH {_MATCHES} SELECT file_id, string_agg(name || '=' || printf('%.6f', score), ',' ORDER BY name) AS scores FROM matches GROUP BY file_id")
def scores_by_file(lib):
    concepts = lib.concepts(MATCH)
    found = score.scores_by_file(score.score_library(lib.embeddings, concepts), concepts)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.format_string("%s=%.6f", e["key"], e["value"])), ",")
    return found.select("file_id", text.alias("scores"))


_OWN = _EMB + ", own AS (SELECT concept_id, list_cosine_similarity(v, p) AS s FROM emb JOIN proto ON label = concept_id WHERE id < 100)"


@query(f"WITH {_OWN} SELECT concept_id, count(*) AS n_examples, round(avg(s), 6) AS cohesion, round(quantile_cont(s, 0.1::DOUBLE), 6) AS least FROM own GROUP BY concept_id")
def prototype_cohesion(lib):
    found = learn.cohesion(lib.examples, learn.prototypes(lib.examples))
    return found.select("concept_id", "n_examples", rounded("cohesion"), rounded("least"))


@query(f"WITH {_OWN} SELECT concept_id, round(greatest(quantile_cont(s, 0.1::DOUBLE), 0.6), 6) AS threshold FROM own GROUP BY concept_id")
def positives_only_threshold(lib):
    found = learn.cohesion(lib.examples, learn.prototypes(lib.examples))
    return found.select("concept_id", F.round(learn.positive_threshold(F.col("least")), 6).alias("threshold"))


_NEGATIVE = _OWN + """, most AS (SELECT concept_id, max(list_cosine_similarity(v, p)) AS most FROM emb JOIN proto ON (label + 9) % 10 = concept_id WHERE id < 100 GROUP BY concept_id),
least AS (SELECT concept_id, quantile_cont(s, 0.1::DOUBLE) AS least FROM own GROUP BY concept_id)"""


@query(f"WITH {_NEGATIVE} SELECT concept_id, round(least(most + 0.01, least.least), 6) AS threshold, round(greatest(0.7, most + 0.01, 0.6), 6) AS tightened FROM most JOIN least USING (concept_id)")
def negatives_threshold(lib):
    protos = learn.prototypes(lib.examples)
    negatives = lib.examples.withColumn("concept_id", (F.col("concept_id") + 9) % 10)
    most = learn.example_scores(negatives, protos).groupBy("concept_id").agg(F.max("score").alias("most"))
    both = learn.cohesion(lib.examples, protos).join(most, "concept_id")
    tightened = learn.retighten(F.lit(0.7), F.col("most"))
    return both.select("concept_id", F.round(learn.negative_threshold(F.col("most"), F.col("least")), 6).alias("threshold"), F.round(tightened, 6).alias("tightened"))


@query(f"""WITH {_OWN}, least AS (SELECT concept_id, quantile_cont(s, 0.1::DOUBLE) AS least FROM own GROUP BY concept_id),
lib AS (SELECT concept_id, list_cosine_similarity(v, p) AS s FROM emb CROSS JOIN proto WHERE NOT EXISTS (FROM emb e WHERE e.id < 100 AND e.label = concept_id AND e.file_id = emb.file_id)),
gaps AS (SELECT concept_id, s, lead(s) OVER (PARTITION BY concept_id ORDER BY s DESC) AS t FROM lib JOIN least USING (concept_id) WHERE s <= least.least),
gap AS (SELECT concept_id, arg_max({{'u': s, 'l': t}}, {{'g': s - t, 's': s}}) AS g FROM gaps WHERE t IS NOT NULL GROUP BY concept_id)
SELECT concept_id, round(least.least, 6) AS least, round(g.u, 6) AS upper, round(g.l, 6) AS lower,
    round(CASE WHEN g.u - g.l >= 0.02 THEN least(greatest((g.u + g.l) / 2, 0.1), greatest(least.least, 0.1)) ELSE greatest(least.least, 0.1) END, 6) AS threshold
FROM least JOIN gap USING (concept_id)""")
def calibrated_threshold(lib):
    protos = learn.prototypes(lib.examples)
    least = learn.least_scores(learn.example_scores(lib.examples, protos))
    found = learn.calibrate(least, learn.library_buckets(lib.embeddings, protos, least, exclude=lib.examples), floor=0.1)
    return found.select("concept_id", *map(rounded, ("least", "upper", "lower", "threshold")))


# Tags.


@query(f"WITH {_LOG} SELECT file_id, concept_id, nullif(state, 'none') AS state FROM latest")
def override_latest_state(lib):
    return tags.latest_overrides(lib.override_log, ["ts", "event_id"])


def _overrides(lib):
    return tags.latest_overrides(lib.override_log, ["ts", "event_id"])


@query(f"WITH {_EFFECTIVE} SELECT file_id, 'tag' || concept_id AS name FROM effective")
def effective_tags(lib):
    concepts = lib.concepts(MATCH)
    pairs = tags.effective(score.score_library(lib.embeddings, concepts), _overrides(lib))
    return tags.with_names(pairs, concepts).select("file_id", "name")


@query(f"WITH {_EFFECTIVE} SELECT file_id, string_agg('tag' || concept_id, ',' ORDER BY 'tag' || concept_id) AS tags FROM effective GROUP BY file_id")
def tags_by_file(lib):
    concepts = lib.concepts(MATCH)
    pairs = tags.effective(score.score_library(lib.embeddings, concepts), _overrides(lib))
    return tags.by_file(pairs, concepts).select("file_id", F.array_join("tags", ",").alias("tags"))


_TWO = "SELECT file_id, round(max(score), 6) AS score, string_agg(name, ',' ORDER BY name) AS tags FROM matches WHERE name IN ('tag0', 'tag1') GROUP BY file_id"


@query(f"WITH {_MATCHES} {_TWO}")
def tags_any(lib):
    concepts = lib.concepts(MATCH)
    return tags.matching(score.score_library(lib.embeddings, concepts), concepts, ["tag0", "tag1"]).select("file_id", rounded(), F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_MATCHES} {_TWO} HAVING count(DISTINCT name) = 2")
def tags_all(lib):
    concepts = lib.concepts(MATCH)
    return tags.matching(score.score_library(lib.embeddings, concepts), concepts, ["tag0", "tag1", "tag0"], "all").select("file_id", rounded(), F.array_join("tags", ",").alias("tags"))


_VIEW = _MATCHES + ", " + _FILES + f""",
seen AS (SELECT id, b.p AS person FROM (SELECT f.id, arg_max({{'p': r.label, 's': list_cosine_similarity(f.v, r.v)}}, {{'s': list_cosine_similarity(f.v, r.v), 'n': -r.id}}) AS b
    FROM (FROM emb WHERE id >= 50) f CROSS JOIN (FROM emb WHERE id < 50) r GROUP BY f.id) WHERE b.s >= {FACE}),
tagged AS (SELECT id, path, kind, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM matches WHERE matches.file_id = files.id), '') AS tags,
    coalesce((SELECT string_agg(DISTINCT 'person' || person, ',') FROM seen WHERE seen.id = files.id), '') AS people FROM files)"""


def _view(lib):
    concepts = lib.concepts(MATCH)
    found = faces.match(lib.faces, lib.references, FACE).select(F.col("id").alias("file_id"), "person_id")
    return tags.library_view(lib.files, score.score_library(lib.embeddings, concepts), concepts, found, lib.people)


def _flat(view):
    return view.select("id", "path", "kind", F.array_join("tags", ",").alias("tags"), F.array_join("people", ",").alias("people"))


@query(f"WITH {_VIEW} FROM tagged")
def library_view(lib):
    return _flat(_view(lib))


@query(f"WITH {_VIEW} FROM tagged WHERE tags = ''")
def untagged_files(lib):
    return _flat(_view(lib).filter(tags.library_filter(F.col("path"), F.col("tags"), untagged=True)))


@query(f"WITH {_VIEW} FROM tagged WHERE contains(lower(path), 'img_00') AND (contains(tags, 'tag1') OR contains(tags, 'tag2'))")
def name_filter(lib):
    return _flat(_view(lib).filter(tags.library_filter(F.col("path"), F.col("tags"), "IMG_00", selected=["tag1", "tag2"])))


@query(f"WITH {_VIEW} SELECT tag, count(*) AS files FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM tagged WHERE tags <> '') GROUP BY tag")
def tag_counts(lib):
    return tags.tag_counts(_view(lib))


@query(f"WITH {_SCORED} SELECT proto.name, count(score) AS matches FROM proto LEFT JOIN (FROM scored WHERE score >= 0.35) s USING (concept_id) GROUP BY proto.name")
def concept_counts(lib):
    concepts = lib.concepts(0.35)
    return tags.concept_counts(concepts, score.score_library(lib.embeddings, concepts)).select("name", "matches")


# Faces.


@query(f"WITH {_FACES} SELECT id, person_id, ref_id, round(score, 6) AS score FROM found")
def face_match(lib):
    return faces.match(lib.faces, lib.references, FACE).select("id", "person_id", "ref_id", rounded())


@query(f"WITH {_FACES} SELECT e.id, e.file_id, f.person_id, round(f.score, 6) AS score FROM (FROM emb WHERE id >= 50) e LEFT JOIN found f USING (id)")
def face_rematch(lib):
    return faces.rematch(lib.faces, lib.references, FACE).select("id", "file_id", "person_id", rounded())


@query(f"WITH {_FACES} SELECT file_id, round(max(score), 6) AS score FROM found WHERE person_id = 3 GROUP BY file_id")
def person_files(lib):
    return search.by_person(faces.rematch(lib.faces, lib.references, FACE), lib.people, "person3").select("file_id", rounded())


@query(f"WITH {_FACES} SELECT p.label::BIGINT AS id, count(DISTINCT file_id) AS files FROM (SELECT DISTINCT label FROM emb WHERE id < 50) p LEFT JOIN found ON person_id = label GROUP BY p.label")
def people_counts(lib):
    return tags.people_counts(lib.people, faces.rematch(lib.faces, lib.references, FACE)).select("id", "files")


@query(f"""WITH RECURSIVE emb AS MATERIALIZED (SELECT vec_id AS id, vec_id // 4 AS file_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id >= 50),
edge AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM emb a JOIN emb b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= {CLUSTER}),
reach AS (SELECT id, id AS seen FROM emb UNION SELECT reach.id, edge.b FROM reach JOIN edge ON reach.seen = edge.a),
label AS (SELECT id, min(seen) AS cluster FROM reach GROUP BY id)
SELECT cluster, count(*) AS size, count(DISTINCT file_id) AS files, string_agg(id::VARCHAR, ',' ORDER BY id) AS face_ids, arg_min(file_id, id) AS sample_file_id FROM label JOIN emb USING (id) GROUP BY cluster HAVING count(*) >= 3""")
def face_clusters(lib):
    found = faces.cluster_unnamed(lib.faces, CLUSTER)
    return found.select("cluster", "size", "files", F.array_join("face_ids", ",").alias("face_ids"), "sample_file_id")


_BOX = """box AS (SELECT vec_id AS id, vec_id // 4 AS file_id, (vec_id * 37 % 1500)::DOUBLE AS l, (vec_id * 53 % 900)::DOUBLE AS t, (20 + vec_id * 7 % 200)::DOUBLE AS w, (30 + vec_id * 11 % 180)::DOUBLE AS h FROM embeddings)"""


def _boxes(lib):
    n = F.col("vec_id")
    left, top = (n * 37 % 1500).cast("double"), (n * 53 % 900).cast("double")
    return lib.table("embeddings").select(n.alias("id"), F.expr("vec_id div 4").alias("file_id"), left.alias("left"), top.alias("top"), (left + 20 + n * 7 % 200).alias("right"), (top + 30 + n * 11 % 180).alias("bottom"))


@query(f"""WITH {_BOX}, b AS (SELECT id, trunc(greatest(0, l + w / 2 - w * 3.2 / 2))::INT AS x1, trunc(greatest(0, t - h * 0.6))::INT AS y1, trunc(least(1600, l + w / 2 + w * 3.2 / 2))::INT AS x2, trunc(least(1200, t + h + h * 4.5))::INT AS y2 FROM box)
SELECT id, concat_ws(',', x1, y1, x2, y2) AS body FROM b WHERE least(x2 - x1, y2 - y1) >= 96""")
def body_boxes(lib):
    body = boxes.body_box(F.struct("left", "top", "right", "bottom"), F.lit(1600), F.lit(1200))
    own = _boxes(lib).select("id", body.alias("body"))
    return own.filter(boxes.short_side(F.col("body")) >= boxes.LEAST_CROP).select("id", boxes.box_text(F.col("body")).alias("body"))


@query(f"WITH {_BOX} SELECT file_id, arg_max(id, {{'s': least(w, h), 'n': -id}}) AS id, max(least(w, h)) AS side FROM box WHERE least(w, h) >= 40 GROUP BY file_id")
def largest_face(lib):
    return faces.largest_face(_boxes(lib)).select("file_id", "id", "side")


# Duplicates.


def _texts(lib):
    d = lib.table("documents")
    name = F.format_string("/docs/%s/doc%d%s.txt", F.col("source"), F.expr("doc_id div 3"), F.when(F.col("doc_id") % 3 == 1, " copy").when(F.col("doc_id") % 3 == 2, "_edit").otherwise(""))
    return d.select(F.col("doc_id").alias("id"), name.alias("path"), hashing.content_hash(F.encode("text", "utf-8")).alias("content_hash"), (F.col("n_chars") % 5).alias("pixels"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ns"))


_TEXTS = """files AS (SELECT doc_id AS id, format('/docs/{}/doc{}{}.txt', source, doc_id // 3, CASE doc_id % 3 WHEN 1 THEN ' copy' WHEN 2 THEN '_edit' ELSE '' END) AS path,
    md5(text) AS h, n_chars % 5 AS pixels, n_chars AS size, doc_id AS mtime_ns FROM documents),
named AS (SELECT *, parse_filename(path) AS name, parse_filename(path, true) AS stem FROM files),
groups AS (SELECT h, list(DISTINCT stem) AS stems FROM named GROUP BY h HAVING count(*) > 1),
members AS (SELECT named.*, {'a': -pixels, 'b': regexp_matches(stem, '(?i)\\bcopy\\b|\\(\\d+\\)\\s*$|[-_ ]\\d+\\s*$|\\bduplicate\\b'),
    'c': len(list_filter(stems, lambda s: s <> stem AND starts_with(stem, s))) > 0, 'd': length(name), 'e': -size, 'f': mtime_ns, 'g': path} AS k FROM named JOIN groups USING (h))"""


@query(f"WITH {_TEXTS} SELECT arg_min(path, k) AS keeper, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM members GROUP BY h")
def exact_duplicates(lib):
    found = duplicates.exact_groups(_texts(lib))
    return found.select("keeper", "n", F.array_join("paths", "|").alias("paths"))


@query(f"WITH {_TEXTS}, kept AS (SELECT h, arg_min(path, k) AS keeper FROM members GROUP BY h) SELECT keeper, path FROM members JOIN kept USING (h) WHERE path <> keeper")
def duplicate_redundant(lib):
    return duplicates.redundant_files(duplicates.exact_members(_texts(lib)))


def _hashed(lib):
    """Bit i of the hash: component i lies above the vector's median."""
    v = F.col("vector")
    sorted_ = F.array_sort(F.transform(v, lambda x: x.cast("double")))
    middle = (sorted_[31] + sorted_[32]) / 2
    bits = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.when(v[i].cast("double") > middle, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return lib.files.withColumn("h", bits).withColumns({"pixels": F.col("size") % 3})


_HASHED = _FILES + f""",
hashed AS (SELECT files.*, size % 3 AS pixels, list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i + 1]::DOUBLE > list_median(embedding::DOUBLE[]) THEN 1::HUGEINT << i ELSE 0 END))::BIGINT AS h
    FROM files JOIN embeddings ON id = vec_id),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS value FROM hashed a JOIN hashed b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= {BITS_APART})"""


@query(f"WITH {_HASHED} SELECT a, b, value FROM pairs")
def hash_hamming_pairs(lib):
    return duplicates.hamming_pairs(_hashed(lib), BITS_APART, [F.col("h")])


_NEAR = "RECURSIVE " + _HASHED + """,
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS seen FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.seen = links.a),
label AS (SELECT id, min(seen) AS g FROM reach GROUP BY id),
named AS (SELECT hashed.*, g, parse_filename(path) AS name, parse_filename(path, true) AS stem FROM hashed JOIN label USING (id)),
keyed AS (SELECT *, {'a': -pixels, 'b': regexp_matches(stem, '[-_ ]\\d+\\s*$'), 'd': length(name), 'e': -size, 'f': mtime_ns, 'g': path} AS k FROM named),
worst AS (SELECT g, max(value) / 255 AS distance FROM pairs JOIN label ON a = id GROUP BY g)"""


@query(f"WITH {_NEAR} SELECT g AS \"group\", round(any_value(distance), 6) AS distance, arg_min(path, k) AS keeper, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM keyed JOIN worst USING (g) GROUP BY g")
def near_duplicates(lib):
    found = duplicates.near_groups(_hashed(lib), BITS_APART, [F.col("h")])
    return found.select("group", rounded("distance"), "keeper", "n", F.array_join("paths", "|").alias("paths"))


# Names, companions and plans.

_KNOWN = ["Clay", "outdoor", "tag 3"]


def _names(lib):
    n = F.col("doc_id")
    stem = F.concat(F.lit("item "), n.cast("string"), F.when(n % 2 == 0, " [CLAY]").otherwise(""), F.when(n % 3 == 0, " [2]").otherwise(""), F.when(n % 5 == 0, "[ tag 3 ]").otherwise(""))
    wanted = F.filter(F.array(F.when(n % 4 == 0, "outdoor"), F.when(n % 2 == 0, "Clay")), lambda t: t.isNotNull())
    return lib.table("documents").select(n.alias("id"), F.concat(F.lit("/lib/"), stem, F.lit(".jpg")).alias("path"), wanted.alias("tags"))


_NAMES = r"""names AS (SELECT doc_id AS id, 'item ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' [CLAY]' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' [2]' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '[ tag 3 ]' ELSE '' END AS stem,
    concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN '[Clay]' END, CASE WHEN doc_id % 4 = 0 THEN '[outdoor]' END) AS suffix FROM documents),
parsed AS (SELECT *, trim(regexp_replace(stem, '\s*\[\s*(clay|outdoor|tag 3)\s*\]', '', 'gi')) AS base FROM names)"""


@query(f"WITH {_NAMES} SELECT id, base, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'Clay' END, CASE WHEN id % 5 = 0 THEN 'tag 3' END) AS tags FROM parsed")
def parse_tags(lib):
    stem = paths.stem(F.col("path"))
    return _names(lib).select("id", naming.base_of(stem, _KNOWN).alias("base"), F.array_join(naming.tags_in(stem, _KNOWN), ",").alias("tags"))


@query(f"WITH {_NAMES} SELECT id, trim(base || ' ' || suffix) || '.jpg' AS name FROM parsed")
def retag_names(lib):
    return _names(lib).select("id", naming.retag(paths.name(F.col("path")), F.col("tags"), _KNOWN).alias("name"))


@query(f"WITH {_NAMES}, p AS (SELECT '/lib/' || stem || '.jpg' AS source, '/lib/' || trim(base || ' ' || suffix) || '.jpg' AS target FROM parsed) SELECT source, target, lower(source) = lower(target) AS case_only FROM p WHERE source <> target")
def pending_renames(lib):
    return renames.plan_renames(_names(lib), _KNOWN)


@query(r"""SELECT doc_id AS id, place::INT AS place, CASE WHEN c <> '' AND NOT regexp_matches(c, '[\[\]/\\]') AND NOT starts_with(c, '.') THEN c END AS tag
FROM (SELECT doc_id, place, trim(regexp_replace(piece, '\s+', ' ', 'g')) AS c FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS place FROM (SELECT doc_id, string_split(text, '.') AS pieces FROM documents)))""")
def validate_tags(lib):
    """Every sentence of the texts as a candidate."""
    pieces = lib.table("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", r"\.")).alias("at", "piece"))
    return pieces.select("id", (F.col("at") + 1).alias("place"), naming.clean_tag(F.col("piece")).alias("tag"))


def _pairs(lib):
    n = F.col("vec_id")
    suffix = F.element_at(F.array(*map(F.lit, [".HEIC", ".mov", ".aae", ".jpg"])), (n % 4 + 1).cast("int"))
    stem = F.when(n % 2 == 0, F.format_string("IMG_%d", F.expr("vec_id div 3"))).otherwise(F.format_string("img_%d", F.expr("vec_id div 3")))
    return lib.table("embeddings").select(n.alias("id"), F.concat(F.format_string("/c/L%d/", F.col("label") % 2), stem, suffix).alias("path"), "label")


_PAIRS = """paths AS (SELECT vec_id AS id, '/c/L' || label % 2 || '/' || CASE WHEN vec_id % 2 = 0 THEN 'IMG_' ELSE 'img_' END || vec_id // 3 || ['.HEIC', '.mov', '.aae', '.jpg'][vec_id % 4 + 1] AS path,
    '/c/L' || label % 2 AS dir, 'img_' || vec_id // 3 AS stem, [0, 8, 13, 2][vec_id % 4 + 1] AS rank, vec_id % 4 = 2 AS sidecar FROM embeddings),
groups AS (SELECT dir, stem, arg_min(path, {'r': rank, 'p': path}) FILTER (NOT sidecar) AS "primary", list(path ORDER BY rank, path) AS members FROM paths GROUP BY dir, stem HAVING count(*) FILTER (NOT sidecar) > 0)"""


@query(f"WITH {_PAIRS} SELECT dir, stem, \"primary\", array_to_string(members, '|') AS members FROM groups")
def companion_groups(lib):
    return companions.groups(_pairs(lib)).select("dir", "stem", "primary", F.array_join("members", "|").alias("members"))


def _tag_list(lib):
    n = F.col("id")
    own = F.filter(F.array(F.when(n % 3 == 0, "alpha"), F.when(n % 5 == 0, "beta"), F.when(n % 7 == 0, "gamma")), lambda t: t.isNotNull())
    return _pairs(lib).select("path", own.alias("tags"))


_TAG_LIST = """own AS (SELECT id, path, list_filter([CASE WHEN id % 3 = 0 THEN 'alpha' END, CASE WHEN id % 5 = 0 THEN 'beta' END, CASE WHEN id % 7 = 0 THEN 'gamma' END], lambda t: t IS NOT NULL) AS tags FROM paths),
members AS (SELECT unnest(members) AS path, "primary" FROM groups),
shared AS (SELECT members.path, "primary", own.tags, own.id FROM members JOIN own ON own.path = "primary")"""


@query(f"WITH {_PAIRS}, {_TAG_LIST} SELECT path, \"primary\", array_to_string(tags, ',') AS tags FROM shared")
def primary_tags(lib):
    return companions.primary_tags(companions.members(_pairs(lib)), _tag_list(lib)).select("path", "primary", F.array_join("tags", ",").alias("tags"))


def _moves(lib, inverse):
    tagged = companions.primary_tags(companions.members(_pairs(lib)), _tag_list(lib))
    folders = lib.spark.createDataFrame([("alpha", "/out/a"), ("beta", "/out/b")], "tag string, folder string")
    scores = _pairs(lib).select("path", F.explode(F.array(F.struct(F.lit("alpha").alias("tag"), (F.col("id") % 11 / 11).alias("score")), F.struct(F.lit("beta").alias("tag"), (F.col("id") % 13 / 13).alias("score")))).alias("s")).select("path", "s.*")
    other = lib.spark.createDataFrame([("gamma", "/out/not-g"), ("alpha", "/out/not-a")], "tag string, folder string") if inverse else None
    return renames.plan_moves(tagged, folders, scores, other)


_MOVES = _PAIRS + ", " + _TAG_LIST + """,
best AS (SELECT *, CASE WHEN list_contains(tags, 'alpha') AND list_contains(tags, 'beta') THEN CASE WHEN id % 11 / 11 >= id % 13 / 13 THEN 'alpha' ELSE 'beta' END
    WHEN list_contains(tags, 'alpha') THEN 'alpha' WHEN list_contains(tags, 'beta') THEN 'beta' END AS tag,
    list_contains(tags, 'alpha')::BIGINT + list_contains(tags, 'beta')::BIGINT AS claims FROM shared),
moves AS (SELECT path AS source, CASE tag WHEN 'alpha' THEN '/out/a/' ELSE '/out/b/' END || parse_filename(path) AS target, tag, true AS matched, claims FROM best WHERE tag IS NOT NULL)"""


@query(f"WITH {_MOVES} FROM moves")
def plan_moves(lib):
    return _moves(lib, False)


@query(f"""WITH {_MOVES} FROM moves UNION ALL SELECT path, '/out/not-a/' || parse_filename(path), 'alpha', false, 1 + (NOT list_contains(tags, 'gamma'))::BIGINT FROM best WHERE tag IS NULL""")
def plan_moves_inverse(lib):
    return _moves(lib, True)


@query("""WITH n AS (SELECT doc_id, source || '.txt' AS name FROM documents), r AS (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM n)
SELECT doc_id AS id, CASE WHEN k = 1 THEN name ELSE replace(name, '.txt', '') || '-' || k || '.txt' END AS name FROM r""")
def free_names(lib):
    d = lib.table("documents")
    return d.select(F.col("doc_id").alias("id"), renames.numbered(F.concat("source", F.lit(".txt")), [F.col("doc_id")]).alias("name"))


# Sources.


@query(f"""WITH {_FILES}, known AS (SELECT path, size, mtime_ns FROM files WHERE id % 3 <> 0 AND id % 7 <> 0)
SELECT f.path FROM files f WHERE kind = 'image' AND EXISTS (FROM known k WHERE k.path = f.path) AND id % 5 <> 0""")
def unchanged_filter(lib):
    found = lib.files.select("path", "kind", F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime_ns")
    known = lib.files.filter("id % 3 <> 0")
    vectors = lib.vectors.filter("id % 7 <> 0")
    return discovery.unchanged(found, known, vectors).select("path")


@query(f"WITH {_FILES} SELECT id, path FROM files WHERE id % 4 = 1")
def missing_files(lib):
    return discovery.missing(lib.files, lib.files.filter("id % 4 <> 1")).select("id", "path")


@query("""WITH d AS (SELECT event_id AS id, round(value, 2) AS d FROM events)
SELECT id, i::INT AS frame, round(CASE WHEN d <= 0 THEN greatest(d, 0.0) / 2 ELSE d * 0.05 + d * 0.9 * i / 7 END, 6) AS frame_time FROM d, unnest(CASE WHEN d <= 0 THEN [0] ELSE range(8) END) AS t(i)""")
def frame_sample_times(lib):
    d = lib.table("events").select(F.col("event_id").alias("path"), F.lit("video").alias("kind"), F.round("value", 2).alias("duration"))
    return discovery.frames(d).select(F.col("path").alias("id"), "frame", rounded("frame_time"))


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://blog.tionsh.example.net/') OR starts_with(url, 'https://m.tionsh.example.net/en/') OR starts_with(url, 'http://blog.tionsh.example.net/en/')")
def allowlist_permits(lib):
    roots = F.array(*map(F.lit, ["https://blog.tionsh.example.net", "https://m.tionsh.example.net/en", "http://blog.tionsh.example.net/en"]))
    return lib.table("pages").filter(paths.within(F.col("url"), roots)).select("page_id")


@query(f"""WITH {_FILES} SELECT count(*) AS files, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'video') AS videos, count(*) AS embeddings,
    count(DISTINCT label) FILTER (id < 100) AS concepts, count(*) FILTER (id >= 50) AS faces, 0::BIGINT AS named_faces FROM files""")
def status_counts(lib):
    return tags.status(lib.files, lib.embeddings, lib.concepts(0.5), lib.faces)


@query("""SELECT event_id AS id, CASE WHEN e IN ('.jpg', '.png') THEN 'image' WHEN e IN ('.mov') THEN 'video' END AS kind, rank, e IN ('.aae') AS sidecar
FROM (SELECT event_id, ['.jpg', '.png', '.mov', '.aae', '.pdf'][event_id % 5 + 1] AS e, [2, 4, 8, 13, 13][event_id % 5 + 1] AS rank FROM events)""")
def classify_paths(lib):
    suffix = F.element_at(F.array(*map(F.lit, [".JPG", ".png", ".Mov", ".aae", ".pdf"])), (F.col("event_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/a.b/x."), F.col("event_type"), suffix)
    return lib.table("events").select(F.col("event_id").alias("id"), paths.kind(path).alias("kind"), paths.primary_rank(path).alias("rank"), paths.is_sidecar(path).alias("sidecar"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings")
def cosine_scan(lib):
    first = lib.embeddings.filter("id = 0").select("vector").first()[0]
    return lib.embeddings.select("id", F.round(cosine(F.col("vector"), F.array(*map(F.lit, first))), 6).alias("score"))
