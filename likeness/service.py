"""What a user does with a library: index, teach, review, score, search, correct, organize.

Each step reads tables from a :class:`Catalog`, composes operators and writes tables back; plans are
carried out on the driver. One library, one writer at a time.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from likeness.functions import naming, paths
from likeness.functions.boxes import LEAST_FACE
from likeness.operators import companions, duplicates, faces, learn, score, search, tags
from likeness.operators.faces import THRESHOLD
from likeness.operators.search import BOUNDARY_LIMIT, CANDIDATES, LIMIT
from likeness.plans import renames
from likeness.sources import discovery, images
from likeness.sources.catalog import Catalog
from likeness.sources.plugins import Embedder, FaceAnalyzer, detect, embed_with, verify_with
from likeness.sources.reading import read_media
from likeness.sources.schema import TABLES
from likeness.sources.scratch import Scratch
from likeness.streaming.ingest import BATCH_FILES, index_pass

MODES = ("rename", "move", "off")


def _in_turn(plans: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The order in which renames can have been carried out: each after the one that freed its name."""
    by_source, out, seen = dict(plans), [], set()
    for source, target in plans:
        chain = []
        while source not in seen and source in by_source:
            seen.add(source)
            chain.append((source, by_source[source]))
            source = by_source[source]
        out += reversed(chain)
    return out


class Service:
    def __init__(self, catalog: Catalog, embedder: Embedder | None = None, verifier=None, analyzer: FaceAnalyzer | None = None, frames: images.FrameSource | None = None):
        """``verifier``: a :class:`Verifier`, or a function from a phrase to a column that scores file ids."""
        self.frames = frames
        self.catalog, self.embedder, self.verifier, self.analyzer, self.spark = catalog, embedder, verifier, analyzer, catalog.spark

    # Indexing.

    def index(self, root: str, samples: int = discovery.SAMPLES, crops: bool = False, batch: int = BATCH_FILES, stop=lambda: False, report=lambda done, of: None) -> dict:
        """Index the media files under a folder that are new or changed, and open no others. Returns counts:
        scanned, indexed, unchanged, failed, frames, regions, faces, named and, where pixels are read in
        tasks, failed_frames and failed_faces.

        An embedder with ``embed_pixels`` gets the pixels of images, of video frames and, with ``crops``, of
        the bodies of faces; an analyzer with ``faces_in`` finds the faces in the same stage. Others are
        given paths. Each ``batch`` of files is committed by itself; ``stop`` is asked between them and
        ``report`` told how many are done."""
        if self.catalog.read("roots").filter(F.col("path") == root).isEmpty():
            self.catalog.append("roots", self.spark.createDataFrame([(root,)], "path string").withColumn("added_at", F.current_timestamp()))
        found = discovery.media(discovery.listing(self.spark, root), root)
        embed, in_stage = self._reader(samples, crops)
        done = index_pass(self.catalog, found, embed, samples, images.fingerprints, self._named, batch, stop, report)
        if self.analyzer is None or in_stage or stop():
            return done
        named = lambda: self.catalog.read("file_faces").filter("person_id is not null").count()
        before = named()
        return done | {"faces": self.find_faces(), "named": named() - before}

    def _reader(self, samples: int, crops: bool):
        """The embedding step of an index pass, and whether it finds the faces, too."""
        if not hasattr(self.embedder, "embed_pixels"):
            return embed_with(self.embedder), False
        in_stage = hasattr(self.analyzer, "faces_in")
        return lambda files: read_media(files, self.embedder, self.frames, self.analyzer if in_stage else None, samples, crops), in_stage

    def _named(self, found: DataFrame) -> DataFrame:
        return faces.match(found, self.catalog.read("person_faces"))

    def forget_missing(self, root: str) -> int:
        """Drop indexed files that are gone from a folder."""
        here = self.catalog.read("files").filter(F.startswith("path", F.lit(root.rstrip("/") + "/")))
        gone = discovery.missing(here, discovery.listing(self.spark, root))
        return self.catalog.forget(gone.select("id"))

    # Concepts.

    def _concept(self, name: str):
        found = self.catalog.read("concepts").filter(F.col("name") == name).head(1)
        if not found:
            raise KeyError(f"no concept {name!r}")
        return found[0]

    def _clean(self, name: str) -> str:
        found = self.spark.createDataFrame([(name,)], "name string").select(naming.clean_tag(F.col("name"))).first()[0]
        if found is None:
            raise ValueError(f"{name!r} can't be a tag's name")
        return found

    def _vectors(self, names: list[str]) -> DataFrame:
        """path, file_id (null if not indexed), vector of example files; from the index where they are in it."""
        wanted = self.spark.createDataFrame([(p,) for p in dict.fromkeys(names)], "path string")
        files = self.catalog.read("files").select("path", F.col("id").alias("file_id"))
        own = wanted.join(files, "path").join(self.catalog.read("embeddings").select("file_id", "vector"), "file_id").select("path", "file_id", "vector")
        rest = [r["path"] for r in wanted.join(own, "path", "left_anti").collect()] if self.embedder else []
        if rest:
            kept, vectors = self.embedder.embed_paths(rest)
            own = own.unionByName(self.spark.createDataFrame([(p, None, v.tolist()) for p, v in zip(kept, vectors)], "path string, file_id long, vector array<float>"))
        return own

    def teach(self, name: str, paths: list[str], negatives: list[str] = ()) -> dict:
        """Learn a concept from example files. Its stored rejections always count as negatives; with
        negatives alone only the threshold of a known concept rises."""
        name = self._clean(name)
        known = self.catalog.read("concepts").filter(F.col("name") == name).head(1)
        negatives = list(negatives)
        if known:
            negatives += [r["path"] for r in self.catalog.read("concept_rejections").filter(F.col("concept_id") == known[0]["id"]).collect()]
        one = F.lit(0).cast("long").alias("concept_id")
        if not paths and negatives:
            concept = self._concept(name)
            proto = self.spark.createDataFrame([(0, concept["prototype"])], "concept_id long, prototype array<float>")
            most = learn.example_scores(self._vectors(negatives).select(one, "vector"), proto).agg(F.max("score")).first()[0]
            if most is None:
                raise ValueError("none of the counter-examples could be read")
            threshold = max(concept["threshold"], most + learn.MARGIN, learn.FLOOR)
            return self._save(name, concept["prototype"], threshold, concept["n_examples"], 0.0)
        examples = self._vectors(paths).select(one, "file_id", "vector").persist()
        against = self._vectors(negatives).select(one, "vector") if negatives else None
        found = learn.teach(self.catalog.read("embeddings"), examples, against).head(1)
        examples.unpersist()
        if not found:
            raise ValueError("none of the examples could be read")
        return self._save(name, found[0]["prototype"], found[0]["threshold"], found[0]["n_examples"], found[0]["cohesion"])

    def _save(self, name, prototype, threshold, n_examples, cohesion) -> dict:
        self.catalog.save_concepts(self.spark.createDataFrame([(name, list(prototype), float(threshold), int(n_examples))], "name string, prototype array<float>, threshold double, n_examples int"))
        return {"name": name, "examples": n_examples, "threshold": threshold, "cohesion": cohesion}

    def boundary(self, name: str, limit: int = BOUNDARY_LIMIT) -> DataFrame:
        concept = self._concept(name)
        return self._with_files(search.boundary(self.catalog.read("embeddings"), concept["prototype"], concept["threshold"], limit))

    def review(self, name: str, path: str, is_match: bool) -> dict:
        """Record an answer about one file and learn again: yes pins the tag, no rejects it for good."""
        concept = self._concept(name)
        pair = self.spark.createDataFrame([(concept["id"], path)], TABLES["concept_rejections"])
        (self.catalog.clear_rejections if is_match else self.catalog.add_rejections)(pair)
        own = self.catalog.read("files").filter(F.col("path") == path).select(F.col("id").alias("file_id"), F.lit(concept["id"]).alias("concept_id"), F.lit("on" if is_match else "off").alias("state"))
        self.catalog.set_overrides(own)
        return self.relearn(name)

    def relearn(self, name: str) -> dict:
        """Learn a concept again from its pinned files and rejections."""
        concept = self._concept(name)
        pinned = self.catalog.read("concept_overrides").filter((F.col("concept_id") == concept["id"]) & (F.col("state") == "on"))
        paths = [r["path"] for r in pinned.join(self.catalog.read("files").withColumnRenamed("id", "file_id"), "file_id").select("path").collect()]
        rejected = self.catalog.read("concept_rejections").filter(F.col("concept_id") == concept["id"]).head(1)
        if not paths and not rejected:
            return {"name": name, "examples": concept["n_examples"], "threshold": concept["threshold"], "cohesion": 0.0}
        return self.teach(name, paths)

    def score(self) -> int:
        """Score the library against all concepts, replace their matches, return how many there are."""
        concepts = self.catalog.read("concepts")
        matches = score.score_library(self.catalog.read("embeddings"), concepts)
        self.catalog.replace_matches([r["id"] for r in concepts.select("id").collect()], matches)
        return self.catalog.read("file_concepts").count()

    # Searching and correcting.

    def _with_files(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.catalog.read("files").select(F.col("id").alias("file_id"), "path", "kind"), "file_id")

    def search(self, concept: str | None = None, text: str | None = None, examples: list[str] | None = None, person: str | None = None, limit: int = LIMIT, threshold: float | None = None) -> DataFrame:
        """Ranked files by a concept, a text, examples or a person."""
        e = self.catalog.read("embeddings")
        if concept is not None:
            hits = search.by_concept(e, self.catalog.read("concepts"), concept, limit, threshold)
        elif text is not None:
            hits = search.by_vector(e, self.embedder.embed_text(text), limit, threshold)
        elif examples:
            hits = search.by_examples(e, self._vectors(examples), limit, threshold)
        else:
            hits = search.by_person(self.catalog.read("file_faces"), self.catalog.read("people"), person, limit)
        return self._with_files(hits).orderBy(F.desc("score"), "file_id")

    def with_tags(self, names: list[str], mode: str = "any", limit: int | None = None, effective: bool = False) -> DataFrame:
        """Files with any or all tags; by stored matches, or with corrections (score 1 where pinned)."""
        fc, concepts = self.catalog.read("file_concepts"), self.catalog.read("concepts")
        if effective:
            fc = tags.effective(fc, self.catalog.read("concept_overrides")).join(fc, ["file_id", "concept_id"], "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
        return self._with_files(tags.matching(fc, concepts, names, mode, limit))

    def override(self, path: str, name: str, state: str | None) -> None:
        if state not in (*tags.STATES, None):
            raise ValueError(f"state must be one of {tags.STATES} or None, got {state!r}")
        own = self.catalog.read("files").filter(F.col("path") == path).select(F.col("id").alias("file_id"))
        self.catalog.set_overrides(own.select("file_id", F.lit(self._concept(name)["id"]).alias("concept_id"), F.lit(state).cast("string").alias("state")))

    def effective_tags(self) -> DataFrame:
        """path, tags of every file, corrections applied."""
        c = self.catalog
        pairs = tags.effective(c.read("file_concepts"), c.read("concept_overrides"))
        own = c.read("files").select(F.col("id").alias("file_id"), "path").join(tags.by_file(pairs, c.read("concepts")), "file_id", "left")
        return own.select("path", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))

    def library(self) -> DataFrame:
        c = self.catalog
        pairs = tags.effective(c.read("file_concepts"), c.read("concept_overrides"))
        return tags.library_view(c.read("files"), pairs, c.read("concepts"), c.read("file_faces"), c.read("people"))

    def verify(self, name: str, scorer, candidates: int = CANDIDATES) -> DataFrame:
        """The best candidates of a concept, ranked again by an external scorer of file ids."""
        return self._with_files(search.verify(self.catalog.read("embeddings"), self._concept(name)["prototype"], scorer, candidates))

    def verify_phrase(self, name: str, phrase: str | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """:meth:`verify` with the verifier that is plugged in, asked the given phrase, the stored one or the name. A
        :class:`Verifier` also tells boxes and errors."""
        if self.verifier is None:
            raise ValueError("no verifier is plugged in")
        stored = self._concept(name)["verify_phrase"]
        asked = phrase or stored or name.replace("-", " ")
        if hasattr(self.verifier, "verify"):
            c = self.catalog
            found = search.verify_files(c.read("embeddings"), c.read("files"), self._concept(name)["prototype"], verify_with(self.verifier, asked), candidates)
            return self._with_files(found.drop("path")).orderBy(F.desc("verified"), "file_id")
        return self.verify(name, self.verifier(asked), candidates).orderBy(F.desc("verified"), "file_id")

    # People.

    def rematch(self, threshold: float = THRESHOLD) -> int:
        """Match faces that nobody is assigned to; returns how many found someone."""
        old = self.catalog.read("file_faces")
        before = old.filter("person_id is not null").count()
        found = faces.rematch(old.filter("person_id is null"), self.catalog.read("person_faces"), threshold)
        self.catalog.upsert("file_faces", found.filter("person_id is not null"), "id")
        return self.catalog.read("file_faces").filter("person_id is not null").count() - before

    def _analyzer(self, given: FaceAnalyzer | None) -> FaceAnalyzer:
        if (given or self.analyzer) is None:
            raise ValueError("no face analyzer is plugged in")
        return given or self.analyzer

    def find_faces(self, analyzer: FaceAnalyzer | None = None, threshold: float = faces.THRESHOLD, least: float = LEAST_FACE) -> int:
        """Detect the faces of indexed images that have none yet, match them to known people and store
        them; returns how many. A file that can't be read has no faces."""
        todo = self.catalog.read("files").filter("kind = 'image'").join(self.catalog.read("file_faces").select(F.col("file_id").alias("id")), "id", "left_anti")
        found = Scratch(self.spark, "faces").keep(detect(todo.select(F.col("id").alias("file_id"), "path"), self._analyzer(analyzer), least))
        n = found.count()
        if n:
            keyed = found.withColumn("id", F.monotonically_increasing_id())
            who = faces.match(keyed, self.catalog.read("person_faces"), threshold).select("id", "person_id", "score")
            self.catalog.add_faces(keyed.join(who, "id", "left").drop("id", "side"))
        return n

    def register_person(self, name: str, paths: list[str], analyzer: FaceAnalyzer | None = None, mode: str = "extend", every: bool = False) -> int:
        """Make a person's references from photographs: the largest face of each, or every face;
        returns how many were added. Photographs without a face are skipped."""
        photos = self.spark.createDataFrame(list(enumerate(dict.fromkeys(paths))), "file_id long, path string")
        found = detect(photos, self._analyzer(analyzer), 0.0)
        if not every:
            found = found.groupBy("file_id").agg(F.max_by(F.struct("vector", "bbox"), F.struct("side", -F.col("seq"))).alias("f")).select("file_id", "f.vector", "f.bbox")
        rows = found.join(photos, "file_id").select("vector", F.col("path").alias("source")).collect()  # of photographs chosen by hand
        if not rows:
            raise ValueError("no face in any of the photographs")
        old = self.catalog.read("person_faces")
        first = 1 + old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = self.spark.createDataFrame([(first + i, r["vector"], r["source"]) for i, r in enumerate(rows)], "id long, vector array<float>, source string")
        person = self.catalog.upsert_person(name)
        references = faces.register(old.select("id", "person_id", "vector", "source"), person, new, mode)
        self.catalog.replace_references(person, references.filter(F.col("person_id") == person))
        return len(rows)

    def name_cluster(self, face_ids: list[int], name: str) -> None:
        person = self.catalog.upsert_person(name)
        assigned, references = faces.name_cluster(self.catalog.read("file_faces"), self.catalog.read("person_faces"), face_ids, person)
        self.catalog.replace_references(person, references.filter(F.col("person_id") == person))
        self.catalog.upsert("file_faces", assigned.filter(F.col("person_id") == person), "id")

    # Duplicates and names.

    def duplicates(self, most: int | None = None) -> DataFrame:
        files = self.catalog.read("files")
        return duplicates.combine(duplicates.exact_groups(files), duplicates.near_groups(files, most))

    def collect_duplicates(self, destination: str, mode: str = "symlink", dry_run: bool = False) -> dict:
        """Put redundant copies into a folder; moved files are followed in the index."""
        files = self.catalog.read("files")
        members = duplicates.combined_members(duplicates.exact_members(files), duplicates.near_members(files))
        paths = [r["path"] for r in duplicates.redundant_files(members).select("path").distinct().orderBy("path").toLocalIterator()]  # files on the driver's disk
        done = renames.place(paths, destination, mode, dry_run)
        if mode == "move" and not dry_run and done["placed"]:
            self.catalog.rename_files(self.spark.createDataFrame(done["placed"], "source string, target string"))
        return done

    def listing(self) -> DataFrame | None:
        """The files on disk under the library's folders; None without any."""
        out = None
        for r in self.catalog.read("roots").select("path").distinct().collect():  # folders that a user has added
            if os.path.exists(r["path"]):
                found = discovery.listing(self.spark, r["path"])
                out = found if out is None else out.unionByName(found)
        return out if out is None else out.dropDuplicates(["path"])

    def _tagged(self, listing: DataFrame | None) -> DataFrame:
        """path, primary, tags of all indexed files and their companions on disk."""
        own = self.effective_tags()
        listing = self.listing() if listing is None else listing
        everything = own.select("path") if listing is None else companions.find(own, listing)
        return companions.primary_tags(companions.members(everything), own)

    def plan(self, mode: str, listing: DataFrame | None = None) -> DataFrame:
        """source, target (and tag, matched, claims of moves) of what organizing would change; ``listing``:
        the files on disk (path), else those under the library's folders."""
        tagged, concepts = self._tagged(listing), self.catalog.read("concepts")
        if mode == "rename":
            return renames.plan_renames(tagged, [r["name"] for r in concepts.select("name").collect()])
        named = tags.with_names(self.catalog.read("file_concepts"), concepts).join(self.catalog.read("files").withColumnRenamed("id", "file_id"), "file_id")
        scores = named.select("path", F.col("name").alias("tag"), "score")
        to, inverse = (concepts.filter(f"{c} is not null").select(F.col("name").alias("tag"), F.col(c).alias("folder")) for c in ("destination", "inverse_destination"))
        return renames.plan_moves(tagged, to, scores, inverse)

    def resolve(self, plans: DataFrame) -> DataFrame:
        """source, target, filed of plans after their collisions with files on disk and with each other."""
        scratch = Scratch(self.spark, "plans")
        plans = scratch.keep(plans.select("source", "target"))
        case_only = F.lower("source") == F.lower("target")
        sources = plans.select(F.col("source").alias("path"))
        folders = [r[0] for r in plans.select(paths.parent(F.col("target"))).distinct().collect() if os.path.isdir(r[0])]  # folders on the driver's disk
        found = None
        for folder in folders:
            own = discovery.listing(self.spark, folder, recursive=False).select("path")
            found = own if found is None else found.unionByName(own)
        if found is None:
            found = sources.limit(0)
        # A name whose holder is about to leave it is free by the time it's needed.
        found = scratch.keep(found.join(plans.filter(~case_only).select(F.col("source").alias("path")), "path", "left_anti"))
        met = plans.filter(~case_only).join(found.withColumnRenamed("path", "target"), "target").collect()  # names that are taken: their bytes are compared on this disk
        alike = [r for r in met if renames.same_content(r["source"], r["target"])]
        kind = "source string, target string, content_hash binary"
        marked = self.spark.createDataFrame([(r["source"], r["target"], b"same") for r in alike], kind)
        held = found.join(marked.select(F.col("target").alias("path"), "content_hash").distinct(), "path", "left")
        own = plans.filter(~case_only).join(marked, ["source", "target"], "left")
        return renames.resolve_collisions(own, held).unionByName(plans.filter(case_only).withColumn("filed", F.lit(False)))

    def organize(self, mode: str | None = None, root: str | None = None, dry_run: bool = False, listing: DataFrame | None = None) -> dict:
        """Write tags into names or file by destination; both are journalled and undone alike. Companions
        on disk travel along; files whose destination already holds their bytes stay and are counted."""
        mode = mode or self.catalog.setting("organize_mode", "rename")
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
        nothing = {"mode": mode, "changed": 0, "already_filed": 0, "errors": [], "changes": []}
        if mode == "off":
            return nothing
        if mode == "move" and self.catalog.read("concepts").filter("destination is not null or inverse_destination is not null").isEmpty():
            return nothing | {"errors": ["no tag has a destination folder"]}
        if not dry_run:
            self.repair()
        planned = Scratch(self.spark, "organize").keep(self.plan(mode, listing))
        resolved = self.resolve(planned).orderBy("source").collect()  # files on the driver's disk
        contested = planned.filter("matched and claims > 1").orderBy("source").collect() if mode == "move" else []
        wanted = [(r["source"], r["target"]) for r in resolved if not r["filed"]]
        number = self.catalog.begin_renames(self.spark.createDataFrame([(k, *p) for k, p in enumerate(wanted)], "seq int, source string, target string")) if wanted and not dry_run else None
        done = renames.apply_renames(wanted, None, dry_run)
        if number is not None:
            self.catalog.finish_renames(number, self.spark.createDataFrame([(k, *p) for k, p in enumerate(done["renamed"])], "seq int, source string, target string"))
        notes = [f"{r['source']}: {r['claims']} tags have a destination, filed by {r['tag']}" for r in contested]
        return {"mode": mode, "changed": len(done["renamed"]), "already_filed": sum(r["filed"] for r in resolved), "errors": [*done["errors"], *notes], "changes": done["renamed"]}

    def repair(self) -> int:
        """Close batches of renames that an earlier run left open: what happened on disk is followed in the index,
        the rest forgotten. Returns how many files had been renamed."""
        moved = 0
        rows = self.catalog.open_renames().collect()  # files on the driver's disk
        targets = {r["target"] for r in rows}
        for number in sorted({r["batch_id"] for r in rows}):
            did = [(r["source"], r["target"]) for r in rows if r["batch_id"] == number and os.path.lexists(r["target"]) and (not os.path.lexists(r["source"]) or r["source"] in targets)]
            self.catalog.finish_renames(number, self.spark.createDataFrame([(k, *p) for k, p in enumerate(_in_turn(did))], "seq int, source string, target string"))
            moved += len(did)
        return moved

    def undo(self, root: str | None = None) -> int:
        """Take the last organizing back; returns how many files."""
        self.repair()
        journal = self.catalog.read("rename_batches")
        number = journal.agg(F.max("batch_id")).first()[0]
        if number is None:
            return 0
        batch = [(r["source"], r["target"]) for r in journal.filter(F.col("batch_id") == number).orderBy("seq").collect()]  # files on the driver's disk
        undone = renames.take_back(batch)
        self.catalog.undo_renames(number, self.spark.createDataFrame([(source, target) for target, source in undone], "source string, target string"))
        return len(undone)

    def status(self) -> dict:
        c = self.catalog
        return tags.status(c.read("files"), c.read("embeddings"), c.read("concepts"), c.read("file_faces")).first().asDict()

    def pending(self) -> int:
        """Files whose name doesn't carry their tags."""
        return self.plan("rename").count()
