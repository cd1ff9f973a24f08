"""The library's tables on storage, merged when they are read.

A table is a list of parts (folders of parquet files) in the order in which they came, and matches have parts
by concept. The manifest, a numbered file, names the parts of all tables; a change writes new parts first and
the next manifest last, in one step, so a change that touches several tables is seen whole or not at all, and
parts that are being read are never overwritten. :meth:`vacuum` deletes parts that no recent manifest names.

Rows are appended as a further part. Rows are deleted by a part of keys, which hides the rows with these keys
in all earlier parts; rows are changed by both in one step. So a change writes in proportion to its own rows,
whatever the table holds. Keys are compared null-safe. Where parts grow many, the newest are merged with
those that are not much larger, so a row is written anew a number of times that follows the logarithm of the
table; where keys outweigh half of their table, it is written anew without the rows that they hide.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from likeness.sources.schema import TABLES, migrate
from likeness.sources.scratch import Scratch

#: The table with parts by concept.
MATCHES = "file_concepts"
#: Parts of a table, or of keys that hide rows of it, above which the newest are merged.
MOST_PARTS = 16
#: Keys that take less than this (bytes) are never worth writing their table anew.
FEW_KEYS = 32 << 20


def _change(method):
    """What a method of the catalogue writes is committed at its end, or at that of the change around it."""

    @wraps(method)
    def run(self, *args, **named):
        with self.change():
            return method(self, *args, **named)

    return run


def _place(part: list) -> int:
    return part[2] if len(part) > 2 else 0


class Catalog:
    """Tables under a folder. One writer at a time; a second one's commit raises."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._pending: dict | None = None
        self._scratch: Scratch | None = None

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self._conf)

    # Manifests: {table: [part, ...]}, for matches {concept: part}, and {table + "/hidden": [part, ...]} for keys that
    # hide rows. A part is [name, columns, place in the order, bytes]; older manifests have the first two alone.

    def _manifests(self) -> list[int]:
        folder, files = self._path("manifests"), self._files()
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _load(self, number: int) -> dict:
        stream = self._files().open(self._path("manifests", f"{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _state(self) -> dict:
        if self._pending is not None:
            return self._pending
        numbers = self._manifests()
        return self._load(numbers[-1]) if numbers else {}

    @contextmanager
    def change(self):
        """What is written inside becomes visible to others at the end, all at once; nothing of it after an error."""
        if self._pending is not None:
            kept = json.dumps(self._pending)
            try:
                yield self
            except BaseException:
                self._pending = json.loads(kept)
                raise
            return
        numbers = self._manifests()
        before = self._load(numbers[-1]) if numbers else {}
        self._pending, self._scratch = json.loads(json.dumps(before)), Scratch(self.spark, "change")
        try:
            yield self
            if self._pending != before:
                self._commit((numbers[-1] if numbers else 0) + 1, self._pending)
        finally:
            self._scratch.clear()
            self._pending = self._scratch = None

    def _commit(self, number: int, state: dict) -> None:
        files, target = self._files(), self._path("manifests", f"{number}.json")
        if files.exists(target):
            raise RuntimeError(f"{self.root} was changed by another writer")
        written = self._path("manifests", f".{uuid.uuid4().hex}")
        out = files.create(written, False)
        out.write(json.dumps(state).encode())
        out.close()
        if not files.rename(written, target):
            raise RuntimeError(f"{self.root} was changed by another writer")

    def vacuum(self, manifests: int = 2) -> int:
        """Delete the parts that the latest manifests don't name, and older manifests; returns how many parts."""
        numbers, files = self._manifests(), self._files()
        named = set()
        for n in numbers[-manifests:]:
            for parts in self._load(n).values():
                named |= {p[0] for p in (parts.values() if isinstance(parts, dict) else parts)}
        gone = 0
        for table in TABLES:
            folder = self._path(table)
            for status in files.listStatus(folder) if files.exists(folder) else []:
                if f"{table}/{status.getPath().getName()}" not in named:
                    gone += files.delete(status.getPath(), True)
        for n in numbers[:-manifests]:
            files.delete(self._path("manifests", f"{n}.json"), False)
        return gone

    def _held(self, table: str) -> bool:
        return bool(self._state().get(table))

    def _parts(self, table: str) -> list[list]:
        held = self._state().get(table) or []
        return list(held.values()) if isinstance(held, dict) else held

    def _hidden(self, table: str) -> list[list]:
        return self._state().get(f"{table}/hidden", [])

    def _next(self, table: str) -> int:
        """The place of the next part of a table, or of keys."""
        return 1 + max((_place(p) for p in [*self._parts(table), *self._hidden(table)]), default=0)

    def _part(self, table: str, df: DataFrame, place: int) -> list:
        """Write a part; its entry in the manifest."""
        name = f"{table}/{uuid.uuid4().hex}"
        columns = df.columns
        if table == MATCHES and "concept_id" in columns and "score" in columns:
            # rows of a concept come to few tasks, those of a large one to several
            df.hint("rebalance", "concept_id").write.partitionBy("concept_id").parquet(f"{self.root}/{name}")
        else:
            df.write.parquet(f"{self.root}/{name}")
        return [name, columns, place, self._bytes(name)]

    def _bytes(self, name: str) -> int:
        return self._files().getContentSummary(self._path(name)).getLength()

    def _size(self, part: list) -> int:
        return part[3] if len(part) > 3 else self._bytes(part[0])

    def read(self, name: str) -> DataFrame:
        """A table as of now."""
        held = self._state().get(name)
        if not held:
            return self.spark.createDataFrame([], TABLES[name])
        return self._rows(name, held)

    def _rows(self, table: str, held: list | dict) -> DataFrame:
        """The rows of some parts of a table that no later key hides."""
        alike: dict[tuple, list[str]] = {}
        if table == MATCHES:
            for concept, part in held.items():
                alike.setdefault((_place(part), part[0]), []).append(f"{self.root}/{part[0]}/concept_id={concept}")
            load = lambda key, paths: self.spark.read.option("basePath", f"{self.root}/{key[1]}").schema(TABLES[table]).parquet(*paths)
        else:
            last = max((_place(p) for p in self._hidden(table)), default=0)
            for part in held:  # parts that no key can hide rows of are read at once
                alike.setdefault((min(_place(part), last), *part[1]), []).append(f"{self.root}/{part[0]}")
            load = lambda _, paths: self.spark.read.parquet(*paths)
        frames = [(key[0], migrate(load(key, paths), table)) for key, paths in alike.items()]
        columns, out = frames[0][1].columns, None
        for place, frame in frames:
            frame = frame.withColumn("_place", F.lit(place))
            out = frame if out is None else out.unionByName(frame)
        for keys, parts in self._hidden_by_keys(table).items():
            gone = self._keys(parts).withColumnsRenamed({k: f"_{k}" for k in keys} | {"_place": "_until"})
            hidden = F.col("_until") > F.col("_place")
            for k in keys:
                hidden = hidden & F.col(k).eqNullSafe(F.col(f"_{k}"))
            out = out.join(gone, hidden, "left_anti")
        return out.select(columns)

    def _hidden_by_keys(self, table: str) -> dict[tuple, list[list]]:
        out: dict[tuple, list[list]] = {}
        for part in self._hidden(table):
            out.setdefault(tuple(c for c in part[1] if c != "_place"), []).append(part)
        return out

    def _keys(self, parts: list[list]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{p[0]}" for p in parts])

    @_change
    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table."""
        part = self._part(name, migrate(df, name), self._next(name))
        self._pending[name] = self._concepts_of(part) if name == MATCHES else [part]
        self._pending.pop(f"{name}/hidden", None)

    def _concepts_of(self, part: list) -> dict:
        """The concepts that a part of matches has rows of."""
        names = [s.getPath().getName() for s in self._files().listStatus(self._path(part[0]))]
        return {n.removeprefix("concept_id="): part for n in names if n.startswith("concept_id=")}

    @_change
    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows, as a further part."""
        if table == MATCHES:
            self.write(table, self.read(table).unionByName(migrate(rows, table)))
        else:
            self._pending[table] = [*self._parts(table), self._part(table, migrate(rows, table), self._next(table))]
            self._merge(table)

    @_change
    def delete(self, table: str, gone: DataFrame, *by: str) -> None:
        """Delete the rows of a table that agree with ``gone`` in some columns."""
        types = self.read(table).schema
        gone = gone.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in by])
        if self._held(table) and not gone.isEmpty():
            place = self._next(table)
            part = self._part(table, gone.distinct().withColumn("_place", F.lit(place)), place)
            self._pending[f"{table}/hidden"] = [*self._hidden(table), part]
            self._merge(table)

    @_change
    def upsert(self, table: str, rows: DataFrame, *by: str) -> None:
        """Add rows in place of those that agree with them in some columns."""
        rows = self._scratch.keep(migrate(rows, table))
        if not rows.isEmpty():
            self.delete(table, rows, *by)
            self.append(table, rows)

    def _merge(self, table: str) -> None:
        """Merge the newest parts where there are many, and drop keys that hide nothing any more."""
        held = self._parts(table)
        if table != MATCHES and len(held) > MOST_PARTS:
            first = self._newest(held)
            merged = self._part(table, self._rows(table, held[first:]), _place(held[-1]))
            self._pending[table] = held = [*held[:first], merged]
        oldest = min(map(_place, held), default=0)
        left = []
        for keys, parts in self._hidden_by_keys(table).items():
            parts = [p for p in parts if _place(p) > oldest]
            if len(parts) > MOST_PARTS:
                first = self._newest(parts)
                latest = self._keys(parts[first:]).groupBy(*keys).agg(F.max("_place").alias("_place"))
                parts = [*parts[:first], self._part(table, latest, _place(parts[-1]))]
            left += parts
        self._pending.pop(f"{table}/hidden", None)
        if left:
            self._pending[f"{table}/hidden"] = left
        size = sum(map(self._size, left))
        if size > FEW_KEYS and 2 * size > sum(map(self._size, {p[0]: p for p in held}.values())):
            self.write(table, self.read(table))

    def _newest(self, parts: list[list]) -> int:
        """From which part on to merge: half of them, and older ones while they are at most twice as large."""
        first = len(parts) - MOST_PARTS // 2
        size = sum(map(self._size, parts[first:]))
        while first and self._size(parts[first - 1]) <= 2 * size:
            first -= 1
            size += self._size(parts[first])
        return first

    def _last_id(self, table: str) -> int:
        return self.read(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def _numbered(self, rows: DataFrame, table: str, *order: str) -> DataFrame:
        """``rows`` with ids from the table's last + 1 on, dense, in order; numbered within ranges, which are
        then shifted by the ranges before them, so no task sees all rows."""
        from pyspark.sql import Window

        after = self._last_id(table)
        parts = self._scratch.keep(rows.drop("id").repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
        sizes = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).select("_part", "_before")  # a row per task
        own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
        return parts.join(F.broadcast(sizes), "_part").withColumn("id", (own + F.col("_before") + after).cast("long")).drop("_part", "_before")

    # Files and what hangs on them.

    @_change
    def upsert_files(self, rows: DataFrame) -> DataFrame:
        """Insert or replace files by path; ids stay. What was derived from a replaced file's content
        (embeddings, faces, matches) goes, corrections stay. Returns the rows with their ids."""
        files = self.read("files")
        known = files.select("path", F.col("id").alias("old"))
        joined = self._scratch.keep(rows.drop("id").dropDuplicates(["path"]).join(known, "path", "left"))
        old = joined.filter("old is not null").withColumnRenamed("old", "id")
        fresh = self._numbered(joined.filter("old is null").drop("old"), "files", "path")
        if not old.isEmpty():
            replaced = old.select(F.col("id").alias("file_id"))
            for table in ("embeddings", "file_faces", MATCHES):
                self.delete(table, replaced, "file_id")
            self.upsert("files", old, "id")
        if not fresh.isEmpty():
            self.append("files", fresh)
        return self.read("files").join(rows.select("path"), "path", "left_semi")

    @_change
    def forget(self, gone: DataFrame) -> int:
        """Delete files (id) with everything that hangs on them; returns how many."""
        files = self.read("files")
        gone = self._scratch.keep(files.join(gone.select("id"), "id", "left_semi").select("id"))
        for table in ("embeddings", "file_faces", MATCHES, "concept_overrides"):
            self.delete(table, gone.select(F.col("id").alias("file_id")), "file_id")
        self.delete("files", gone, "id")
        return gone.count()

    @_change
    def rename_files(self, renames: DataFrame) -> None:
        """Change paths (source, target) in the index, all at once; a file at a target that isn't renamed itself
        gives way."""
        gone = renames.select(F.col("target").alias("path")).join(renames.select(F.col("source").alias("path")), "path", "left_anti")
        files = self.read("files")
        moved = files.join(renames.withColumnsRenamed({"source": "path", "target": "new"}).select("path", "new"), "path")
        moved = self._scratch.keep(moved.withColumn("path", F.coalesce("new", "path")).drop("new"))
        self.delete("files", files.join(gone, "path", "left_semi"), "id")
        self.upsert("files", moved, "id")

    # The journal of renames: a batch is written before files are touched, and closed in the step that changes
    # their paths. One that was left open tells what may have happened on disk.

    @_change
    def begin_renames(self, plans: DataFrame) -> int:
        """Write a batch of intended renames (seq, source, target); returns its number."""
        journal = self.read("rename_batches")
        number = 1 + (journal.agg(F.max("batch_id")).first()[0] or 0)
        self.append("rename_batches", plans.select(F.lit(number).cast("long").alias("batch_id"), F.col("seq").cast("int").alias("seq"), "source", "target", F.lit(False).alias("done")))
        return number

    @_change
    def finish_renames(self, number: int, done: DataFrame) -> None:
        """Change the paths of a batch's renames that were carried out (seq: in which order, source, target) and keep
        those in the journal."""
        done = self._scratch.keep(done.select(F.col("seq").alias("order"), "source", "target"))
        self.rename_files(done.drop("order"))
        journal = self.read("rename_batches")
        kept = journal.filter(F.col("batch_id") == number).join(done, ["source", "target"]).withColumns({"seq": F.col("order").cast("int"), "done": F.lit(True)})
        kept = self._scratch.keep(kept.select(journal.columns))
        self.delete("rename_batches", journal.filter(F.col("batch_id") == number), "batch_id")
        self.append("rename_batches", kept)

    @_change
    def undo_renames(self, number: int, undone: DataFrame | None = None) -> None:
        """Take a batch's renames back in the index, or those alone that ``undone`` (source, target) has, and
        drop the batch."""
        journal = self.read("rename_batches")
        own = journal.filter((F.col("batch_id") == number) & F.col("done"))
        own = own if undone is None else own.join(undone.select("source", "target"), ["source", "target"], "left_semi")
        self.rename_files(self._scratch.keep(own.select(F.col("target").alias("source"), F.col("source").alias("target"))))
        self.delete("rename_batches", journal.filter(F.col("batch_id") == number), "batch_id")

    def open_renames(self) -> DataFrame:
        """Batches whose outcome the journal doesn't know."""
        return self.read("rename_batches").filter("not coalesce(done, false)")

    @_change
    def add_embeddings(self, rows: DataFrame) -> None:
        """Append vectors from rows of parallel lists (file_id, vectors, frame_times, boxes); lists of
        different lengths raise."""
        uneven = rows.filter((F.size("vectors") != F.size("frame_times")) | (F.size("vectors") != F.size("boxes"))).head(1)
        if uneven:
            raise ValueError(f"file {uneven[0]['file_id']}: vectors, times and boxes differ in number")
        each = rows.select("file_id", F.explode(F.arrays_zip("vectors", "frame_times", "boxes")).alias("e"))
        each = each.select("file_id", F.col("e.vectors").alias("vector"), F.col("e.frame_times").alias("frame_time"), F.col("e.boxes").alias("box"))
        self.append("embeddings", self._numbered(each, "embeddings", "file_id", "frame_time"))

    # Concepts, corrections, people.

    @_change
    def save_concepts(self, rows: DataFrame) -> None:
        """Insert or replace concepts by name: prototype, threshold and count are replaced; id,
        destinations and phrase stay."""
        old = self.read("concepts")
        new = rows.select("name", F.col("prototype").alias("p"), F.col("threshold").alias("t"), F.col("n_examples").alias("n"))
        kept = old.join(new, "name", "left").withColumns({"prototype": F.coalesce("p", "prototype"), "threshold": F.coalesce("t", "threshold"), "n_examples": F.coalesce("n", "n_examples")})
        added = self._numbered(rows.join(old.select("name"), "name", "left_anti"), "concepts", "name")
        self.write("concepts", migrate(kept, "concepts").unionByName(migrate(added, "concepts")))

    @_change
    def update_concept(self, name: str, **values: str | None) -> None:
        """Set destination, inverse_destination or verify_phrase; empty clears."""
        columns = {k: F.when(F.col("name") == name, F.lit(v or None).cast("string")).otherwise(F.col(k)) for k, v in values.items()}
        self.write("concepts", self.read("concepts").withColumns(columns))

    @_change
    def delete_concept(self, name: str) -> bool:
        """Delete a concept with its matches, corrections and rejections; whether there was one."""
        gone = self.read("concepts").filter(F.col("name") == name).select("id")
        ids = [r["id"] for r in gone.limit(2).collect()]
        for table in ("concept_overrides", "concept_rejections"):
            self.delete(table, gone.select(F.col("id").alias("concept_id")), "concept_id")
        if ids:
            self._pending[MATCHES] = {c: part for c, part in self._state().get(MATCHES, {}).items() if int(c) not in ids}
            self.delete("concepts", gone, "id")
        return bool(ids)

    @_change
    def replace_matches(self, concept_ids: list[int], matches: DataFrame) -> None:
        """Replace all matches of some concepts; an empty set clears them. Of several scores of a pair
        the largest counts. Matches of other concepts are neither read nor written."""
        own = [int(c) for c in concept_ids]
        one = matches.filter(F.col("concept_id").isin(own)).groupBy("file_id", "concept_id").agg(F.max("score").alias("score"))
        new = self._concepts_of(self._part(MATCHES, migrate(one, MATCHES), self._next(MATCHES)))
        kept = {c: part for c, part in self._state().get(MATCHES, {}).items() if int(c) not in own}
        self._pending[MATCHES] = kept | new
        self._merge(MATCHES)

    @_change
    def add_rejections(self, rows: DataFrame) -> None:
        self.upsert("concept_rejections", rows.dropDuplicates(["concept_id", "path"]), "concept_id", "path")

    @_change
    def clear_rejections(self, rows: DataFrame) -> None:
        self.delete("concept_rejections", rows, "concept_id", "path")

    @_change
    def set_overrides(self, rows: DataFrame) -> None:
        """The given states replace earlier ones; a null state clears."""
        bad = rows.filter(F.col("state").isNotNull() & ~F.col("state").isin("on", "off")).head(1)
        if bad:
            raise ValueError(f"state must be on, off or null, got {bad[0]['state']!r}")
        rows = self._scratch.keep(rows.select("file_id", "concept_id", "state"))
        self.delete("concept_overrides", rows, "file_id", "concept_id")
        stated = rows.filter("state is not null")
        if not stated.isEmpty():
            self.append("concept_overrides", stated)

    @_change
    def log_overrides(self, entries: DataFrame) -> None:
        """Apply entries of a log of corrections (file_id, concept_id, state, ts, event_id): for each pair
        the latest entry of these and earlier calls holds; a null state clears."""
        pair, order = ["file_id", "concept_id"], F.struct("ts", "event_id")
        last = lambda rows: rows.groupBy(*pair).agg(F.max_by(F.struct("state", "ts", "event_id"), order).alias("last")).select(*pair, "last.*")
        known = self.read("override_times")
        entries = self._scratch.keep(migrate(entries, "override_times"))
        latest = self._scratch.keep(last(known.join(entries, pair, "left_semi").unionByName(entries)))
        self.set_overrides(latest.select(*pair, "state"))
        self.upsert("override_times", latest, *pair)

    @_change
    def replace_references(self, person_id: int, faces: DataFrame) -> None:
        """A person's reference faces, replaced; their number follows."""
        faces = self._scratch.keep(migrate(faces.withColumn("person_id", F.lit(person_id)), "person_faces"))
        self.delete("person_faces", self.spark.range(1).select(F.lit(person_id).alias("person_id")), "person_id")
        self.append("person_faces", faces)
        n = faces.count()
        self.write("people", self.read("people").withColumn("n_examples", F.when(F.col("id") == person_id, F.lit(n)).otherwise(F.col("n_examples"))))

    @_change
    def delete_person(self, name: str) -> bool:
        """Delete a person and their references; faces found stay, unassigned, with their score."""
        ids = [r["id"] for r in self.read("people").filter(F.col("name") == name).select("id").limit(2).collect()]
        if ids:
            gone = self._scratch.keep(self.read("people").filter(F.col("id").isin(ids)))
            self.delete("person_faces", gone.select(F.col("id").alias("person_id")), "person_id")
            self.upsert("file_faces", self.read("file_faces").filter(F.col("person_id").isin(ids)).withColumn("person_id", F.lit(None)), "id")
            self.delete("people", gone, "id")
        return bool(ids)

    @_change
    def upsert_person(self, name: str) -> int:
        """The id of a person, new or known."""
        people = self.read("people")
        found = people.filter(F.col("name") == name).head(1)
        if found:
            return found[0]["id"]
        new = 1 + self._last_id("people")
        self.append("people", self.spark.createDataFrame([(new, name, 0)], "id long, name string, n_examples int"))
        return new

    @_change
    def add_faces(self, rows: DataFrame) -> None:
        """Append found faces (file_id, vector, frame_time, bbox and, if matched, person_id and score)."""
        self.append("file_faces", self._numbered(rows, "file_faces", "file_id", "bbox"))

    @_change
    def assign_face(self, face_id: int, person_id: int | None, score: float | None = None) -> None:
        own = self.read("file_faces").filter(F.col("id") == face_id)
        self.upsert("file_faces", own.withColumns({"person_id": F.lit(person_id), "score": F.lit(score)}), "id")

    @_change
    def set_setting(self, key: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, value)], TABLES["meta"]), "key")

    def setting(self, key: str, default: str | None = None) -> str | None:
        found = self.read("meta").filter(F.col("key") == key).head(1)
        return found[0]["value"] if found else default
