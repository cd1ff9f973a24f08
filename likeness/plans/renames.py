"""Planning renames and moves as tables; applying and undoing them.

Planning is relational and has no side effect. Files are renamed on the driver, in rounds.
"""

from __future__ import annotations

import filecmp
import json
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.functions import naming, paths
from likeness.operators.joins import join_unique
from likeness.sources.scratch import Scratch


def plan_renames(tagged: DataFrame, known: list[str]) -> DataFrame:
    """source, target, case_only of the files (path, tags) whose name doesn't carry their tags."""
    path = F.col("path")
    target = F.concat_ws("/", F.when(paths.parent(path) != "", paths.parent(path)), naming.retag(paths.name(path), F.col("tags"), known))
    target = F.when(path.startswith("/") & (paths.parent(path) == ""), F.concat(F.lit("/"), target)).otherwise(target)
    return tagged.select(path.alias("source"), target.alias("target")).filter("source <> target").withColumn("case_only", paths.case_only(F.col("source"), F.col("target")))


def plan_moves(tagged: DataFrame, destinations: DataFrame, scores: DataFrame | None = None, inverse: DataFrame | None = None) -> DataFrame:
    """source, target, tag, matched, claims: where each file (path, primary, tags) goes.

    ``destinations`` and ``inverse``: tag, folder. The highest-scoring tag (``scores``: path, tag,
    score) of those with a destination decides, ties alphabetically; without one the first tag that
    the file does not carry and that has an inverse destination. The primary decides for its whole
    group. ``claims`` over 1 is worth a note; files already in their folder aren't planned.
    """
    own = tagged.select("path", "primary", "tags")
    primaries = own.filter("path = primary").select(F.col("path").alias("primary"), "tags")
    claims = primaries.select("primary", F.explode("tags").alias("tag")).distinct().join(destinations.select("tag", "folder").filter("folder <> ''"), "tag")
    if scores is None:
        claims = claims.withColumn("score", F.lit(0.0))
    else:
        claims = claims.join(scores.select(F.col("path").alias("primary"), "tag", "score"), ["primary", "tag"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    first = F.min_by(F.struct("tag", "folder"), F.struct(-F.col("score"), F.col("tag"))).alias("best")
    decided = claims.groupBy("primary").agg(first, F.count("*").alias("claims")).withColumn("matched", F.lit(True))
    if inverse is not None:
        rest = primaries.join(decided.select("primary"), "primary", "left_anti")
        # The first in order that a file lacks: the smallest number missing among those of the tags it carries.
        folders = [(r["tag"], r["folder"]) for r in inverse.filter("folder <> ''").groupBy("tag").agg(F.min("folder").alias("folder")).orderBy("tag").collect()]  # a user's settings
        numbers = primaries.sparkSession.createDataFrame([(n, *f) for n, f in enumerate(folders)], "number int, tag string, folder string")
        carried = rest.select("primary", F.explode("tags").alias("tag")).join(numbers, "tag").groupBy("primary").agg(F.collect_set("number").alias("held"))
        lacking = rest.select("primary").join(carried, "primary", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
        lacking = lacking.withColumn("number", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("held")), "held")))
        best = F.struct("tag", "folder").alias("best")
        other = lacking.join(numbers, "number").select("primary", best, (F.lit(len(folders)) - F.size("held")).cast("long").alias("claims"), F.lit(False).alias("matched"))
        decided = decided.unionByName(other)
    out = own.join(decided, "primary").select(F.col("path").alias("source"), F.concat("best.folder", F.lit("/"), paths.name(F.col("path"))).alias("target"), F.col("best.tag").alias("tag"), "matched", "claims")
    return out.filter("source <> target")


def numbered(names: Column, order: list[Column]) -> Column:
    """The n-th holder of a name gets ``-n`` before its suffix, from the second on."""
    n = F.row_number().over(Window.partitionBy(names).orderBy(*order))
    return F.when(n == 1, names).otherwise(F.concat(paths.stem(names), F.lit("-"), n.cast("string"), paths.suffix(names)))


def resolve_collisions(plans: DataFrame, listing: DataFrame) -> DataFrame:
    """source, target, filed: where plans (source, target, content_hash) go if files of ``listing`` (path,
    content_hash) or other plans hold their names. A target held by equal content is already filed. Of
    the other plans for a free name the first in order of source gets it; the rest, and those whose name
    is held, are named after their folder where that helps and the name is free and no earlier plan's,
    else numbered with the lowest free numbers from 2 on. No two plans get one name, none a held one.
    """
    held = listing.select(F.col("path").alias("target"), F.col("content_hash").alias("held")).dropDuplicates(["target"])
    own = plans.select("source", "target", "content_hash").join(held.withColumn("taken", F.lit(True)), "target", "left")
    own = own.withColumns({"taken": F.coalesce("taken", F.lit(False)), "filed": F.coalesce(F.col("held") == F.col("content_hash"), F.lit(False))})
    first = F.row_number().over(Window.partitionBy("target").orderBy("source")) == 1
    own = own.withColumn("as_wanted", F.col("filed") | (~F.col("taken") & first))
    target = F.col("target")
    folder = F.when(target.contains("/"), F.concat(paths.parent(target), F.when(paths.parent(target) == "/", "").otherwise("/"))).otherwise("")
    hinted = F.concat(folder, paths.stem(target), F.lit(" ("), paths.disambiguator(F.col("source")), F.lit(")"), paths.suffix(target))
    done = own.filter("as_wanted").select("source", "target", "filed")
    rest = own.filter("not as_wanted").select("source", "target", hinted.alias("hinted"))
    names = done.filter("not filed").select("target").unionByName(held.select("target"))
    free = rest.filter("hinted is not null").join(names.select(F.col("target").alias("hinted")), "hinted", "left_anti")
    by_folder = free.groupBy("hinted").agg(F.min("source").alias("source"))
    names = names.unionByName(by_folder.select(F.col("hinted").alias("target")))
    rest = rest.drop("hinted").join(by_folder, "source", "left")
    done = done.unionByName(rest.filter("hinted is not null").select("source", F.col("hinted").alias("target"), F.lit(False).alias("filed")))
    rest = rest.filter("hinted is null").withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("source")))
    # Names that look numbered: target and number.
    number = F.regexp_extract(paths.stem(target), r"-([1-9][0-9]{0,8})$", 1)
    used = names.filter(number != "").select(F.concat(folder, F.regexp_replace(paths.stem(target), r"-[0-9]+$", ""), paths.suffix(target)).alias("target"), number.cast("long").alias("number")).distinct()
    wanted = rest.groupBy("target").agg(F.count("*").alias("most"))
    used = used.join(wanted, "target", "left_semi")
    room = wanted.join(used.groupBy("target").agg(F.count("*").alias("more")), "target", "left")
    numbers = room.select("target", F.explode(F.sequence(F.lit(2).cast("long"), F.col("most") + 1 + F.coalesce("more", F.lit(0)))).alias("number")).join(used, ["target", "number"], "left_anti")
    numbers = numbers.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("number")))
    counted = F.concat(folder, paths.stem(target), F.lit("-"), F.col("number").cast("string"), paths.suffix(target))
    return done.unionByName(rest.join(numbers, ["target", "n"]).select("source", counted.alias("target"), F.lit(False).alias("filed")))


def same_content(a: str, b: str) -> bool:
    """Whether two files hold the same bytes; sizes are compared first, an unreadable one is no match."""
    try:
        return os.path.getsize(a) == os.path.getsize(b) and filecmp.cmp(a, b, shallow=False)
    except OSError:
        return False


def blocked(plans: DataFrame) -> DataFrame:
    """Plans whose target is still another pending plan's source."""
    return plans.join(plans.select(F.col("source").alias("target")).distinct(), "target", "left_semi").filter("source <> target")


def rounds(plans: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """source, target, round, in_cycle of plans (source, target; a row for each source): a plan waits for the one whose
    source is its target. ``round`` (from 1) is when its turn comes; plans of a cycle, and those that wait for
    one, have none, and ``in_cycle`` tells the former. Plans that change nothing are left out, but their files
    keep their names, so plans that wait for one have no round either.

    Each plan points to the one it waits for. Pointers are doubled: a plan takes over its pointer's pointer
    and adds its distance, so chains of any length take a number of rounds that grows with its logarithm.
    What still points somewhere then is stuck, and where it points to are the cycles. Many plans may wait
    for one, which the join sets apart. The result reads tables of ``scratch``.
    """
    scratch = scratch or Scratch(plans.sparkSession, "rounds")
    staying = scratch.keep(plans.filter("source is not null and not coalesce(source <> target, false)").select("source"))
    plans = scratch.keep(plans.filter("source <> target").select("source", "target"))
    sources = plans.select(F.col("source").alias("target")).unionByName(staying.select(F.col("source").alias("target")))
    state = scratch.keep(join_unique(plans, sources, "target").select("source", F.col("target").alias("to"), F.lit(1).cast("long").alias("steps")))
    nowhere = F.lit(None).cast(plans.schema["source"].dataType).alias("to")
    far = plans.join(state.select("source"), "source", "left_anti").select("source", nowhere, F.lit(1).cast("long").alias("steps"))
    done = [scratch.keep(far.unionByName(staying.select("source", nowhere, F.lit(None).cast("long").alias("steps"))))]  # no steps lead past a file that stays
    left, jumps = state.count(), 1
    of_plans = max(2, plans.count())
    while left and jumps < 2 * of_plans:
        ended = done[0]
        for d in done[1:]:
            ended = ended.unionByName(d)
        known = ended.unionByName(state).select(F.col("source").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = scratch.keep(join_unique(state, known, "to").select("source", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps")))
        done.append(moved.filter("to is null"))
        state = moved.filter("to is not null")
        left, jumps = state.count(), 2 * jumps
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    cycles = state.select(F.col("to").alias("source")).distinct().withColumn("in_cycle", F.lit(True))
    out = plans.join(ended.select("source", F.col("steps").cast("int").alias("round")), "source", "left").join(cycles, "source", "left")
    return out.select("source", "target", "round", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def apply_renames(plans: list[tuple[str, str]], root: str | None, dry_run: bool = False) -> dict:
    """Rename in rounds: a plan waits while its target is a pending source; cycles are reported.
    Missing sources and taken targets are errors of their own file. Journals what it did in a file of
    ``root``, where one is given."""
    pending, done, errors = list(dict.fromkeys(plans)), [], []
    while pending:
        sources = {s for s, _ in pending}
        ready = [(s, t) for s, t in pending if t not in sources or t == s]
        if not ready:
            errors += [f"{s}: its new name belongs to a file that is waiting for this one" for s, _ in pending]
            break
        for source, target in ready:
            same = source.lower() == target.lower()
            if not os.path.exists(source):
                errors.append(f"{source}: missing")
            elif os.path.lexists(target) and not same:
                errors.append(f"{source}: {target} is taken")
            else:
                if not dry_run:
                    Path(target).parent.mkdir(parents=True, exist_ok=True)
                    os.rename(source, target)
                done.append((source, target))
        pending = [p for p in pending if p not in set(ready)]
    if done and not dry_run and root is not None:
        write_journal(root, [*read_journal(root), [[s, t] for s, t in done]])
    return {"renamed": done, "errors": errors}


JOURNAL = ".likeness-renames.json"


def read_journal(root: str) -> list:
    """Batches of renames; a missing or unreadable journal is empty."""
    try:
        found = json.loads((Path(root) / JOURNAL).read_text())
    except (OSError, ValueError):
        return []
    return found if isinstance(found, list) else []


def write_journal(root: str, batches: list) -> None:
    """Replace the journal in one step."""
    with tempfile.NamedTemporaryFile("w", dir=root, delete=False) as f:
        json.dump(batches, f)
    os.replace(f.name, Path(root) / JOURNAL)


def take_back(renames: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Undo renames on disk, the last first; returns those (target, source) that could be."""
    undone = []
    for source, target in reversed(renames):
        if os.path.exists(target) and (not os.path.exists(source) or source.lower() == target.lower()):
            Path(source).parent.mkdir(parents=True, exist_ok=True)
            os.rename(target, source)
            undone.append((target, source))
    return undone


def undo_last(root: str) -> list[tuple[str, str]]:
    """Take the last batch of a file's journal back, in reverse order."""
    batches = read_journal(root)
    undone = take_back(batches[-1]) if batches else []
    if batches:
        write_journal(root, batches[:-1])
    return undone


def place(sources: list[str], destination: str, mode: str = "symlink", dry_run: bool = False) -> dict:
    """Link, copy or move files into a folder under free names; missing ones are skipped."""
    if mode not in ("symlink", "copy", "move"):
        raise ValueError(f"mode must be symlink, copy or move, got {mode!r}")
    placed, skipped, names = [], [], set()
    for source in sources:
        path = Path(source)
        if not path.exists():
            skipped.append(source)
            continue
        n, target = 1, Path(destination) / path.name
        while str(target) in names or target.exists():
            n += 1
            target = Path(destination) / f"{path.stem}-{n}{path.suffix}"
        names.add(str(target))
        placed.append((source, str(target)))
        if not dry_run:
            Path(destination).mkdir(parents=True, exist_ok=True)
            {"symlink": lambda: target.symlink_to(path.resolve()), "copy": lambda: shutil.copy2(path, target), "move": lambda: shutil.move(path, target)}[mode]()
    return {"placed": placed, "skipped": skipped}
