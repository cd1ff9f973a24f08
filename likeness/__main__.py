"""Command line: ``python -m likeness --library FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import importlib
import json
import secrets
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="likeness", description="Find, tag and clean up files by example.")
    p.add_argument("--library", required=True, help="folder of the library's tables")
    p.add_argument("--embedder", default="likeness.sources.plugins:HashEmbedder", help="module:class of the model that makes vectors")
    p.add_argument("--analyzer", help="module:class of the model that finds faces")
    p.add_argument("--verifier", help="module:class of a verifier, or module:function from a phrase to a column that scores file ids")
    c = p.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "index": ["folder"], "forget": ["folder"], "teach": ["name", "paths*"], "search": ["name"], "text": ["prompt"], "score": [], "apply": [], "concepts": [], "people": [], "status": [], "rematch": [],
        "boundary": ["name"], "review": ["name", "path", "answer"], "override": ["path", "name", "state"], "tags": ["names*"], "duplicates": [], "destination": ["name", "folder"], "organize": ["folder"], "undo": ["folder"],
        "add-person": ["name", "paths*"], "faces": [], "clusters": [], "name-cluster": ["name", "face_ids*"], "verify": ["name"], "collect": ["folder"], "vacuum": [], "serve": [],
    }.items():
        s = c.add_parser(name)
        for a in arguments:
            s.add_argument(a.rstrip("*"), nargs="*" if a.endswith("*") else None)
        if name in ("search", "text"):
            s.add_argument("-n", "--limit", type=int, default=25)
        if name == "serve":
            s.add_argument("--host", default="127.0.0.1")
            s.add_argument("--port", type=int, default=8765)
            s.add_argument("--token", help="what requests carry; a new one is printed if it isn't given")
        s.add_argument("--threshold", type=float)
        s.add_argument("--not", dest="negatives", nargs="*", default=[])
        s.add_argument("--all", action="store_true")
        s.add_argument("--mode", default=None)
        s.add_argument("--dry-run", action="store_true")
        s.add_argument("--phrase")
        s.add_argument("--replace", action="store_true", help="a person's references, instead of adding to them")
    return p


def _serve(service, host: str, port: int, token: str) -> None:
    """Answer requests until it is interrupted."""
    from likeness.server import Api, serve

    server = serve(Api(service), token, host, port)
    print(json.dumps({"url": f"http://{host}:{server.server_port}", "token": token}), flush=True)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession, functions as F

    from likeness.operators import faces, tags
    from likeness.service import Service
    from likeness.sources.catalog import Catalog

    spark = SparkSession.builder.appName("likeness").getOrCreate()
    plugged = lambda given: given and getattr(importlib.import_module(given.partition(":")[0]), given.partition(":")[2])
    s = Service(Catalog(spark, a.library), plugged(a.embedder)(), verifier() if isinstance(verifier := plugged(a.verifier), type) else verifier, a.analyzer and plugged(a.analyzer)())
    read = s.catalog.read
    actions = {
        "index": lambda: s.index(a.folder), "forget": lambda: s.forget_missing(a.folder), "teach": lambda: s.teach(a.name, a.paths, a.negatives),
        "search": lambda: s.search(concept=a.name, limit=a.limit, threshold=a.threshold), "text": lambda: s.search(text=a.prompt, limit=a.limit, threshold=a.threshold),
        "score": s.score, "apply": s.score, "status": s.status, "rematch": s.rematch, "boundary": lambda: s.boundary(a.name),
        "concepts": lambda: tags.concept_counts(read("concepts"), read("file_concepts")).select("name", "threshold", "n_examples", "matches", "destination").orderBy("name"),
        "people": lambda: tags.people_counts(read("people"), read("file_faces")).select("name", "n_examples", "files").orderBy("name"),
        "review": lambda: s.review(a.name, a.path, a.answer == "yes"), "override": lambda: s.override(a.path, a.name, None if a.state == "clear" else a.state),
        "tags": lambda: s.with_tags(a.names, "all" if a.all else "any"), "duplicates": lambda: s.duplicates().select("kind", "keeper", "n", "redundant"),
        "destination": lambda: s.catalog.update_concept(a.name, destination=a.folder), "organize": lambda: s.organize(a.mode, a.folder, a.dry_run), "undo": lambda: s.undo(a.folder),
    }
    actions |= {
        "add-person": lambda: {"added": s.register_person(a.name, a.paths, mode="replace" if a.replace else "extend", every=a.all)}, "faces": s.find_faces,
        "clusters": lambda: faces.cluster_unnamed(read("file_faces"), a.threshold or faces.CLUSTER_THRESHOLD).orderBy(F.desc("size"), "cluster"),
        "name-cluster": lambda: s.name_cluster([int(i) for i in a.face_ids], a.name), "collect": lambda: s.collect_duplicates(a.folder, a.mode or "symlink", a.dry_run),
        "verify": lambda: s.verify_phrase(a.name, a.phrase), "vacuum": s.catalog.vacuum,
        "serve": lambda: _serve(s, a.host, a.port, a.token or secrets.token_urlsafe(24)),
    }
    try:
        out = actions[a.command]()
    except (KeyError, ValueError) as e:
        print(f"likeness: {e}", file=sys.stderr)
        return 1
    if hasattr(out, "toLocalIterator"):
        for row in out.toLocalIterator():  # in full; searches have their own limit
            print(json.dumps(row.asDict(), default=str, ensure_ascii=False))
    elif out is not None:
        print(json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
