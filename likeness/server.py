"""A small HTTP interface to a library: JSON in and out, one bearer token, paths below opened roots alone."""

from __future__ import annotations

import hmac
import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, functions as F

from likeness.functions import hashing
from likeness.jobs import JobRunner
from likeness.operators import faces, search, tags
from likeness.service import MODES, Service
from likeness.sources import images
from likeness.sources.scratch import Scratch

SETTINGS = {"organize_mode": MODES}


def _split(text: str) -> list[str]:
    return [t.strip() for t in text.split(",") if t.strip()]


class Api:
    """Routes to functions; raises KeyError (404), PermissionError (403), ValueError (400), RuntimeError (409)."""

    def __init__(self, service: Service, jobs: JobRunner | None = None):
        self.s, self.jobs = service, jobs or JobRunner(service.spark)
        self.read = service.catalog.read
        self.routes = [
            (method, re.compile("^" + re.sub(r"<(\w+)>", r"(?P<\1>[^/]+)", path) + "$"), function)
            for method, path, function in [
                ("GET", "/api/health", lambda b: {"ok": True}),
                ("GET", "/api/library", lambda b: self.rows(self.s.library().orderBy("path"), b)),
                ("GET", "/api/tags", lambda b: self.rows(tags.concept_counts(self.read("concepts"), self.read("file_concepts")).select("name", "threshold", F.col("n_examples").alias("examples"), "matches", "destination", "inverse_destination").orderBy("name"))),
                ("POST", "/api/tags", lambda b: self.s.teach(b["name"], self.allowed(b.get("paths", [])), self.allowed(b.get("negatives", [])))),
                ("GET", "/api/tags/<name>/boundary", lambda b, name: self.rows(self.s.boundary(name, int(b.get("limit", 12))).orderBy("distance"))),
                ("POST", "/api/tags/<name>/review", lambda b, name: self.s.review(name, self.allowed([b["path"]])[0], bool(b["match"]))),
                ("DELETE", "/api/tags/<name>", lambda b, name: self.found(self.s.catalog.delete_concept(name), name)),
                ("POST", "/api/tags/<name>/destination", lambda b, name: self.destination(name, b)),
                ("POST", "/api/tags/<name>/verify", self.verify),
                ("GET", "/api/thumb", lambda b: images.thumbnail(self.s.spark, self.allowed([b["path"]])[0], int(b.get("side", 256)), self.s.frames)),
                ("POST", "/api/override", lambda b: self.s.override(self.allowed([b["path"]])[0], b["name"], b.get("state"))),
                ("GET", "/api/search", self.search),
                ("POST", "/api/index", lambda b: self.job("index", lambda job: self.s.index(b["folder"], stop=job.cancelled.is_set, report=job.report))),
                ("POST", "/api/score", lambda b: self.job("score", lambda job: self.s.score())),
                ("GET", "/api/people", lambda b: self.rows(tags.people_counts(self.read("people"), self.read("file_faces")).select("name", F.col("n_examples").alias("references"), "files").orderBy("name"))),
                ("GET", "/api/people/<name>/files", lambda b, name: self.rows(self.s.search(person=name, limit=None), b)),
                ("POST", "/api/people", lambda b: {"added": self.s.register_person(b["name"], self.allowed(b["paths"]), mode=b.get("mode", "extend"), every=bool(b.get("every")))}),
                ("DELETE", "/api/people/<name>", lambda b, name: self.found(self.s.catalog.delete_person(name), name)),
                ("GET", "/api/clusters", lambda b: self.rows(faces.cluster_unnamed(self.read("file_faces"), float(b.get("threshold", faces.CLUSTER_THRESHOLD))).orderBy(F.desc("size"), "cluster"), b)),
                ("POST", "/api/clusters/name", lambda b: self.s.name_cluster([int(i) for i in b["face_ids"]], b["name"])),
                ("POST", "/api/rematch", lambda b: {"matched": self.s.rematch()}),
                ("GET", "/api/settings", lambda b: {k: self.s.catalog.setting(k, v[0]) for k, v in SETTINGS.items()}),
                ("POST", "/api/settings", self.settings),
                ("POST", "/api/organize", lambda b: self.s.organize(b.get("mode"), b.get("root"), bool(b.get("dry_run")))),
                ("POST", "/api/undo", lambda b: {"undone": self.s.undo(self.root())}),
                ("GET", "/api/pending", lambda b: {"pending": self.s.pending()}),
                ("GET", "/api/duplicates", self.duplicates),
                ("POST", "/api/duplicates/collect", lambda b: self.s.collect_duplicates(b["destination"], b.get("mode", "symlink"), bool(b.get("dry_run")))),
                ("GET", "/api/jobs/<number>", lambda b, number: self.jobs.poll(self.found(self.jobs.get(int(number)), number)).as_dict()),
                ("POST", "/api/jobs/<number>/cancel", lambda b, number: {"cancelled": self.jobs.cancel(int(number))}),
                ("GET", "/api/status", lambda b: self.s.status()),
            ]
        ]

    @staticmethod
    def rows(df: DataFrame, b: dict | None = None) -> list[dict]:
        """All rows; ``offset`` and ``limit`` of a request give one page of an ordered answer."""
        df = df.offset(int(b["offset"])) if b and "offset" in b else df
        df = df.limit(int(b["limit"])) if b and "limit" in b else df
        return [r.asDict(recursive=True) for r in df.toLocalIterator()]

    @staticmethod
    def found(value, name):
        if not value:
            raise KeyError(name)
        return value

    def root(self) -> str:
        first = self.read("roots").orderBy("added_at").head(1)
        return self.found(first, "no folder is open")[0]["path"]

    def allowed(self, paths: list[str]) -> list[str]:
        """The paths, if all lie below opened folders."""
        roots = [r["path"].rstrip("/") for r in self.read("roots").collect()]
        for path in paths:
            if ".." in path.split("/") or not any(path == r or path.startswith(r + "/") for r in roots):
                raise PermissionError(path)
        return list(paths)

    def job(self, kind: str, work) -> dict:
        return self.jobs.submit(kind, work).as_dict()

    def destination(self, name: str, b: dict) -> None:
        self.s._concept(name)
        self.s.catalog.update_concept(name, **{k: b.get(k) for k in ("destination", "inverse_destination") if k in b})

    def settings(self, b: dict) -> None:
        for key, value in b.items():
            if value not in SETTINGS.get(key, ()):
                raise ValueError(f"{key}: {value!r}")
            self.s.catalog.set_setting(key, value)

    def search(self, b: dict) -> list[dict]:
        """Ranked files: all with the tags, or the ``limit`` best by a concept, a text, examples or a person."""
        if "tags" in b:
            found = self.s.with_tags(_split(b["tags"]), b.get("mode", "any"), effective=b.get("effective") == "true")
            return self.rows(found.orderBy(F.desc("score"), "file_id"), b)
        return self.rows(self.s.search(b.get("concept"), b.get("text"), self.allowed(_split(b.get("examples", ""))), b.get("person"), int(b.get("limit", search.LIMIT))))

    def verify(self, b: dict, name: str) -> list[dict]:
        return self.rows(self.s.verify_phrase(name, b.get("phrase"), int(b.get("candidates", search.CANDIDATES))))

    def duplicates(self, b: dict) -> dict:
        found = Scratch(self.s.spark, "duplicates").keep(self.s.duplicates(hashing.cutoff(float(b.get("distance", hashing.DISTANCE)))))
        redundant = found.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
        return {"groups": self.rows(found.orderBy("kind", F.desc("n"), "keeper"), b), "redundant": redundant}

    def call(self, method: str, url: str, body: dict) -> tuple[int, object]:
        """Status and answer."""
        parts = urlsplit(url)
        given = {k: v[-1] for k, v in parse_qs(parts.query).items()} | body
        for own, pattern, function in self.routes:
            m = pattern.match(parts.path)
            if own == method and m:
                try:
                    return 200, function(given, **{k: unquote(v) for k, v in m.groupdict().items()})
                except KeyError as e:
                    return 404, {"error": str(e)}
                except PermissionError as e:
                    return 403, {"error": f"outside the opened folders: {e}"}
                except ValueError as e:
                    return 400, {"error": str(e)}
                except RuntimeError as e:
                    return 409, {"error": str(e)}
        return 404, {"error": "no such route"}


def serve(api: Api, token: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, not yet running; every request needs ``Authorization: Bearer`` with the token."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            held = self.headers.get("Authorization", "")
            if not hmac.compare_digest(held.encode(), f"Bearer {token}".encode()):
                status, out = 401, {"error": "a token is needed"}
            else:
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                    status, out = api.call(self.command, self.path, body)
                except ValueError:
                    status, out = 400, {"error": "not JSON"}
            image = isinstance(out, bytes)
            data = out if image else json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "image/png" if image else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
