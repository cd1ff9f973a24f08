import json
import os

import numpy as np
import pytest

from likeness.__main__ import main
from likeness.plans import renames
from likeness.service import Service
from likeness.sources import discovery
from likeness.sources.catalog import Catalog
from likeness.sources.plugins import HashEmbedder


def _colours():
    """Vectors from the first word of a file's name: reds are close to reds."""

    class Colours(HashEmbedder):  # local, so that it travels with the plan
        def _vector(self, text):
            name = os.path.basename(text)
            base = HashEmbedder._vector(self, name.split("_")[0].lower())
            v = base + 0.1 * HashEmbedder._vector(self, name)
            return (v / np.linalg.norm(v)).astype(np.float32)

    return Colours(32)


@pytest.fixture
def service(spark, tmp_path):
    for name in ("red_1.jpg", "red_2.jpg", "red_3.jpg", "red_3.aae", "red_4.jpg", "red_5.jpg", "blue_1.jpg", "blue_2.jpg", "blue_3.png", "green_1.jpg", "green_2.jpg", "green_3.jpg"):
        (tmp_path / "lib").mkdir(exist_ok=True)
        (tmp_path / "lib" / name).write_bytes(name.encode())
    s = Service(Catalog(spark, f"file://{tmp_path}/tables"), _colours())
    s.folder = f"{tmp_path}/lib"
    s.path = lambda n: f"{s.folder}/{n}"
    return s


def test_teach_score_correct_and_organize(service):
    s = service
    stats = s.index(s.folder)
    assert stats["indexed"] == 11 and s.index(s.folder)["unchanged"] == 11
    taught = s.teach(" reds ", [s.path("red_1.jpg"), s.path("red_2.jpg")])
    assert taught["name"] == "reds" and taught["cohesion"] > 0.9
    s.score()
    reds = {os.path.basename(r.path) for r in s.with_tags(["reds"]).collect()}
    assert {"red_3.jpg", "red_4.jpg", "red_5.jpg"} <= reds and not any(n.startswith(("blue", "green")) for n in reds)
    assert {os.path.basename(r.path) for r in s.search(concept="reds", limit=5).collect()} == {f"red_{i}.jpg" for i in range(1, 6)}
    s.override(s.path("blue_1.jpg"), "reds", "on")
    s.override(s.path("red_5.jpg"), "reds", "off")
    got = {os.path.basename(r.path): list(r.tags) for r in s.effective_tags().collect()}
    assert got["blue_1.jpg"] == ["reds"] and got["red_5.jpg"] == [] and got["red_4.jpg"] == ["reds"]
    s.score()
    assert {os.path.basename(r.path): list(r.tags) for r in s.effective_tags().collect()} == got
    assert {os.path.basename(r.path) for r in s.with_tags(["reds"], effective=True).collect()} >= {"blue_1.jpg", "red_4.jpg"}

    assert s.organize("rename", s.folder, dry_run=True)["changed"] == 6 and "red_1.jpg" in os.listdir(s.folder)
    out = s.organize("rename", s.folder)
    assert out["changed"] == 6 and {"red_3 [reds].jpg", "red_3 [reds].aae", "blue_1 [reds].jpg", "red_5.jpg"} <= set(os.listdir(s.folder))
    assert s.pending() == 0
    assert s.undo(s.folder) == 6 and {"red_3.jpg", "red_3.aae"} <= set(os.listdir(s.folder)) and s.catalog.read("rename_batches").isEmpty()
    s.catalog.update_concept("reds", destination=s.folder + "/filed")
    os.mkdir(s.folder + "/filed")
    for name, data in (("red_3.jpg", b"red_3.jpg"), ("red_4.jpg", b"another")):
        with open(f"{s.folder}/filed/{name}", "wb") as f:
            f.write(data)
    moved = s.organize("move", s.folder)
    assert {"red_3.aae", "blue_1.jpg", "red_4.jpg", "red_4 (lib).jpg"} <= set(os.listdir(s.folder + "/filed")) and not moved["errors"] and moved["already_filed"] == 1
    assert "red_3.jpg" in os.listdir(s.folder) and s.organize("move", s.folder)["changed"] == 0
    with pytest.raises(ValueError):
        s.organize("burn")


def test_names_that_begin_with_an_underscore_are_listed(service):
    s = service
    for name in ("_DSC1.jpg", "_DSC1.xmp", ".hidden.jpg"):
        with open(s.path(name), "wb") as f:
            f.write(b"x")
    os.mkdir(s.path("_sub"))
    with open(s.path("_sub/a b%20.png"), "wb") as f:
        f.write(b"x")
    found = {r.path for r in discovery.listing(s.spark, s.folder).collect()}
    assert {s.path("_DSC1.jpg"), s.path("_DSC1.xmp"), s.path("_sub/a b%20.png"), s.path("red_3.aae")} <= found
    assert s.index(s.folder)["indexed"] == 13


def test_long_lists_are_answered_in_full(service):
    from likeness.server import Api

    s, n = service, 1200
    rows = [(i, f"/lib/{i:04d}.jpg", "image", 1, 1) for i in range(n)]
    s.catalog.append("files", s.spark.createDataFrame(rows, "id long, path string, kind string, size long, mtime_ns long"))
    api = Api(s)
    assert len(api.call("GET", "/api/library", {})[1]) == n
    page = api.call("GET", "/api/library?offset=1100&limit=50", {})[1]
    assert [r["path"] for r in page] == [f"/lib/{i:04d}.jpg" for i in range(1100, 1150)]
    assert api.call("POST", "/api/people", {"name": "ann", "paths": []})[0] == 400


def test_a_plugged_verifier_tells_boxes(service):
    class Named:
        def verify(self, paths, phrase):
            return [(float(phrase == "red hat" and "red" in os.path.basename(p)), "0,0,1,1") for p in paths]

    service.index(service.folder)
    service.teach("red-hat", [r.path for r in service.catalog.read("files").filter("path like '%red%'").collect()][:2])
    service.verifier = Named()
    rows = service.verify_phrase("red-hat").collect()
    assert rows and {(r.verified, "red" in os.path.basename(r.path), r.box, r.error) for r in rows} <= {(1.0, True, "0,0,1,1", None), (0.0, False, "0,0,1,1", None)}


def test_review_and_negatives(service):
    s = service
    s.index(s.folder)
    with pytest.raises(ValueError):
        s.teach("a/b", [s.path("red_1.jpg")])
    first = s.teach("reds", [s.path("red_1.jpg"), s.path("red_2.jpg")])
    higher = s.teach("reds", [], [s.path("red_5.jpg")])
    assert higher["threshold"] >= max(first["threshold"], 0.6)
    assert {r.matching for r in s.boundary("reds").collect()} == {True, False} or s.boundary("reds").count() == 11
    after = s.review("reds", s.path("red_4.jpg"), True)
    assert after["examples"] == 1
    s.review("reds", s.path("red_5.jpg"), False)
    assert s.catalog.read("concept_rejections").count() == 1
    s.review("reds", s.path("red_5.jpg"), True)
    assert s.catalog.read("concept_rejections").count() == 0
    with pytest.raises(KeyError):
        s.review("none", s.path("red_5.jpg"), True)


def test_forgetting(service):
    s = service
    s.index(s.folder)
    os.remove(s.path("green_1.jpg"))
    assert s.forget_missing(s.folder) == 1 and s.status()["files"] == 10


def test_command_line(service, tmp_path, capsys):
    base = ["--library", f"file://{tmp_path}/tables"]
    assert main([*base, "index", service.folder]) == 0
    assert json.loads(capsys.readouterr().out)["indexed"] == 11
    assert main([*base, "teach", "reds", service.path("red_1.jpg")]) == 0
    assert main([*base, "search", "none"]) == 1
    capsys.readouterr()
    assert main([*base, "concepts"]) == 0
    assert json.loads(capsys.readouterr().out)["name"] == "reds"


def test_people_from_photographs(service):
    class Analyzer:  # local, so that it travels with the plan
        def faces(self, path):
            name = os.path.basename(path)
            if name.startswith("blue_2"):
                raise OSError(path)
            v = [1.0, 0.1, 0.0] if name.startswith("red") else [0.0, 1.0, 0.1] if name.startswith("green") else [0.0, 0.0, 1.0]
            return [((0, 0, 100, 80), v), ((0, 0, 30, 30), [-9.0, -9.0, -9.0])] + ([((0, 0, 300, 300), [0.0, 0.0, 1.0])] if "1" in name else [])

    s = service
    s.index(s.folder)
    assert s.register_person("ann", [s.path("red_2.jpg"), s.path("red_3.jpg"), s.path("blue_2.jpg")], Analyzer()) == 2
    assert s.find_faces(Analyzer()) == 10 + 3 and s.find_faces(Analyzer()) == 0
    assert {os.path.basename(r.path) for r in s.search(person="ann").collect()} == {f"red_{i}.jpg" for i in range(1, 6)}
    assert s.rematch() == 0
    assert s.register_person("bo", [s.path("green_2.jpg")], Analyzer(), every=True) == 2 and s.rematch() == 3
    assert s.register_person("ann", [s.path("red_4.jpg")], Analyzer()) == 1 and s.catalog.read("person_faces").count() == 5
    assert s.register_person("ann", [s.path("red_4.jpg")], Analyzer(), mode="replace") == 1 and s.catalog.read("person_faces").count() == 3
    with pytest.raises(ValueError):
        s.register_person("cy", [s.path("blue_2.jpg")], Analyzer())
    clusters = s.catalog.read("file_faces").filter("person_id is null").count()
    assert clusters == 5
    ids = [r.id for r in s.catalog.read("file_faces").filter("person_id is null").collect()]
    s.name_cluster(ids, "cy")
    s.catalog.assign_face(ids[0], None)
    assert s.catalog.read("file_faces").filter("person_id is null").count() == 1 and s.catalog.delete_person("cy")


def test_http(service):
    import threading
    import urllib.error
    import urllib.request

    from likeness.server import Api, serve

    api = Api(service)
    server = serve(api, "secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None, token="secret"):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"}, method=method)
        try:
            with urllib.request.urlopen(request) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert ask("GET", "/api/health", token="other")[0] == 401 and ask("GET", "/api/health") == (200, {"ok": True}) and ask("GET", "/api/none")[0] == 404
    job = ask("POST", "/api/index", {"folder": service.folder})[1]
    api.jobs.wait()
    assert ask("GET", f"/api/jobs/{job['id']}")[1]["result"]["indexed"] == 11
    assert ask("POST", "/api/tags", {"name": "reds", "paths": ["/etc/passwd"]})[0] == 403
    assert ask("POST", "/api/tags", {"name": "a/b", "paths": [service.path("red_1.jpg")]})[0] == 400
    assert ask("POST", "/api/tags", {"name": "reds", "paths": [service.path("red_1.jpg"), service.path("red_2.jpg")]})[0] == 200
    assert api.call("POST", "/api/score", {})[0] == 200
    api.jobs.wait()
    assert {os.path.basename(r["path"]) for r in ask("GET", "/api/search?tags=reds,&mode=all")[1]} >= {"red_3.jpg"}
    assert ask("POST", "/api/override", {"path": service.path("blue_1.jpg"), "name": "reds", "state": "on"})[0] == 200
    assert [t["name"] for t in ask("GET", "/api/tags")[1]] == ["reds"] and ask("DELETE", "/api/tags/none")[0] == 404
    assert ask("POST", "/api/settings", {"organize_mode": "burn"})[0] == 400 and ask("POST", "/api/settings", {"organize_mode": "off"})[0] == 200
    assert ask("POST", "/api/organize", {})[1]["changed"] == 0 and ask("GET", "/api/duplicates")[1] == {"groups": [], "redundant": 0}
    assert ask("GET", "/api/people")[1] == [] and ask("GET", "/api/status")[1]["files"] == 11
    server.shutdown()


def test_jobs(spark):
    import threading

    from likeness.jobs import JobRunner

    jobs, go = JobRunner(spark), threading.Event()
    first = jobs.submit("wait", lambda job: go.wait(30) and 7)
    with pytest.raises(RuntimeError):
        jobs.submit("other", lambda job: 1)
    go.set()
    jobs.wait()
    assert first.as_dict()["state"] == "done" and first.result == 7
    failed = jobs.submit("fail", lambda job: 1 / 0)
    jobs.wait()
    assert failed.state == "failed" and "zero" in failed.error
    slow = jobs.submit("slow", lambda job: job.cancelled.wait(30))
    assert jobs.cancel(slow.id) and not jobs.cancel(99)
    jobs.wait()
    assert slow.state == "cancelled"
    for _ in range(25):
        jobs.submit("x", lambda job: None)
        jobs.wait()
    assert len(jobs.history) == 20


def test_a_crash_between_renaming_and_its_commit_is_repaired(service, monkeypatch):
    s = service
    s.index(s.folder)
    names = sorted(r.path for r in s.catalog.read("files").collect())[:3]
    a, b, c = names
    plans = [(a, b), (b, c + "x"), (c, s.folder + "/never.jpg")]
    number = s.catalog.begin_renames(s.spark.createDataFrame([(k, *p) for k, p in enumerate(plans)], "seq int, source string, target string"))
    os.rename(b, c + "x")
    os.rename(a, b)  # here the machine stops
    assert s.repair() == 2 and s.repair() == 0
    paths = {r.path for r in s.catalog.read("files").collect()}
    assert {b, c + "x", c} <= paths and a not in paths and len(paths) == 11
    assert [(r.source, r.target) for r in s.catalog.read("rename_batches").filter(f"batch_id = {number}").orderBy("seq").collect()] == [(b, c + "x"), (a, b)]
    assert s.undo() == 2 and all(os.path.exists(p) for p in names)
    assert set(names) <= {r.path for r in s.catalog.read("files").collect()}
    assert s.undo() == 0
