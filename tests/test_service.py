"""HTTP, command line and SQL names over one small collection."""

import io
import json
import shutil
import struct
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from docspark.errors import EngineError
from docspark.functions.register import register
from docspark.service.app import App
from docspark.plans.hybrid import Query
from docspark.service.cli import parser, run
from docspark.functions.answers import is_collection_question
from docspark.service.http import make_server


def call(base, path, body=None, token="t", method=None, headers=None):
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(base + path, data, {"Authorization": f"Bearer {token}", "X-Who": "keeper", **(headers or {})}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_http_and_cli(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "lamp.txt").write_text("The lamp oil is replaced every 90 nights.")
    app = App(spark, str(tmp_path / "data"))
    auth = lambda headers: headers.get("X-Who")
    only = lambda rows, who: rows if who == "keeper" else rows.filter("false")
    server = make_server(app, token="t", auth=auth, routes={("POST", "/extra"): lambda a, who, body: (201, {"who": who, **body})}, retrieval_filter=only)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert call(base, "/health", token="no")[0] == 200 and call(base, "/collections", token="no")[0] == 401
    assert call(base, "/health", headers={"Host": "evil.example"})[0] == 403 and call(base, "/health", headers={"Origin": "http://evil.example"})[0] == 403
    code, page = call(base, "/", token="no")
    assert code == 200 and "<title>docspark</title>" in page and call(base, "/", headers={"Host": "evil.example"})[0] == 403
    assert call(base, "/v1/health", token="no")[0] == 200 and call(base, "/v1/collections", token="no")[0] == 401
    assert call(base, "/v1/collections/c1/search")[0] == 405 and call(base, "/jobs", {"x": 1})[0] == 405
    code, out = call(base, "/v1/collections/c1/ingest", {"paths": [str(tmp_path / "files")]})
    assert code == 202
    app.jobs.wait(json.loads(out)["job"], 120)
    job = json.loads(call(base, f"/jobs/{json.loads(out)['job']}")[1])
    assert job["state"] == "succeeded" and job["result"]["files_added"] == 1 and job["progress"] == job["result"]
    assert call(base, "/extra", {"x": 1}) == (201, '{"who": "keeper", "x": 1}')
    assert json.loads(call(base, "/collections/c1/search", {"query": "lamp", "mode": "keyword"}, headers={"X-Who": "guest"})[1])["hits"] == []
    about = json.loads(call(base, "/collections/c1/ask", {"question": "How many files are indexed?"})[1])
    assert about["about_collection"] and about["summary"]["ok"] == 1 and about["documents"][0].endswith("lamp.txt")
    assert json.loads(call(base, "/collections")[1])["collections"][0]["count"] == 1
    assert json.loads(call(base, "/collections/c1/documents")[1])["summary"]["ok"] == 1
    hits = json.loads(call(base, "/collections/c1/search", {"query": "lamp", "mode": "keyword"})[1])["hits"]
    assert hits[0]["source_path"].endswith("lamp.txt") and "distance" not in hits[0] and hits[0]["keyword_score"] > 0
    answer = json.loads(call(base, "/collections/c1/ask", {"question": "lamp oil replaced"})[1])
    assert answer["found"] and answer["citations"][0]["number"] == 1
    stream = call(base, "/collections/c1/ask", {"question": "lamp oil replaced", "stream": True})[1]
    assert "event: token" in stream and "event: answer" in stream
    assert call(base, "/collections/nosuch/search", {"query": "x"})[0] == 404 and call(base, "/collections/c1/search", {"query": "x", "top_k": 0})[0] == 400
    assert call(base, "/settings", {"a": 1})[0] == 200 and json.loads(call(base, "/settings")[1]) == {"a": 1}
    assert call(base, "/collections/c1/search", [1])[0] == 400 and call(base, "/nothing")[0] == 404
    server.shutdown()
    out = io.StringIO()
    assert run(app, parser().parse_args(["search", "c1", "lamp oil"]), out) == 0 and "lamp.txt" in out.getvalue()
    assert run(app, parser().parse_args(["info", "nosuch"]), out) == 3
    assert run(app, parser().parse_args(["version"]), out) == 0 and run(app, parser().parse_args(["model"]), out) == 0
    root = tmp_path / "data" / "c1"  # as format 3 had it: one manifest, of names alone
    newest = sorted(p for p in (root / "manifests").iterdir() if p.name[0].isdigit())[-1]
    values = json.loads(newest.read_text())
    values = {k: values[k] for k in ("embedding_model", "dim", "version", "next_id", "user_version", "removed_count")} | {k: [x["name"] for x in values[k]] for k in ("chunks", "removed", "documents")}
    (root / "manifest.json").write_text(json.dumps(values | {"format_version": 3}))
    shutil.rmtree(root / "manifests")
    assert app.reader("c1").info()["count"] == 1
    assert run(app, parser().parse_args(["migrate", "c1"]), out) == 0 and json.loads(out.getvalue().splitlines()[-1]) == {"format_version": 5}
    assert json.loads((root / "manifest-format3.json").read_text())["next_id"] == values["next_id"]
    c1 = app.reader("c1")
    assert c1.store.manifest.indexed and c1.info()["count"] == 1 and [h["id"] for h in c1.query(Query(text="lamp", mode="keyword"))] == [0]
    folder = tmp_path / "first"
    folder.mkdir()
    (folder / "header.bin").write_bytes(b"TAG0" + struct.pack("<4I", 2, 2, 256, 3))
    (folder / "vectors.bin").write_bytes(struct.pack("<768f", *([0.5] * 256 + [0.25] * 256 + [0.0] * 256)))
    assert run(app, parser().parse_args(["convert", str(folder), "c2"]), out) == 0
    c2 = app.reader("c2").store
    assert c2.chunks().count() == 2 and c2.get_vector(1)[:2] == [0.25, 0.25]
    said, stop = io.StringIO(), threading.Event()
    serve = ThreadingHTTPServer.serve_forever
    ThreadingHTTPServer.serve_forever = lambda server: (stop.set(), server.server_close())
    try:
        assert run(app, parser().parse_args(["gui", "--no-browser"]), said) == 0 and stop.is_set()
    finally:
        ThreadingHTTPServer.serve_forever = serve
    assert said.getvalue().startswith("http://127.0.0.1:") and "/#token=" in said.getvalue()
    with app.serving():
        with pytest.raises(EngineError):
            with app.serving():
                pass
    app.save_settings({"watch": {"collection": "c1", "folders": [str(tmp_path / "files")], "seconds": 1}})
    assert app.watching is not None and app.watching.isActive
    app.save_settings({"watch": {}})
    assert app.watching is None
    assert is_collection_question("How many documents are in this collection?") and not is_collection_question("How often is the lamp trimmed?")


def test_sql_names(spark):
    register(spark)
    assert spark.sql("SELECT l2_squared(array(1D, 2D), array(1D, 4D)) AS d, base_name('/a/b.txt') AS b").first().asDict() == {"d": 4.0, "b": "b.txt"}
    assert spark.sql("SELECT normalize_text(cast('a' AS BINARY)) AS t").first()["t"] == "a"
    rows = spark.sql("SELECT * FROM chunk_text('One paragraph.')").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 14, 0, "One paragraph.")]
