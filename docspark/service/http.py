"""The HTTP interface: JSON in and out, answers as server-sent events on request."""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from docspark.api import Collection, RetrievalFilter
from docspark.errors import EngineError, require
from docspark.functions.answers import is_collection_question
from docspark.plans.hybrid import Query
from docspark.service.app import HTTP_CODES, App

#: Fixed value: the largest request body.
MOST_BODY = 1 << 20
#: Methods of the paths that there are, by their parts; "*" stands for a name or number.
METHODS = {
    ("health",): "GET", ("settings",): "GET POST", ("collections",): "GET", ("jobs",): "GET", ("jobs", "*"): "GET DELETE",
    ("collections", "*", "documents"): "GET", **{("collections", "*", x): "POST" for x in ("ingest", "search", "ask")},
}
#: The page for a browser; it holds no data and asks for all with the token of its address.
PAGE = Path(__file__).with_name("page.html")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "[::1]")


#: An auth provider gives the principal of a request's headers, or None to refuse it.
Auth = Callable[[Mapping[str, str]], object]
#: A route of one's own gets app, principal and body, and gives code and reply.
Route = Callable[[App, object, dict], tuple[int, object]]


def make_server(app: App, port: int = 0, token: str | None = None, auth: Auth | None = None, routes: dict[tuple[str, str], Route] | None = None, retrieval_filter: RetrievalFilter | None = None) -> ThreadingHTTPServer:
    """``auth`` comes after host, origin and token; what it gives goes to ``retrieval_filter`` with each search. ``routes``:
    (method, path) to functions, asked where the server has no route of its own."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):  # document text never goes to a log
            pass

        def _reply(self, code: int, body: object, kind: str = "application/json") -> None:
            raw = body if isinstance(body, bytes) else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _body(self) -> dict:
            n = int(self.headers.get("Content-Length") or 0)
            require(n <= MOST_BODY, "the request is too large", "TOO_LARGE")
            try:
                out = json.loads(self.rfile.read(n) or b"{}")
            except ValueError as e:
                raise EngineError("INVALID_ARGUMENT", f"not JSON: {e}") from e
            require(isinstance(out, dict), "the body has to be an object")
            return out

        def _allowed(self) -> bool:
            """Host, then origin, then token."""
            host = (self.headers.get("Host") or "").rpartition(":")[0] or self.headers.get("Host") or ""
            origin = self.headers.get("Origin")
            if host.lower() not in LOCAL_HOSTS or (origin and urlsplit(origin).hostname not in ("localhost", "127.0.0.1", "::1")):
                self._reply(403, {"error": "DENIED"})
                return False
            if self.command == "GET" and urlsplit(self.path).path == "/":
                self._reply(200, PAGE.read_bytes(), "text/html; charset=utf-8")
                return False
            sent = (self.headers.get("Authorization") or "").removeprefix("Bearer ")
            health = self.path.removeprefix("/v1") == "/health"
            if token and not health and not hmac.compare_digest(sent, token):
                self._reply(401, {"error": "DENIED"})
                return False
            self.principal = auth(self.headers) if auth else None
            if auth and self.principal is None and not health:
                self._reply(401, {"error": "DENIED"})
                return False
            return True

        def _reader(self, name: str) -> Collection:
            c = app.reader(name)
            if retrieval_filter is None:
                return c
            return Collection(c.store, c.embedder, retrieval_filter, self.principal, c.audit)

        def _serve(self, method: str) -> None:
            if not self._allowed():
                return
            try:
                self._route(method)
            except EngineError as e:
                self._reply(HTTP_CODES.get(e.status, 500), {"error": e.status, "message": str(e)})
            except (TypeError, ValueError, KeyError) as e:
                self._reply(400, {"error": "INVALID_ARGUMENT", "message": str(e)})

        def _route(self, method: str) -> None:
            url = urlsplit(self.path)
            parts, args = [p for p in url.path.removeprefix("/v1/").split("/") if p], parse_qs(url.query)
            match method, parts:
                case "GET", ["health"]:
                    self._reply(200, {"status": "ok"})
                case "GET", ["settings"]:
                    self._reply(200, app.settings())
                case "POST", ["settings"]:
                    self._reply(200, app.save_settings(self._body()))
                case "GET", ["collections"]:
                    self._reply(200, {"collections": [{"name": n, **app.reader(n).info()} for n in app.collections()]})
                case "GET", ["collections", name, "documents"]:
                    c = app.reader(name)
                    rows = c.store.documents(args.get("prefix", [""])[0]).orderBy("source_path").limit(int(args.get("limit", ["1000"])[0])).collect()
                    self._reply(200, {"summary": c.summary(), "documents": [r.asDict() for r in rows]})
                case "POST", ["collections", name, "ingest"]:
                    paths = self._body()["paths"]
                    require(isinstance(paths, list) and all(isinstance(p, str) for p in paths), "paths have to be strings")
                    self._reply(202, {"job": app.jobs.submit("ingest", app.ingest_job(name, paths)).id})
                case "GET", ["jobs"]:
                    self._reply(200, {"jobs": [{"id": j.id, "kind": j.kind, "state": j.state} for j in app.jobs.newest()]})
                case "GET", ["jobs", number]:
                    job = app.jobs.get(int(number))
                    require(job is not None, "no such job", "NOT_FOUND")
                    plain = lambda x: asdict(x) if x is not None else None
                    self._reply(200, {"id": job.id, "state": job.state, "error": job.error, "progress": plain(job.progress), "result": plain(job.result)})
                case "DELETE", ["jobs", number]:
                    require(app.jobs.get(int(number)) is not None, "no such job", "NOT_FOUND")
                    app.jobs.cancel(int(number))
                    self._reply(200, {"id": int(number)})
                case "POST", ["collections", name, "search"]:
                    self._search(self._reader(name), self._body())
                case "POST", ["collections", name, "ask"]:
                    body = self._body()
                    if is_collection_question(body["question"]) and not body.get("stream"):
                        self._reply(200, app.about(name))
                    else:
                        self._ask(self._reader(name), body)
                case _:
                    own = (routes or {}).get((method, url.path))
                    shape = tuple("*" if i == 1 else p for i, p in enumerate(parts))
                    if own is None and shape in METHODS:
                        self._reply(405, {"error": "INVALID_ARGUMENT", "message": f"use {METHODS[shape]}"})
                        return
                    self._reply(*(own(app, self.principal, self._body()) if own else (404, {"error": "NOT_FOUND"})))

        def _search(self, c, body: dict) -> None:
            mode, text = body.get("mode", "hybrid"), body["query"]
            vector = c.embedder.embed([text], query=True)[0].tolist()
            q = Query(vector=vector, text=text, mode=mode, top_k=body.get("top_k", 5), path_prefix=body.get("path_prefix", ""))
            hits = c.query(q)
            rows, out = c.store.get_many([h["id"] for h in hits]), []
            for h in hits:
                row = rows[h["id"]]
                x = {"id": h["id"], "score": h["score"], "source_path": row["source_path"], "page": row["page"], "text": row["text"]}
                if h["distance"] >= 0:
                    x["distance"] = h["distance"]
                if h["keyword_rank"]:
                    x["keyword_score"] = h["keyword_score"]
                out.append(x)
            self._reply(200, {"hits": out})

        def _ask(self, c, body: dict) -> None:
            options = {k: body[k] for k in ("top_k", "budget", "least_similarity", "path_prefix") if k in body}
            if not body.get("stream"):
                self._reply(200, asdict(c.ask(body["question"], app.generator, **options)))
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()

            def event(name: str, data: object) -> bool:
                try:
                    self.wfile.write(f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n".encode())
                    self.wfile.flush()
                    return True
                except OSError:
                    return False  # the reader has gone: stop

            try:
                event("answer", asdict(c.ask(body["question"], app.generator, on_token=lambda t: event("token", t), **options)))
            except EngineError as e:
                event("error", {"error": e.status, "message": str(e)})

        def do_GET(self):
            self._serve("GET")

        def do_POST(self):
            self._serve("POST")

        def do_DELETE(self):
            self._serve("DELETE")

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
