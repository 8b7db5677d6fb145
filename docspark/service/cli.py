"""python -m docspark.service.cli COMMAND: ingest, search, ask, info, serve, gui, migrate, convert, model, version."""

from __future__ import annotations

import argparse
import json
import secrets
import sys
import webbrowser

from docspark.api import check_name, to_json
from docspark.errors import EngineError
from docspark.plans.store import Store
from docspark.service.app import App

#: Exit codes by status; other errors give 1, and a run that was interrupted gives 130.
EXIT_CODES = {"INVALID_ARGUMENT": 2, "NOT_FOUND": 3, "MODEL_MISMATCH": 4, "BUSY": 5, "CONFLICT": 5}
STOPPED = 130
VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docspark")
    p.add_argument("--data", default="./collections")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("ingest", ["collection", "paths+"]), ("search", ["collection", "query"]), ("ask", ["collection", "query"]), ("info", ["collection"]), ("serve", []), ("gui", []), ("migrate", ["collection"]), ("convert", ["folder", "collection"]), ("model", []), ("version", [])):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a.rstrip("+"), **({"nargs": "+"} if a.endswith("+") else {}))
        if name in ("search", "ask"):
            s.add_argument("--top-k", type=int, default=5)
        if name in ("serve", "gui"):
            s.add_argument("--port", type=int, default=8080 if name == "serve" else 0)
            s.add_argument("--token")
        if name == "gui":
            s.add_argument("--no-browser", action="store_true")
    return p


def run(app: App, args: argparse.Namespace, out=sys.stdout) -> int:
    try:
        match args.command:
            case "ingest":
                print(to_json(app.ingest(args.collection, args.paths)), file=out)
            case "search":
                c = app.reader(args.collection)
                hits = c.query_text(args.query, args.top_k)
                rows = c.store.get_many([h["id"] for h in hits])
                for h in hits:
                    row = rows[h["id"]]
                    text = row["text"].replace("\n", " ").encode()
                    cut = text[:200].decode("utf-8", "ignore") + ("..." if len(text) > 200 else "")
                    print(json.dumps({"score": h["score"], "path": row["source_path"], "page": row["page"], "snippet": cut}, ensure_ascii=False), file=out)
            case "ask":
                print(to_json(app.reader(args.collection).ask(args.query, app.generator, args.top_k)), file=out)
            case "info":
                print(json.dumps(app.reader(args.collection).info()), file=out)
            case "serve":
                from docspark.service.http import make_server

                with app.serving():
                    app.apply_watch()
                    make_server(app, args.port, args.token).serve_forever()
            case "gui":
                from docspark.service.http import make_server

                token = args.token or secrets.token_urlsafe(24)
                with app.serving():
                    app.apply_watch()
                    server = make_server(app, args.port, token)
                    address = f"http://127.0.0.1:{server.server_port}/#token={token}"
                    print(address, file=out, flush=True)
                    if not args.no_browser:
                        webbrowser.open(address)
                    server.serve_forever()
            case "migrate":
                c = app.writer(args.collection)  # opening for writing brings an older manifest up to date
                c.store.close()
                print(json.dumps({"format_version": c.store.manifest.format_version}), file=out)
            case "convert":
                store = Store.convert(app.spark, args.folder, f"file://{app.data_dir}/{check_name(args.collection)}", app.embedder.id)
                store.close()
                print(json.dumps({"dim": store.manifest.dim, "count": store.manifest.next_id}), file=out)
            case "model":
                print(json.dumps({"embedder": app.embedder.id, "dim": app.embedder.dim, "generator": type(app.generator).__name__}), file=out)
            case "version":
                print(VERSION, file=out)
        return 0
    except KeyboardInterrupt:
        return STOPPED
    except EngineError as e:
        print(f"{e.status}: {e}", file=sys.stderr)
        return EXIT_CODES.get(e.status, 1)


def main() -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args()
    return run(App(SparkSession.builder.appName("docspark").getOrCreate(), args.data), args)


if __name__ == "__main__":
    sys.exit(main())
