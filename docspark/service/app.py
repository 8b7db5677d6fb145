"""Named collections in a data folder, shared by the HTTP server and the command line."""

from __future__ import annotations

import contextlib
import json
import logging
import logging.handlers
import os
import threading
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from docspark.api import NAME, AuditEvent, Collection, check_name
from docspark.errors import EngineError, require
from docspark.functions.embed import Embedder, WordEmbedder
from docspark.plans.answer import ExtractiveGenerator, Generator
from docspark.streaming.jobs import JobQueue
from docspark.streaming.watch import SECONDS, watch

#: HTTP codes of the statuses.
HTTP_CODES = {
    "OK": 200, "INVALID_ARGUMENT": 400, "TOO_LONG": 400, "NOT_FOUND": 404, "ALREADY_EXISTS": 409, "BUSY": 409, "CONFLICT": 409, "MODEL_MISMATCH": 409, "DENIED": 403,
    "UNSUPPORTED": 501, "TOO_LARGE": 413, "CANCELLED": 499,
}


#: Files a commit carries in a sync that reports its progress.
FILES_A_COMMIT = 2_000
#: Fixed value: bytes after which the log is rolled over.
LOG_BYTES = 4 << 20


class App:
    def __init__(self, spark: SparkSession, data_dir: str, embedder: Embedder | None = None, generator: Generator | None = None):
        self.spark, self.data_dir = spark, os.path.abspath(data_dir)
        self.embedder, self.generator = embedder or WordEmbedder(), generator or ExtractiveGenerator()
        os.makedirs(self.data_dir, exist_ok=True)
        self.log = logging.getLogger(f"docspark.{uuid.uuid4().hex}")  # actions and codes, never texts
        handler = logging.handlers.RotatingFileHandler(f"{self.data_dir}/docspark.log", maxBytes=LOG_BYTES, backupCount=1)
        handler.setFormatter(logging.Formatter("%(asctime)sZ %(message)s", "%Y-%m-%dT%H:%M:%S"))
        handler.formatter.converter = time.gmtime
        self.log.addHandler(handler)
        self.log.setLevel(logging.INFO)
        self.log.propagate = False
        self.jobs, self._readers, self._lock = JobQueue(spark), {}, threading.Lock()
        self.watching: StreamingQuery | None = None

    def _root(self, name: str) -> str:
        return f"file://{self.data_dir}/{check_name(name)}"

    def _audit(self, event: AuditEvent) -> None:
        self.log.info("%s %s %s %d", event.action, event.collection.rpartition("/")[2], event.status, event.count)

    def collections(self) -> list[str]:
        return sorted(n for n in os.listdir(self.data_dir) if NAME.fullmatch(n) and any(os.path.exists(f"{self.data_dir}/{n}/{m}") for m in ("manifests", "manifest.json")))

    def reader(self, name: str) -> Collection:
        """A cached read handle at the newest commit."""
        with self._lock:
            if name not in self._readers:
                self._readers[name] = Collection.open(self.spark, self._root(name), self.embedder, audit=self._audit)
            self._readers[name].refresh()
            return self._readers[name]

    def writer(self, name: str) -> Collection:
        root = self._root(name)
        if name in self.collections():
            return Collection.open(self.spark, root, self.embedder, writer=True, audit=self._audit)
        return Collection.create(self.spark, root, self.embedder, audit=self._audit)

    def ingest(self, name: str, paths: list[str], **options):
        require(bool(paths), "no paths")
        c = self.writer(name)
        try:
            return c.ingest(paths, **options)
        finally:
            c.store.close()

    def ingest_job(self, name: str, paths: list[str]):
        """A job's work: commits as it goes, reports the counters after each, and stops between two when cancelled."""
        return lambda job: self.ingest(name, paths, files_a_commit=FILES_A_COMMIT, progress=job.report, cancelled=job.cancelled)

    def about(self, name: str) -> dict:
        """An answer to questions about a collection itself, which no passage holds."""
        c = self.reader(name)
        largest = [r["source_path"] for r in c.store.largest_documents(20).collect()]
        return {"text": "", "found": True, "about_collection": True, "summary": c.summary(), "documents": largest}

    @contextlib.contextmanager
    def serving(self):
        """One server a data folder: its process id stands in a file while it runs; a file of a process that is gone is taken over."""
        path = f"{self.data_dir}/server.pid"
        for _ in range(2):
            try:
                with open(path, "x", encoding="ascii") as f:
                    f.write(str(os.getpid()))
                break
            except FileExistsError:
                with open(path, encoding="ascii") as f:
                    other = f.read().strip()
                require(not (other.isdigit() and alive(int(other))), f"process {other} serves {self.data_dir}", "BUSY")
                os.unlink(path)
        try:
            yield
        finally:
            os.unlink(path)

    def apply_watch(self) -> StreamingQuery | None:
        """Watch what the settings' ``watch`` block says: collection, folders and, if given, seconds. Without one nothing is watched."""
        if self.watching is not None:
            self.watching.stop()
            self.watching = None
        block = self.settings().get("watch") or {}
        name, folders = block.get("collection"), block.get("folders") or []
        if name and folders:
            self.watching = watch(self.writer(name), folders, block.get("seconds", SECONDS))
        return self.watching

    def settings(self) -> dict:
        path = f"{self.data_dir}/config.json"
        if not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            out = json.load(f)
        require(isinstance(out, dict), "settings have to be an object")
        return out

    def save_settings(self, changes: dict) -> dict:
        """Written beside and moved into place."""
        new = self.settings() | changes
        tmp = f"{self.data_dir}/config-{uuid.uuid4().hex}.tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(new, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, f"{self.data_dir}/config.json")
        if "watch" in changes:
            self.apply_watch()
        return new


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True
