"""Changes of files in folders as a stream of rows: path, size, mtime_ns, change (added, changed, removed), listing.

The offset of the stream is the number of a listing, and listings are kept beside the query's checkpoint, so a query that
starts again goes on from the listing that it had reached and gives no file that is as it was. A listing is written in the
order of the walk, and so compared with the one before in one pass without holding either; what differs is written in
parts of PART rows, and a part is a partition. A listing counts from when it is moved into place, after its parts.
What cannot be looked at is unknown and not gone: its files stay in the listing as they were.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from docspark.sources.listing import in_skipped, walk

PART = 1_000
#: Listings that are kept behind the committed one.
BEHIND = 2
SCHEMA = "path string, size long, mtime_ns long, change string, listing long"

Entry = tuple[str, int, int]


def place(path: str) -> tuple[bytes, ...]:
    """A path's place in the order of a walk."""
    return tuple(map(os.fsencode, path.split("/")))


def outermost(folders: list[str]) -> list[str]:
    """The folders that lie in no other one, in order."""
    plain = sorted({os.path.abspath(f) for f in folders}, key=place)
    return [f for f in plain if not any(f.startswith(o.rstrip("/") + "/") for o in plain if o != f)]


def compare(old: Iterator[Entry], new: Iterator[Entry], failed: list[str]) -> Iterator[tuple[Entry, str]]:
    """Entries of the listing now, each with its change ("" for none), and those that are gone."""
    unknown = lambda path: any(path == f or path.startswith(f.rstrip("/") + "/") for f in failed)
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or a and place(a[0]) < place(b[0]):
            yield a, "" if unknown(a[0]) else "removed"
            a = next(old, None)
        elif a is None or place(b[0]) < place(a[0]):
            yield b, "added"
            b = next(new, None)
        else:
            yield b, "" if tuple(a[1:]) == tuple(b[1:]) else "changed"
            a, b = next(old, None), next(new, None)


class Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class FolderReader(DataSourceStreamReader):
    def __init__(self, folders: list[str], state: str, hidden: bool):
        self.folders, self.state, self.hidden = outermost(folders), state.rstrip("/"), hidden

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.state) if "://" in self.state or self.state.startswith("file:") else (fs.LocalFileSystem(), self.state)

    def _numbers(self, store, root: str) -> list[int]:
        from pyarrow import fs

        names = [f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        return sorted(int(m[1]) for m in map(re.compile(r"(\d+)\.listing\.gz").fullmatch, names) if m)

    def _lines(self, store, path: str) -> Iterator[list]:
        with store.open_input_stream(path, compression="gzip") as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from map(json.loads, lines)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The number of the newest listing; a new one is taken, and kept if anything differs."""
        store, root = self._store()
        store.create_dir(root, recursive=True)
        numbers, failed = self._numbers(store, root), []
        n = (numbers or [0])[-1]
        line = lambda x: json.dumps(x).encode() + b"\n"
        walked, listed = (f"{root}/{kind}-{uuid.uuid4().hex}.tmp" for kind in ("walked", "listed"))
        with store.open_output_stream(walked, compression="gzip") as out:
            for folder in self.folders:
                for path, size, mtime in walk(folder, self.hidden, 0, failed):
                    if not in_skipped(path, folder):
                        out.write(line((path, size, mtime)))
        old = self._lines(store, f"{root}/{n:09d}.listing.gz") if n else iter(())
        many, part = 0, None
        with store.open_output_stream(listed, compression="gzip") as out:
            for entry, change in compare(old, self._lines(store, walked), failed):
                if change != "removed":
                    out.write(line(entry))
                if change:
                    if many % PART == 0:
                        if part:
                            part.close()
                        store.create_dir(f"{root}/{n + 1:09d}", recursive=True)
                        part = store.open_output_stream(f"{root}/{n + 1:09d}/{many // PART:09d}.gz", compression="gzip")
                    part.write(line((*entry, change, n + 1)))
                    many += 1
        if part:
            part.close()
        store.delete_file(walked)
        if not many:
            store.delete_file(listed)
            return {"listing": n}
        with store.open_output_stream(f"{root}/{n + 1:09d}/parts") as out:  # more may lie there from a listing that was broken off
            out.write(str(-(-many // PART)).encode())
        store.move(listed, f"{root}/{n + 1:09d}.listing.gz")
        return {"listing": n + 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        store, root = self._store()
        out = []
        for n in range(start["listing"] + 1, end["listing"] + 1):
            with store.open_input_stream(f"{root}/{n:09d}/parts") as f:
                out += [Part(f"{root}/{n:09d}/{k:09d}.gz") for k in range(int(f.read()))]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = self._store()
        yield from map(tuple, self._lines(store, partition.value))

    def commit(self, end: dict) -> None:
        store, root = self._store()
        for n in self._numbers(store, root):
            if n < end["listing"] - BEHIND:
                store.delete_file(f"{root}/{n:09d}.listing.gz")
                store.delete_dir(f"{root}/{n:09d}")


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes")``; options: folders (a JSON list), state (a folder that lives as long as the
    checkpoint), hidden. The driver walks the folders; the executors have to see ``state``."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(json.loads(self.options["folders"]), self.options["state"], self.options.get("hidden", "false") == "true")
