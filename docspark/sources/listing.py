"""Listing of files and folders."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Folders of software that a walk does not enter, and the deepest level that it does.
SKIPPED = ("node_modules", "site-packages", "dist-packages", "__pycache__", ".venv", "Pods", ".gradle", ".cargo", ".git", ".svn")
MOST_DEPTH = 256
#: A row with ``failed`` is a folder that could not be listed, or a file that could not be looked at.
SCHEMA = "path string, size long, mtime_ns long, skipped boolean, failed boolean"


def walk(root: str, hidden: bool = False, depth: int = 0, failed: list[str] | None = None) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime_ns) in byte order; linked folders are not entered, linked files are listed. ``failed`` gets the
    paths of what is there and cannot be listed or looked at, and of a root that is not there."""
    if depth > MOST_DEPTH:
        return
    failed = [] if failed is None else failed
    try:
        names = sorted(os.listdir(root), key=os.fsencode)
    except FileNotFoundError:
        if not depth:
            failed.append(root)
        return
    except OSError:
        failed.append(root)
        return
    for name in names:
        if name.startswith(".") and not hidden:
            continue
        path = os.path.join(root, name)
        try:
            s = os.stat(path)
        except FileNotFoundError:  # gone meanwhile, or a link to nothing
            continue
        except OSError:
            failed.append(path)
            continue
        if not stat.S_ISDIR(s.st_mode):
            yield path, s.st_size, s.st_mtime_ns
        elif not os.path.islink(path) and depth < MOST_DEPTH:
            yield from walk(path, hidden, depth + 1, failed)


def in_skipped(path: str, root: str) -> bool:
    """Whether a folder of SKIPPED lies between the walked root and the file."""
    return any(p in SKIPPED for p in os.path.relpath(path, root).split(os.sep)[:-1])


def list_paths(spark: SparkSession, paths: list[str], hidden: bool = False) -> DataFrame:
    """A row a file under ``paths`` (files or folders), and one for each folder that could not be listed, whose files are then
    unknown and not gone. All paths are looked at first: one that is missing stops everything.

    The folders right below the given ones are walked by tasks of their own, so that the driver holds no listing but of
    these. All executors have to see the folders, as reading the files asks for anyway.
    """
    for p in paths:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
    rows, folders = [], []
    for p in paths:
        if not os.path.isdir(p):
            s = os.stat(p)
            rows.append((p, s.st_size, s.st_mtime_ns, False, False))
            continue
        failed: list[str] = []
        rows += [(f, n, t, False, False) for f, n, t in walk(p, hidden, MOST_DEPTH, failed)]
        rows += [(f, None, None, False, True) for f in failed]
        if p not in failed:
            below = [e.name for e in os.scandir(p) if e.is_dir(follow_symlinks=False) and (hidden or not e.name.startswith("."))]
            folders += [(p, os.path.join(p, n)) for n in below]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for root, folder in zip(b["root"], b["folder"], strict=True):
                failed: list[str] = []
                found = [(f, n, t, in_skipped(f, root), False) for f, n, t in walk(folder, hidden, 1, failed)]
                found += [(f, None, None, in_skipped(f, root), True) for f in failed]
                yield pd.DataFrame(found, columns=["path", "size", "mtime_ns", "skipped", "failed"]).astype({"size": "Int64", "mtime_ns": "Int64"})

    own = spark.createDataFrame(rows, SCHEMA)
    if not folders:
        return own
    tasks = spark.createDataFrame(folders, "root string, folder string").repartition(min(len(folders), 10_000), "folder")
    return own.unionByName(tasks.mapInPandas(run, SCHEMA))


def list_remote(spark: SparkSession, root: str) -> DataFrame:
    """The same listing through Spark, for stores that only Spark reads: times in microseconds, contents not read."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.split(F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path")), "/")
    skipped = F.arrays_overlap(F.slice(rel, 1, F.greatest(F.size(rel) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED)))
    return files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), skipped.alias("skipped"), F.lit(False).alias("failed"))
