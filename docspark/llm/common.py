"""Scratch tables in the folder that driver and executors share, and small helpers."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.rows import dealt
from docspark.scratch import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six ASCII white-space characters; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


_owner: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owner", default=None)


@contextlib.contextmanager
def owned() -> Iterator[list[str]]:
    """Gives the folders of all scratch spaces that this thread makes inside, for whoever knows when they are read no more."""
    made: list[str] = []
    before = _owner.set(made)
    try:
        yield made
    finally:
        _owner.reset(before)


class Scratch:
    """Tables and files of one operator call, under one folder of the shared directory.

    A written table cuts the lineage, so lost executors cost a read and not a recomputation. Results are read from it
    until they have been written or collected; ``owned`` tells the folders to whoever can then ``delete`` them, and
    ``clear_scratch`` deletes all of an application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        if (made := _owner.get()) is not None:
            made.append(self.root)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            delete(self.spark, t.scratch_path)


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docspark/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch of this application; no result that is still lazy may be used afterwards."""
    delete(spark, application_dir(spark))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


#: How this Python worker forgets what it keeps from task to task, by operator.
_keeps: dict[str, Callable[[], None]] = {}


def turn(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called where a task's Python begins: what other operators keep in this worker is forgotten.

    Spark hands its workers on from stage to stage; they end only when none of an executor's has had work for a minute.
    """
    others = [k for k in _keeps if k != owner]
    for other in others:
        _keeps.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()  # pages of batches that are gone
    if forget:
        _keeps[owner] = forget


def free_prefix(*frames: DataFrame) -> str:
    """A prefix of underscores that no column of the frames begins with, for columns of one's own."""
    taken = [c for f in frames for c in f.columns]
    prefix = "__"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables; documents of one scan split at most are dealt out to the cores first."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return dealt(rows) if table == "documents" else rows
