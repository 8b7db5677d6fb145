"""Watching folders: a stream of changed files that the collection takes up batch by batch.

The source's offsets are listings of the folders, kept with the checkpoint, so that nothing is read twice, also not by a
query that starts again. A batch that is repeated finds its files stored and changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docspark.api import Collection
from docspark.errors import require
from docspark.plans.sync import SyncStatus
from docspark.sources.changes import FolderChanges

#: Folders that are watched at most, and seconds between looks.
MOST_FOLDERS, SECONDS = 16, 60


def watch(collection: Collection, folders: list[str], seconds: int = SECONDS, on_status: Callable[[SyncStatus], None] | None = None, once: bool = False, checkpoint: str | None = None, **options) -> StreamingQuery:
    """Start watching; ``once`` takes up what has changed and ends. A folder that is missing or cannot be listed keeps its
    documents. ``checkpoint``: by default a folder in the collection, one for these folders."""
    require(collection.embedder is not None, "watching needs an embedder")

    def take(changes: DataFrame) -> None:
        status = collection.apply_changes(changes, **options)
        if on_status:
            on_status(status)

    return watch_folders(collection.spark, take, folders, checkpoint or checkpoint_in(collection.store.root, folders), seconds, once)


def checkpoint_in(root: str, folders: list[str]) -> str:
    return f"{root}/watch/{hashlib.sha256(json.dumps(sorted(folders)).encode()).hexdigest()[:16]}"


def watch_folders(spark: SparkSession, take: Callable[[DataFrame], object], folders: list[str], checkpoint: str, seconds: int = SECONDS, once: bool = False) -> StreamingQuery:
    """``take`` gets the changed files of each batch."""
    require(0 < len(folders) <= MOST_FOLDERS, f"1 to {MOST_FOLDERS} folders can be watched")
    spark.dataSource.register(FolderChanges)
    changes = spark.readStream.format("folder_changes").option("folders", json.dumps(folders)).option("state", f"{checkpoint}/listings").load()
    writer = changes.writeStream.foreachBatch(lambda rows, _: take(rows)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
