"""Keeping a collection in step with folders of files.

The listing is joined with the stored records; files that may have changed are read, extracted, split and embedded in
parallel, where what fails becomes a row with a status; one commit then carries all changes, or a few do.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.errors import EngineError
from docspark.functions.embed import Embedder, embed_all
from docspark.operators.chunk import MOST, OVERLAP, TARGET, check_limits, chunk_text
from docspark.plans.store import DOCUMENTS, Store
from docspark.sources.extract import MOST_BYTES, REGISTRY, is_supported, safe_extract
from docspark.sources.listing import list_paths

#: Version of how passages are made and embedded; a collection with another one is embedded anew.
RECIPE = 2
_PIECE = "chunk_index:long,offset:long,length:long,page:long,text:string,embedding:array<float>"
#: A file's passages go on in rows of at most PIECES; ``part`` counts a file's rows from 0, ``n_pieces`` all of its passages.
PIECES = 256
RESULT = f"source_path string, size long, mtime_ns long, known boolean, action string, content_hash string, title string, message string, part int, n_pieces long, pieces array<struct<{_PIECE}>>"


@dataclass(frozen=True)
class SyncStatus:
    """Counters of a run. ``files_seen``: supported files outside skipped folders; ``files_skipped``: unsupported ones."""

    files_seen: int = 0
    files_added: int = 0
    files_updated: int = 0
    files_unchanged: int = 0
    files_no_text: int = 0
    files_failed: int = 0
    files_removed: int = 0
    files_skipped: int = 0
    chunks_added: int = 0
    chunks_removed: int = 0


def plan_sync(listing: DataFrame, documents: DataFrame, same_recipe: Column | bool = True) -> DataFrame:
    """Each listed file with what is stored of it and ``look``: whether its content has to be read.

    A file is left alone without reading it if it is known, was no error, was made by this recipe, and has the stored
    size and time.
    """
    same_recipe = F.lit(same_recipe) if isinstance(same_recipe, bool) else same_recipe
    stored = documents.select("source_path", *(F.col(c).alias(f"old_{c}") for c in ("content_hash", "size", "mtime_ns", "status")))
    rows = listing.withColumnRenamed("path", "source_path").join(stored, "source_path", "left")
    known = F.col("old_status").isNotNull()
    still = known & (F.col("old_status") != "error") & same_recipe & (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime_ns"))
    return rows.withColumns({"known": known, "look": ~still, "may_keep": known & (F.col("old_status") != "error") & same_recipe})


def removals(documents: DataFrame, seen: DataFrame, folders: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Stored documents below the folders that the listing lacks. A folder's name counts with its slash.

    ``failed``: paths that could not be looked at; documents at or below them are not known to be gone.
    """
    below = F.lit(False)
    for f in folders:
        below = below | F.col("source_path").startswith(f.rstrip("/") + "/")
    gone = documents.filter(below).join(seen.select("source_path"), "source_path", "left_anti")
    if failed is None:
        return gone
    parts = F.split("source_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    unknown = gone.select("source_path", F.explode(above).alias("path")).join(failed.select("path"), "path", "left_semi")
    return gone.join(unknown.select("source_path"), "source_path", "left_anti")


def content_digest_column(raw: Column) -> Column:
    """``content_digest`` of a binary column."""
    return F.concat(F.lit("sha256:"), F.sha2(raw, 256))


def content_digest(raw: bytes) -> str:
    return "sha256:" + hashlib.sha256(raw).hexdigest()


def _read(path: str) -> bytes | None:
    """A file's bytes; a path with a scheme is read from the store that it names."""
    try:
        if "://" in path or path.startswith("file:"):
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_stream(at) as f:
                return f.read()
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def make_processor(embedder: Embedder, target: int, most: int, overlap: int, waits):
    registry = dict(REGISTRY)

    def one(path: str, size: int, known: bool, may_keep: bool, old_hash: str | None) -> dict:
        out = {"action": "", "content_hash": "", "title": "", "message": "", "pieces": []}
        if size > MOST_BYTES:  # by the listing, before a byte is read
            return out | {"action": "failed", "message": "the file is too large"}
        raw = _read(path)
        if raw is None:
            return out | {"action": "failed", "message": "cannot read file"}
        digest = content_digest(raw)
        if may_keep and digest == old_hash:
            return out | {"action": "touched", "content_hash": digest}
        x = safe_extract(raw, path, registry)
        out |= {"content_hash": digest, "title": x["title"]}
        if x["status"] != "ok":
            return out | {"action": "failed", "message": x["message"]}
        try:
            found = chunk_text(x["text"], x["pages"], target, most, overlap)
        except Exception as e:
            return out | {"action": "failed", "message": f"cannot split: {e}"}
        if not found:
            return out | {"action": "no_text"}
        data = x["text"].encode()
        texts = [data[o : o + n].decode() for o, n, _ in found]
        try:
            vectors = embed_all(embedder, texts, waits)
        except Exception as e:
            return out | {"action": "retry", "content_hash": "", "message": f"embedding failed and will try again: {e}"[:300]}
        pieces = [{"chunk_index": i, "offset": o, "length": n, "page": g, "text": t, "embedding": v} for i, ((o, n, g), t, v) in enumerate(zip(found, texts, vectors, strict=True))]
        return out | {"action": "updated" if known else "added", "pieces": pieces}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(len(b)):
                r = b.iloc[at]
                x = one(r["source_path"], int(r["size"]), bool(r["known"]), bool(r["may_keep"]), r["old_content_hash"])
                pieces = x.pop("pieces")
                for part in range(max(1, -(-len(pieces) // PIECES))):
                    own = {"part": part, "n_pieces": len(pieces), "pieces": pieces[part * PIECES : (part + 1) * PIECES]}
                    yield pd.DataFrame([{"source_path": r["source_path"], "size": r["size"], "mtime_ns": r["mtime_ns"], "known": r["known"], **x, **own}])

    return run


def sync(
    spark: SparkSession, store: Store, paths: list[str], embedder: Embedder, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, hidden: bool = False, waits=(0.4, 0.8),
    files_a_commit: int | None = None, progress: Callable[[SyncStatus], None] | None = None, cancelled: Callable[[], bool] | None = None,
) -> SyncStatus:
    """Bring the store in step with ``paths``; a file that two of them reach is visited once and then counts as unchanged.

    One commit carries all, or about ``files_a_commit`` files each: then ``progress`` gets the counters after each commit,
    and ``cancelled`` is asked before each; what is committed stays, and the next sync takes up what is left.
    """
    check_limits(target, most, overlap)
    found = list_paths(spark, paths, hidden).filter("NOT skipped").drop("skipped")
    every, failed = found.filter("NOT failed").drop("failed"), found.filter("failed")
    visits, listing = every.filter(is_supported(F.col("path"))).count(), every.dropDuplicates(["path"])
    supported = listing.filter(is_supported(F.col("path")))
    documents = store.documents()
    plan = plan_sync(supported, documents, store.manifest.user_version == RECIPE)
    todo = plan.filter("look").select("source_path", "size", "mtime_ns", "known", "may_keep", "old_content_hash")
    gone = removals(documents, plan, [p for p in paths if os.path.isdir(p)], failed).select("doc_id")
    parts = max(1, -(-todo.count() // files_a_commit)) if files_a_commit else 1
    again = visits - supported.count()
    out = SyncStatus(files_seen=visits, files_unchanged=plan.filter("NOT look").count() + again, files_skipped=every.count() - visits)
    run = make_processor(embedder, target, most, overlap, tuple(waits))
    for part in range(parts):
        if cancelled and cancelled():
            raise EngineError("CANCELLED", "the sync was stopped")
        own = todo if parts == 1 else todo.filter(F.pmod(F.xxhash64("source_path"), F.lit(parts)) == part)
        out = _commit_part(spark, store, own, documents, gone if part == parts - 1 else None, run, out, RECIPE if part == parts - 1 else None)
        if progress:
            progress(out)
    return out


def sync_changes(spark: SparkSession, store: Store, changes: DataFrame, embedder: Embedder, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, waits=(0.4, 0.8)) -> SyncStatus:
    """Bring the store in step with what has changed in folders, without listing them: ``path, size, mtime_ns, change, listing``.

    Of several changes of a path the one of the latest listing counts. Documents whose embedding failed are tried again. The
    same changes a second time change nothing.
    """
    check_limits(target, most, overlap)
    newest = changes.groupBy("path").agg(F.max_by(F.struct("size", "mtime_ns", "change"), "listing").alias("c")).select("path", "c.*")
    there, documents = newest.filter((F.col("change") != "removed") & is_supported(F.col("path"))).drop("change"), store.documents()
    failed = documents.filter("status = 'error' AND mtime_ns = 0").select(F.col("source_path").alias("path"), "size", F.lit(0).cast("long").alias("mtime_ns"))
    same = store.manifest.user_version == RECIPE
    plan = plan_sync(there.unionByName(failed.join(newest, "path", "left_anti")), documents, same)
    todo = plan.filter("look").select("source_path", "size", "mtime_ns", "known", "may_keep", "old_content_hash")
    gone = documents.join(newest.filter("change = 'removed'").select(F.col("path").alias("source_path")), "source_path", "left_semi").select("doc_id")
    out = SyncStatus(files_seen=there.count(), files_unchanged=plan.filter("NOT look").count(), files_skipped=newest.filter((F.col("change") != "removed") & ~is_supported(F.col("path"))).count())
    if todo.isEmpty() and gone.isEmpty():
        return out
    recipe = RECIPE if same or not store.manifest.documents else None  # an older collection is made anew by a whole sync
    return _commit_part(spark, store, todo, documents, gone, make_processor(embedder, target, most, overlap, tuple(waits)), out, recipe)


def _commit_part(spark: SparkSession, store: Store, todo: DataFrame, documents: DataFrame, gone: DataFrame | None, run, before: SyncStatus, recipe: int | None) -> SyncStatus:
    stage = f"{store.root}/staging-{uuid.uuid4().hex}"
    many = max(1, spark.sparkContext.defaultParallelism * 4)
    todo.repartition(many, "source_path").mapInPandas(run, RESULT).write.parquet(stage)
    staged = spark.read.parquet(stage)
    done = staged.filter("part = 0")  # a row a file
    status = F.when(F.col("action").isin("added", "updated"), "ok").when(F.col("action") == "no_text", "no_text").otherwise("error")
    written = done.filter("action <> 'touched'").select(
        F.col("source_path").alias("doc_id"), "source_path", "content_hash", "size",
        F.when(F.col("action") == "retry", 0).otherwise(F.col("mtime_ns")).cast("long").alias("mtime_ns"), "title",
        F.col("n_pieces").alias("chunk_count"), status.alias("status"), "message",
    )
    touched = done.filter("action = 'touched'").select("source_path", "size", "mtime_ns").join(documents.drop("size", "mtime_ns"), "source_path")
    columns = [c.split()[0] for c in DOCUMENTS.split(", ")]
    records = written.select(columns).unionByName(touched.select(columns))
    changed = done.filter("action <> 'touched'").select(F.col("source_path").alias("doc_id"))
    changed = changed if gone is None else changed.unionByName(gone)
    new = staged.select("source_path", "content_hash", F.explode("pieces").alias("p")).select(
        F.col("source_path").alias("doc_id"), "source_path", "content_hash", "p.chunk_index", "p.offset", "p.length", "p.page", "p.text", "p.embedding"
    )
    counts = dict(done.groupBy("action").count().collect())
    removed = gone.count() if gone is not None else 0

    def commit() -> tuple[int, int]:
        old = store.chunks().join(changed, "doc_id", "left_semi").select("id")
        n = old.count()
        return store.commit(add=new, remove_ids=old if n else None, records=records if counts else None, drop_documents=gone if removed else None, user_version=recipe), n

    added, chunks_removed = store.again(commit)
    store._fs.delete(store._path(stage.removeprefix(store.root + "/")), True)
    return replace(
        before, files_added=before.files_added + counts.get("added", 0), files_updated=before.files_updated + counts.get("updated", 0),
        files_unchanged=before.files_unchanged + counts.get("touched", 0), files_no_text=before.files_no_text + counts.get("no_text", 0),
        files_failed=before.files_failed + counts.get("failed", 0) + counts.get("retry", 0), files_removed=before.files_removed + removed,
        chunks_added=before.chunks_added + added, chunks_removed=before.chunks_removed + chunks_removed,
    )
