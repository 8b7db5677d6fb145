"""A collection: passages, their keyword index, document records and settings as versioned Parquet segments.

A commit writes new segments only and then puts a manifest of the next number, which succeeds only if no other writer has
put it first; whoever comes second moves its change onto the newer manifest and tries again. Nobody holds a lock, so a
writer that is killed at any step leaves files that no manifest names, and holds nobody up. Numbers for new passages are
reserved by a manifest of their own, before the passages are written under them. Two commits that touch the same
documents do not merge: the second gets CONFLICT and has to look again.

Additions append a segment of passages and one of postings, removals one of passage ids, records one with a version.
The manifest has each segment's range of ids, rows and bytes, and the numbers of live passages and tokens. Readers see the
manifest they opened until they refresh. ``tidy`` folds segments of like size, ``compact`` all of them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.errors import EngineError, require
from docspark.functions.terms import tokens
from docspark.operators.keyword import POSTINGS, KeywordIndex, index_terms
from docspark.sources.legacy import read_folder

FORMAT, MOST_DIM = 5, 65_536
CHUNKS = "id long, doc_id string, chunk_index long, source_path string, offset long, length long, text string, content_hash string, page long, embedding array<float>"
DOCUMENTS = "doc_id string, source_path string, content_hash string, size long, mtime_ns long, title string, chunk_count long, status string, message string"
#: As they are stored: passages with their number of tokens, records with the version that wrote them, files with their ids.
STORED, RECORDS, FILES = f"{CHUNKS}, n_tokens int", f"{DOCUMENTS}, version long, deleted boolean", "file string, lo long, hi long"
NEW_CHUNKS = [c.split()[0] for c in CHUNKS.split(", ") if not c.startswith("id ")]
#: Removed ids up to this many are broadcast to the scan of chunks; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Segments of like size that ``tidy`` folds into one, and so the base of "like size"; bytes below which all are alike.
FAN, LEAST_BYTES = 4, 1 << 20
#: Times that a change is moved onto a newer manifest.
TRIES = 50
ALL_IDS = (0, 2**63 - 1)
KINDS = ("chunks", "terms", "removed", "documents")


@dataclass(frozen=True)
class Segment:
    """``lo`` and ``hi``: least and greatest id; ``terms``: the postings of the same passages; ``of``: what it was folded from."""

    name: str
    rows: int = 0
    bytes: int = 0
    lo: int = ALL_IDS[0]
    hi: int = ALL_IDS[1]
    terms: str = ""
    of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    """``count`` and ``n_tokens`` are of live passages; ``indexed``: every segment of passages has its postings."""

    embedding_model: str
    dim: int
    format_version: int = FORMAT
    version: int = 0
    next_id: int = 0
    user_version: int = 0
    removed_count: int = 0
    chunks: tuple[Segment, ...] = ()
    removed: tuple[Segment, ...] = ()
    documents: tuple[Segment, ...] = ()
    meta: dict[str, str] = field(default_factory=dict)
    count: int = 0
    n_tokens: int = 0
    indexed: bool = True

    @classmethod
    def of_json(cls, raw: bytes) -> Manifest:
        values = json.loads(raw)
        for fmt, names in ADDED.items():
            require(values["format_version"] < fmt or set(names) <= values.keys(), "the manifest lacks what its format has", "CORRUPT")
        if values["format_version"] < 5:  # names alone, and no counts
            values |= {"indexed": False} | {k: [{"name": n} for n in values[k]] for k in ("chunks", "removed", "documents")}
        own = {k: tuple(Segment(**s | {"of": tuple(s.get("of", ()))}) for s in values[k]) for k in ("chunks", "removed", "documents")}
        return cls(**values | own)

    def to_json(self) -> bytes:
        return json.dumps(asdict(self), indent=1).encode()


#: What manifests of older formats lack. The defaults stand for it.
ADDED = {3: ("user_version", "removed_count"), 4: ("meta",), 5: ("count", "n_tokens", "indexed")}


def largest(documents: DataFrame, k: int) -> DataFrame:
    """The k documents with most passages, ties by path."""
    return documents.orderBy(F.desc("chunk_count"), "source_path").limit(k)


class Store:
    """``Store.create`` and ``Store.open`` give one; ``writer=True`` allows changes, in any number of processes at a time."""

    def __init__(self, spark: SparkSession, root: str, writer: bool = False):
        self.spark, self.root, self.writer = spark, root.rstrip("/"), writer
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest: Manifest

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, embedding_model: str, dim: int, crypto: object = None, keywords: bool = True) -> Store:
        """``keywords``: keep a keyword index; without it, keyword queries read the texts."""
        require(crypto is None, "encryption of the store is not supported", "UNSUPPORTED")
        require(bool(embedding_model), "a collection needs the name of its embedding model")
        require(1 <= dim <= MOST_DIM, f"dimension out of range: {dim}")
        new = cls(spark, root, writer=True)
        require(not new._fs.exists(new._path("")), f"{root} exists", "ALREADY_EXISTS")
        first = Manifest(embedding_model, dim, indexed=keywords)
        require(new._put(first), f"{root} exists", "ALREADY_EXISTS")
        return new

    @classmethod
    def open(cls, spark: SparkSession, root: str, writer: bool = False, embedding_model: str | None = None) -> Store:
        out = cls(spark, root, writer)
        out.refresh()
        m = out.manifest
        require(m.format_version <= FORMAT, f"format {m.format_version} is newer than {FORMAT}", "UNSUPPORTED")
        require(embedding_model in (None, m.embedding_model), f"the collection was made with {m.embedding_model}", "MODEL_MISMATCH")
        if writer:
            out.migrate()
        return out

    @classmethod
    def convert(cls, spark: SparkSession, folder: str, root: str, embedding_model: str, tag: bytes | None = None) -> Store:
        """A collection from a folder of the first format: vector i becomes passage i, without text."""
        header, vectors = read_folder(spark, folder, tag)
        out = cls.create(spark, root, embedding_model, header.dim)
        if header.count:
            out.add_vectors(vectors)
        return out

    def migrate(self) -> bool:
        """Bring an older manifest to FORMAT, with the old one kept beside it; whether there was anything to do.

        Segments are folded on the way, which gives them ranges, token counts and a keyword index.
        """
        old = self.manifest.format_version
        self._may_write()
        if old == FORMAT:
            return False
        kept = self._fs.create(self._path(f"manifest-format{old}.json"), True)
        kept.write(bytearray(self._read_bytes(self._path("manifest.json"))))
        kept.close()
        self._fold(self.manifest.chunks, self.manifest.documents, True)
        return True

    def close(self) -> None:
        self.writer = False

    def _may_write(self) -> None:
        require(self.writer, "the collection is open for reading", "DENIED")

    # manifests

    def _read_bytes(self, path) -> bytes:
        stream = self._fs.open(path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _newest(self) -> Manifest:
        """The manifest with the highest number; of collections before format 5, the one there is."""
        folder = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        if numbers := sorted(n for n in names if n[:1].isdigit()):
            return Manifest.of_json(self._read_bytes(self._path(f"manifests/{numbers[-1]}")))
        require(self._fs.exists(self._path("manifest.json")), f"no collection at {self.root}", "NOT_FOUND")
        return Manifest.of_json(self._read_bytes(self._path("manifest.json")))

    def refresh(self) -> bool:
        """Move to the newest commit; whether there was a newer one."""
        old, self.manifest = getattr(self, "manifest", None), self._newest()
        return old is None or old.version != self.manifest.version

    def _put(self, new: Manifest) -> bool:
        """Write a manifest of a number that none has yet; whether this was the one."""
        jvm, target = self.spark.sparkContext._jvm, self._path(f"manifests/{new.version:012d}.json")
        tmp = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(new.to_json()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # renaming would overwrite: a link does not
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(tmp))
            else:
                option = jvm.org.apache.hadoop.fs.Options.Rename
                kinds = self.spark.sparkContext._gateway.new_array(option, 1)
                kinds[0] = option.NONE  # refuses to overwrite
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(tmp, target, kinds)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(tmp, False)
        self.manifest = new
        return True

    def _publish(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        """Put ``change`` of the newest manifest as the next one, again and again until nobody was faster. ``change`` may
        raise to give up."""
        for i in range(TRIES):
            if self._put(replace(change(self.manifest), version=self.manifest.version + 1)):
                return self.manifest
            time.sleep(min(0.01 * i, 0.2))
            self.refresh()
        raise EngineError("BUSY", f"{self.root} changes all the time")

    # reading

    def _read(self, segments: tuple[Segment, ...], schema: str, part: str = "") -> DataFrame:
        names = [f"{self.root}/{s.terms if part else s.name}{part}" for s in segments]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _live(self, rows: DataFrame, m: Manifest | None = None) -> DataFrame:
        """``rows`` without removed ids."""
        m = m or self.manifest
        if not m.removed:
            return rows
        gone = self._read(m.removed, "id long")
        return rows.join(F.broadcast(gone) if m.removed_count <= BROADCAST_IDS else gone, "id", "left_anti")

    def chunks(self) -> DataFrame:
        """The live passages of this view."""
        return self._live(self._read(self.manifest.chunks, CHUNKS))

    def terms(self) -> KeywordIndex | None:
        """The keyword index of this view, or None if it has none. A query reads the row groups of its terms."""
        m = self.manifest
        if not m.indexed:
            return None
        return KeywordIndex(self._live(self._read(m.chunks, POSTINGS, "/postings")), m.count, m.n_tokens)

    def documents(self, prefix: str = "") -> DataFrame:
        """The newest record of each document whose path begins with ``prefix``."""
        rows = self._read(self.manifest.documents, RECORDS).filter(F.col("source_path").startswith(prefix))
        return _newest_records(rows).filter("NOT deleted").drop("version", "deleted")

    def _of_ids(self, ids: list[int]) -> DataFrame:
        """The stored passages of these ids, from the files that can have them."""
        files = []
        for s in self.manifest.chunks:
            own = [i for i in ids if s.lo <= i <= s.hi]
            if not own:
                continue
            if (s.lo, s.hi) == ALL_IDS:
                files.append(f"{self.root}/{s.name}")
                continue
            holds = F.exists(F.array(*map(F.lit, own)), lambda i: (F.col("lo") <= i) & (i <= F.col("hi")))
            files += [f"{self.root}/{s.name}/{r['file']}" for r in self.spark.read.schema(FILES).parquet(f"{self.root}/{s.name}/_files").filter(holds).collect()]  # a file an id
        if not files:
            return self.spark.createDataFrame([], CHUNKS)
        return self.spark.read.schema(CHUNKS).parquet(*files).filter(F.col("id").isin(ids))

    def get_many(self, ids: list[int]) -> dict[int, dict]:
        """The live passages of these ids that there are, by id, in one job over the files that have them."""
        rows = self._of_ids([int(i) for i in ids])
        if self.manifest.removed:
            rows = rows.join(self._read(self.manifest.removed, "id long").filter(F.col("id").isin([int(i) for i in ids])), "id", "left_anti")
        return {r["id"]: r.asDict() for r in rows.collect()}

    def get(self, chunk_id: int) -> dict:
        found = self.get_many([chunk_id])
        require(bool(found), f"no passage {chunk_id}", "NOT_FOUND")
        return found[chunk_id]

    def get_vector(self, chunk_id: int) -> list[float]:
        return list(self.get(chunk_id)["embedding"])

    def get_document(self, doc_id: str) -> dict:
        """A document's record; files without it are passed over by their Bloom filters."""
        rows = self._read(self.manifest.documents, RECORDS).filter(F.col("doc_id") == doc_id)
        row = _newest_records(rows).filter("NOT deleted").drop("version", "deleted").first()
        require(row is not None, f"no document {doc_id}", "NOT_FOUND")
        return row.asDict()

    def largest_documents(self, k: int) -> DataFrame:
        return largest(self.documents(), k)

    def get_meta(self, name: str) -> str | None:
        return self.manifest.meta.get(name)

    # writing

    def set_meta(self, name: str, value: str) -> None:
        self._may_write()
        self._publish(lambda m: replace(m, meta=m.meta | {name: value}))

    def _delete(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(name), True)

    def _segment(self, df: DataFrame, kind: str, **more) -> Segment:
        """Written rows: with a range of ids and a table of files if they have ids."""
        name = f"{kind}/{self.manifest.version + 1:08d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{name}"
        writer = df.write
        if "doc_id" in df.columns:
            writer = writer.option("parquet.bloom.filter.enabled#doc_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(at)
        if kind == "chunks":
            file = F.element_at(F.split(F.input_file_name(), "/"), -1)
            files = self.spark.read.schema("id long").parquet(at).groupBy(file.alias("file")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
            files.coalesce(1).write.parquet(f"{at}/_files")  # a row a file
            r = self.spark.read.parquet(f"{at}/_files").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.min("lo"), F.lit(0)).alias("lo"), F.coalesce(F.max("hi"), F.lit(-1)).alias("hi")).first()
            out = r.asDict()
        else:
            out = {"rows": self.spark.read.parquet(at).count(), "lo": 0, "hi": -1}
        return Segment(name, bytes=self._fs.getContentSummary(self._path(name)).getLength(), **out | more)

    def _with_terms(self, segment: Segment) -> Segment:
        """The segment of passages with its postings, sorted by term."""
        rows = self._read((segment,), "id long, text string")
        name = segment.name.replace("chunks/", "terms/", 1)
        index_terms(rows).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{self.root}/{name}/postings")
        return replace(segment, terms=name)

    def _staged(self, rows: DataFrame, stage: str) -> tuple[DataFrame, int]:
        """Rows in (source_path, chunk_index) order, written with their places, and how many: the order that is numbered is
        the order that is kept."""
        counted = F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)) if self.manifest.indexed else F.lit(None).cast("int")
        line = rows.select(*NEW_CHUNKS, counted.alias("n_tokens")).repartitionByRange("source_path", "chunk_index").sortWithinPartitions("source_path", "chunk_index")
        line.withColumn("m", F.monotonically_increasing_id()).write.parquet(stage)
        staged = self.spark.read.parquet(stage)
        return staged, staged.count()

    def _numbered(self, staged: DataFrame, first: int) -> DataFrame:
        part = F.shiftright("m", 33)
        counts = staged.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("m").alias("least"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
        bases = counts.withColumn("base", before + first)
        return staged.join(F.broadcast(bases), part == F.col("part")).withColumn("id", F.col("base") + F.col("m") - F.col("least")).select("id", *NEW_CHUNKS, "n_tokens")

    def _check_new(self, rows: DataFrame) -> None:
        bad = F.lit(False)
        for c in ("doc_id", "source_path", "text", "content_hash", "embedding"):
            bad = bad | F.col(c).isNull()
        for c in ("chunk_index", "offset", "length", "page"):
            bad = bad | F.col(c).isNull() | (F.col(c) < 0)
        bad = bad | (F.size("embedding") != self.manifest.dim)
        require(rows.filter(bad).isEmpty(), "a passage has nulls, negative numbers or a vector of another size")

    def commit(self, add: DataFrame | None = None, remove_ids: DataFrame | None = None, records: DataFrame | None = None, drop_documents: DataFrame | None = None, user_version: int | None = None) -> int:
        """One all-or-nothing change: the number of passages that were added.

        ``add``: passages without ids; ``remove_ids``: (id); ``records``: documents, which replace those with their doc_id;
        ``drop_documents``: (doc_id), their records go. Passages of replaced documents go by ``remove_ids``. CONFLICT if
        another commit has changed one of these documents since this store was opened or refreshed; nothing is changed
        then, and the store has the newest manifest.
        """
        self._may_write()
        seen, n, stage, made = self.manifest, 0, f"staging-{uuid.uuid4().hex}", []
        added = removed = None
        written: list[Segment] = []
        try:
            if add is not None:
                self._check_new(add)
                staged, n = self._staged(add, f"{self.root}/{stage}")
                if n:
                    first = self._publish(lambda m: replace(m, next_id=m.next_id + n)).next_id - n
                    added = self._segment(self._numbered(staged, first), "chunks")
                    made.append(added.name)
                    n_tokens = self._read((added,), STORED).agg(F.sum("n_tokens")).first()[0] or 0
                    if self.manifest.indexed:
                        made.append(added.name.replace("chunks/", "terms/", 1))
                        added = self._with_terms(added)
            if remove_ids is not None:
                removed = self._segment(remove_ids.select("id").distinct(), "removed")
                made.append(removed.name)
            for df, deleted in ((records, False), (drop_documents, True)):
                if df is not None:
                    if deleted:
                        df = df.select("doc_id", *(F.lit("" if t == "string" else 0).cast(t).alias(c) for c, t in (x.split() for x in DOCUMENTS.split(", ")[1:])))
                        known = self._read(seen.documents, RECORDS).select("doc_id", F.col("source_path").alias("p")).distinct()
                        df = df.join(known, "doc_id").withColumn("source_path", F.col("p")).drop("p")
                    written.append(self._segment(df.withColumns({"version": F.lit(self.manifest.version + 1).cast("long"), "deleted": F.lit(deleted)}), "documents"))
                    made.append(written[-1].name)

            def change(m: Manifest) -> Manifest:
                require(not (added and m.indexed and not added.terms), "the collection has been indexed meanwhile", "CONFLICT")
                if written:
                    self._check_documents(tuple(written), seen, m)
                gone = gone_tokens = 0
                if removed is not None and removed.rows:
                    r = self._live(self._read(m.chunks, STORED).select("id", "n_tokens"), m).join(self._read((removed,), "id long"), "id", "left_semi").agg(F.count("*"), F.sum("n_tokens")).first()
                    gone, gone_tokens = r[0], r[1] or 0
                return replace(
                    m, chunks=(*m.chunks, *([added] if added else [])), removed=(*m.removed, *([removed] if gone else [])), documents=(*m.documents, *written),
                    removed_count=m.removed_count + gone, count=m.count + n - gone, n_tokens=m.n_tokens + (n_tokens if n else 0) - gone_tokens,
                    user_version=m.user_version if user_version is None else user_version,
                )

            self._publish(change)
            made.clear()
        finally:
            self._delete(stage, *made)
        return n

    def _check_documents(self, own: tuple[Segment, ...], seen: Manifest, now: Manifest) -> None:
        """CONFLICT if records that came since ``seen`` are of the same documents as ``own``; folded segments count as new
        unless all that they were folded from had been seen."""
        known = {s.name for s in seen.documents}
        new = tuple(s for s in now.documents if s.name not in known and not (s.of and known.issuperset(s.of)))
        if new:
            ids = self._read(new, RECORDS).select("doc_id")
            require(self._read(own, RECORDS).join(ids, "doc_id", "left_semi").isEmpty(), "another commit has changed the same documents", "CONFLICT")

    def again(self, work: Callable[[], object], tries: int = 5):
        """``work``, which looks at the collection and commits, repeated on the newest manifest if it meets a conflict."""
        for i in range(tries):
            try:
                return work()
            except EngineError as e:
                if e.status != "CONFLICT" or i == tries - 1:
                    raise
                self.refresh()

    def add(self, rows: DataFrame) -> int:
        return self.commit(add=rows)

    def add_vectors(self, vectors: DataFrame) -> int:
        """Passages without texts from bare vectors (id, embedding), such as a collection of the first format: in an empty
        collection vector i gets id i."""
        none = F.lit("")
        return self.add(vectors.select(
            F.lit("v1").alias("doc_id"), F.col("id").alias("chunk_index"), none.alias("source_path"), F.lit(0).cast("long").alias("offset"),
            F.lit(0).cast("long").alias("length"), none.alias("text"), none.alias("content_hash"), F.lit(0).cast("long").alias("page"), "embedding",
        ))

    def delete(self, ids: list[int]) -> None:
        """All or nothing: an id that is not there refuses the whole call."""
        wanted = {int(i) for i in ids}
        require(self.get_many(sorted(wanted)).keys() == wanted, "a passage to be removed does not exist", "NOT_FOUND")
        self.commit(remove_ids=self.spark.createDataFrame([(i,) for i in sorted(wanted)], "id long"))

    def delete_document(self, doc_id: str) -> int:
        def work() -> int:
            ids = self.chunks().filter(F.col("doc_id") == doc_id).select("id")
            n = ids.count()
            self.commit(remove_ids=ids, drop_documents=self.spark.createDataFrame([(doc_id,)], "doc_id string"))
            return n

        return self.again(work)

    def replace_document(self, record: DataFrame, rows: DataFrame) -> int:
        """Replace one document: the passages get the record's doc_id, and the record their number."""
        r = record.first()
        rows = rows.withColumn("doc_id", F.lit(r["doc_id"]))
        record = record.withColumn("chunk_count", F.lit(rows.count()))
        return self.again(lambda: self.commit(add=rows, remove_ids=self.chunks().filter(F.col("doc_id") == r["doc_id"]).select("id"), records=record))

    # folding

    def _fold_chunks(self, old: tuple[Segment, ...], indexed: bool) -> tuple[Segment, ...]:
        """One segment of the live passages of some, sorted by id; none if none is left."""
        rows = self._live(self._read(old, STORED))
        if indexed:
            rows = rows.withColumn("n_tokens", F.coalesce("n_tokens", F.size(tokens(F.col("text"))), F.lit(0)))
        new = self._segment(rows.repartitionByRange("id").sortWithinPartitions("id"), "chunks", of=tuple(s.name for s in old))
        if not new.rows:
            self._delete(new.name)
            return ()
        if indexed and all(s.terms for s in old):  # merged: no text is read again
            name = new.name.replace("chunks/", "terms/", 1)
            merged = self._live(self._read(old, POSTINGS, "/postings"))
            merged.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{self.root}/{name}/postings")
            return (replace(new, terms=name),)
        return (self._with_terms(new) if indexed else new,)

    def _fold(self, chunks: tuple[Segment, ...], documents: tuple[Segment, ...], indexed: bool) -> bool:
        """Replace some segments by one of each kind; False if another fold was faster. Commits that come meanwhile stay."""
        m, made = self.manifest, []
        new_chunks = self._fold_chunks(chunks, indexed) if chunks else ()
        new_documents = ()
        if documents:
            rows = _newest_records(self._read(documents, RECORDS))
            rows = rows if len(documents) < len(m.documents) else rows.filter("NOT deleted")  # older records may be elsewhere
            new_documents = (self._segment(rows, "documents", of=tuple(s.name for s in documents)),)
        kept, new_removed = [s for s in m.chunks if s not in chunks], ()
        if chunks and m.removed and kept:  # ids that are still somewhere
            left = self._read(m.removed, "id long").distinct().join(self._read(tuple(kept), "id long"), "id", "left_semi")
            new_removed = (self._segment(left, "removed", of=tuple(s.name for s in m.removed)),)
        made = [s.name for s in (*new_chunks, *new_documents, *new_removed)] + [s.terms for s in new_chunks if s.terms]
        folded = {*(s.name for s in chunks), *(s.name for s in documents), *(s.name for s in (m.removed if chunks else ()))}

        def change(now: Manifest) -> Manifest:
            names = {s.name for s in (*now.chunks, *now.documents, *now.removed)}
            require(folded <= names, "another fold was faster", "CONFLICT")
            left = lambda of: tuple(s for s in of if s.name not in folded)
            removed = (*(s for s in new_removed if s.rows), *left(now.removed))
            totals = {"format_version": FORMAT}
            if now.format_version < 5 or indexed and not now.indexed:
                r = self._read((*new_chunks, *left(now.chunks)), STORED).agg(F.count("*"), F.sum("n_tokens")).first()
                totals |= {"count": r[0], "n_tokens": r[1] or 0}
            return replace(
                now, chunks=(*new_chunks, *left(now.chunks)), removed=removed, documents=(*new_documents, *left(now.documents)),
                removed_count=sum(s.rows for s in removed), indexed=now.indexed or indexed, **totals,
            )

        try:
            self._publish(change)
        except EngineError as e:
            self._delete(*made)
            if e.status != "CONFLICT":
                raise
            return False
        return True

    def compact(self, index: bool | None = None) -> bool:
        """Fold all segments into one of each kind; ids stay. Readers of older manifests keep their files. ``index``: make a
        keyword index if there is none."""
        self._may_write()
        m = self.manifest
        return self._fold(m.chunks, m.documents, m.indexed if index is None else index or m.indexed)

    def tidy(self, least_bytes: int = LEAST_BYTES) -> int:
        """Fold segments of like size, FAN or more at a time, until no more are alike; how many folds. Each byte is so written
        again a logarithm of times, and there are about FAN segments for each size."""
        self._may_write()
        folds = 0
        while True:
            alike = tuple(_alike(s, least_bytes) for s in (self.manifest.chunks, self.manifest.documents))
            if not any(alike) or not self._fold(*alike, self.manifest.indexed):
                return folds
            folds += 1

    def vacuum(self, older_s: float = 3600) -> None:
        """Delete manifests but the newest, and files that it does not name, last changed ``older_s`` seconds ago or before: no
        reader may be on an older manifest, and no commit may take longer."""
        before = (time.time() - older_s) * 1000
        named = {s.name for kind in ("chunks", "removed", "documents") for s in getattr(self.manifest, kind)} | {s.terms for s in self.manifest.chunks}
        named.add(f"manifests/{self.manifest.version:012d}.json")
        for kind in (*KINDS, "manifests", ""):
            if self._fs.exists(self._path(kind)):
                for s in self._fs.listStatus(self._path(kind)):
                    name = s.getPath().getName()
                    if (kind or name.startswith("staging-")) and f"{kind}/{name}".lstrip("/") not in named and s.getModificationTime() <= before:
                        self._fs.delete(s.getPath(), True)


def _newest_records(rows: DataFrame) -> DataFrame:
    columns = [c.split()[0] for c in RECORDS.split(", ")]
    newest = F.max_by(F.struct(*columns), "version")
    return rows.groupBy("doc_id").agg(newest.alias("r")).select("r.*")


def _alike(segments: tuple[Segment, ...], least_bytes: int) -> tuple[Segment, ...]:
    """The smallest segments of like size, by powers of FAN, if there are FAN of them."""
    by: dict[int, list[Segment]] = {}
    for s in segments:
        level = 0
        while s.bytes >= least_bytes * FAN**level:
            level += 1
        by.setdefault(level, []).append(s)
    return next((tuple(by[k]) for k in sorted(by) if len(by[k]) >= FAN), ())
