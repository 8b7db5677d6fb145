"""The collection as its users see it."""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.errors import EngineError, require
from docspark.functions.embed import Embedder
from docspark.plans import answer as A
from docspark.plans.batch import answer_many
from docspark.plans.hybrid import Query, search, sentinels, with_similarity
from docspark.plans.store import Store
from docspark.plans.sync import SyncStatus, sync, sync_changes

NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


def check_name(name: str) -> str:
    require(bool(NAME.fullmatch(name)), f"not a collection name: {name!r}")
    return name


@dataclass
class AuditEvent:
    action: str
    collection: str
    status: str
    count: int


#: A filter gets the candidate rows and the principal, and gives the rows that the principal may see.
RetrievalFilter = Callable[[DataFrame, object], DataFrame]


class Collection:
    """Search, questions, additions and removals over one store. ``audit`` is called after each operation."""

    def __init__(self, store: Store, embedder: Embedder | None = None, retrieval_filter: RetrievalFilter | None = None, principal: object = None, audit: Callable[[AuditEvent], None] | None = None):
        if embedder is not None:
            require(embedder.id == store.manifest.embedding_model and embedder.dim == store.manifest.dim, "the embedder is not the collection's", "MODEL_MISMATCH")
        self.store, self.spark, self.embedder = store, store.spark, embedder
        self.retrieval_filter, self.principal, self.audit = retrieval_filter, principal, audit
        self._busy = threading.Lock()

    @classmethod
    def create(cls, spark: SparkSession, root: str, embedder: Embedder, **more) -> Collection:
        out = cls(Store.create(spark, root, embedder.id, embedder.dim), embedder, **more)
        out._tell("create", "OK", 0)
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str, embedder: Embedder | None = None, writer: bool = False, **more) -> Collection:
        out = cls(Store.open(spark, root, writer, embedder.id if embedder else None), embedder, **more)
        out._tell("open", "OK", 0)
        return out

    def _tell(self, action: str, status: str, count: int) -> None:
        if self.audit:
            self.audit(AuditEvent(action, self.store.root, status, count))

    def _audited(self, action: str, work: Callable[[], tuple[object, int]]):
        try:
            out, n = work()
        except EngineError as e:
            self._tell(action, e.status, 0)
            raise
        self._tell(action, "OK", n)
        return out

    # searching

    def _seen(self) -> DataFrame | None:
        if self.retrieval_filter is None:
            return None
        try:
            # only rows of this view can come back, whatever the filter makes
            return self.retrieval_filter(self.store.chunks(), self.principal).select("id")
        except EngineError:
            raise
        except Exception as e:
            raise EngineError("DENIED", f"the retrieval filter failed: {e}") from e

    def query(self, q: Query, allowed: Column | None = None) -> list[dict]:
        def work():
            q.check()
            hits = [r.asDict() for r in sentinels(search(self.store.chunks(), q, allowed, self._seen(), terms=self.store.terms())).collect()]
            return hits, len(hits)

        return self._audited("search", work)

    def search_vector(self, vector: Sequence[float], top_k: int = 5, **more) -> list[dict]:
        return self.query(Query(vector=vector, mode="vector", top_k=top_k, **more))

    def query_text(self, text: str, top_k: int = 5, **more) -> list[dict]:
        require(self.embedder is not None, "a text query needs an embedder")
        return self.query(Query(vector=self.embedder.embed([text], query=True)[0].tolist(), text=text, top_k=top_k, **more))

    def ask(self, question: str | Sequence[dict], model: A.Generator | None = None, top_k: int = 8, budget: int = 1100, least_similarity: float = 0.25, path_prefix: str = "", on_token=None) -> A.Answer:
        """``question``: a text, or a list of messages with one of the user alone."""
        if not isinstance(question, str):
            require(len(question) == 1 and question[0].get("role") == "user", "one message of the user is answered, no more", "UNSUPPORTED")
            question = question[0].get("content") or ""
        require(1 <= top_k <= 100, "top_k has to be 1 to 100")
        require(budget >= 64, "the budget has to be 64 or more")
        require(-1 <= least_similarity <= 1, "a similarity is -1 to 1")
        require(bool(question.strip()), "the question is empty")
        require(self.embedder is not None, "a question needs an embedder")

        def retrieve(s: A.State) -> None:
            vector = self.embedder.embed([s.question], query=True)[0].tolist()
            rows = self.store.chunks()
            hits = search(rows, Query(vector=vector, text=s.question, top_k=top_k, path_prefix=path_prefix), None, self._seen(), terms=self.store.terms())
            found = with_similarity(hits, rows, vector).join(self.store.documents().select("doc_id", "title"), "doc_id", "left")
            order = [F.desc("score"), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()]
            s.passages = [
                A.Passage(r["id"], r["doc_id"], r["source_path"], r["title"] or "", r["page"], r["offset"], r["length"], r["text"], r["score"], r["similarity"], r["content_hash"])
                for r in found.orderBy(*order).collect()  # at most top_k
            ]

        def work():
            stages = A.standard_stages(retrieve, model or A.ExtractiveGenerator(), least_similarity, budget, on_token)
            made = A.make_answer(A.run(stages, A.State(question)))
            return made, len(made.citations)

        return self._audited("ask", work)

    def ask_many(self, questions: DataFrame, model: A.Generator | None = None, top_k: int = 8, budget: int = 1100, least_similarity: float = 0.25) -> DataFrame:
        """``ask`` for a table of questions (query_id, text), in one plan: a row of ``batch.ANSWERS`` each. Null and blank texts
        find nothing."""
        require(self.embedder is not None, "a question needs an embedder")
        require(1 <= top_k <= 100 and budget >= 64 and -1 <= least_similarity <= 1, "top_k, budget or similarity out of range")
        index, embedder = self.store.terms(), self.embedder
        require(index is not None, "the collection has no keyword index", "UNSUPPORTED")

        @F.pandas_udf("array<float>")
        def embed(text: pd.Series) -> pd.Series:
            return pd.Series(list(embedder.embed(text.tolist(), query=True)))

        asked = questions.select("query_id", "text", F.when(F.trim("text") != "", embed(F.coalesce("text", F.lit("")))).alias("embedding"))
        return answer_many(self.store.chunks(), asked, index, model, top_k, budget, least_similarity, self._seen())

    # changing

    def add(self, rows: DataFrame) -> int:
        return self._audited("add", lambda: (lambda n: (n, n))(self.store.add(rows)))

    def remove(self, ids: list[int]) -> None:
        self._audited("remove", lambda: (self.store.delete(ids), len(ids)))

    def remove_document(self, doc_id: str) -> int:
        return self._audited("remove_document", lambda: (lambda n: (n, n))(self.store.delete_document(doc_id)))

    def ingest(self, paths: list[str], **options) -> SyncStatus:
        require(self.embedder is not None, "ingestion needs an embedder")
        if not self._busy.acquire(blocking=False):
            raise EngineError("BUSY", "the collection is being changed")
        try:
            def work():
                try:
                    out = sync(self.spark, self.store, paths, self.embedder, **options)
                except FileNotFoundError as e:
                    raise EngineError("NOT_FOUND", f"no such path: {e}") from e
                return out, out.chunks_added

            return self._audited("ingest", work)
        finally:
            self._busy.release()

    def apply_changes(self, changes: DataFrame, **options) -> SyncStatus:
        """Take up changed, new and removed files, as ``sources.changes`` streams them; waits for another change to end."""
        require(self.embedder is not None, "ingestion needs an embedder")
        with self._busy:
            def work():
                self.store.refresh()
                out = sync_changes(self.spark, self.store, changes, self.embedder, **options)
                return out, out.chunks_added

            return self._audited("ingest", work)

    # describing

    def info(self) -> dict:
        m = self.store.manifest
        return {"embedding_model": m.embedding_model, "dim": m.dim, "count": m.count if m.format_version >= 5 else self.store.chunks().count()}

    def summary(self) -> dict:
        return summarize(self.store.documents()).first().asDict()

    def refresh(self) -> bool:
        return self.store.refresh()


def problems(documents: DataFrame) -> DataFrame:
    """Documents that gave no passages: without text, or failed."""
    return documents.filter(F.col("status") != "ok").select("source_path", "status")


def summarize(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "no_text").alias("no_text"),
        F.count_if(~F.col("status").isin("ok", "no_text")).alias("failed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
    )


def to_json(value: A.Answer | SyncStatus) -> str:
    return json.dumps(asdict(value), ensure_ascii=False)
