"""Hybrid queries: exact vectors and keywords over one filtered set of rows, fused by rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.errors import require
from docspark.functions.terms import query_phrases
from docspark.functions.vectors import cosine_from_distance
from docspark.operators.fusion import best, fuse, ranked
from docspark.operators.keyword import KeywordIndex, text_scores
from docspark.operators.vector_search import MOST_K, ExactIndex, VectorIndex

MODES = ("hybrid", "vector", "keyword")
#: How many rows each list holds for k results.
POOL_TIMES, LEAST_POOL, MOST_POOL = 4, 50, 2000


@dataclass(frozen=True)
class Query:
    vector: Sequence[float] | None = None
    text: str | None = None
    mode: str = "hybrid"
    top_k: int = 5
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    path_prefix: str = ""

    def check(self) -> None:
        require(self.mode in MODES, f"unknown mode {self.mode}")
        require(1 <= self.top_k <= MOST_K, f"top_k has to be 1 to {MOST_K}")
        require(self.vector_weight >= 0 and self.keyword_weight >= 0, "weights have to be 0 or more")
        require(self.vector is not None or self.text is not None, "a query needs a vector or a text")
        require(self.mode != "vector" or self.vector is not None, "a vector query needs a vector")
        require(self.mode != "keyword" or self.text is not None, "a keyword query needs a text")

    @property
    def pool(self) -> int:
        return min(max(POOL_TIMES * self.top_k, LEAST_POOL), MOST_POOL)


def allowed_rows(rows: DataFrame, path_prefix: str = "", allowed: Column | None = None, acl: DataFrame | None = None) -> DataFrame:
    """Rows under a path prefix (a plain string prefix), that a predicate lets through and that an access list of ids names."""
    if path_prefix:
        rows = rows.filter(F.col("source_path").startswith(path_prefix))
    if allowed is not None:
        rows = rows.filter(allowed)
    return rows if acl is None else rows.join(acl.select("id"), "id", "left_semi")


def search(rows: DataFrame, q: Query, allowed: Column | None = None, acl: DataFrame | None = None, index: VectorIndex | None = None, terms: KeywordIndex | None = None) -> DataFrame:
    """The q.top_k best rows: id, score, distance, keyword_score, vector_rank, keyword_rank, and similarity.

    ``rows``: id, source_path, text, embedding. Filters come before both lists; keyword statistics are of all rows.
    ``terms``: the keyword index of these rows, else the query's phrases are counted in the texts.
    """
    q.check()
    may = allowed_rows(rows, q.path_prefix, allowed, acl)
    limited = bool(q.path_prefix) or allowed is not None or acl is not None
    spark = rows.sparkSession
    if q.mode != "keyword" and q.vector is not None:
        near = (index or ExactIndex()).search(may, q.vector, q.pool, limited)
        v = ranked(near, "distance", "id", name="vector_rank")
    else:
        v = spark.createDataFrame([], "id long, distance double, vector_rank int")
    phrases = query_phrases(q.text) if q.text is not None and q.mode != "vector" else []
    if phrases:
        ids = may.select("id") if limited else None
        scored = terms.scores(phrases, ids) if terms else text_scores(rows, phrases, ids)
        top = scored.orderBy(F.desc("score"), "id").limit(q.pool).withColumnRenamed("score", "keyword_score")
        k = ranked(top, F.desc("keyword_score"), "id", name="keyword_rank")
    else:
        k = spark.createDataFrame([], "id long, keyword_score double, keyword_rank int")
    return best(fuse(v, k, q.vector_weight, q.keyword_weight), q.top_k)


def with_similarity(hits: DataFrame, rows: DataFrame, vector: Sequence[float]) -> DataFrame:
    """Hits joined to their rows (text fetched for the hits only), with the cosine to the query vector, of unit vectors."""
    from docspark.functions.vectors import as_vector, dot

    joined = rows.join(F.broadcast(hits), "id")  # at most top_k hits
    cosine = F.when(F.col("distance").isNotNull(), cosine_from_distance(F.col("distance"))).otherwise(dot(F.col("embedding"), as_vector(vector)))
    return joined.withColumn("similarity", F.coalesce(cosine, F.lit(-1.0))).drop("embedding")


def sentinels(hits: DataFrame) -> DataFrame:
    """Hits as callers see them: -1, 0 and 0 stand for what a list lacks."""
    return hits.fillna({"distance": -1.0, "keyword_score": 0.0, "vector_rank": 0, "keyword_rank": 0})
