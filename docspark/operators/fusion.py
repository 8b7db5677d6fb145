"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the constant added to ranks.
RANK_OFFSET = 60


def ranked(rows: DataFrame, *order, name: str) -> DataFrame:
    """``rows`` (at most a few thousand, a pool that was cut before) with their 1-based place; a repeated id keeps its first."""
    rows = rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    first = F.row_number().over(Window.partitionBy("id").orderBy(name))
    return rows.withColumn("__first", first).filter("__first = 1").drop("__first")


def fuse(vector: DataFrame, keyword: DataFrame, vector_weight: float = 1.0, keyword_weight: float = 1.0, by: Sequence[str] = ("id",)) -> DataFrame:
    """Rows (id, score, distance, keyword_score, vector_rank, keyword_rank) of both lists.

    ``vector``: id, distance, vector_rank; ``keyword``: id, keyword_score, keyword_rank. What a list lacks is null. A list
    of weight 0 still lists its rows. ``by``: what tells rows apart, also the question if there are many.
    """
    both = vector.join(keyword, list(by), "full_outer")
    term = lambda w, rank: F.coalesce(F.lit(float(w)) / (F.lit(float(RANK_OFFSET)) + F.col(rank)), F.lit(0.0))
    score = term(vector_weight, "vector_rank") + term(keyword_weight, "keyword_rank")
    return both.select(*by, score.alias("score"), "distance", "keyword_score", "vector_rank", "keyword_rank")


def best(fused: DataFrame, k: int) -> DataFrame:
    """The k best, ties first by place in the vector list, then in the keyword list."""
    return fused.orderBy(F.desc("score"), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()).limit(k)
