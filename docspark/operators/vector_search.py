"""Exact nearest neighbours by squared distance, ties by id.

Vectors are compared with queries by matrix products in single precision; what those may not rule out, with a bound on
their rounding, is measured again by differences in double precision. ``pack_vectors`` lays vectors out in blocks of
contiguous numbers, which reach Python without a conversion for each number; written, they are the layout to search often.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.lists import LISTS, merged_lists, packed_lists

MOST_K = 10_000
#: Queries that a batch is compared with at once; vectors and queries of a packed block.
QUERY_BLOCK, VECTORS_A_BLOCK, QUERIES_A_BLOCK = 256, 4096, 1024
#: Bytes of packed queries that are broadcast to the scan of vectors; more are joined block by block without it.
BROADCAST_BYTES = 64 << 20
BLOCKS = "ids binary, data binary, n int"


def check_k(k: int) -> None:
    if not 1 <= k <= MOST_K:
        raise ValueError(f"top_k has to be 1 to {MOST_K}: {k}")


class VectorIndex(Protocol):
    """What a hybrid query needs of an index over vectors. ``limited``: ``vectors`` are not all that the index was made of."""

    name: str

    def search(self, vectors: DataFrame, query: Sequence[float], k: int, limited: bool = True) -> DataFrame: ...


class ExactIndex:
    """Every vector is compared, an Arrow batch at a time; a task passes on its k best. Filter before, not after."""

    name = "exact"

    def __init__(self, id_col: str = "id", vector_col: str = "embedding"):
        self.id_col, self.vector_col = id_col, vector_col

    def search(self, vectors: DataFrame, query: Sequence[float], k: int, limited: bool = True) -> DataFrame:
        """Rows (id, distance), ascending; fewer than k if there are fewer vectors. Rows without a vector are left out."""
        check_k(k)
        rows = _candidates(vectors, [(0, query)], k, self.id_col, self.vector_col)
        return rows.select("id", "distance").orderBy("distance", "id").limit(k)


def top_k(vectors: DataFrame, query: Sequence[float], k: int, allowed: Column | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest among the rows that ``allowed`` lets through."""
    rows = vectors if allowed is None else vectors.filter(allowed)
    return ExactIndex(id_col, vector_col).search(rows, query, k)


def top_k_batched(vectors: DataFrame, queries: list[tuple[int, Sequence[float]]], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, id, distance, rank) for a given list of queries."""
    check_k(k)
    if not queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return _candidates(vectors, queries, k, id_col, vector_col).withColumn("rank", rank).filter(F.col("rank") <= k)


def _near(m: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the pairs that can be among each query's k best of these rows."""
    a, b = m.astype(np.float32, copy=False), q.astype(np.float32)
    squares, own = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    near = b @ a.T
    near *= -2
    near += squares
    if k < len(m):
        # each product and sum is off by a rounding a term at most
        slack = 6e-8 * (m.shape[1] + 8) * (own + squares.max() + 2 * np.sqrt(own * squares.max()))
        kth = np.partition(near, k - 1, axis=1)[:, k - 1]
        qi, vi = np.nonzero(near <= (kth + 2 * slack)[:, None])
    else:
        qi, vi = (x.ravel() for x in np.indices(near.shape))
    return qi, vi, ((m[vi].astype(np.float64) - q[qi]) ** 2).sum(1)


class _Best:
    """The k best (distance, id) of each of some queries, over any number of batches."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        for at in range(0, len(self.queries), QUERY_BLOCK):
            qi, vi, d = _near(m, self.queries[at : at + QUERY_BLOCK], self.k)
            ends = np.searchsorted(qi, np.arange(len(self.queries[at : at + QUERY_BLOCK]) + 1))
            for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                old = self.found[at + i]
                dist, own = np.concatenate([old[0], d[lo:hi]]), np.concatenate([old[1], ids[vi[lo:hi]]])
                keep = np.lexsort((own, dist))[: self.k]
                self.found[at + i] = (dist[keep], own[keep])

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        n = [len(d) for d, _ in self.found]
        none = np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate([none.astype(np.int64), *(i for _, i in self.found)])), pa.array(np.concatenate([none, *(d for d, _ in self.found)]))],
            ["query_id", "id", "distance"],
        )


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _candidates(vectors: DataFrame, queries: list[tuple[int, Sequence[float]]], k: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows (query_id, id, distance): each task's k best of each query. ``vectors`` may be packed blocks."""
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64)
    packed = vectors.columns == ["ids", "data", "n"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(matrix, k)
        for b in batches:
            if packed:
                for i, data, n in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                    best.add(np.frombuffer(i.as_buffer(), "<i8"), np.frombuffer(data.as_buffer(), "<f4").reshape(n, -1))
            elif b.num_rows:
                best.add(b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), b.num_rows))
        yield best.rows(ids)

    rows = vectors if packed else vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).filter(F.col(vector_col).isNotNull())
    return rows.mapInArrow(compare, "query_id long, id long, distance double")


def pack_vectors(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", rows: int = VECTORS_A_BLOCK) -> DataFrame:
    """Blocks (ids, data, n): little-endian ids and single-precision numbers of n vectors. Rows without a vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            own, data = np.concatenate(ids).astype("<i8"), np.concatenate(parts).astype("<f4")
            ids.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([own.tobytes()]), pa.array([data.tobytes()]), pa.array([len(own)], pa.int32())], ["ids", "data", "n"])

        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids.append(part.column(0).to_numpy(zero_copy_only=False)), parts.append(_matrix(part.column(1), part.num_rows))
                if sum(map(len, ids)) >= rows:
                    yield block()
        if ids:
            yield block()

    plain = vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).filter(F.col(vector_col).isNotNull())
    return plain.mapInArrow(run, BLOCKS)


def top_k_joined(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, id, distance, rank) for a table of queries of any size, (query_id, embedding), against all vectors.

    Blocks of vectors meet blocks of queries; the queries never pass through the driver.
    """
    check_k(k)
    asked = pack_vectors(queries, "query_id", vector_col, QUERIES_A_BLOCK).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("n").alias("q_n"))
    size = queries.select(F.sum(F.size(vector_col)) * 4).first()[0] or 0
    if size <= BROADCAST_BYTES:
        asked = F.broadcast(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data, n, q_ids, q_data, q_n in zip(*(b.column(i) for i in range(6)), strict=True):
                best = _Best(np.frombuffer(q_data.as_buffer(), "<f4").reshape(q_n.as_py(), -1).astype(np.float64), k)
                best.add(np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(data.as_buffer(), "<f4").reshape(n.as_py(), -1))
                yield packed_lists(np.frombuffer(q_ids.as_buffer(), "<i8"), [(own, distance) for distance, own in best.found])

    blocks = vectors if vectors.columns == ["ids", "data", "n"] else pack_vectors(vectors, id_col, vector_col)
    return merged_lists(blocks.crossJoin(asked).mapInArrow(compare, LISTS), k).withColumnRenamed("value", "distance")
