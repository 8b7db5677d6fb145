"""An exact index of vectors: blocks around pivots, passed over by the triangle inequality.

Each vector lies with its nearest pivot, in the order of its distance to it, in blocks that know the least and greatest of
these distances. A query at distance t from a pivot is at least t - hi and lo - t from all vectors of a block [lo, hi].
The nearest blocks give a k-th best distance; blocks that are certainly farther are passed over, and pivots of which no
block is left are not read, as each has its own folder. Rounding is covered by a margin, so the rows are those of a scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.vector_search import _candidates, _matrix, check_k

#: Pivots at most, which the driver holds; vectors of a block; blocks that are looked at first, eight times as many again
#: until they hold k rows.
MOST_PIVOTS, A_BLOCK, FIRST = 1_024, 512, 8
#: Relative and absolute allowance for the rounding of distances.
MARGIN = 1e-6
LAID = "pivot int, near double, id long, v array<float>"
BLOCKS = "pivot int, lo double, hi double, ids binary, data binary, n int"


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """LAID rows: each vector's nearest pivot, the first of several, and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots * pivots).sum(1)
        for b in batches:
            if not len(b):
                continue
            m = _matrix(b.column(1), len(b)).astype(float)
            own = (squares - 2 * (m @ pivots.T)).argmin(1)
            near = np.sqrt(((m - pivots[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(near), b.column(0), b.column(1)], ["pivot", "near", "id", "v"])

    return rows.mapInArrow(run, LAID)


def _blocks(laid: DataFrame, size: int) -> DataFrame:
    """Blocks of rows that come sorted by pivot and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            near, n = t.column(1).to_numpy(), len(t)
            data = t.column(3).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4")
            out = [t.column(0)[0].as_py(), near[0], near[-1], t.column(2).to_numpy().astype("<i8").tobytes(), data.tobytes(), n]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            pivot = b.column(0).to_numpy()
            at = 0
            while at < len(b):
                if held and held[0].column(0)[0].as_py() != pivot[at]:
                    yield block()
                same = int(np.searchsorted(pivot[at:], pivot[at], side="right"))
                take = min(same, size - sum(map(len, held)))
                held.append(b.slice(at, take))
                at += take
                if sum(map(len, held)) == size:
                    yield block()
        if held:
            yield block()

    return laid.mapInArrow(run, BLOCKS)


class PivotIndex:
    """``PivotIndex.build`` writes one under a path; ``report`` tells of the last search."""

    name = "pivots"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        self.pivots = np.array([r["v"] for r in spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()], dtype=float)
        self.report: dict[str, int] = {}

    @classmethod
    def build(cls, spark: SparkSession, vectors: DataFrame, path: str, pivots: int | None = None, a_block: int = A_BLOCK, id_col: str = "id", vector_col: str = "embedding") -> PivotIndex:
        """Rows without a vector are left out. ``pivots``: by default as many as the root of the number of vectors, MOST_PIVOTS at
        most, with the least hashes of their ids."""
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("v IS NOT NULL")
        wanted = pivots or min(MOST_PIVOTS, max(1, math.isqrt(rows.count())))
        chosen = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(min(wanted, MOST_PIVOTS)).collect()
        spark.createDataFrame([(i, r["v"]) for i, r in enumerate(chosen)], "pivot int, v array<float>").write.parquet(f"{path}/pivots")
        laid = _assign(rows, np.array([r["v"] for r in chosen], dtype=float)) if chosen else spark.createDataFrame([], LAID)
        order = ("pivot", "near", "id")
        _blocks(laid.repartitionByRange(*order).sortWithinPartitions(*order), a_block).write.partitionBy("pivot").parquet(f"{path}/blocks")
        return cls(spark, path)

    def _bounded(self, query: np.ndarray) -> DataFrame:
        """The blocks with the least distance that their vectors can have."""
        to = np.sqrt(((self.pivots - query) ** 2).sum(1)).tolist()
        at = self.spark.createDataFrame(list(enumerate(to)), "pivot int, to double")  # MOST_PIVOTS rows
        bound = F.greatest(F.col("to") - F.col("hi"), F.col("lo") - F.col("to"), F.lit(0.0)) - (F.col("to") + F.col("hi") + 1) * MARGIN
        return self.blocks.join(F.broadcast(at), "pivot").withColumn("bound", bound)

    def _rows(self, blocks: DataFrame, vectors: DataFrame | None) -> DataFrame:
        """Packed blocks, or their vectors one by one if only those of ``vectors`` count."""
        if vectors is None:
            return blocks.select("ids", "data", "n")
        dim = self.pivots.shape[1]

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, data in zip(b.column(0), b.column(1), strict=True):
                    flat = pa.array(np.frombuffer(data.as_buffer(), "<f4"))
                    own = pa.array(np.frombuffer(ids.as_buffer(), "<i8"))
                    yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), flat)], ["id", "v"])

        return blocks.select("ids", "data").mapInArrow(unpack, "id long, v array<float>").join(vectors.select("id"), "id", "left_semi")

    def search(self, vectors: DataFrame | None, query: Sequence[float], k: int, limited: bool = True) -> DataFrame:
        """Rows (id, distance), ascending by squared distance, then id. ``limited``: only ids of ``vectors`` count."""
        check_k(k)
        q = np.array(query, dtype=float)
        only = vectors if limited else None
        if not len(self.pivots):
            return self.spark.createDataFrame([], "id long, distance double")
        bounded = self._bounded(q)
        best = lambda blocks: _candidates(self._rows(blocks, only), [(0, query)], k, "id", "v").select("id", "distance").orderBy("distance", "id").limit(k)
        every, first = bounded.select("bound").count(), FIRST
        while True:
            # the bound up to which a number of blocks lies
            reach = bounded.select("bound").orderBy("bound").limit(first).agg(F.max("bound")).first()[0]
            some = best(self._read(bounded, reach)).collect()
            if len(some) == k or first >= every:
                break
            first *= 8
        least = math.sqrt(some[-1]["distance"]) * (1 + MARGIN) + MARGIN if len(some) == k else math.inf
        reach = max(reach, least)
        self.report = {"blocks": every, "skipped": bounded.filter(F.col("bound") > reach).count()}
        return best(self._read(bounded, reach))

    def _read(self, bounded: DataFrame, reach: float) -> DataFrame:
        """Blocks within reach, from the folders of the pivots that have one."""
        within = bounded.filter(F.col("bound") <= reach)
        pivots = [r["pivot"] for r in within.select("pivot").distinct().collect()]  # MOST_PIVOTS at most
        return within.filter(F.col("pivot").isin(pivots))
