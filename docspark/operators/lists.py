"""Each query's best rows, from lists of them that many tasks have made.

A list is one row of packed numbers while it is shuffled and sorted; its entries are rows again once the lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LISTS = "query_id long, ids binary, data binary"


def packed_lists(query_ids: np.ndarray, lists: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """LISTS of (ids, values), one for each query."""
    raw = lambda at, kind: pa.array([x[at].astype(kind).tobytes() for x in lists], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), raw(0, "<i8"), raw(1, "<f8")], ["query_id", "ids", "data"])


def merged_lists(lists: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """``query_id, id, value, rank``: the k first entries of each query's LISTS by value, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(t: pa.Table) -> pa.RecordBatch:
            size = np.array([x.as_buffer().size for x in t.column(1)], np.int64) // 8
            ids = np.frombuffer(b"".join(t.column(1).to_pylist()), "<i8")
            value = np.frombuffer(b"".join(t.column(2).to_pylist()), "<f8")
            query = np.repeat(t.column(0).to_numpy(), size)
            order = np.lexsort((ids, -value if descending else value, query))
            query = query[order]
            first = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, np.int64)
            rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) + 1
            keep = rank <= k
            return pa.RecordBatch.from_arrays([pa.array(query[keep], pa.int64()), pa.array(ids[order[keep]], pa.int64()), pa.array(value[order[keep]], pa.float64()), pa.array(rank[keep], pa.int32())], ["query_id", "id", "value", "rank"])

        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by query; the last one's lists may go on in the next batch
            if not b.num_rows:
                continue
            q = b.column(0).to_numpy()
            cut = int(np.searchsorted(q, q[-1]))
            if cut or (held and held[-1].column(0)[0].as_py() != q[0]):
                yield merged(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield merged(pa.Table.from_batches(held))

    dealt = lists.repartition("query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(run, "query_id long, id long, value double, rank int")
