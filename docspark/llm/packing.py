"""Packing along a space-filling curve.

A document's token counts, hashed to a vector and projected to a few dimensions by a fixed random matrix, give a cell of
a grid; the cell's place on the Hilbert curve is the document's key. Documents are range-sorted by key and laid end to
end; sequences are consecutive stretches of that line, so that neighbours on the curve share sequences and only the last
sequence of all is padded.

Ids are encoded once and written. The line is cut into ranges at quantiles of a sample of keys, which only decide how
evenly the tasks are loaded: order and sequences are the same with any bounds. A key's lower bits are a hash of the
document, so that any number of copies of one text spreads over ranges. Token counts per range, added up over a small
table, tell each range where it begins; a range is a task, and ranges are cut independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, turn
from docspark.llm.tokens import encoder

LENGTH, END_ID = 2048, 1
#: Buckets of the hashed vectors, dimensions of the curve, bits a dimension, bits of the hash below the key.
BUCKETS, DIMS, BITS, TIE_BITS = 1024, 4, 8, 30
#: Tokens in a range of the curve, and the most ranges (their totals go through the driver, 16 bytes each).
RANGE_TOKENS, MOST_RANGES = 8_000_000, 65_536
#: Keys looked at for each bound between ranges.
SAMPLE = 32


def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def cells(vectors: np.ndarray) -> np.ndarray:
    """Grid cells of projected unit vectors: each coordinate is about standard normal, and its logistic image about even."""
    return np.minimum((1 / (1 + np.exp(-1.702 * vectors)) * 2**BITS).astype(np.int64), 2**BITS - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by Skilling's transposition (2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the top bit down
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for).

    Every row is packed whole: its ids and the end id, cut only where a sequence ends. A null or empty text is its end
    id alone. Rows that repeat an id are packed one by one, next to each other if their texts are equal. Ties on the
    curve are ordered by (doc_id, tokens). A null id sorts first. An empty table gives no rows; further columns are
    ignored.
    """
    scratch = Scratch(spark, "packing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, matrix = encoder(vocabulary), projection()
        end = np.array([end_id], enc.dtype).tobytes()
        mask = np.uint64(2**TIE_BITS - 1)
        bucket = np.arange(max(enc.vocab.values()) + 1 + end_id, dtype=np.int64) * 40503 % 65521 % BUCKETS
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                packed = [p + end for p in enc.encode(b.column(1).to_pylist())]
                counts = np.zeros((len(packed), BUCKETS))
                for i, p in enumerate(packed):
                    counts[i] = np.bincount(bucket[np.frombuffer(p, enc.dtype)], minlength=BUCKETS)
                v = np.sqrt(counts)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                v -= v.mean(1, keepdims=True)  # what all documents share is not direction
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                ties = np.array([zlib.crc32(p, i or 0) for p, i in zip(packed, b.column(2).to_pylist(), strict=True)], dtype=np.uint64) & mask
                key = (hilbert(cells(v @ matrix)) << TIE_BITS) | ties.astype(np.int64)
                n = [len(p) // enc.dtype.itemsize for p in packed]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "key", "n", "ids"])

    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("tie"))
    coded = scratch.save(source.mapInArrow(encode, f"doc_id {id_type}, key long, n long, ids binary"), "ids")
    rows, total = coded.agg(F.count("*"), F.sum("n")).first()
    ranges = max(1, min(MOST_RANGES, (total or 0) // RANGE_TOKENS))
    bounds = np.zeros(0, dtype=np.int64)
    if ranges > 1:
        share = min(1.0, SAMPLE * ranges / rows)  # by a hash of the key, at most about SAMPLE keys a range
        looked = coded.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key").toArrow()
        looked = np.sort(looked.column(0).to_numpy())
        if len(looked):
            bounds = np.unique(looked[np.arange(1, ranges) * len(looked) // ranges])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("packing")  # the ids are written: the encoder is needed no more
        out = np.zeros(len(bounds) + 1, dtype=np.int64)
        for b in batches:
            out += np.bincount(np.searchsorted(bounds, b.column(0).to_numpy(), side="right"), b.column(1).to_numpy(), len(out)).astype(np.int64)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["range", "n"])

    parts = dict(coded.select("key", "n").mapInArrow(sums, "range long, n long").groupBy("range").agg(F.sum("n")).collect())  # a row a range
    sizes = np.array([parts.get(i, 0) for i in range(len(bounds) + 1)], dtype=np.int64)
    bases = np.cumsum(sizes) - sizes
    width = encoder(vocabulary).dtype

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("packing")
        for b in batches:
            at = np.searchsorted(bounds, b.column(1).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], ["range", "doc_id", "key", "n", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("packing")
        current, pos = -1, 0
        kinds = [pa.from_numpy_dtype("int64")] * 6
        for b in batches:
            ids_of, own, rows = b.column(1).to_pylist(), b.column(3), []
            docs_here, ids_out = [], []
            for r, (seg, doc) in enumerate(zip(b.column(0).to_pylist(), ids_of, strict=True)):
                if seg != current:
                    current, pos = seg, int(bases[seg])
                ids = np.frombuffer(own[r].as_buffer(), width)
                start, n = 0, len(ids)
                while start < n:
                    off = pos % length
                    take = min(n - start, length - off)
                    piece = ids[start : start + take].astype("<u4")
                    rows.append((start, take, zlib.crc32(piece.tobytes()), n, pos // length, off))
                    docs_here.append(doc)
                    if with_ids:
                        ids_out.append(piece.astype(np.int64))
                    start, pos = start + take, pos + take
            cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            extra = [pa.array(ids_out, pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([pa.array(docs_here, b.column(1).type), *cols, *extra], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

    placed = coded.mapInArrow(place, f"range long, doc_id {id_type}, key long, n long, ids binary")
    line = placed.repartitionById(len(sizes), F.col("range").cast("int")).sortWithinPartitions("range", "key", "doc_id", "n").select("range", "doc_id", "n", "ids")
    return line.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(spark, docs, vocabulary())
