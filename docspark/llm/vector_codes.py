"""Product codes of vectors: a codebook per part, learnt by Lloyd rounds in integers with Hamerly's two bounds.

Components become integers and vectors are cut into parts of equal width. A round's table holds, for each vector, its
integers and for each part the entry that it has, an upper bound of its distance to that entry and a lower bound of its
distance to every other one. Bounds follow the entries' movements by the triangle inequality and are kept in single
precision, rounded outwards. Where the upper bound is less than the lower one, or than half the distance from its entry to
the next, no other entry can be as near and nothing is computed; otherwise the upper bound is made exact, and if that does
not do either, all entries are compared in integers. As only strict inequalities count, equally near entries always meet
in the full comparison, which takes the lower index.

A task writes its rows of the next table and, as one more row, its sums by part and entry; the sums are added up by Spark, so
that the driver sees one codebook. Each round reads one table and writes one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers that a task handles at once.
STEP = 1 << 22
#: A label with at least a share of 1 / LABELS of the rows is joined by broadcast (LABELS rows at most), others by shuffle.
LABELS = 4_096


def above(x: np.ndarray) -> np.ndarray:
    """The next single-precision number over the nearest one."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


@dataclass
class Books:
    """Codebooks (parts, entries, width), and what their last change means for the bounds."""

    entries: np.ndarray
    moved: np.ndarray = field(default=None)  # each entry's movement, and the largest of the others'
    others: np.ndarray = field(default=None)
    gap: np.ndarray = field(default=None)  # half the distance to the nearest other entry

    @classmethod
    def after(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Books:
        if before is None:
            return cls(entries)
        n = entries.shape[1]
        moved = above(np.sqrt(((entries - before) ** 2).sum(2).astype(float)))
        own = np.eye(n, dtype=bool)
        others = np.where(own, np.float32(0), moved[:, None, :]).max(2)
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(3).astype(float)
        gap = below(np.sqrt(np.where(own, np.inf, apart).min(2)) / 2)
        return cls(entries, moved, others, gap)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts (n, width) and their codebooks (n, entries, width): nearest entry, its squared distance, the second least."""
    far = ((x[:, None, :] - entries) ** 2).sum(2)
    code = far.argmin(1)
    at = np.arange(len(x))
    near = far[at, code]
    if far.shape[1] == 1:
        return code, near, np.full(len(x), np.inf)
    far[at, code] = np.iinfo(np.int64).max
    return code, near, far.min(1).astype(float)


def assign(x: np.ndarray, books: Books, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, upper and lower bounds (n, parts) of integers (n, parts, width), and how many parts met all entries.

    ``state``: the same three of the round before, or None.
    """
    n, parts, _ = x.shape
    p = np.arange(parts)
    if state is None:
        code, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
        todo = np.ones((n, parts), bool)
    else:
        code, upper, lower = (a.copy() for a in state)
        upper = above(upper.astype(float) + books.moved[p, code])
        lower = below(lower.astype(float) - books.others[p, code])
        bound = np.maximum(lower, books.gap[p, code])
        r, q = np.nonzero(upper >= bound)
        own = ((x[r, q] - books.entries[q, code[r, q]]) ** 2).sum(1)
        upper[r, q] = above(np.sqrt(own.astype(float)))
        todo = upper >= bound
    r, q = np.nonzero(todo)
    step = max(1, STEP // books.entries[0].size)
    for at in range(0, len(r), step):
        i, j = r[at : at + step], q[at : at + step]
        c, near, second = scan(x[i, j], books.entries[j])
        code[i, j], upper[i, j], lower[i, j] = c, above(np.sqrt(near.astype(float))), below(np.sqrt(second))
    return code, upper, lower, len(r)


def _blocks(column: pa.Array, dtype: str, n: int) -> np.ndarray:
    """A binary column without nulls, of values of one length, as rows of numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], dtype, (ends[-1] - ends[0]) // np.dtype(dtype).itemsize, ends[0]).reshape(n, -1)


def _binary(rows: np.ndarray, dtype: str) -> pa.Array:
    raw = np.ascontiguousarray(rows.reshape(len(rows), math.prod(rows.shape[1:])).astype(dtype))
    width = raw.shape[1] * raw.itemsize
    ends = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); ValueError where squared distances of such numbers might not fit 64 bits."""
    out = np.floor(values.astype(float) * scale)
    if out.size and np.abs(out).max() > math.isqrt(2**61 // out.shape[1]) - 1:
        raise ValueError("components are too large for 64-bit distances")
    return out.astype(np.int64)


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds neither nulls nor numbers that are not finite."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.filter(v.isNotNull() & ~F.coalesce(odd, F.lit(True)))


@dataclass
class Compressed:
    """``rows``: id, label, code (a byte a part), error (long); ``books``; ``scanned``: parts that met all entries, by round."""

    rows: DataFrame
    books: Books
    scanned: list[int]


def compress(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, scratch: Scratch | None = None) -> Compressed:
    """Codes of all usable vectors after ``rounds`` rounds of assigning and averaging, and the codebooks.

    Dropped are null vectors and vectors with nulls or numbers that are not finite, with no components, or with a number of
    components that ``parts`` does not divide or that the vector of the least id does not have. Codebooks start as the
    ``entries`` (256 at most) least rows by id, then vector; rows without an id come after all others. Fewer rows make
    smaller codebooks. Each row counts by itself, also if its id or vector repeats. Other columns are not read. A table
    without usable vectors gives no rows and empty codebooks. Components whose squared distances might not fit 64 bits
    raise a ValueError.
    """
    scratch = scratch or Scratch(spark, "vector-codes")
    kinds = {f.name: f.dataType for f in vectors.schema}
    rows = usable(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = lambda of: [r["v"] for r in of.orderBy(F.asc_nulls_last("id"), "v").select("id", "v").limit(entries).collect()]
    starts = first(rows)
    dim = len(starts[0]) if starts else parts
    if any(len(v) != dim for v in starts):
        starts = first(rows.filter(F.size("v") == dim))
    rows, width = rows.filter(F.size("v") == dim), dim // parts
    initial = integers(np.array(starts, float).reshape(-1, dim), scale)
    books = Books.after(initial.reshape(-1, parts, width).transpose(1, 0, 2).copy())
    n_entries = books.entries.shape[1]
    slots = parts * n_entries * (width + 1)

    state = T.StructType([T.StructField("id", kinds[id_col]), T.StructField("label", kinds[label_col]), *(T.StructField(n, T.BinaryType()) for n in ("x", "code", "upper", "lower")), T.StructField("sums", T.ArrayType(T.LongType()))])
    final = T.StructType([*state.fields[:2], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    scanned: list[int] = []

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, tuple | None]:
        if b.num_columns == 3:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            return integers(flat.reshape(len(b), dim), scale).reshape(-1, parts, width), None
        x = _blocks(b.column(2), "<i4", len(b)).astype(np.int64).reshape(-1, parts, width)
        return x, tuple(_blocks(b.column(k), t, len(b)) for k, t in ((3, "u1"), (4, "<f4"), (5, "<f4")))

    def round_of(books: Books):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, full = np.zeros((parts, n_entries, width + 1), np.int64), 0
            names, arrow = state.names, None
            for whole in batches:
                for at in range(0, len(whole), max(1, STEP // dim)):
                    b = whole.slice(at, max(1, STEP // dim))
                    x, before = read(b)
                    code, upper, lower, n = assign(x, books, before)
                    full += n
                    for p in range(parts):
                        np.add.at(sums[p], code[:, p], np.concatenate([np.ones((len(x), 1), np.int64), x[:, p]], 1))
                    columns = [b.column(0), b.column(1), _binary(x, "<i4"), _binary(code, "u1"), _binary(upper, "<f4"), _binary(lower, "<f4"), pa.nulls(len(x), pa.list_(pa.int64()))]
                    arrow = [c.type for c in columns]
                    yield pa.RecordBatch.from_arrays(columns, names)
            if arrow:
                last = [pa.nulls(1, t) for t in arrow[:-1]]
                yield pa.RecordBatch.from_arrays([*last, pa.array([[*sums.ravel().tolist(), full]], arrow[-1])], names)

        return run

    def last_of(books: Books):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), max(1, STEP // dim)):
                    b = whole.slice(at, max(1, STEP // dim))
                    x, before = read(b)
                    code = assign(x, books, before)[0]
                    error = ((x - books.entries[np.arange(parts), code]) ** 2).sum((1, 2))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(code, "u1"), pa.array(error)], final.names)

        return run

    now = None
    for _ in range(rounds if n_entries else 0):
        made = scratch.save(rows.mapInArrow(round_of(books), state), "round")
        if now:
            scratch.drop(now)
        now = made
        sums = now.filter("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # a codebook
        total = np.zeros(slots + 1, np.int64)
        for r in sums:
            total[r["pos"]] = r["n"]
        scanned.append(int(total[-1]))
        by = total[:-1].reshape(parts, n_entries, width + 1)
        mean = np.where(by[:, :, :1] > 0, by[:, :, 1:] // np.maximum(by[:, :, :1], 1), books.entries)
        books = Books.after(mean, books.entries)
        rows = now.filter("sums IS NULL").drop("sums")
    out = scratch.save(rows.mapInArrow(last_of(books), final) if n_entries else spark.createDataFrame([], final), "codes")
    if now:
        scratch.drop(now)
    return Compressed(out.withColumnsRenamed({"id": id_col, "label": label_col}) if {id_col, label_col} != {"id", "label"} else out, books, scanned)


def label_errors(rows: DataFrame, scratch: Scratch, label_col: str = "label") -> DataFrame:
    """``rows`` with label_error, the sum of ``error`` over rows of an equal label; nulls are one label.

    Labels with many rows are joined by broadcast, LABELS of them at most by what many means, and the rest by a shuffle, so
    that no label's rows meet in a task.
    """
    sums = scratch.save(rows.groupBy(label_col).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")).withColumnRenamed(label_col, "of"), "labels")
    n, labels = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    same = F.col(label_col).eqNullSafe(F.col("of"))
    heavy = F.broadcast(sums.filter(F.col("n") * LABELS >= n).drop("n"))
    out = rows.join(heavy, same).drop("of")
    if labels > 1 and sums.filter(F.col("n") * LABELS < n).limit(1).count():
        light = sums.filter(F.col("n") * LABELS < n).drop("n")
        out = out.unionByName(rows.join(heavy, same, "left_anti").join(light, same).drop("of"))
    return out


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error, codebooks_sha256; rows as ``compress`` says."""
    scratch = Scratch(spark, "vector-codes")
    done = compress(spark, vectors, scratch=scratch)
    rows = label_errors(done.rows, scratch)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(done.books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """Each round written out."""
    width = f"len(embedding) // {PARTS}"
    sql = f"""WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, p.p AS p, k.k AS k, floor({SCALE} * embedding[p.p * ({width}) + k.k + 1]::DOUBLE)::BIGINT AS x
  FROM kept, range({PARTS}) p(p), range(4096) k(k) WHERE k.k < {width}
), start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}
), c0 AS MATERIALIZED (SELECT p, e, k, x AS c FROM x JOIN start USING (vec_id)"""
    for r in range(ROUNDS + 1):
        sql += f"""
), d{r} AS (SELECT vec_id, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (p, k) GROUP BY ALL
), a{r} AS MATERIALIZED (SELECT vec_id, p, e, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1"""
        if r < ROUNDS:
            sql += f"""
), s{r} AS (SELECT p, e, k, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (SELECT p, e, k, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r} LEFT JOIN s{r} USING (p, e, k)"""
    return sql + f"""
), code AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
), by_label AS (SELECT label, sum(error)::BIGINT AS label_error FROM code JOIN kept USING (vec_id) GROUP BY label
), book AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM code JOIN kept USING (vec_id) JOIN by_label ON by_label.label IS NOT DISTINCT FROM kept.label, book"""


ORACLE_SQL = _oracle()
