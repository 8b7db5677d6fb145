"""How far each source's use of words is from the other sources of its language, and in which terms.

Terms are counted by language and source. A term's counts make a sparse vector over the language's sources, and equal vectors
are one: every pair of sources is evaluated once for each distinct vector and multiplied by the number of terms that
have it. A pair's value where neither source has the term depends on the pair alone, so a vector costs a row of the pair
matrix for each of its entries and not the whole matrix: the sum starts with every term absent from both, and each entry
adds what it changes. The matrix is cut into blocks of BLOCK x BLOCK sources; a vector goes to those blocks in which it has
an entry, and the vectors of a block are dealt to as many tasks as there are thousands of them.

All arithmetic is in integers. p = 1 + floor(10^9 (count + 1) / (N + V)) is taken in two steps of division, which is exact
up to N + V = 2.8e14.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import Scratch

#: A term is in at least so many documents of its language; ranks of terms go to TOP.
LEAST_DOCS, TOP = 3, 200
BILLION, STEPS = 1_000_000_000, (31_250, 32_000)
#: Terms and groups that a task keeps before it gives its counts away.
KEEP = 400_000
#: Sources in a row or column of a block; vectors of a block in a task; numbers that a task holds at once.
BLOCK, DEALT, HELD = 256, 16_384, 1 << 21
#: Pieces that a small table is repeated for, so that a frequent key's rows are joined in as many tasks.
SALTS = 32
#: Bytes outside of terms become spaces, A-Z becomes a-z; all bytes of characters beyond ASCII belong to terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shares(counts, totals):
    """1 + floor(10^9 (count + 1) / total), elementwise; ``totals`` is N + V."""
    a, b = STEPS
    whole, rest = np.divmod(counts + 1, totals)
    high, low = np.divmod(rest * a, totals)
    return 1 + BILLION * whole + b * high + low * b // totals


def share_column(count: Column, total: Column) -> Column:
    """The same as ``shares``, in SQL."""
    a, b = (F.lit(x) for x in STEPS)
    div = lambda x, y: F.call_function("div", x, y)
    rest = (count + 1) % total * a
    return F.lit(1) + F.lit(BILLION) * div(count + 1, total) + b * div(rest, total) + div(rest % total * b, total)


def divergence(p, q):
    return (p - q) * (p - q) // q


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, df``: occurrences, and rows with the term. A row with a null term for each group that occurs.

    Texts are split and counted in Python by bytes; a task gives its sums away whenever it holds KEEP of them.
    """
    names = ["lang", "source", "term", "n", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        df: dict[tuple, Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                terms, k = list(own), len(own) + 1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array([None, *terms], pa.binary()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *map(df[lang, source].__getitem__, terms)], pa.int64())], names)
            n.clear()
            df.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words, group = text.translate(LETTERS).split(), (lang, source)
                distinct = set(words)
                if group not in n:
                    n[group], df[group] = Counter(), Counter()
                n[group].update(words)
                df[group].update(distinct)
                held += len(distinct) + 1
                if held > KEEP:
                    held = sum(map(len, n.values())) + len(n)
                    if held > KEEP // 2:
                        yield from flush()
                        held = 0
        yield from flush()

    or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(or_empty(lang_col).alias("lang"), or_empty(source_col).alias("source"), or_empty(text_col).cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term binary, n long, df long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def beside(rows: DataFrame, small: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """An inner join in which a frequent key's rows are dealt to SALTS tasks, ``small`` being repeated for each."""
    again = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(again, [*keys, "salt"]).drop("salt")


def pair_sums(vectors: DataFrame, groups: DataFrame, langs: DataFrame, scratch: Scratch, size: int = BLOCK) -> DataFrame:
    """``lang, i, j, value``: for each ordered pair of different sources, by number, the sum over all kept terms.

    ``vectors``: lang, vec (structs i, n by i), times; ``groups``: lang, i, total (N + V); ``langs``: lang, terms,
    sources, vectors (how many distinct ones).
    """
    salts = (F.col("vectors") / DEALT).cast("int") + 1
    sized = langs.select("lang", "terms", salts.alias("salts"), ((F.col("sources") - 1) / size).cast("int").alias("last"))
    block = lambda i: (i / size).cast("int")
    # rows that open a block: its sources' totals
    sides = groups.groupBy("lang", block(F.col("i")).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda x: x["total"]).alias("totals"))
    sides = scratch.save(sides, "sides")
    opens = sides.select("lang", F.col("block").alias("row"), F.col("totals").alias("a")).join(sides.select("lang", F.col("block").alias("col"), F.col("totals").alias("b")), "lang").join(sized.select("lang", "terms", "salts"), "lang")
    opens = opens.select("lang", "row", "col", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), F.lit(None).cast("array<long>").alias("u"), F.lit(None).cast("array<long>").alias("v"), F.col("terms").alias("times"))
    # rows with a vector's entries in the block's rows and columns
    mixed = F.xxhash64("vec")
    own = beside(vectors, sized.drop("terms"), ["lang"], mixed)
    touched = F.array_distinct(F.transform("vec", lambda e: block(e["i"])))
    every = F.sequence(F.lit(0), F.col("last"))
    blocks = F.flatten(F.transform(every, lambda r: F.transform(F.filter(every, lambda c: F.array_contains("touched", r) | F.array_contains("touched", c)), lambda c: F.struct(r.alias("row"), c.alias("col")))))
    own = own.withColumn("touched", touched).withColumn("at", F.explode(blocks))
    part = lambda side: F.filter("vec", lambda e: block(e["i"]) == F.col(f"at.{side}"))
    numbers = lambda side: F.transform(part(side), lambda e: (e["i"] % size).cast("long"))
    counts = lambda side: F.transform(part(side), lambda e: e["n"])
    cells = own.select("lang", "at.row", "at.col", F.pmod(mixed, F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), numbers("row").alias("x"), numbers("col").alias("y"), counts("row").alias("u"), counts("col").alias("v"), "times")
    dealt = opens.unionByName(cells).repartition("lang", "row", "col", "salt").sortWithinPartitions("lang", "row", "col", "salt", "kind")
    sums = dealt.mapInArrow(partial(_evaluate, size=size), "lang string, i long, j long, value long")
    return sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


class _Cell:
    """Sums of one block of the pair matrix over the vectors of one task."""

    def __init__(self, row: int, col: int, a: np.ndarray, b: np.ndarray, terms: int, first: bool):
        self.row, self.col, self.a, self.b = row, col, a, b
        self.value = np.zeros((len(a), len(b)), np.int64)
        if terms:
            self.p, self.q = shares(np.zeros_like(a), a), shares(np.zeros_like(b), b)  # of an absent term
            self.none = divergence(self.p[:, None], self.q[None, :])
            if first:
                self.value += terms * self.none

    def add(self, times: np.ndarray, x: list, y: list) -> None:
        """``times`` of n vectors, and the entries of all, (vector, number, count), in the block's rows and columns."""
        r, i, c = x
        s, j, d = y
        q = np.broadcast_to(self.q, (len(times), len(self.b))).copy()
        q[s, j] = shares(d, self.b[j])
        given = np.zeros((len(times), len(self.a)), bool)
        given[r, i] = True
        if len(r):  # the rows of sources that have the term
            change = (divergence(shares(c, self.a[i])[:, None], q[r]) - self.none[i]) * times[r, None]
            order = np.argsort(i, kind="stable")
            at = np.flatnonzero(np.diff(i[order], prepend=-1))
            self.value[i[order][at]] += np.add.reduceat(change[order], at, axis=0)
        if len(s):  # the columns of sources that have it, for rows that do not
            change = (divergence(self.p[None, :], q[s, j][:, None]) - self.none[:, j].T) * times[s, None] * ~given[s]
            order = np.argsort(j, kind="stable")
            at = np.flatnonzero(np.diff(j[order], prepend=-1))
            self.value[:, j[order][at]] += np.add.reduceat(change[order], at, axis=0).T


def _entries(b: pa.RecordBatch, numbers: int, counts: int) -> list[np.ndarray]:
    size = b.column(numbers).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return [np.repeat(np.arange(len(b)), size), *(b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (numbers, counts))]


def _evaluate(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sums of each block, whose rows come together, the one with its sources' totals first."""
    cell, at = None, None

    def done() -> Iterator[pa.RecordBatch]:
        if cell is not None:
            i, j = np.divmod(np.arange(cell.value.size), len(cell.b))
            i, j = i + cell.row * size, j + cell.col * size
            own = i != j
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * int(own.sum()), pa.string()), pa.array(i[own]), pa.array(j[own]), pa.array(cell.value.ravel()[own])], ["lang", "i", "j", "value"])

    for b in batches:
        places = list(zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        bounds = [k for k in range(len(places)) if k == 0 or places[k] != places[k - 1]]
        for lo, hi in zip(bounds, [*bounds[1:], len(places)], strict=True):
            *here, kind = places[lo]
            if kind == 0:
                yield from done()
                at = here
                x, y = (np.array(b.column(k)[lo].as_py(), np.int64) for k in (5, 6))
                cell = _Cell(here[1], here[2], x, y, b.column(9)[lo].as_py(), here[3] == 0)
                continue
            step = max(1, HELD // cell.value.size)
            for k in range(lo, hi, step):
                c = b.slice(k, min(hi - k, step))
                cell.add(c.column(9).to_numpy(zero_copy_only=False).astype(np.int64), _entries(c, 5, 7), _entries(c, 6, 8))
    yield from done()


def audit(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value (long), rank (int), for every group of language and source.

    'pair': all other sources of the language, by the sum of f over the language's kept terms. 'term': the group's terms
    that it uses more than the language does, by f against the language, ranks to ``top``. Kept are terms in at least ``least`` rows
    of the language. Ties go to the lesser item by UTF-8. Null texts, languages and sources are empty strings; each row is a
    document, whatever its id. A group without terms takes part with counts of zero; without any kept term all
    values are 0. Other columns are not read. An empty table gives no rows.
    """
    scratch = scratch or Scratch(spark, "source-divergence")
    counts = scratch.save(term_counts(docs, text_col, lang_col, source_col), "counts")
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")  # of a language's sources
    numbers = scratch.save(counts.filter("term IS NULL").select("lang", "source", number.alias("i")), "sources")
    rows = beside(counts.filter("term IS NOT NULL"), numbers, ["lang", "source"], F.xxhash64("term"))
    terms = rows.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("in_lang"), F.array_sort(F.collect_list(F.struct("i", "n"))).alias("vec"))
    terms = scratch.save(terms.filter(F.col("df") >= least).drop("df"), "terms")
    entries = terms.select("lang", "term", "in_lang", F.explode("vec").alias("e")).select("lang", "term", "in_lang", "e.i", "e.n")
    by_source = entries.groupBy("lang", "i").agg(F.sum("n").alias("n"))
    vectors = scratch.save(terms.groupBy("lang", "vec").agg(F.count("*").alias("times")), "vectors")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("n_lang"))
    distinct = vectors.groupBy("lang").agg(F.count("*").alias("vectors"))
    langs = numbers.groupBy("lang").agg(F.count("*").alias("sources")).join(of_lang, "lang", "left").join(distinct, "lang", "left").na.fill(0)
    langs = scratch.save(langs, "langs")
    groups = numbers.join(by_source, ["lang", "i"], "left").join(langs.select("lang", "terms", "n_lang"), "lang")
    groups = scratch.save(groups.select("lang", "i", "source", (F.coalesce("n", F.lit(0)) + F.col("terms")).alias("total"), (F.col("n_lang") + F.col("terms")).alias("total_lang")), "groups")

    pairs = pair_sums(vectors, groups.select("lang", "i", "total"), langs, scratch, block)
    name = lambda i, as_: numbers.select("lang", F.col("i").alias(i), F.col("source").alias(as_))
    pairs = beside(beside(pairs, name("i", "source"), ["lang", "i"], F.xxhash64("j")), name("j", "item"), ["lang", "j"], F.xxhash64("i"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    used = beside(entries, groups, ["lang", "i"], F.xxhash64("term"))
    used = used.withColumns({"p": share_column(F.col("n"), F.col("total")), "q": share_column(F.col("in_lang"), F.col("total_lang"))}).filter("n > 0 AND p > q")
    used = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    return pairs.unionByName(ranked(used).filter(F.col("rank") <= top))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return audit(spark, docs)


ORACLE_SQL = rf"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}
), n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n_source, coalesce(k.v, 0) AS v, coalesce(k.n, 0) AS n_lang FROM g
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM n GROUP BY ALL) s USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(in_lang) AS n FROM kept GROUP BY ALL) k USING (lang)
), p AS (
  SELECT v.lang, v.source, kept.term, coalesce(n.n, 0) AS n, 1 + {BILLION}::HUGEINT * (coalesce(n.n, 0) + 1) // (v.n_source + v.v) AS p,
    1 + {BILLION}::HUGEINT * (kept.in_lang + 1) // (v.n_lang + v.v) AS q
  FROM v JOIN kept USING (lang) LEFT JOIN n ON n.lang = v.lang AND n.source = v.source AND n.term = kept.term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
), every AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM every WHERE part = 'pair' OR rank <= {TOP}"""
