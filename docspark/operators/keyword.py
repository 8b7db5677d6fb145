"""Keyword search by BM25 over words and phrases, with statistics of the whole collection.

``index_terms`` makes postings once: (term, id, tf, positions, n_tokens). A ``KeywordIndex`` over written postings, which are
sorted by term, reads only the row groups of a query's terms. Without an index ``text_scores`` counts a query's phrases
straight in the texts: one pass for the statistics, one for the scores, and no row is shuffled. Both use one formula, so
their scores are equal. Many queries at once are ``plans.batch``'s; ``text_index`` makes the postings of their terms alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.terms import query_phrases, tokens
from docspark.scratch import kept_table

#: The parameters of BM25 and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
POSTINGS = "term string, id long, tf int, positions array<int>, n_tokens int"
#: Rows whose postings are made at once (their tokens' keys fit 64 bits); terms up to which they are broadcast.
ROWS, MOST_TERMS = 512, 1_000_000


def row_postings(batches: Iterator[pa.RecordBatch], lengths: bool = False) -> Iterator[pa.RecordBatch]:
    """Postings of rows (id, tokens), some rows at a time. ``lengths``: also one for each row whose term is empty, as no token is."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy().astype(np.int64)
            if lengths:
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(sizes) + 1), pa.int32()), pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([""] * len(sizes), pa.string()), b.column(0), pa.array(sizes * 0, pa.int32()), none, pa.array(sizes, pa.int32())], ["term", "id", "tf", "positions", "n_tokens"])
            coded = b.column(1).flatten().dictionary_encode()
            if not len(coded):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # row, term and position in one number: sorting numbers is faster than sorting by three
            codes, places = len(coded.dictionary), int(sizes.max())
            key = np.sort((row * codes + coded.indices.to_numpy()) * places + position)
            key, position = np.divmod(key, places)
            row, code = np.divmod(key, codes)
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
            ends = np.append(first, len(row))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(position, pa.int32()))
            n_tokens = pa.array(sizes[row[first]], pa.int32())
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), b.column(0).take(pa.array(row[first])), pa.array(np.diff(ends), pa.int32()), positions, n_tokens], ["term", "id", "tf", "positions", "n_tokens"])


def index_terms(rows: DataFrame, id_col: str = "id", text_col: str = "text", compat: bool = False) -> DataFrame:
    """Postings of all terms of all rows, whose ids are distinct: a row's are made where it is read, and no token is shuffled."""
    found = rows.select(F.col(id_col).cast("long").alias("id"), tokens(F.col(text_col), compat).alias("tokens"))
    return found.mapInArrow(row_postings, POSTINGS)


def shifted(positions: Column, by: int | Column) -> Column:
    return F.transform(positions, lambda p: p - by)


def _occurrences(found: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in an array of tokens."""
    if len(phrase) == 1:
        return F.size(found) - F.size(F.array_remove(found, phrase[0]))
    here = lambda i: reduce(lambda a, b: a & b, (F.get(found, i + j) == w for j, w in enumerate(phrase)))
    starts = F.filter(F.sequence(F.lit(0), F.size(found) - len(phrase)), here)
    return F.when((F.size(found) >= len(phrase)) & F.array_contains(found, phrase[0]), F.size(starts)).otherwise(0)


def _scored(found: DataFrame, times: Counter, dfs: Sequence[int], n: int, average: float | None) -> DataFrame:
    """Rows (id, score) of those that have a phrase; ``found``: id, n_tokens, and tf0, tf1, ... of the phrases in order."""
    score, hit = F.lit(0.0), F.lit(False)
    for i, (k, df) in enumerate(zip(times.values(), dfs, strict=True)):
        idf = math.log((n - df + 0.5) / (df + 0.5))
        tf = F.col(f"tf{i}")
        score = score + k * (idf if idf > 0 else LEAST_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / (average or 1.0)))
        hit = hit | (tf > 0)
    return found.filter(hit).select("id", score.alias("score"))


def text_scores(rows: DataFrame, phrases: list[list[str]], allowed: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Scores straight from a table of texts, for a query's few phrases. Runs the pass for the statistics at once."""
    times = Counter(map(tuple, phrases))
    if not times:
        return rows.sparkSession.createDataFrame([], "id long, score double")
    counts = [F.coalesce(_occurrences(F.col("tokens"), list(p)), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(times)]
    # as a generated row, so that the optimizer does not write the tokenizer into each expression that uses its tokens
    found = rows.select(F.col(id_col).alias("id"), F.explode(F.array(tokens(F.col(text_col)))).alias("tokens"))
    found = found.select("id", F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens"), *counts)
    n, average, *dfs = found.agg(F.count("*"), F.avg("n_tokens"), *(F.count_if(F.col(f"tf{i}") > 0) for i in range(len(times)))).first()
    if allowed is not None:
        found = found.join(allowed.select("id"), "id", "left_semi")
    return _scored(found, times, dfs, n, average)


@dataclass(frozen=True)
class KeywordIndex:
    """Postings of all rows of a collection, and how many rows and tokens it has."""

    postings: DataFrame
    n: int
    n_tokens: int

    def scores(self, phrases: list[list[str]], allowed: DataFrame | None = None) -> DataFrame:
        """``text_scores`` of the rows that were indexed: the same rows and numbers, from the postings of the phrases' terms."""
        times = Counter(map(tuple, phrases))
        if not times or not self.n:
            return self.postings.sparkSession.createDataFrame([], "id long, score double")
        hits = self.postings.filter(F.col("term").isin(sorted({w for p in times for w in p})))
        counts = []
        for i, p in enumerate(times):
            of = lambda w, c: F.max(F.when(F.col("term") == w, F.col(c)))
            if len(p) == 1:
                tf = of(p[0], "tf")
            else:  # positions shifted to where the phrase would begin
                tf = F.size(reduce(F.array_intersect, [shifted(F.coalesce(of(w, "positions"), F.array().cast("array<int>")), j) for j, w in enumerate(p)]))
            counts.append(F.coalesce(tf, F.lit(0)).alias(f"tf{i}"))
        found = hits.groupBy("id").agg(F.first("n_tokens").alias("n_tokens"), *counts)
        if all(len(p) == 1 for p in times):
            by = dict(hits.groupBy("term").count().collect())  # a row a term of the query
            dfs = [by.get(p[0], 0) for p in times]
        else:
            dfs = list(found.agg(*(F.count_if(F.col(f"tf{i}") > 0) for i in range(len(times)))).first())
        if allowed is not None:
            found = found.join(allowed.select("id"), "id", "left_semi")
        return _scored(found, times, dfs, self.n, self.n_tokens / self.n)

    def top(self, text: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """``keyword_top`` of the rows that were indexed."""
        return self.scores(query_phrases(text), allowed).orderBy(F.desc("score"), "id").limit(k)


def text_index(rows: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text") -> KeywordIndex:
    """An index of a table of texts with the postings of some terms (term) alone, for one use: written at once, in one pass over
    the texts that also counts rows and tokens."""
    spark = rows.sparkSession
    terms = terms.select("term").distinct()
    many = terms.count() > MOST_TERMS
    terms = terms.union(spark.range(1).select(F.lit("").alias("term")))
    found = rows.select(F.col(id_col).cast("long").alias("id"), tokens(F.col(text_col)).alias("tokens"))
    made = found.mapInArrow(lambda b: row_postings(b, lengths=True), POSTINGS)
    own = kept_table(spark, made.join(terms if many else F.broadcast(terms), "term", "left_semi"))
    n, n_tokens = own.filter("term = ''").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return KeywordIndex(own.filter("term <> ''"), n, n_tokens)


def keyword_top(rows: DataFrame, text: str, k: int, id_col: str = "id", text_col: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """The k best rows (id, score) for a query text, straight from a table of texts; equal scores by id."""
    return text_scores(rows, query_phrases(text), allowed, id_col, text_col).orderBy(F.desc("score"), "id").limit(k)
