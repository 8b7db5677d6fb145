"""Hybrid search and answers for a table of questions in one plan.

Both lists, the fusion, the texts, the removal of repeats and the budget are partitioned by question or by blocks of rows;
questions are not collected. Keyword scores come from blocks: a block of rows has its postings, a block of questions its
phrases with their weights, and a pair of blocks gives each question's best rows by ``operators.block_scores``. Blocks are
files of the shared folder, and what goes through Spark are their names: a row of megabytes would be copied for each pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.errors import EngineError
from docspark.functions.terms import query_phrases, tokens
from docspark.functions.vectors import cosine_from_distance, dot
from docspark.operators.block_scores import BlockScores, in_order
from docspark.operators.fusion import fuse
from docspark.operators.keyword import K1, LEAST_IDF, ROWS, B, KeywordIndex, row_postings, shifted, text_index
from docspark.operators.lists import LISTS, merged_lists, packed_lists
from docspark.operators.vector_search import top_k_joined
from docspark.plans import answer as A
from docspark.plans.hybrid import Query
from docspark.scratch import kept_table, shared_dir

#: Rows and questions of a block, and blocks of rows that a task takes questions through at most.
ROWS_A_BLOCK, QUESTIONS_A_BLOCK, BLOCKS_A_TASK = 16_384, 8_192, 16
#: Texts whose postings are held at once in a task, and of a file.
TEXTS_A_BLOCK = 2_048
#: Distinct phrases, questions' phrases, and hits, up to which they are broadcast.
MOST_PHRASES, MOST_ASKED, MOST_HITS = 1_000_000, 10_000_000, 1_000_000
FILES = "path string, n long, n_tokens long"
ANSWERS = "query_id long, found boolean, answer string, kept array<long>, cited array<long>, prompt_bytes long"
ANSWER_TYPES = (pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())


def asked_phrases(questions: DataFrame) -> DataFrame:
    """``query_id, phrase, words, times``; a phrase is its words with spaces between."""

    @F.pandas_udf("array<array<string>>")
    def phrases(text: pd.Series) -> pd.Series:
        return text.map(lambda t: query_phrases(t or ""))

    words = questions.select("query_id", F.explode(phrases("text")).alias("words"))
    return words.groupBy("query_id", F.array_join("words", " ").alias("phrase")).agg(F.first("words").alias("words"), F.count("*").alias("times"))


def phrase_rows(index: KeywordIndex, phrases: DataFrame) -> DataFrame:
    """``phrase, id, tf, n_tokens`` of all rows that have one of ``phrases`` (phrase, words)."""
    near = F.broadcast if phrases.count() <= MOST_PHRASES else lambda df: df
    one = phrases.filter(F.size("words") == 1).select("phrase", F.get("words", F.lit(0)).alias("term"))
    found = index.postings.join(near(one), "term").select("phrase", "id", "tf", "n_tokens")
    many = phrases.filter(F.size("words") > 1)
    if many.isEmpty():
        return found
    many = many.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    parts = index.postings.join(near(many), "term").groupBy("phrase", "id").agg(F.first("size").alias("size"), F.first("n_tokens").alias("n_tokens"), F.collect_list(shifted(F.col("positions"), F.col("at"))).alias("starts"))
    starts = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), F.array_intersect)
    parts = parts.filter(F.size("starts") == F.col("size")).withColumn("tf", F.size(starts)).filter("tf > 0")
    return found.unionByName(parts.select("phrase", "id", "tf", "n_tokens"))


def _raw(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([np.asarray(x).astype(kind).tobytes()], pa.binary())


def _folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/docspark-blocks-{uuid.uuid4().hex}"


def _save(folder: str, block: pa.RecordBatch, n: int, n_tokens: int = 0) -> pa.RecordBatch:
    """A block's row of FILES, once it is written. A task that runs twice leaves a file that no row names."""
    from pyarrow import fs

    path = f"{folder}/{uuid.uuid4().hex}.arrow"
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as out, pa.ipc.new_stream(out, block.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
        to.write_batch(block)
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([n_tokens], pa.int64())], ["path", "n", "n_tokens"])


def _load(path: str) -> list[pa.Scalar]:
    """The values of a written block's only row."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as raw, pa.ipc.open_stream(raw) as found:
        return [c[0] for c in found.read_next_batch().columns]


def _even(files: Sequence[tuple[str, int]], parts: int) -> list[list[str]]:
    """Files (path, n) put together to at most so many parts of about the same number of rows."""
    total, before, out = sum(n for _, n in files), 0, [[] for _ in range(parts)]
    for path, n in files:
        out[before * parts // total].append(path)
        before += n
    return [x for x in out if x]


def _each(spark: SparkSession, work: list, run: Callable[[object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` of each piece of work, a task each. Work is a few names of files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from run(work[i])

    return spark.range(0, len(work), 1, max(1, len(work))).mapInArrow(task, schema)


def _block(t: pa.Table) -> pa.RecordBatch:
    """A block of rows from its entries (id, phrase, tf, n_tokens)."""
    own = t.column("id").to_numpy()  # a row's entries mostly follow one another
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    ids, row = np.unique(own[first], return_inverse=True)
    row = np.repeat(row, np.diff(np.append(first, len(own))))
    coded = t.column("phrase").combine_chunks()
    coded = coded if pa.types.is_dictionary(coded.type) else coded.dictionary_encode()
    up = pc.sort_indices(coded.dictionary)
    place = np.empty(len(up), np.int64)
    place[up.to_numpy()] = np.arange(len(up))
    term = place[coded.indices.to_numpy()]
    order = in_order(row, len(ids))
    size = np.zeros(len(ids), np.int64)
    size[row] = t.column("n_tokens").to_numpy()
    ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))])
    names = pa.ListArray.from_arrays(pa.array([0, len(up)], pa.int32()), coded.dictionary.take(up))
    return pa.RecordBatch.from_arrays([_raw(ids, "<i8"), names, _raw(ptr, "<i8"), _raw(term[order], "<i4"), _raw(t.column("tf").to_numpy()[order], "<i4"), _raw(size, "<i4")], ["ids", "phrases", "ptr", "terms", "tfs", "sizes"])


def _entries(ids, names, ptr, terms, tfs, sizes) -> pa.Table:
    """The entries of a block of rows, with coded phrases."""
    n = np.diff(np.frombuffer(ptr.as_buffer(), "<i8"))
    coded = pa.DictionaryArray.from_arrays(pa.array(np.frombuffer(terms.as_buffer(), "<i4")), names.values)
    return pa.table([np.repeat(np.frombuffer(ids.as_buffer(), "<i8"), n), coded, np.frombuffer(tfs.as_buffer(), "<i4"), np.repeat(np.frombuffer(sizes.as_buffer(), "<i4"), n)], ["id", "phrase", "tf", "n_tokens"])


def _row_blocks(entries: DataFrame, n: int) -> list[tuple[str, int]]:
    """Files (path, rows) of blocks of rows from ``id, phrase, tf, n_tokens``, of ``n`` rows at most."""
    folder = _folder(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for b in batches:  # sorted by id
            ids = b.column(0).to_numpy()
            new = np.flatnonzero(np.diff(ids, prepend=ids[0] if last is None else last)) if len(ids) else []
            at = 0
            if last is None and len(ids):
                n = 1
            for k in new:
                if n == TEXTS_A_BLOCK:
                    yield _save(folder, _block(pa.Table.from_batches([*held, b.slice(at, k - at)])), n)
                    held, at, n = [], k, 0
                n += 1
            held.append(b.slice(at))
            last = ids[-1] if len(ids) else last
        if sum(map(len, held)):
            yield _save(folder, _block(pa.Table.from_batches(held)), n)

    dealt = entries.select("id", "phrase", "tf", "n_tokens").repartition(_parts(entries.sparkSession, n), "id").sortWithinPartitions("id")
    return [(r["path"], r["n"]) for r in dealt.mapInArrow(run, FILES).collect()]


def _parts(spark: SparkSession, n: int) -> int:
    """Blocks that ``n`` rows make: as large as the cores and a task's memory allow, as each has k best rows of its own."""
    return max(1, min(2 * spark.sparkContext.defaultParallelism, n // 1_024), -(-n // ROWS_A_BLOCK))


@dataclass(frozen=True)
class TextBlocks:
    """A table of texts for one table of questions: blocks of its rows, written once, in one pass over the texts. What a posting
    takes is a few bytes of a file; no posting is a row, is joined or shuffled. ``files``: (path, rows) of the blocks."""

    spark: SparkSession
    files: list[tuple[str, int]]
    n: int
    n_tokens: int

    @classmethod
    def of(cls, rows: DataFrame, questions: DataFrame, id_col: str = "id", text_col: str = "text") -> TextBlocks:
        """``rows``: with distinct ids; phrases of several words are looked for if ``questions`` have them."""
        found = rows.select(F.col(id_col).cast("long").alias("id"), tokens(F.col(text_col)).alias("tokens"))
        phrases = asked_phrases(questions).filter(F.size("words") > 1).select("phrase", "words").dropDuplicates(["phrase"])
        phrases = kept_table(rows.sparkSession, phrases)
        if phrases.isEmpty():
            found = found.withColumn("also", F.lit(None).cast("array<struct<phrase:string,tf:int>>"))
        else:
            index = text_index(rows, phrases.select(F.explode("words").alias("term")), id_col, text_col)
            also = phrase_rows(index, phrases).groupBy("id").agg(F.collect_list(F.struct("phrase", F.col("tf").cast("int").alias("tf"))).alias("also"))
            found = found.join(also, "id", "left")
        folder = _folder(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            n = n_tokens = 0

            def block() -> pa.RecordBatch:
                if sum(map(len, held)):
                    return _save(folder, _block(pa.concat_tables(held).unify_dictionaries()), n, n_tokens)
                return pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n], pa.int64()), pa.array([n_tokens], pa.int64())], ["path", "n", "n_tokens"])

            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy().astype(np.int64)
                    n, n_tokens = n + len(sizes), n_tokens + int(sizes.sum())
                    for made in row_postings(iter([b.select(["id", "tokens"])])):
                        held.append(pa.table([made.column("id"), made.column("term").dictionary_encode(), made.column("tf"), made.column("n_tokens")], ["id", "phrase", "tf", "n_tokens"]))
                    if b.column(2).null_count < b.num_rows:
                        many = np.repeat(np.arange(len(sizes)), pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy())
                        phrase, tf = b.column(2).flatten().flatten()
                        held.append(pa.table([b.column(0).take(pa.array(many)), phrase.dictionary_encode(), tf, pa.array(sizes[many], pa.int32())], ["id", "phrase", "tf", "n_tokens"]))
                    if n >= TEXTS_A_BLOCK:
                        yield block()
                        held, n, n_tokens = [], 0, 0
            if n:
                yield block()

        made = found.mapInArrow(run, FILES).collect()  # a row for every 2,048 texts
        return cls(rows.sparkSession, [(r["path"], r["n"]) for r in made if r["path"]], sum(r["n"] for r in made), sum(r["n_tokens"] for r in made))

    def counts(self) -> DataFrame:
        """``phrase, df``: how many rows of a block have a phrase."""

        def run(paths: list[str]) -> Iterator[pa.RecordBatch]:
            for path in paths:
                _, names, _, terms, _, _ = _load(path)
                df = np.bincount(np.frombuffer(terms.as_buffer(), "<i4"), minlength=len(names))
                yield pa.RecordBatch.from_arrays([names.values, pa.array(df, pa.int64())], ["phrase", "df"])

        return _each(self.spark, _even(self.files, _parts(self.spark, self.n)), run, "phrase string, df long")

    def entries(self) -> DataFrame:
        """``id, phrase, tf, n_tokens`` of all rows."""

        def run(paths: list[str]) -> Iterator[pa.RecordBatch]:
            for path in paths:
                t = _entries(*_load(path))
                yield from t.set_column(1, "phrase", pc.cast(t.column("phrase"), pa.string())).to_batches()

        return _each(self.spark, _even(self.files, _parts(self.spark, self.n)), run, "id long, phrase string, tf int, n_tokens int")


def _question_blocks(asked: DataFrame) -> list[tuple[str, int]]:
    """Files (path, questions) from ``query_id, phrase, weight``: ids, the phrases that they have, and question by question the
    phrases' places, in the phrases' order, and weights. A block of questions is of a few files."""
    folder, most = _folder(asked), max(1, QUESTIONS_A_BLOCK // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(own: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(own)
            ids, size = np.unique(t.column(0).to_numpy(), return_counts=True)
            coded = t.column(1).combine_chunks().dictionary_encode()
            names = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
            made = pa.RecordBatch.from_arrays([_raw(ids, "<i8"), names, _raw(size, "<i8"), _raw(coded.indices.to_numpy(), "<i4"), _raw(t.column(2).to_numpy(), "<f8")], ["query_ids", "asked", "sizes", "terms", "weights"])
            return _save(folder, made, len(ids))

        held, n, last = [], 0, None
        for b in batches:  # sorted by question and phrase
            ids, at = b.column(0).to_numpy(), 0
            for k in np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if last is None else last)) if len(ids) else []:
                if n == most:
                    yield block([*held, b.slice(at, k - at)])
                    held, at, n = [], k, 0
                n += 1
            held.append(b.slice(at))
            last = ids[-1] if len(ids) else last
        if sum(map(len, held)):
            yield block(held)

    dealt = asked.select("query_id", "phrase", "weight").repartition("query_id").sortWithinPartitions("query_id", "phrase")
    return [(r["path"], r["n"]) for r in dealt.mapInArrow(run, FILES).collect()]


def _number(x: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _questions(paths: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of questions: ids, distinct phrases, where each question's begin, their places among the phrases, and weights."""
    ids, names, sizes, terms, weights = zip(*map(_load, paths), strict=True)
    coded = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(_number(t, "<i4")), n.values) for t, n in zip(terms, names, strict=True)]).unify_dictionaries().combine_chunks()
    ptr = np.concatenate([[0], np.cumsum(np.concatenate([_number(x, "<i8") for x in sizes]))])
    return np.concatenate([_number(x, "<i8") for x in ids]), coded.dictionary, ptr, coded.indices.to_numpy(), np.concatenate([_number(x, "<f8") for x in weights])


def _rows(paths: list[str], asked: pa.Array, average: float) -> BlockScores:
    """A block of rows with the postings of the asked phrases; ``average``: tokens a row."""
    every, counts, terms, parts = [], [], [], []
    for path in paths:
        ids, names, ptr, term, tf, size = _load(path)
        place = pc.fill_null(pc.index_in(names.values, value_set=asked), -1).to_numpy()[_number(term, "<i4")]
        hit = place >= 0
        row = np.repeat(np.arange(len(_number(ids, "<i8")), dtype=np.int32), np.diff(_number(ptr, "<i8")))[hit]
        tf = _number(tf, "<i4")[hit]
        parts.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * _number(size, "<i4")[row] / average)))
        every.append(_number(ids, "<i8")), counts.append(np.bincount(row, minlength=len(every[-1]))), terms.append(place[hit])
    ptr = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return BlockScores(np.concatenate(every), ptr, np.concatenate(terms), np.concatenate(parts), len(asked))


def _best_rows(blocks: list[list[str]], questions: list[str], k: int, average: float) -> pa.RecordBatch:
    """LISTS of each question's k best rows of some blocks, one block after the other."""
    ids, asked, ptr, term, weight = _questions(questions)
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
    for paths in blocks:
        rows = _rows(paths, asked, average)
        for i, (lo, hi) in enumerate(zip(ptr.tolist(), ptr[1:].tolist(), strict=False)):
            own, score = best[i]
            also, more = rows.best(term[lo:hi], weight[lo:hi], k, score[-1] if len(own) == k else 0.0)
            if len(own) and len(also):
                also, more = np.concatenate([own, also]), np.concatenate([score, more])
                order = np.lexsort((also, -more))[:k]
                also, more = also[order], more[order]
            if len(also):
                best[i] = also, more
        del rows
    some = [i for i, (own, _) in enumerate(best) if len(own)]
    return packed_lists(ids[some], [best[i] for i in some])


def keyword_lists(index: KeywordIndex | TextBlocks, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, id, keyword_score, keyword_rank``: the k best rows of each question (query_id, text), ties by id.

    Frequencies and lengths are of all rows of the index; only ``allowed`` ids are listed.
    """
    asked = kept_table(questions.sparkSession, asked_phrases(questions))
    n_asked = asked.count()
    whole = isinstance(index, TextBlocks)
    if whole:
        found = index.entries()
        phrases = asked.select("phrase").distinct()
        df = index.counts().join(F.broadcast(phrases) if n_asked <= MOST_ASKED else phrases, "phrase", "left_semi").groupBy("phrase").agg(F.sum("df").alias("df"))
    else:
        found = phrase_rows(index, asked.select("phrase", "words").dropDuplicates(["phrase"]))
        df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)) * F.col("times")
    weighed = asked.join(df, "phrase").select("query_id", "phrase", weight.alias("weight"))
    if allowed is not None:
        found = found.join(allowed.select("id"), "id", "left_semi")
    rows = index.files if whole and allowed is None else _row_blocks(found, index.n)
    spark, asked = questions.sparkSession, _question_blocks(weighed)
    average = (index.n_tokens / index.n if index.n else 0) or 1.0
    rows = _even(rows, _parts(spark, sum(n for _, n in rows)))
    asked = _even(asked, -(-sum(n for _, n in asked) // QUESTIONS_A_BLOCK))
    chain = max(1, min(BLOCKS_A_TASK, len(rows) * len(asked) // (6 * spark.sparkContext.defaultParallelism)))
    chains = [rows[at : at + chain] for at in range(0, len(rows), chain)]

    def run(pair: tuple[list[list[str]], list[str]]) -> Iterator[pa.RecordBatch]:
        yield _best_rows(*pair, k, average)

    lists = _each(spark, [(c, q) for c in chains for q in asked], run, LISTS)
    return merged_lists(lists, k, descending=True).select("query_id", "id", F.col("value").alias("keyword_score"), F.col("rank").alias("keyword_rank"))


def search_many(rows: DataFrame, questions: DataFrame, index: KeywordIndex | TextBlocks, top_k: int = 5, vector_weight: float = 1.0, keyword_weight: float = 1.0, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, place, id, score, distance, keyword_score, vector_rank, keyword_rank``: what ``hybrid.search`` gives for each
    question (query_id, text, embedding); a null text or vector leaves its list empty. ``index``: of all ``rows``."""
    Query(vector=[0.0], text="", top_k=top_k, vector_weight=vector_weight, keyword_weight=keyword_weight).check()
    pool = Query(text="", top_k=top_k).pool
    may = rows if allowed is None else rows.join(allowed.select("id"), "id", "left_semi")
    asked = questions.filter("embedding IS NOT NULL").select("query_id", "embedding")
    v = top_k_joined(may.select("id", "embedding"), asked, pool).withColumnRenamed("rank", "vector_rank")
    k = keyword_lists(index, questions.select("query_id", "text"), pool, allowed)
    both = fuse(v, k, vector_weight, keyword_weight, by=["query_id", "id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()))
    return both.withColumn("place", place).filter(F.col("place") <= top_k)


def answer_many(rows: DataFrame, questions: DataFrame, index: KeywordIndex | TextBlocks, model: A.Generator | None = None, top_k: int = 8, budget: int = 1100, least_similarity: float = 0.25, allowed: DataFrame | None = None) -> DataFrame:
    """A row a question, of ANSWERS: the stages of an answer over its hits, in tasks. ``kept``: passages of the prompt, best
    first; ``cited``: those that the answer rests on. A question that finds nothing gets that answer, and one that is over
    the budget by itself gets no answer.

    ``rows``: id, doc_id, source_path, offset, length, page, text, embedding; ``questions``: query_id, text, embedding.
    """
    model = model or A.ExtractiveGenerator()
    hits = search_many(rows, questions, index, top_k, allowed=allowed).select("query_id", "place", "id", "score", "distance")
    small = questions.count() * top_k <= MOST_HITS
    found = rows.select("id", "doc_id", "source_path", "offset", "length", "page", "text", F.col("embedding").alias("own")).join(F.broadcast(hits) if small else hits, "id")
    asked = questions.select("query_id", F.coalesce("text", F.lit("")).alias("question"), "embedding")
    every = asked.join(found, "query_id", "left")
    cosine = F.coalesce(cosine_from_distance(F.col("distance")), dot(F.col("own"), F.col("embedding")), F.lit(-1.0))
    every = every.select("query_id", "question", "place", "id", "doc_id", "source_path", "offset", "length", "page", F.col("text").alias("passage"), "score", cosine.alias("similarity"))

    def one(key: tuple, own: pa.Table) -> pa.Table:
        def retrieve(s: A.State) -> None:
            there = sorted((r for r in own.to_pylist() if r["id"] is not None), key=lambda r: r["place"])
            s.passages = [A.Passage(r["id"], r["doc_id"], r["source_path"], "", r["page"], r["offset"], r["length"], r["passage"] or "", r["score"], r["similarity"]) for r in there]

        def row(*values) -> pa.Table:
            return pa.table([pa.array([v], kind) for v, kind in zip((key[0].as_py(), *values), ANSWER_TYPES, strict=True)], [c.split()[0] for c in ANSWERS.split(", ")])

        try:
            s = A.run(A.standard_stages(retrieve, model, least_similarity, budget), A.State(own.column("question")[0].as_py()))
        except EngineError as e:
            if e.status != "TOO_LONG":
                raise
            return row(False, "", [], [], 0)
        made = A.make_answer(s)
        return row(made.found, made.text, [p.id for p in s.passages], [c.chunk_id for c in made.citations], len(s.prompt.encode()))

    return every.groupBy("query_id").applyInArrow(one, ANSWERS)  # top_k rows a question


__all__ = ["ANSWERS", "TextBlocks", "answer_many", "asked_phrases", "keyword_lists", "phrase_rows", "search_many"]
