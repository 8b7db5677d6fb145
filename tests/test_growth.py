"""Steps whose tasks or batches must not grow faster than the tables."""

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from docspark import queries as Q
from docspark.functions import answers
from docspark.functions.text import normalize, normalize_text
from docspark.operators.chunk import chunk_documents, chunk_text
from docspark.operators.keyword import index_terms

SMALL = "/root/testdata/sf0.001"


def used_partitions(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_markup_files_are_made_by_many_tasks(spark):
    """Parts that lie in one row group are dealt out before they are read as files."""
    assert used_partitions(Q.extract_markups(spark, SMALL)) > 4


def test_office_files_are_made_by_many_tasks(spark):
    assert used_partitions(Q.extract_office(spark, SMALL)) > 4


def test_snippet_looks_at_the_first_characters_only(spark):
    """The line is cut from the text once, before line ends are replaced; results as in plain Python."""
    texts = ["", "a\r\nb", "x" * 60, "x" * 61, "é" * 30, "é" * 31, "a" + "é" * 40, "\n" * 70, "日本" * 50, None]

    def plain(t):
        raw = t.replace("\r", " ").replace("\n", " ").encode()
        return raw.decode() if len(raw) <= 60 else raw[:60].decode(errors="ignore") + "..."

    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", answers.snippet(F.col("t"), 60).alias("s"))
    assert {r["i"]: r["s"] for r in out.collect()} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    assert "regexp_replace(t" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_python_steps_take_arrow_batches_in_slices(spark):
    """Nulls and rows on both sides of a slice's end; no step turns a whole batch into Python objects."""
    arrow = PythonEvalType.SQL_SCALAR_ARROW_UDF
    texts = [None if i % 7 == 0 else f"line {i}.\r\n\r\nmore ﬁn {i}" for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    assert normalize_text.evalType == arrow
    out = rows.select("i", normalize_text(F.col("t").cast("binary")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in out} == {i: None if t is None else normalize(t.encode()) for i, t in enumerate(texts)}
    found = chunk_documents(rows.withColumnRenamed("t", "text"), target=10, most=20, overlap=3)
    want = {(i, k, *c) for i, t in enumerate(texts) for k, c in enumerate(chunk_text(t or "", [], 10, 20, 3))}
    assert {(r["i"], r["chunk_index"], r["offset"], r["length"], r["page"]) for r in found.collect()} == want
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (found, Q.embed_documents(spark, SMALL))]
    assert all("ArrowEvalPython" in p and str(PythonEvalType.SQL_SCALAR_PANDAS_UDF) not in p.split("ArrowEvalPython")[1].split("\n")[0] for p in plans)


def test_postings_are_made_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "b c")] + [(i, f"a x{i} a") for i in range(10, 700)], "id long, text string").coalesce(1)
    out = index_terms(rows)
    assert "Exchange" not in out._jdf.queryExecution().sparkPlan().toString() and "Aggregate" not in out._jdf.queryExecution().sparkPlan().toString()
    got = {(r["term"], r["id"]): (r["tf"], list(r["positions"]), r["n_tokens"]) for r in out.collect()}
    want = {("a", 1): (2, [0, 2], 3), ("b", 1): (1, [1], 3), ("b", 4): (1, [0], 2), ("c", 4): (1, [1], 2)}
    for i in range(10, 700):
        want |= {("a", i): (2, [0, 2], 3), (f"x{i}", i): (1, [1], 3)}
    assert got == want
