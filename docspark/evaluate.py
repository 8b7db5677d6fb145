"""Scoring a collection on a set of questions with known facts and sources."""

from __future__ import annotations

import statistics
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.api import Collection
from docspark.functions.answers import NOT_FOUND
from docspark.functions.terms import tokens
from docspark.operators.keyword import KeywordIndex
from docspark.operators.rows import exact_median, numbered

RESULT = "id long, correct boolean, cited boolean, file_recall boolean, passage_recall boolean, refused boolean, seconds double"


@dataclass(frozen=True)
class Question:
    """``expect``: any of these facts answers it; ``source``: the file that holds them; one without a source cannot be answered."""

    id: int
    text: str
    expect: Sequence[str] = ()
    source: str = ""


def states(answer: str, fact: str) -> bool:
    """But for case, commas and spaces; digits may not match inside a longer number."""
    import re

    strip = lambda s: re.sub(r"[, ]", "", s.lower())
    f = strip(fact)
    pattern = (r"(?<!\d)" if f[:1].isdigit() else "") + re.escape(f) + (r"(?!\d)" if f[-1:].isdigit() else "")
    return bool(re.search(pattern, strip(answer)))


def ask_all(c: Collection, questions: Sequence[Question], top_k: int = 10, **options) -> DataFrame:
    """A row a question, of RESULT."""
    rows = []
    for q in questions:
        t = time.perf_counter()
        a = c.ask(q.text, top_k=top_k, **options)
        seconds = time.perf_counter() - t
        hits = list(c.store.get_many([h["id"] for h in c.query_text(q.text, top_k)]).values())
        answerable = bool(q.source)
        rows.append((
            q.id, answerable and any(states(a.text, f) for f in q.expect), answerable and any(x.source_path.endswith(q.source) for x in a.citations),
            answerable and any(h["source_path"].endswith(q.source) for h in hits), answerable and any(states(h["text"], f) for h in hits for f in q.expect),
            not a.found or a.text.strip() == NOT_FOUND, seconds,
        ))
    return c.spark.createDataFrame(rows, RESULT)


#: Texts up to which they are broadcast.
MOST_ASKED = 100_000


def holders(rows: DataFrame, asked: DataFrame, index: KeywordIndex) -> DataFrame:
    """``query_id, id``: the rows (id, text) that hold each text of ``asked`` (query_id, text), character by character.

    Tokens between a text's first and last stand wherever it stands, so a text is looked for in the rows that have the rarest
    of them by ``index`` (of the asked texts' terms at least); texts of fewer than three tokens are looked for in all rows.
    """
    own = asked.filter("text IS NOT NULL").select("query_id", F.col("text").alias("asked"), F.explode(F.array(tokens(F.col("text")))).alias("t"))
    near = F.broadcast if asked.count() <= MOST_ASKED else lambda df: df
    inner = own.filter(F.size("t") >= 3).select("query_id", "asked", F.explode(F.slice("t", F.lit(2), F.size("t") - 2)).alias("term"))
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    rarest = inner.join(df, "term", "left").groupBy("query_id", "asked").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    pairs = index.postings.select("term", "id").join(near(rarest), "term").select("query_id", "id", "asked")
    found = rows.select("id", "text").join(pairs, "id").filter(F.contains("text", "asked")).select("query_id", "id")
    short = own.filter(F.size("t") < 3).select("query_id", "asked")
    if short.isEmpty():
        return found
    return found.unionByName(rows.select("id", "text").join(near(short), F.contains("text", "asked")).select("query_id", "id"))


def score(results: DataFrame, questions: Sequence[Question]) -> dict:
    """Counts over answerable questions, refusals over the others, and the median time (the upper one of two)."""
    spark: SparkSession = results.sparkSession
    kinds = spark.createDataFrame([(q.id, bool(q.source)) for q in questions], "id long, answerable boolean")
    n = lambda c: F.count_if(F.col(c) & F.col("answerable")).alias(c)
    both = results.join(kinds, "id")
    out = both.agg(F.count_if("answerable").alias("answerable"), n("correct"), n("cited"), n("file_recall"), n("passage_recall"), F.count_if(F.col("refused") & ~F.col("answerable")).alias("refused")).first().asDict()
    out["median_seconds"] = statistics.median_high([r["seconds"] for r in results.select("seconds").collect()])
    return out


def growth(rows: DataFrame, time: str, tie: str, value: str) -> DataFrame:
    """Medians of ``value`` over the first and the last eighth of the rows in the order of ``time``, and the growth between
    them in percent. Eighths are those of ntile(8): the first ones have a row more where the number does not divide."""
    n = rows.count()
    first, last = n // 8 + (n % 8 > 0), n // 8
    line = numbered(rows, F.unix_micros(F.col(time).cast("timestamp")), tie)
    a = exact_median(line.filter(F.col("row") < first), value, tie).withColumnRenamed("median", "first_eighth")
    b = exact_median(line.filter(F.col("row") >= n - last), value, tie).withColumnRenamed("median", "last_eighth")
    both = a.crossJoin(F.broadcast(b))  # one row each
    return both.withColumn("growth", (F.col("last_eighth") - F.col("first_eighth")) / F.col("first_eighth") * 100)
