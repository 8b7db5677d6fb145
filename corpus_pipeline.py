"""The corpus pipeline: stages over the documents table, each written as Parquet and read again.

A stage is called with what the stage before it kept. All but the last return the columns of ``documents``, further ones
included, whatever they are called. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import line_dedup, mixing, near_dedup, packing, quality
from docspark.llm.common import Scratch, delete, free_prefix, owned, read

#: Near duplicates: words a shingle, similarity in percent.
SHINGLE, SIMILAR = 5, 80
#: Scratch of stages that were called one by one: (place of the stage, folder) by input folder.
_open: dict[str, list[tuple[int, str]]] = defaultdict(list)


def _stage(f: Callable) -> Callable:
    """For callers that write each stage's result before they call the next: scratch of the earlier stages over the same
    input folder goes when a stage is called. ``run`` keeps account by itself, so that several runs do not meet here; two
    callers that go through STAGES over one folder at a time have to use ``run``."""

    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [g for _, g in STAGES].index(step)
        for root in [r for k, r in _open[sf_dir] if k < place]:
            delete(spark, root)
        _open[sf_dir] = [x for x in _open[sf_dir] if x[0] >= place]
        with owned() as made:
            out = f(spark, docs, sf_dir)
        _open[sf_dir] += [(place, root) for root in made]
        return out

    step.__doc__, step.whole = f.__doc__, f
    return step


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt from the labelled rows that are not held out.

    Null and empty texts are judged like any text, by the vector of an empty one. Rows that repeat or lack a doc_id are
    judged each by their own text.
    """
    return quality.keep_good(spark, docs, read(spark, sf_dir, "labels"))


@_stage
def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that came before; n_chars follows the text. A document of which nothing is left goes.

    Null and empty texts stay. Rows that repeat a doc_id with the same text count as one document and stay alike; with
    different texts, and for rows without a doc_id (which sort first), a hash of the text gives their order.
    """
    out, stats = line_dedup.dedup_lines(spark, docs), line_dedup.stats_column(docs)
    gone = (F.col(f"{stats}.n_removed") > 0) & (F.col(f"{stats}.n_removed") == F.col(f"{stats}.n_lines"))
    out = out.filter(~gone).drop(stats)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id.

    Of rows that repeat a doc_id with the same text one stays; with different texts each is in the group of its text.
    Rows without a doc_id, which nothing can name, stay. Documents without words are near nothing and stay.
    """
    p = free_prefix(docs)
    text = p + "text"
    rows = docs.withColumn(text, F.xxhash64("text"))
    kept = near_dedup.link_documents(spark, rows, SHINGLE, SIMILAR, keep=[text]).filter("kept").select(F.col("doc_id").alias(p + "kept"), F.col(text).alias(p + "kept_text")).distinct()
    rows = rows.join(kept, (F.col("doc_id") == F.col(p + "kept")) & (F.col(text) == F.col(p + "kept_text")), "left_semi")
    return rows.dropDuplicates(["doc_id", text]).drop(text).unionByName(docs.filter("doc_id IS NULL"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 2 times), in the order of their virtual finish times.

    Each row counts by itself, also rows that repeat or lack a doc_id. Null sources are one source; null and empty texts
    have size 0.
    """
    return mixing.take(spark, docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Each row is packed by itself, whatever its doc_id; a null or empty text is
    its end id alone."""
    return packing.pack(spark, docs, packing.vocabulary())


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", fresh_lines),
    ("minhash_near_dedup", one_of_each),
    ("mix_sources", mixed),
    ("hilbert_packing", packed),
]

#: The classifier, the hashing and the packing order have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's scratch goes as soon as its result is written."""
    out, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with owned() as made:
            out = scratch.save(stage.whole(spark, out, sf_dir), name)
        for root in made:
            delete(spark, root)
    return out
