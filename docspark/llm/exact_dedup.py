"""Exact dedup with heavy hitters taken out before the shuffle.

A table of digests is written once. Misra-Gries counters (``freqItems``) name every digest that may hold more than
``support`` of the rows; one pre-aggregated pass counts those candidates exactly. The verified winners, at most
``1/support`` rows, are broadcast: their rows get their group's figures on the map side and never meet in a task. The
other digests are aggregated with partial sums before their shuffle and joined back to their rows; both sides of that
join are plain rows of written tables, so that partitions that are still too large are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, lower_ascii

#: Share of all rows from which a digest counts as frequent; its inverse bounds the broadcast.
SUPPORT = 1 / 256


def digest(text):
    """SHA-256 (hex) of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def dedup_exact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of a group stays. A null text is an empty one, so null and empty texts form one group. Null ids
    never win against an id; a group without any id keeps null (keep_id null, kept true for its rows). Rows that
    repeat an id count each in group_size and, if that id wins, are each marked as kept. An empty table gives no rows.
    """
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.save(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")), "digests")
    found = rows.stat.freqItems(["text_sha256"], support).first()
    candidates = spark.createDataFrame([(x,) for x in (found[0] if found and found[0] else [])], "text_sha256 string")
    least = support * rows.count()
    winners = scratch.save(
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter((F.col("group_size") > 1) & (F.col("group_size") >= least)),
        "winners",
    )
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    others = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = others.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rest = others.join(scratch.save(groups, "groups"), "text_sha256")
    return frequent.select(rest.columns).unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
