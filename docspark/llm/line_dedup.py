"""Line dedup over overlapping windows of three lines.

Every three consecutive lines are hashed; a window seen before (by doc_id, then position) is a later occurrence. The
line ranges that later occurrences cover are merged per document and cut from its text. One line or two that hold more
than LONG words are windows too: a passage of that length may stand on fewer than three lines, or in a document that
has no three. Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import WORD, Scratch, free_prefix

#: Lines in a window, and words above which fewer lines are a window of their own.
WIDTH, LONG = 3, 50
STATS = "dedup_lines_stats"


def stats_column(docs: DataFrame) -> str:
    """The name of the figures' column: STATS, with underscores after it if ``docs`` has such a column."""
    name, taken = STATS, {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The input's rows and columns, with ``text_col`` cleaned, and n_lines, n_removed (long) in ``stats_column(docs)``.

    Lines are what line feeds separate, compared exactly, empty lines included. Of equal windows the one with the
    smallest (doc_id, position) stays; the others are removed, except for lines that the first one itself covers when
    both overlap in one document. Documents of fewer than three lines have only the windows of one or two lines with
    more than LONG words (runs of characters other than ASCII white space). Null texts stay null (0 lines), and an empty
    text is one line. A null doc_id sorts first. Rows that repeat a doc_id with the same text are one document and stay
    alike; with another text the text's hash orders them. Any further columns pass through, whatever they are called.
    """
    scratch = scratch or Scratch(spark, "line-dedup")
    p = free_prefix(docs)
    key, tie, lines, counts = F.col(p + "id"), F.col(p + "tie"), F.col(p + "lines"), F.col(p + "counts")
    docs_ = docs.withColumns({p + "id": F.col(f"`{id_col}`"), p + "tie": F.xxhash64(f"`{text_col}`"), p + "lines": F.split(F.col(f"`{text_col}`"), "\n", -1)})
    # 128 bits of SHA-256 stand for a window; windows of one row are cut from the list of its lines
    digest = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    joined = lambda i, width: F.array_join(F.slice(lines, i, F.lit(width)), "\n")

    def windows_of(width: int) -> Column:
        """Structs (at, width, hash) of a row's windows of ``width`` lines; at counts from 0."""
        starts = F.when(F.size(lines) >= width, F.sequence(F.lit(1), F.size(lines) - (width - 1))).otherwise(F.array().cast("array<int>"))
        if width < WIDTH:
            starts = F.filter(starts, lambda i: sum((F.get(counts, i - 1 + k) for k in range(1, width)), F.get(counts, i - 1)) > LONG)
        return F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.lit(width).alias("width"), digest(joined(i, width)).alias("hash")))

    every = F.concat(*(windows_of(w) for w in range(WIDTH, 0, -1)))
    counted = docs_.withColumn(p + "counts", F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))))
    windows = counted.filter(F.col(f"`{text_col}`").isNotNull()).select(key.alias("id"), tie.alias("tie"), F.explode(every).alias("w"))
    windows = scratch.save(windows.select("id", "tie", "w.at", "w.width", "w.hash"), "windows")
    first = scratch.save(
        windows.groupBy("hash")
        .agg(F.min(F.struct("id", "tie", "at")).alias("first"), F.max(F.struct("id", "tie", "at")).alias("last"))
        .filter(F.col("first") != F.col("last"))
        .select("hash", F.col("first.id").alias("id0"), F.col("first.tie").alias("tie0"), F.col("first.at").alias("at0")),
        "first",
    )
    same = F.col("id").eqNullSafe(F.col("id0")) & (F.col("tie") == F.col("tie0"))
    # joined on the hash alone, both sides straight from written tables, so that skewed hashes are split
    later = windows.join(first, "hash").filter(~(same & (F.col("at") == F.col("at0")))).select(
        "id", "tie",
        F.when(same, F.greatest(F.col("at"), F.col("at0") + F.col("width"))).otherwise(F.col("at")).alias("lo"),
        (F.col("at") + F.col("width")).alias("hi"),
    ).distinct()
    # covered ranges [lo, hi) that touch are merged
    order = Window.partitionBy("id", "tie").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(reach.isNull() | (reach < F.col("lo")), 1).otherwise(0)).withColumn(
        "island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    cuts = (
        islands.groupBy("id", "tie", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("id", "tie").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))
        .select(F.col("id").alias(p + "cid"), F.col("tie").alias(p + "ctie"), F.col("cuts").alias(p + "cuts"))
    )
    both = docs_.join(cuts, key.eqNullSafe(F.col(p + "cid")) & (tie == F.col(p + "ctie")), "left")
    n, cut = F.size(lines), F.col(p + "cuts")
    removed = F.aggregate(cut, F.lit(0), lambda a, x: a + x["hi"] - x["lo"])
    # what stays: before the first cut, and from each cut's end to the next one's start
    after = F.transform(cut, lambda x, i: F.slice(lines, x["hi"] + 1, F.coalesce(F.get(cut, i + 1)["lo"], n) - x["hi"]))
    left = F.concat(F.slice(lines, F.lit(1), F.get(cut, F.lit(0))["lo"]), F.flatten(after))
    text = F.col(f"`{text_col}`")
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out[text_col] = F.when(cut.isNull(), text).otherwise(F.array_join(left, "\n"))
    stats = F.struct(F.when(text.isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))
    return both.select(*(v.alias(k) for k, v in out.items()), stats.alias(stats_column(docs)))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup_lines(spark, docs.select("doc_id", "text"))
    return out.select("doc_id", "dedup_lines_stats.n_lines", "dedup_lines_stats.n_removed", "text")


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, width, unnest(range(0, greatest(len(ls) - width + 1, 0))) AS p0, ls FROM l, range(1, {WIDTH + 1}) t(width)),
g AS (SELECT doc_id, p0, width, array_to_string(ls[p0 + 1:p0 + width], chr(10)) AS passage FROM w),
h AS (SELECT * FROM g WHERE width = {WIDTH} OR len(regexp_extract_all(passage, '{WORD}')) > {LONG}),
f AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(p0) OVER o AS f0
      FROM h WINDOW o AS (PARTITION BY width, passage ORDER BY doc_id, p0 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
r AS (SELECT doc_id, unnest(range(CASE WHEN doc_id = d0 THEN greatest(p0, f0 + width) ELSE p0 END, p0 + width)) AS pos
      FROM f WHERE doc_id <> d0 OR p0 <> f0),
p AS (SELECT DISTINCT doc_id, pos FROM r),
x AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, ls FROM l),
k AS (SELECT x.doc_id, string_agg(x.ls[x.pos + 1], chr(10) ORDER BY x.pos) FILTER (p.pos IS NULL) AS text,
             count(*) AS n_lines, count(p.pos) AS n_removed
      FROM x LEFT JOIN p USING (doc_id, pos) GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN k USING (doc_id)
"""
