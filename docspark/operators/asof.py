"""As-of joins: each row with the last mark at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, marks: DataFrame, by: str, at: str, value: str, width: int = 1 << 20) -> DataFrame:
    """``rows`` (with ``by`` and a whole number ``at``) with ``value``: that of the last of ``marks`` (by, at, value) of the same
    ``by`` at or before ``at``, the greatest of several at one place, or null before the first. A null ``by`` or ``at`` gets
    null, and so do marks that lack one or have no value.

    Both are put in one line, marks first, and the last value is carried on. A line is cut every ``width``, and a cut's
    line begins with the last mark before it, so that no group's rows have to meet in a task; columns are kept, whatever
    they are called.
    """
    names = rows.columns
    cut = lambda c: F.floor(F.col(c) / F.lit(width)).alias("cut")
    key, place = F.col(f"`{by}`").alias("by"), F.col(f"`{at}`").cast("long").alias("at")
    lined = rows.select(key, place, F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    mine = marks.select(key, place, F.col(f"`{value}`").alias("value")).filter("by IS NOT NULL AND at IS NOT NULL AND value IS NOT NULL").groupBy("by", "at").agg(F.max("value").alias("value"))
    # each cut's last mark, carried to the cuts behind it: a row a cut
    cuts = mine.select("by", cut("at"), "at", "value").groupBy("by", "cut").agg(F.max_by("value", "at").alias("last"))
    asked = lined.select("by", cut("at")).filter("by IS NOT NULL AND cut IS NOT NULL").distinct()
    line = Window.partitionBy("by").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    every = asked.join(cuts, ["by", "cut"], "full_outer").withColumn("value", F.last("last", ignorenulls=True).over(line))
    start = every.select("by", "cut", F.lit(None).cast("long").alias("at"), "value", F.lit(0).alias("kind"), F.lit(None).cast(lined.schema["row"].dataType).alias("row"))
    both = mine.select("by", cut("at"), "at", "value", F.lit(0).alias("kind"), F.lit(None).cast(lined.schema["row"].dataType).alias("row"))
    both = both.unionByName(lined.select("by", cut("at"), "at", F.lit(None).cast(marks.schema[value].dataType).alias("value"), F.lit(1).alias("kind"), "row"))
    both = both.unionByName(start.filter("value IS NOT NULL"))
    order = Window.partitionBy("by", "cut").orderBy(F.asc_nulls_first("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("by").isNotNull() & F.col("at").isNotNull()
    found = both.withColumn("found", F.when(whole, F.last("value", ignorenulls=True).over(order))).filter("kind = 1")
    return found.select(*(F.col(f"row.`{c}`") for c in names), F.col("found").alias(value))


def pages_of(offsets: DataFrame, starts: DataFrame, by: str = "doc_id", offset: str = "offset") -> DataFrame:
    """``offsets`` with ``page``: the page, from 1, on which each byte lies by ``starts`` (by, page_start), 0 for texts without
    pages; before the first start it is page 1."""
    line = Window.partitionBy(by).orderBy("page_start")  # a text's pages
    numbered = starts.filter(F.col("page_start").isNotNull()).dropDuplicates([by, "page_start"]).select(by, F.col("page_start").cast("long").alias(offset), F.row_number().over(line).alias("page"))
    first = numbered.filter("page = 1").select(F.col(by).alias("has"))
    found = as_of(offsets, numbered, by, offset, "page")
    known = found.join(first, F.col(by) == F.col("has"), "left")
    return known.select(*offsets.columns, F.coalesce("page", F.when(F.col("has").isNotNull(), 1).otherwise(0)).alias("page"))
