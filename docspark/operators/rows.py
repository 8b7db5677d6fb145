"""Row numbers and distinct rows without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into.
RANGES = 1_024


def dealt(table: DataFrame) -> DataFrame:
    """A table that is one scan split or less, dealt out to the cores row by row; any other as it is.

    What is moved is a split (spark.sql.files.maxPartitionBytes) at most, on a cluster of any size: larger tables are
    scanned as they are stored. Rows are dealt in turn, by no key. Sizes are those of the files; nothing runs.
    """
    spark = table.sparkSession
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    at = [path(f) for f in table.inputFiles()]
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    if len(at) > spark.sparkContext.defaultParallelism or sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in at) > split:
        return table
    return table.repartition(2 * spark.sparkContext.defaultParallelism)


def spread(table: DataFrame) -> DataFrame:
    """A table of short rows that cost much work each, dealt out to the cores whatever its size: it can lie in one row group,
    which a single task reads. What is moved are the rows, not what is made of them."""
    return table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism)


def numbered(rows: DataFrame, by: Column, *ties: str, name: str = "row") -> DataFrame:
    """``rows`` with their place, from 0, in the order of a numeric expression without nulls, then of ``ties``.

    Ranges of equal width are counted in a small table; windows run inside a range. Nothing is sampled, so the ranges are
    the same whenever they are computed.
    """
    lo, hi = rows.agg(F.min(by), F.max(by)).first()
    width = F.lit(float(hi - lo) or 1.0) if lo is not None else F.lit(1.0)
    at = F.least(F.floor((by - F.lit(lo)) / width * RANGES), F.lit(RANGES - 1)).cast("int")
    rows = rows.withColumns({"__range": at, "__by": by})
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    bases = rows.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__by", *ties))
    return rows.withColumn("__inside", inside).join(F.broadcast(bases), "__range").withColumn(name, F.col("__base") + F.col("__inside") - 1).drop("__range", "__by", "__base", "__inside")


def exact_median(rows: DataFrame, value: str, *ties: str) -> DataFrame:
    """One row: the median, the mean of the middle two of an even number. Null without rows."""
    n = rows.count()
    middle = numbered(rows.select(value, *ties), F.col(value), *ties).filter(F.col("row").isin((n - 1) // 2, n // 2))
    return middle.agg(F.avg(value).alias("median"))


def best_of_equal(rows: DataFrame, same: str, *order) -> DataFrame:
    """Of rows that are equal in ``same`` the first in an order: aggregated on a digest, so that equal rows do not meet in a task.

    ``order``: names of columns, "-name" for descending; the last has to tell rows apart.
    """
    key = F.struct(*(F.negative(F.col(c[1:])).alias(c[1:]) if c.startswith("-") else F.col(c) for c in order))
    marked = rows.withColumns({"__same": F.sha2(F.coalesce(F.col(same), F.lit("")), 256), "__none": F.col(same).isNull(), "__key": key})
    first = marked.groupBy("__same", "__none").agg(F.min("__key").alias("__first"))
    both = marked.join(first, ["__same", "__none"]).filter(F.col("__key") == F.col("__first"))
    return both.select(rows.columns)
