"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash and queued, twice over. A queued document's virtual finish time is the
words of its source up to and with it, divided by the source's weight. All queues are range-sorted by that time and the
mix takes documents until its words reach the budget. A source that is used up leaves its share to the others, which is
the same as resharing the excess by weight.

Running sums are two-level: sums of hash ranges (or time ranges) are added up in a small table, and windows run inside
one range only, so that no source, however large, meets in one task. The budget ends inside one range of times, which
alone is sorted for the cut; ``take`` then writes the documents in the order of their times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import WORD, Scratch, free_prefix

#: Weights, repeated over the sources in order of their code points (null last).
WEIGHTS = (3, 1, 2)
BUDGET, EPOCHS, SEED = 1.5, 2, 20
#: Ranges into which each source's queue and the time axis are cut, by the table's rows.
ROWS_PER_RANGE, MOST_RANGES = 1_024, 32_768


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_hash(seed: int) -> Column:
    """60 bits of MD5 over seed, doc_id and size."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, 15), 16, 10).cast("long")


def source_plan(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Per source: rank, weight, source_size, target. ``sizes``: source, source_size (one row a source).

    Targets fill up by weight: with sources in the order of cap / weight, those whose cap lies under the level that
    the others reach stop at the cap. The table of sources is taken to be short: its windows run in one task.
    """
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": F.col("source_size") * float(epochs), "ratio": F.col("source_size") * float(epochs) / F.col("weight")})
    before = every.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    full, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumns({"level": (F.sum("source_size").over(every) * budget - full) / (F.sum("weight").over(every) - gone)})
    # once a source's level lies under its ratio, it and all later ones share that level
    open_level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    s = s.withColumn("open_level", open_level)
    share = F.least("cap", F.col("weight") * F.col("open_level"))
    return s.select("source", "rank", "weight", "source_size", F.coalesce(share, F.col("cap")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = SEED, keep: Sequence[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, times (of the copies taken), rank
    (of the source), and the columns ``keep`` (names of none of these).

    Size is the number of runs of characters other than ASCII white space; null texts have size 0. Rows with a null
    source are one source, the last. Ties in the shuffle's hash are ordered by (doc_id, size), so repeated rows keep
    apart and reruns agree. Documents of size 0 are taken with their queue and count nothing. An empty table gives no
    rows. Only whole documents are taken, so a source misses its target by less than its largest document.
    """
    scratch = scratch or Scratch(spark, "mixing")
    rows = scratch.save(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *keep)
        .withColumn("h", shuffle_hash(seed)),
        "sizes",
    )
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    # the hash as a number in [0, ranges): cutting by its upper part keeps the order of h
    at = F.floor(F.col("h").cast("double") / float(2**60) * ranges).cast("int")
    rows = rows.withColumn("range", F.least(at, F.lit(ranges - 1)))
    sums = scratch.save(rows.groupBy("source", "range").agg(F.sum("size").alias("part")), "range-sums")
    plan = source_plan(spark, sums.groupBy("source").agg(F.sum("part").alias("source_size")), weights, budget, epochs)
    up = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("part").over(up), F.lit(0))).alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select(
        F.col("b.source").alias("s"), F.col("range").alias("r"), "base", "rank", "weight", "source_size", "target"
    )
    bases = scratch.save(bases, "bases")
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.withColumn("run", F.sum("size").over(inside)).join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    queue = queue.select(
        "doc_id", "source", "size", "h", "rank", "source_size", "target", *keep,
        F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: (F.col("base") + F.col("run") + e * F.col("source_size")) / F.col("weight")).alias("times"),
    )
    queue = scratch.save(queue, "queue")
    # the global order: (time, rank, h, doc_id). Its prefix within the budget ends in one time range, sorted alone
    total = n and (plan_total(bases) or 0)
    limit = total * budget
    entries = queue.select("size", "rank", "h", "doc_id", F.explode("times").alias("time"))
    last = float(entries.agg(F.max("time")).first()[0] or 0.0) or 1.0
    steps = max(16, ranges * epochs)
    slot = F.least(F.floor(F.col("time") / last * steps), F.lit(steps - 1))
    filled, cut = 0, steps
    for s, part in sorted(entries.groupBy(slot.alias("slot")).agg(F.sum("size")).collect()):  # at most `steps` rows
        if filled + part > limit:
            cut = s
            break
        filled += part
    order = Window.partitionBy("slot").orderBy("time", "rank", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = entries.withColumn("slot", slot).filter(F.col("slot") == cut).withColumn("run", F.sum("size").over(order)).filter(F.col("run") <= limit - filled)
    final = edge.agg(F.max(F.struct("time", "rank", "h", "doc_id"))).first()[0]

    def taken(t: Column) -> Column:
        here = F.least(F.floor(t / last * steps), F.lit(steps - 1))
        if final is None:
            return here < cut
        got = F.struct(F.lit(final["time"]).alias("time"), F.lit(final["rank"]).alias("rank"), F.lit(final["h"]).alias("h"), F.lit(final["doc_id"]).cast(dict(queue.dtypes)["doc_id"]).alias("doc_id"))
        return (here < cut) | ((here == cut) & (F.struct(t.alias("time"), "rank", "h", "doc_id") <= got))

    times = F.filter("times", taken)
    copies = F.size(times).cast("long")
    return queue.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), times.alias("times"), "rank", *keep)


def take(spark: SparkSession, docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **plan) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, range-sorted by virtual finish time; the columns of ``docs``.

    Rows are numbered and the plan comes back to them by number, so that rows that repeat an id, lack one, or are equal
    are each written as often as planned. Documents of size 0 are taken like others.
    """
    scratch = Scratch(spark, "mixing-rows")
    p = free_prefix(docs)
    row, time, rank = p + "row", p + "time", p + "rank"
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    made = mix(spark, rows, source_col, id_col, text_col, keep=[row], **plan)
    copies = made.select(F.col(row).alias(row + "_"), F.explode("times").alias(time), F.col("rank").alias(rank))
    out = rows.join(copies, F.col(row) == F.col(row + "_")).repartitionByRange(time, rank, row).sortWithinPartitions(time, rank, row)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def plan_total(bases: DataFrame) -> int | None:
    return bases.select("rank", "source_size").distinct().agg(F.sum("source_size")).first()[0]


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
q AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id, size)), 1, 15))::BIGINT AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][rank % {len(WEIGHTS)} + 1]::DOUBLE AS weight, {EPOCHS}.0::DOUBLE * source_size AS cap FROM r),
-- the water level: the largest for which the capped shares stay within the budget, tried at each source's own ratio
v AS (SELECT a.source, (SELECT {BUDGET}::DOUBLE * sum(source_size) FROM w) AS budget,
             sum(b.cap) FILTER (b.cap / b.weight <= a.cap / a.weight) AS full_cap,
             sum(b.weight) FILTER (b.cap / b.weight > a.cap / a.weight) AS open_weight,
             sum(least(b.cap, b.weight * a.cap / a.weight)) AS filled
      FROM w a, w b GROUP BY a.source, a.cap, a.weight),
l AS (SELECT coalesce(max((budget - full_cap) / open_weight) FILTER (filled <= budget),
                      (SELECT {BUDGET}::DOUBLE * sum(source_size) / sum(weight) FROM w)) AS level FROM v),
f AS (SELECT q.doc_id, q.size, w.source_size, least(w.cap, w.weight * l.level) AS target, w.rank, w.weight, q.h,
             sum(q.size) OVER (PARTITION BY w.rank ORDER BY q.h, q.doc_id, q.size ROWS UNBOUNDED PRECEDING) AS run
      FROM q JOIN w ON q.source IS NOT DISTINCT FROM w.source, l),
e AS (SELECT *, (run + epoch * source_size) / weight AS time FROM f, range({EPOCHS}) t(epoch)),
m AS (SELECT *, sum(size) OVER (ORDER BY time, rank, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM e)
SELECT doc_id, size, source_size, target,
       coalesce(sum(size) FILTER (total <= (SELECT {BUDGET} * sum(size) FROM d)), 0)::BIGINT AS taken
FROM m GROUP BY doc_id, size, source_size, target
"""
