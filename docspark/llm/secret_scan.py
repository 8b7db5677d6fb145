"""Secret scans with an incremental blob ledger.

A text is content-addressed by the SHA-256 of its UTF-8 bytes: a blob. The ledger holds the findings of each pair of
blob and rule version, empty ones too. A scan lists the blobs of all rows, drops the pairs that the ledger has, sends
one copy of each blob that is left to the scanner with the rules it lacks, appends the findings, and joins the ledger
back to every row that carries the blob. A blob that ten thousand rows or versions share is scanned once; a changed
rule is run over all blobs again, alone.

The ledger is a Parquet folder with a subfolder for each rule version, so that a scan reads those of its rules. Two scans
that append at once may both add a pair; pairs are told apart on reading, and equal pairs have equal findings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, exists


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` has fewer than ``least`` characters are
    dropped after the match (what they covered stays covered). ``needs``: one of these, in lower case, occurs in any
    text with a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    base: bool = True

    @property
    def version(self) -> str:
        return self.kind + "-" + hashlib.sha256(f"{self.pattern}|{self.group}|{self.least}".encode()).hexdigest()[:12]


KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" for c in k) for k in ("password", "passwd", "secret", "token", "api_key"))
#: The base rules in the order in which equal starts are listed.
RULES = (
    Rule("assign", rf"""({_key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, KEYWORDS),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs [0-9a-f]+ of 32 characters and more
)
#: Kinds beyond the base ones.
EXTRA = (Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",), base=False),)
LEDGER = "blob binary, version string, kind string, spans array<struct<start:int,stop:int>>"
#: Unseen blobs up to this many (48 bytes each) are sent to the scan of texts, so that only their texts leave the JVM.
#: More of them are joined by shuffle, for which texts are packed; a Bloom filter of bounded size keeps seen ones out.
BROADCAST_BLOBS = 20_000
#: Bits of the filter for an unseen blob, and at most (16 MB); hashes. With 16 bits a seen text gets by once in 400 times,
#: and beyond 8 million unseen blobs more often; what gets by is dropped in the join.
SIEVE_BITS, MOST_SIEVE_BITS, HASHES = 16, 1 << 27, 4
#: Blobs of which a task remembers that it has packed them; copies beyond are packed again and dropped in the join.
REMEMBERED = 1_000_000


def find(text: str, rule: Rule, compiled: re.Pattern | None = None, lowered: str | None = None) -> list[tuple[int, int]]:
    """Spans (start, stop) of the whole matches, in code points."""
    if rule.needs:
        lowered = text.lower() if lowered is None else lowered
        if not any(k in lowered for k in rule.needs):
            return []
    return [m.span() for m in (compiled or re.compile(rule.pattern)).finditer(text) if len(m[rule.group]) >= rule.least]


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def places(name: Column, bits: int) -> Column:
    """A blob's bits in a filter of ``bits``."""
    return F.array(*(F.pmod(F.xxhash64(name, F.lit(i)), F.lit(bits)) for i in range(HASHES)))


def sieve(blobs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of ``n`` blobs (b) as 64-bit words, and its bits: words that are not 0 reach the driver, of bounded number."""
    bits = min(MOST_SIEVE_BITS, 1 << max(10, (n * SIEVE_BITS - 1).bit_length()))
    at = blobs.select(F.explode(places(F.col("b"), bits)).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return words, bits


def passes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of bits (n, HASHES) are all set."""
    return ((words[at >> 6] >> (at & 63)) & 1 == 1).all(1)


def _pack(batches: Iterator[pa.RecordBatch], words: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """Packed texts by blob and row, those of ``words`` alone if there is a fourth column of their bits."""
    import zstandard

    press, schema = zstandard.ZstdCompressor(level=1), pa.schema([("row_id", pa.int64()), ("blob", pa.binary()), ("packed", pa.binary())])
    seen: set[bytes] = set()  # of this task's rows: a copy in the same part of the table is not sent again
    for batch in batches:
        if words is not None and len(batch):
            at = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES)
            batch = batch.filter(pa.array(passes(words.value, at)))
        ids, names, packed = [], [], []
        for i, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (i, b) not in seen:
                if len(seen) < REMEMBERED:
                    seen.add((i, b))
                ids.append(i), names.append(b), packed.append(press.compress(t))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary()), pa.array(packed, pa.binary())], schema=schema)


def scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress, compiled = zstandard.ZstdDecompressor(), {r.version: (r, re.compile(r.pattern)) for r in rules}
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        schema = pa.schema([("blob", pa.binary()), ("version", pa.string()), ("kind", pa.string()), ("spans", span)])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                out: dict[str, list] = {k: [] for k in schema.names}
                for name, packed, todo in zip(b.column("blob").to_pylist(), b.column("packed").to_pylist(), b.column("todo").to_pylist(), strict=True):
                    text = unpress.decompress(packed).decode("utf-8", "replace")
                    lowered = text.lower()
                    for v in todo:
                        rule, pattern = compiled[v]
                        out["blob"].append(name), out["version"].append(v), out["kind"].append(rule.kind)
                        out["spans"].append([{"start": s, "stop": e} for s, e in find(text, rule, pattern, lowered)])
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return scan


def scan_secrets(spark: SparkSession, docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES + EXTRA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, blob, findings array of (start, order, kind, stop, base), sorted by start, then kind as listed.

    ``ledger_path`` is a Parquet folder that later scans pass again; without one the ledger lives for this call. A null
    text is an empty one, with no findings. Rows that repeat an id, a text, or both give a row each. An empty table
    gives no rows; the table's further columns are ignored.
    """
    scratch = Scratch(spark, "secret-scan")
    ledger_path = ledger_path or scratch.path("ledger")
    paths = scratch.save(docs.select(F.col(id_col).cast("long").alias("doc_id"), blob(F.col(text_col)).alias("blob")), "paths")
    versions = [r.version for r in rules]
    ledger = spark.read.schema(LEDGER).parquet(ledger_path) if exists(spark, ledger_path) else spark.createDataFrame([], LEDGER)
    have = ledger.filter(F.col("version").isin(versions)).groupBy("blob").agg(F.collect_set("version").alias("have"))
    one = paths.groupBy("blob").agg(F.min("doc_id").alias("row_id"))
    todo = one.join(have, "blob", "left").withColumn("todo", F.array_except(F.array(*map(F.lit, versions)), F.coalesce("have", F.array().cast("array<string>"))))
    todo = scratch.save(todo.filter(F.size("todo") > 0).select(F.col("blob").alias("b"), F.col("row_id").alias("r"), "todo"), "todo")
    texts = docs.select(F.col(id_col).cast("long").alias("row_id"), blob(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    unseen = todo.count()
    wanted = (F.col("blob") == F.col("b")) & F.col("row_id").eqNullSafe(F.col("r"))
    if unseen:
        # by blob and row: other rows with the blob go elsewhere and are dropped there
        kind = "row_id long, blob binary, packed binary"
        if unseen <= BROADCAST_BLOBS:
            lost = texts.join(F.broadcast(todo.select("b", "r")), wanted, "left_semi").mapInArrow(_pack, kind).join(F.broadcast(todo), wanted)
        else:
            words, bits = sieve(todo, unseen)
            sent = spark.sparkContext.broadcast(words)
            lost = texts.withColumn("at", places(F.col("blob"), bits)).mapInArrow(partial(_pack, words=sent), kind).join(todo, wanted)
        found = lost.select("blob", "packed", "todo").mapInArrow(scanner(rules), LEDGER).dropDuplicates(["blob", "version"])
        found.write.mode("append").partitionBy("version").parquet(ledger_path)
    ledger = spark.read.schema(LEDGER).parquet(ledger_path) if exists(spark, ledger_path) else ledger
    order = F.coalesce(*(F.when(F.col("kind") == r.kind, i) for i, r in enumerate(rules)))
    base = F.col("kind").isin([r.kind for r in rules if r.base])
    found = (
        ledger.filter(F.col("version").isin(versions) & (F.size("spans") > 0)).dropDuplicates(["blob", "version"])
        .withColumns({"order": order, "base": base})
        .withColumn("f", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("order").alias("order"), F.col("kind").alias("kind"), s["stop"].alias("stop"), F.col("base").alias("base"))))
        .groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("f"))).alias("findings"))
    )
    found = scratch.save(found, "findings")  # so that a blob with very many rows is split in the join
    return paths.join(found, "blob", "left").select("doc_id", "blob", "findings")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = scan_secrets(spark, docs)
    own = F.filter("findings", lambda f: f["base"])
    listed = lambda a: F.coalesce(F.array_join(F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ","), F.lit(""))
    count = lambda kind: F.coalesce(F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long"), F.lit(0)).alias(f"n_{kind}")
    n = [F.when(F.col("findings").isNull(), F.lit(0).cast("long")).otherwise(count(r.kind)).alias(f"n_{r.kind}") for r in RULES]
    return out.select("doc_id", *n, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def _sql_spans(rule: Rule) -> str:
    """Rows (doc_id, kind, start, stop) of a rule, as DuckDB has no positions of matches: matches are put between two marks
    that no text has, and the pieces' lengths are added up."""
    pattern = rule.pattern.replace("'", "''")
    return rf"""
  SELECT doc_id, '{rule.kind}' AS kind, {[r.kind for r in RULES + EXTRA].index(rule.kind)} AS place, before AS start, before + length(hit) AS stop
  FROM (SELECT doc_id, split_part(pieces[n], chr(57345), 1) AS hit,
               list_sum(list_transform(pieces[1:n - 1], lambda x: length(replace(x, chr(57345), ''))))::BIGINT AS before
        FROM (SELECT doc_id, pieces, unnest(range(2, len(pieces) + 1)) AS n
              FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS pieces FROM d)))
  WHERE length({f"regexp_extract(hit, '{pattern}', {rule.group})" if rule.group else 'hit'}) >= {rule.least}"""


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(map(_sql_spans, RULES + EXTRA))}),
f AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)},
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (kind NOT IN ({', '.join(f"'{r.kind}'" for r in EXTRA)})) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""
