"""Near-duplicate detection by min-max hashing, with every link confirmed on the full shingle sets.

Each permutation gives two signature values, the least and the greatest hash of a document's shingles, so half as many
hashes are evaluated as for a min-hash signature of the same length. Bands of ROWS values are the buckets.

1. Documents with equal shingle sets become one class; only classes are compared, copies never meet each other.
2. In each bucket every class is compared with one representative (another one in each band). Confirmed links join
   classes into components.
3. A bucket whose classes are by then one component needs nothing more. In the others, each class outside the
   representative's component is compared with every class of the bucket whose size allows a link, in blocks: exact set
   intersections of a block pair are counted in one pass over an inverted index, and a pair that is already connected is
   not reported again. The components are then joined over these links.

So no link between bucket members is lost, though pairs that add nothing to the components are never written. The
minimum and the maximum under one permutation depend on each other, the more the smaller the sets: of a union of u
shingles, i of them shared, both agree with the probability i (i - 1) / (u (u - 1)). A document gets as many bands as
its size needs for a pair at the threshold to share no bucket with a probability of MISS at most, whatever its union.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import UPPER, WORD, Scratch, turn

ROWS, MISS, SEED = 4, 1e-7, 11
#: Members of a block in step 3, and representatives' groups in step 2 before they are salted.
BLOCK, GROUP = 512, 128


def band_table(percent: int, miss: float = MISS) -> np.ndarray:
    """Bands of ROWS = 4 values for a set of n shingles, by n; for larger sets the last entry.

    A pair meets in the bands that both sets have. Its union is as large as its larger set at least, so what a size
    needs is the most that any union from there on needs.
    """
    u = np.arange(2, 4096)
    i = -(-percent * u // 100)
    both = (i * (i - 1) / (u * (u - 1))) ** 2  # two permutations a band
    need = np.where(i == u, 1, np.ceil(math.log(miss) / np.log1p(-np.minimum(both, 1 - 1e-9)))).astype(int)
    least = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** 4)) if percent < 100 else 1
    need = np.maximum.accumulate(np.append(need, least)[::-1])[::-1]
    return np.concatenate([need[:1], need[:1], need])


#: Words whose hashes a worker keeps, at about 200 bytes each.
KNOWN_WORDS = 200_000
_words: dict[bytes, int] = {}


def begin() -> None:
    """The words' hashes are kept until another operator's task begins in this worker."""
    turn("near_dedup", _words.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_words) > KNOWN_WORDS:
        _words.clear()
    known, out = _words, []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes (64 bits, sorted) of a text's shingles; bytes.split() cuts at the six ASCII white spaces."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = finish(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, count, dtype=np.uint64)


def band_hashes(found: np.ndarray, mul: np.ndarray, add: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash a band from the minima and maxima under each permutation."""
    low, high = np.full(len(mul), 2**64 - 1, np.uint64), np.zeros(len(mul), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            x = found[at : at + 2048, None] * mul + add
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        values = np.stack([low, high], 1).ravel()[: bands * rows].reshape(bands, rows)
        out = np.arange(bands, dtype=np.uint64)
        for i in range(rows):
            out = finish(out * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return out


def describe(size: int, bands: np.ndarray):
    """mapInArrow: (doc_id, data, ...) -> doc_id, n_shingles, cls (128 bits of the set's digest), bands, packed words, ..."""
    mul, add = permutations(int(bands.max()) * ROWS // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        begin()
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                n, cls, sig, packed = [], [], [], []
                for text in b.column(1).to_pylist():
                    s = shingles(text, size)
                    k = int(bands[min(len(s), len(bands) - 1)])
                    n.append(len(s))
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(band_hashes(s, mul[: k * ROWS // 2], add[: k * ROWS // 2], k, ROWS).view(np.int64) if len(s) else [])
                    packed.append(press.compress(text) if len(s) else b"")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(packed, pa.binary()), *b.columns[2:]],
                    ["doc_id", "n", "cls", "bands", "packed", *b.schema.names[2:]],
                )

    return run


class Sets:
    """Shingle sets of packed texts."""

    def __init__(self, size: int):
        import zstandard

        begin()
        self.size, self.press = size, zstandard.ZstdDecompressor()

    def __call__(self, packed: bytes) -> np.ndarray:
        return shingles(self.press.decompress(packed), self.size)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def linked(inter, na, nb, percent: int):
    return 100 * inter >= percent * (na + nb - inter)


def verify_stars(size: int, percent: int):
    """mapInArrow over rows (rep, salt, own, cls, packed) sorted so that a representative comes before its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, rep, base = Sets(size), None, None
        for b in batches:
            a, z = [], []
            for r, own, cls, packed in zip(*(b.column(k).to_pylist() for k in ("rep", "own", "cls", "packed")), strict=True):
                if own == 0:
                    rep, base = r, sets(packed)
                    continue
                if r != rep:
                    raise ValueError("a member without its representative")
                s = sets(packed)
                if linked(common(base, s), len(base), len(s), percent):
                    a.append(cls), z.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(z, pa.binary())], ["a", "b"])

    return run


def verify_blocks(size: int, percent: int):
    """applyInArrow over one block pair: rows (side, cls, label, packed); links that join components, a forest of them."""

    def run(table: pa.Table) -> pa.Table:
        sets = Sets(size)
        rows = list(zip(*(table.column(k).to_pylist() for k in ("side", "cls", "label", "packed")), strict=True))
        left = [r for r in rows if r[0] == 0]
        own = [sets(r[3]) for r in left]
        sizes = np.array([len(s) for s in own])
        values, owner = np.concatenate([*own, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, z = [], []
        for side, cls, label, packed in rows:
            if side == 0 or not len(left):
                continue
            s = sets(packed)
            lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            inter = np.bincount(owner[at], minlength=len(own))
            for i in np.flatnonzero(linked(inter, sizes, len(s), percent)).tolist():
                x, y = root(left[i][2]), root(label)
                if left[i][1] != cls and x != y:
                    parent[x] = y
                    a.append(left[i][1]), z.append(cls)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(z, pa.binary())})

    return run


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, label) of every class on an edge: label is the least class that it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each written before the next reads it. Star
    steps group edges by a node, with only a minimum taken of a group, and stop when an edge list stands still.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        # large star: a node's larger neighbours point to the least of it and its neighbours
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large-star")
        # small star: a node and its smaller neighbours point to the least of them
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = scratch.save(small, "small-star")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e, large)
        e = new
        if mark == seen:
            return e.select(F.col("u").alias("cls"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
        seen = mark


def link_documents(spark: SparkSession, docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and the columns ``keep``.

    A document's set: its distinct ``size``-word shingles after lower-casing A-Z, or all its words as one shingle if it
    has fewer. Two documents are linked if 100 * intersection >= ``percent`` * union; a component is what links reach
    and its id the least doc_id in it. Documents without words (null, empty, white space) have 0 shingles, are linked
    with nothing and are components of their own. Rows that repeat a doc_id are linked by their own texts. A row without an
    id belongs to its component like any other but cannot name it; kept is false for it unless no row has an id. An
    empty table gives no rows. Shingles are told apart by 64-bit hashes.
    """
    scratch = Scratch(spark, "near-dedup")
    carried = [f"keep_{k}" for k in range(len(keep))]
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"), *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried, strict=True))
    )
    more = "".join(f", {k} {dict(docs.dtypes)[c]}" for c, k in zip(keep, carried, strict=True))
    t = scratch.save(source.mapInArrow(describe(size, band_table(percent)), f"doc_id long, n long, cls binary, bands array<long>, packed binary{more}"), "documents")
    ids = t.select("doc_id", "n", "cls", *carried)
    # a class is represented by its least (doc_id, bands); equal sets have equal bands
    classes = scratch.save(t.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    member = classes.select("cls", "n", F.posexplode("bands").alias("band", "hash"))
    # the representative differs from band to band; of buckets with one class nothing is kept
    bucket = scratch.save(
        member.groupBy("band", "hash").agg(F.min(F.struct(F.xxhash64("cls", "band").alias("h"), "cls", "n")).alias("r"), F.count("*").alias("members")).filter("members > 1")
        .select("band", "hash", "members", F.col("r.cls").alias("rep"), F.col("r.n").alias("rep_n")),
        "buckets",
    )
    inside = scratch.save(member.join(bucket, ["band", "hash"]), "members")
    near = F.lit(100) * F.least("n", "rep_n") >= F.lit(percent) * F.greatest("n", "rep_n")
    pairs = inside.filter((F.col("cls") != F.col("rep")) & near).select("cls", "rep").distinct()
    pairs = scratch.save(pairs, "star-pairs")
    reps = scratch.save(pairs.groupBy("rep").agg(F.count("*").alias("members")).withColumn("salts", F.ceil(F.col("members") / GROUP).cast("int")), "representatives")
    # the words of one row of each class that takes part
    part = inside.select("cls").distinct()
    texts = t.filter("n > 0").select("doc_id", F.col("cls").alias("c"), "packed").join(
        classes.join(part, "cls", "left_semi").select("cls", "first"), (F.col("c") == F.col("cls")) & F.col("doc_id").eqNullSafe(F.col("first"))
    ).select("cls", "packed").dropDuplicates(["cls"])
    texts = scratch.save(texts, "texts")
    stars = pairs.join(reps, "rep").select("rep", F.pmod(F.xxhash64("cls"), "salts").cast("int").alias("salt"), F.lit(1).alias("own"), "cls")
    heads = reps.select("rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("own"), F.col("rep").alias("cls"))
    rows_ = stars.union(heads).join(texts, "cls").select("rep", "salt", "own", "cls", "packed")
    found = rows_.repartition("rep", "salt").sortWithinPartitions("rep", "salt", "own").mapInArrow(verify_stars(size, percent), "a binary, b binary")
    found = scratch.save(found, "star-links")
    label = scratch.save(components(spark, found, scratch), "star-labels")
    # buckets that are not one component yet, and the classes in them that are not their representative's
    labelled = inside.filter("members > 2").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    labelled = labelled.join(label.select(F.col("cls").alias("rep"), F.col("label").alias("rep_label")), "rep", "left").withColumn("main", F.col("label") == F.coalesce("rep_label", "rep"))
    # sets that differ by more than one class of sizes are too unlike in size for a link
    sized = F.floor(F.log("n") / (1.001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    labelled = scratch.save(labelled.select("band", "hash", "cls", "label", "main", sized.alias("sized")), "labelled")
    counts = labelled.groupBy("band", "hash", "sized").agg(F.count("*").alias("all"), F.count_if(~F.col("main")).alias("strays"))
    near_sizes = F.explode(F.array(F.col("sized") - 1, F.col("sized"), F.col("sized") + 1)).alias("own")
    counts = counts.select("band", "hash", near_sizes, "all", F.when(F.col("own") == F.col("sized"), F.col("strays")).otherwise(0).alias("strays"))
    counts = counts.groupBy("band", "hash", "own").agg(F.sum("all").alias("all"), F.sum("strays").alias("strays")).filter("strays > 0")
    sizes = scratch.save(counts.select("band", "hash", "own", F.ceil(F.col("all") / BLOCK).cast("int").alias("cols"), F.ceil(F.col("strays") / BLOCK).cast("int").alias("lines")), "stray-buckets")
    at = lambda n: F.pmod(F.xxhash64("cls", F.lit(3)), n).cast("int")
    left = labelled.filter(~F.col("main")).withColumn("own", F.col("sized")).join(sizes, ["band", "hash", "own"])
    left = left.select("band", "hash", "own", at("lines").alias("line"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(0).alias("side"), "cls", "label")
    right = labelled.select("band", "hash", "cls", "label", near_sizes).join(sizes, ["band", "hash", "own"])
    right = right.select("band", "hash", "own", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("line"), at("cols").alias("col"), F.lit(1).alias("side"), "cls", "label")
    blocks = left.unionByName(right).join(texts, "cls")
    links = scratch.save(blocks.groupBy("band", "hash", "own", "line", "col").applyInArrow(verify_blocks(size, percent), "a binary, b binary").distinct(), "block-links")
    # the star components over these links
    own = lambda side: label.select(F.col("cls").alias(side), F.col("label").alias(f"{side}_label"))
    links = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    wider = components(spark, links, scratch).select(F.col("cls").alias("label"), F.col("label").alias("wider"))
    final = classes.select("cls", "first").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    final = final.join(wider, "label", "left").select("cls", "first", F.coalesce("wider", "label").alias("label"))
    final = scratch.save(final, "labels")
    least = final.groupBy("label").agg(F.min("first").alias("component_id"))
    named = scratch.save(final.join(least, "label").select("cls", "component_id"), "components")
    out = ids.join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return link_documents(spark, docs, 3, 85)


ORACLE_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents),
-- shingles of three words; of fewer words, all of them as one
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT g.b, r.reached FROM r JOIN g ON g.a = r.doc_id),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
