"""Tokens of whole texts, huge ones in overlapping chunks that are encoded apart and spliced.

A text of more than LONG characters is cut into chunks that reach an overlap into the next one, and the chunks are dealt to
tasks as rows. The vocabularies that this is done for cut a text into words by a pattern that never looks back, so from a
position where two encodings both begin a word they are the same word by word. Hence for texts a and b that begin
at different places and both reach a common word start p,

    tokens(a to the end) - tokens(b to the end) = tokens of a before p - tokens of b before p,

and the count of a text is the sum of these differences over its seams plus the tokens of its last chunk. A word start
counts as proven when it lies MARGIN characters and the longest special string before the end of both chunks, so that what
was cut off cannot have moved it, or at the end of the text. Seams where no word start is common (a run of letters
longer than the overlap) are encoded again with overlaps that widen eightfold, to the end of the text at last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import Scratch
from docspark.llm.tokens import UnitEncoder, encoder

#: Characters of a chunk, and of its first overlap; texts of up to LONG characters are not cut.
LONG, OVERLAP, WIDEN = 65_536, 512, 8
#: Characters of short texts that are encoded at once.
STEP = 1 << 20
#: Characters that the pattern looks ahead beyond a word, with some to spare.
MARGIN = 4
LIMIT = 512
PIECES = "doc_id {id}, n_bytes long, n_tokens long, key long, chunk long, size long, piece string"
ENDS = "key long, chunk long, at array<int>, before array<int>, n_tokens long, first boolean"
#: Chunks that leave Python at once.
BATCH = 64


def splice_margin(path: str) -> int | None:
    """Characters before a chunk's end in which a word start is not proven, or None if texts cannot be cut.

    Cut are texts for byte-level vocabularies with the usual pattern, no normaliser, and special strings that neither
    overlap each other nor take white space with them.
    """
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec.get("added_tokens") or []
    special = [t["content"] for t in tokens]
    meets = any(a != b and b in a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) for a in special for b in special)
    if UnitEncoder._mode(spec) != "prefix" or spec.get("post_processor") or meets or any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    return MARGIN + max(map(len, special), default=0)


class Counter:
    """A vocabulary file's library, for a worker: .json by tokenizers, .model by sentencepiece."""

    def __init__(self, path: str):
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.units = encoder(path)

    def count(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]
        return [len(ids) // self.units.dtype.itemsize for ids in self.units.encode(texts)]

    def words(self, text: str) -> tuple[list[int], list[int], int]:
        """Where the words begin, the tokens before each, and the tokens of all."""
        got = self.units.tokenizer.encode(text, add_special_tokens=False)
        ids, offsets, starts, before, last = got.word_ids, got.offsets, [], [], None
        for k, w in enumerate(ids):
            if w is None or w != last:
                starts.append(offsets[k][0])
                before.append(k)
                last = w
        return starts, before, len(ids)


def slices(rows: list[int], texts: Sequence[str], most: int = STEP) -> Iterator[list[int]]:
    """``rows`` in runs whose texts have ``most`` characters together, or one row."""
    run, n = [], 0
    for k in rows:
        if run and n + len(texts[k]) > most:
            yield run
            run, n = [], 0
        run.append(k)
        n += len(texts[k])
    if run:
        yield run


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def in_region(words: tuple[list[int], list[int], int], lo: int, hi: int, end: int | None) -> tuple[list[int], list[int]]:
    """Word starts from ``lo`` to ``hi``, counted from ``lo``, and the tokens before each; ``end``: the text's end, as a start too."""
    starts, before, n = words
    own = [(s - lo, k) for s, k in zip(starts, before, strict=True) if lo <= s <= hi]
    if end is not None:
        own.append((end - lo, n))
    return [s for s, _ in own], [k for _, k in own]


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, overlap: int = OVERLAP, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8) and n_tokens (long).

    A null text counts as empty (0 bytes, 0 tokens). Special strings inside texts are the special tokens that the
    library takes them for; none is added. Rows that repeat or lack an id are counted each. Other columns are not read.
    An empty table gives no rows. Vocabularies whose texts cannot be cut (``splice_margin``) get every text whole.
    """
    if not 0 < overlap < long:
        raise ValueError("the overlap has to be shorter than a chunk")
    scratch, margin = scratch or Scratch(spark, "token-counts"), splice_margin(path)
    kind = dict(docs.dtypes)[id_col]
    schema = PIECES.format(id=kind)
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of texts that are not cut, and the chunks of the others with a number for the text, which is the task's and the row's."""
        from pyspark import TaskContext

        def batch(ids: pa.Array, *columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names)

        tool, seen = counter(path), TaskContext.get().partitionId() << 36
        for b in batches:
            ids, (texts, size) = b.column(0), zip(*((t, len(t.encode("utf-8", "surrogatepass"))) for t in (t or "" for t in b.column(1).to_pylist())), strict=True) if len(b) else ((), ())
            whole = [k for k, t in enumerate(texts) if margin is None or len(t) <= long]
            for part in slices(whole, texts):
                yield batch(ids.take(pa.array(part, pa.int64())), [size[k] for k in part], tool.count([texts[k] for k in part]), *[[None] * len(part)] * 4)
            for k in sorted({*range(len(texts))}.difference(whole)):
                t, seen = texts[k], seen + 1
                starts = list(range(0, len(t), long))
                for i in range(0, len(starts), BATCH):
                    part = starts[i : i + BATCH]
                    n, own = len(part), ids.take(pa.array([k if at == 0 else None for at in part], pa.int64()))
                    yield batch(own, [size[k]] * n, [None] * n, [seen] * n, [at // long for at in part], [len(t)] * n, [t[at : at + long + overlap] for at in part])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of chunks: the word starts in the overlap with the chunk before, under that seam's number with counts below zero,
        and in the one with the next; and the tokens of the last chunk, at no seam."""
        tool = counter(path)
        for b in batches:
            out: list[tuple] = []
            for key, i, size, piece in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                words, at = tool.words(piece), i * long
                ends = at + len(piece) == size
                sure = len(piece) if ends else len(piece) - margin
                end = len(piece) if ends else None
                if i:
                    out.append((key, i - 1, *in_region(words, 0, min(overlap, sure), end if end is not None and end <= overlap else None), None, False))
                if at + long < size:
                    out.append((key, i, *in_region(words, long, min(long + overlap, sure), end), None, True))
                else:
                    out.append((key, None, None, None, words[2], False))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], a) for k, a in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.bool_()))], [c.split()[0] for c in ENDS.split(", ")])

    rows = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema), "texts")
    whole = rows.filter("key IS NULL").select("doc_id", "n_bytes", "n_tokens")
    chunks = rows.filter("key IS NOT NULL")
    if margin is None or not chunks.limit(1).count():
        return whole
    dealt = chunks.select("key", "chunk", "size", "piece").repartition("key", "chunk")
    ends = scratch.save(dealt.mapInArrow(encoded, ENDS), "ends")
    sides = ends.filter("chunk IS NOT NULL").groupBy("key", "chunk").agg(*(F.max(F.when(F.col("first") == side, F.struct("at", "before"))).alias(n) for n, side in (("a", True), ("b", False))))  # two rows a seam
    common = F.array_min(F.array_intersect("a.at", "b.at"))
    tokens = lambda side: F.get(F.col(f"{side}.before"), F.array_position(F.col(f"{side}.at"), common).cast("int") - 1)
    seams = scratch.save(sides.select("key", "chunk", (tokens("a") - tokens("b")).cast("long").alias("n_tokens")), "seams")
    found = [ends.filter("chunk IS NULL").select("key", "n_tokens"), seams.filter("n_tokens IS NOT NULL").select("key", "n_tokens")]
    in_a_row = F.col("chunk") - F.row_number().over(Window.partitionBy("key").orderBy("chunk"))  # a text's open seams
    open_ = seams.filter("n_tokens IS NULL").select("key", "chunk", in_a_row.alias("island")).groupBy("key", "island").agg(F.min("chunk").alias("chunk"), (F.max("chunk") + 1).alias("to")).drop("island")
    wide = overlap
    while open_.limit(1).count():
        wide *= WIDEN
        seams = scratch.save(_widened(chunks, open_, path, long, wide, margin), "seams")
        found.append(seams.filter("n_tokens IS NOT NULL").select("key", "n_tokens"))
        open_ = seams.filter("n_tokens IS NULL").drop("n_tokens")
    parts = found[0]
    for f in found[1:]:
        parts = parts.unionByName(f)
    of_key = parts.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"))
    huge = chunks.filter("chunk = 0").select("doc_id", "n_bytes", "key").join(of_key, "key").select("doc_id", "n_bytes", "n_tokens")
    return whole.unionByName(huge)


def _widened(chunks: DataFrame, seams: DataFrame, path: str, long: int, wide: int, margin: int) -> DataFrame:
    """``key, chunk, to, n_tokens``: tokens from the beginning of ``chunk`` less those from that of ``to``, encoded with an
    overlap of ``wide`` characters, or null where that does not do.

    A seam gets the blocks that it spans and as many as the overlap reaches into, joined in its task: a part of one text.
    """
    own = seams.withColumn("need", F.explode(F.sequence(F.col("chunk"), F.col("to") + (-(-wide // long) - 1))))
    texts = chunks.select("key", F.col("chunk").alias("need"), "size", F.substring("piece", 1, long).alias("block"))
    blocks = F.array_sort(F.collect_list(F.struct("need", "block")))
    joined = own.join(texts, ["key", "need"]).groupBy("key", "chunk", "to").agg(F.max("size").alias("size"), F.array_join(F.transform(blocks, lambda x: x["block"]), "").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for b in batches:
            out = []
            for key, i, to, size, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                at = (to - i) * long
                text = text[: at + wide]
                ends = i * long + len(text) == size
                end, sure = (len(text), len(text)) if ends else (None, len(text) - margin)
                first = in_region(tool.words(text), at, sure, end)
                second = dict(zip(*in_region(tool.words(text[at:]), 0, sure - at, None if end is None else end - at), strict=True))
                out.append((key, i, to, next((n - second[p] for p, n in zip(*first, strict=True) if p in second), None)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["key", "chunk", "to", "n_tokens"])

    return joined.mapInArrow(run, "key long, chunk long, to long, n_tokens long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row."""
    return count_tokens(spark, docs, vocabulary()).withColumn("over_limit", F.col("n_tokens") > limit)
