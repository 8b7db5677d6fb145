"""Token ids as binary shards with keyed access through a minimal perfect hash.

Documents are range-partitioned by id and sorted; each task encodes its documents and writes shards of bounded size.
A shard is one file, little-endian throughout:

    magic "DSTK", version, bytes per id, documents, ids, distinct keys, hash words, hash levels     8 unsigned 64-bit
    keys                 int64[documents]     in ascending order, rows without a key first
    ends                 uint64[documents]    ids up to the end of each document
    hash level sizes     uint64[levels]       in 64-bit words
    hash bits            uint64[words]
    hash ranks           uint64[words]        set bits before each word
    fingerprints         uint32[distinct keys]    by hash slot
    first documents      uint32[distinct keys]    by hash slot: the key's first row in the shard
    payload              ids

The hash is a cascade of bit arrays: a key's slot is the rank of its bit on the first level where it met no other key.
Fingerprints reject keys that are not in the shard (but for 2**-32 of them, for which the key column is compared). A
key is found with a fixed number of short reads: its bit and rank on a level, fingerprint, row, key and ends.
Files are written under another name and then moved; the manifest, which the writing job returns, names the files that
count, so that a task that runs twice leaves no trace in the result. It also has each shard's least and greatest key.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import Scratch
from docspark.llm.tokens import encoder

#: Bytes of ids after which a shard is closed.
SHARD_BYTES = 64 << 20
NO_KEY = np.iinfo(np.int64).min
MAGIC, VERSION, GAMMA, LEVELS = int.from_bytes(b"DSTK", "little"), 1, 2.0, 64
MANIFEST = "part long, seq long, path string, documents long, ids long, lo long, hi long"
#: Characters of a text by which rows of one id are dealt to tasks.
PREFIX = 32
#: Shards whose key ranges are sent to all tasks (16 bytes each); the ranges of more are joined.
MOST_RANGES = 1_000_000
#: Keys asked of a shard from which its index is read whole.
MANY_KEYS = 256


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over key and seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct integer keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys, [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            words = int(len(left) * GAMMA) // 64 + 1
            at = mixed(left, len(sizes) + 1) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(words)
            left = left[~alone[at.astype(np.int64)]]
        bits = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        counts = np.bitwise_count(bits).astype(np.uint64)
        return cls(np.array(sizes, "<u8"), bits, (np.cumsum(counts) - counts).astype("<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1 for some of the keys that were never put in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, words in enumerate(self.sizes.tolist()):
            at = mixed(keys[todo], level + 1) % np.uint64(words * 64)
            word = self.bases[level] + (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot = self.ranks[word].astype(np.int64) + np.bitwise_count(below)
            out[todo[hit]] = slot[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 0) >> np.uint64(32)).astype("<u4")


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shard(path: str, keys: np.ndarray, counts: np.ndarray, payload: bytes, width: int) -> None:
    """``keys`` ascending, NO_KEY for rows without one; ``counts`` ids per row; ``payload`` their ids."""
    distinct, first = np.unique(keys[keys != NO_KEY], return_index=True)
    first = first + int((keys == NO_KEY).sum())
    index = PerfectHash.build(distinct)
    prints, places = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    slot = index.slots(distinct)
    prints[slot], places[slot] = fingerprints(distinct), first
    head = np.array([MAGIC, VERSION, width, len(keys), counts.sum(), len(distinct), len(index.bits), len(index.sizes)], "<u8")
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at + ".tmp") as out:
        for part in (head, keys.astype("<i8"), np.cumsum(counts).astype("<u8"), index.sizes, index.bits, index.ranks, prints, places):
            out.write(part.tobytes())
        out.write(payload)
    fs.move(at + ".tmp", at)


class Shard:
    """A shard file open for keyed access. ``whole``: read at once, else by ranges as they are needed."""

    def __init__(self, path: str, whole: bool = True):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        self.raw = self.file.read_buffer() if whole else None
        head = np.frombuffer(self._bytes(0, 64), "<u8").tolist()
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError(f"not a shard of version {VERSION}: {path}")
        _, _, self.width, self.rows, self.ids_total, self.distinct, words, levels = head
        at, self.places = 64, {}
        for name, kind, count in (
            ("keys", "<i8", self.rows), ("ends", "<u8", self.rows), ("sizes", "<u8", levels), ("bits", "<u8", words), ("ranks", "<u8", words),
            ("prints", "<u4", self.distinct), ("firsts", "<u4", self.distinct), ("ids", f"<u{self.width}", self.ids_total),
        ):
            self.places[name] = (at, np.dtype(kind), count)
            at += count * np.dtype(kind).itemsize
        sizes = self.part("sizes")
        self.index = PerfectHash(sizes, self.part("bits"), self.part("ranks")) if whole else None
        self.levels = list(zip(sizes.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True))

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _bytes(self, at: int, n: int):
        if self.raw is not None:
            return self.raw[at : at + n]
        self.file.seek(at)
        return self.file.read(n)

    def part(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        """Entries of one of the file's arrays."""
        at, kind, total = self.places[name]
        count = total - first if count is None else min(count, total - first)
        return np.frombuffer(self._bytes(at + first * kind.itemsize, count * kind.itemsize), kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, or -1; for a shard that was read whole."""
        keys = np.asarray(keys, dtype=np.int64)
        if not self.distinct:
            return np.full(len(keys), -1, dtype=np.int64)
        slot = self.index.slots(keys)
        row = self.part("firsts")[np.maximum(slot, 0)].astype(np.int64)
        good = (slot >= 0) & (self.part("prints")[np.maximum(slot, 0)] == fingerprints(keys)) & (self.part("keys")[row] == keys)
        return np.where(good, row, -1)

    def find_one(self, key: int) -> int:
        """The first row of a key, or -1, by short reads."""
        own = np.array([key], dtype=np.int64)
        for level, (words, base) in enumerate(self.levels):
            bit = int(mixed(own, level + 1)[0] % np.uint64(words * 64))
            word = int(self.part("bits", base + bit // 64, 1)[0])
            if word >> (bit % 64) & 1:
                slot = int(self.part("ranks", base + bit // 64, 1)[0]) + (word & ((1 << bit % 64) - 1)).bit_count()
                if self.part("prints", slot, 1)[0] != fingerprints(own)[0]:
                    return -1
                row = int(self.part("firsts", slot, 1)[0])
                return row if self.part("keys", row, 1)[0] == key else -1
        return -1

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every row with this key (one, unless a key repeats)."""
        at = int(self.find(np.array([key]))[0]) if self.raw is not None else self.find_one(key)
        out = []
        while 0 <= at < self.rows and self.part("keys", at, 1)[0] == key:
            begin = int(self.part("ends", at - 1, 1)[0]) if at else 0
            out.append(self.part("ids", begin, int(self.part("ends", at, 1)[0]) - begin))
            at += 1
        return out


def write_store(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode, append ``end_id`` to each document, write shards under ``path``; the manifest, a row a shard, with
    ``base``: the ids of all shards before it.

    Every row is written, in ascending (id, text) order with rows without an id first. A null or empty text is its end
    id alone. Rows that repeat an id follow one another and are found together, even where they are dealt to several
    tasks. An empty table gives no shards. Further columns are ignored.
    """
    path = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq, end = encoder(vocabulary), TaskContext.get().partitionId(), 0, None
        end = np.array([end_id], enc.dtype).tobytes()
        keys: list[int] = []
        counts: list[int] = []
        chunks: list[bytes] = []
        size, names = 0, [c.split()[0] for c in MANIFEST.split(", ")]

        def close() -> pa.RecordBatch:
            nonlocal seq, size
            to = f"{path}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.bin"
            n = np.array(counts, dtype=np.int64)
            write_shard(to, np.array(keys, dtype=np.int64), n, b"".join(chunks), enc.dtype.itemsize)
            lo = next((k for k in keys if k != NO_KEY), None)  # ascending, those without a key first
            values = (part, seq, to, len(n), int(n.sum()), lo, None if lo is None else keys[-1])
            row = pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in values], names)
            seq, size = seq + 1, 0
            keys.clear(), counts.clear(), chunks.clear()
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                payloads = [p + end for p in enc.encode(b.column(1).to_pylist())]
                for key, p in zip(b.column(0).fill_null(int(NO_KEY)).to_pylist(), payloads, strict=True):
                    keys.append(key), counts.append(len(p) // enc.dtype.itemsize), chunks.append(p)
                    size += len(p)
                    if size >= shard_bytes:
                        yield close()
        if counts:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # dealt by the beginnings of texts too: an id or the lack of one that very many rows share is not one task's
    dealt = rows.repartitionByRange("id", F.substring("text", 1, PREFIX))
    manifest = dealt.sortWithinPartitions("id", "text").mapInArrow(write, MANIFEST)
    manifest = Scratch(spark, "token-manifest").save(manifest, "manifest")
    # one row a shard
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_store(manifest: DataFrame) -> DataFrame:
    """Per row of a store: doc_id, start, n_tokens, ids_crc32, each found through its shard's index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Shard(path) as shard:
                    keys, ends, ids = shard.part("keys"), shard.part("ends").astype(np.int64), shard.part("ids")
                    keyed = keys != NO_KEY
                    row = np.arange(len(keys))
                    again = np.concatenate([[False], keys[1:] == keys[:-1]])
                    found = np.where(keyed, shard.find(keys), row)
                    if (found < 0).any() or (found[~again] != row[~again]).any():
                        raise ValueError(f"the index of {path} does not lead to its documents")
                    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(begin.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=~keyed), pa.array(begin + base), pa.array(ends - begin), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # a shard a task, by number: what a manifest row weighs says nothing of its shard
    line = manifest.select("path", "base", (F.row_number().over(Window.orderBy("part", "seq")) - 1).alias("n"))
    shards = line.repartitionById(max(1, manifest.count()), F.col("n")).select("path", "base")
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, ids) of the wanted keys: each shard is asked for the keys of its range only, by short reads.

    Keys that are not in the store give no row; a null key gives none; a key that repeats in ``keys`` is looked up once.
    """
    ranges = manifest.filter("lo IS NOT NULL").select("path", "lo", "hi")
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).filter("key IS NOT NULL").distinct()
    shards = ranges.count()
    if shards <= MOST_RANGES:
        table = ranges.orderBy("lo", "hi").toArrow()
        paths, lo, hi = table.column("path").to_pylist(), table.column("lo").to_numpy(), table.column("hi").to_numpy()
        sent = manifest.sparkSession.sparkContext.broadcast((paths, lo, hi))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            paths, lo, hi = sent.value
            for b in batches:
                k = b.column(0).to_numpy()
                # shards are ranges in order, which share at most the keys at their ends
                first, last = np.searchsorted(hi, k, "left"), np.searchsorted(lo, k, "right")
                n = np.maximum(last - first, 0)
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in at.tolist()], pa.string()), pa.array(np.repeat(k, n))], ["path", "key"])

        pairs = wanted.mapInArrow(place, "path string, key long")
    else:
        pairs = wanted.join(ranges, F.col("key").between(F.col("lo"), F.col("hi"))).select("path", "key")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked: dict[str, list[int]] = {}
            for path, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                asked.setdefault(path, []).append(key)
            for path, own in asked.items():
                with Shard(path, whole=len(own) >= MANY_KEYS) as shard:
                    for key in own:
                        for ids in shard.get(key):
                            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return pairs.repartition(min(10_000, max(1, shards)), "path").sortWithinPartitions("path", "key").mapInArrow(get, "doc_id long, ids array<long>")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    store = Scratch(spark, "token-store")
    return read_store(write_store(spark, docs, store.path("shards"), public_tokenizers.path("byte_bpe_50k.json")))
