"""Reader of the first, vector-only format: ``header.bin`` and ``vectors.bin``, little-endian float32 rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.errors import require

BATCH = 4096


@dataclass(frozen=True)
class Header:
    """``count`` vectors of ``dim`` elements; the file has room for ``capacity``, and what lies beyond is zeros."""

    version: int
    count: int
    dim: int
    capacity: int


def parse_header(raw: bytes, tag: bytes | None = None) -> Header:
    """A tag of four bytes, then version, count and dimension as unsigned 32-bit integers, and from version 2
    on the capacity. ``tag``: the tag that is asked for."""
    require(len(raw) >= 16 and tag in (None, raw[:4]), "not a header of the first format", "CORRUPT")
    version, count, dim = struct.unpack_from("<3I", raw, 4)
    require(version in (1, 2) and (version == 1 or len(raw) >= 20), f"header version {version}", "CORRUPT")
    capacity = struct.unpack_from("<I", raw, 16)[0] if version == 2 else count
    require(dim > 0 and capacity >= count, "header out of range", "CORRUPT")
    return Header(version, count, dim, capacity)


def read_folder(spark: SparkSession, folder: str, tag: bytes | None = None) -> tuple[Header, DataFrame]:
    """Header and vectors (id, embedding) of a folder of the first format."""
    raw = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/header.bin").select("content").first()
    require(raw is not None, f"no header in {folder}", "NOT_FOUND")
    header = parse_header(bytes(raw["content"]), tag)
    return header, read_vectors(spark, f"{folder.rstrip('/')}/vectors.bin", header.dim).filter(F.col("id") < header.count)


def read_vectors(spark: SparkSession, path: str, dim: int, header_bytes: int = 0) -> DataFrame:
    """(id, embedding) of a raw vector file: row i is vector i. A length that is no whole number of rows is refused."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                body = memoryview(raw)[header_bytes:]
                if len(body) % (4 * dim):
                    raise ValueError(f"{len(body)} bytes are no whole number of vectors of {dim}")
                m = np.frombuffer(body, "<f4").reshape(-1, dim)
                for at in range(0, len(m), BATCH):
                    part = m[at : at + BATCH]
                    yield pd.DataFrame({"id": np.arange(at, at + len(part)), "embedding": list(part)})

    return files.mapInPandas(run, "id long, embedding array<float>")
