"""Embedders: functions from texts to unit vectors, run in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np

#: Texts in a call, and seconds before the second and third try.
BATCH, WAITS = 16, (0.4, 0.8)


class Embedder(Protocol):
    """``id`` and ``dim`` are kept with a collection; texts of queries and documents may get different prefixes."""

    id: str
    dim: int

    def embed(self, texts: Sequence[str], query: bool = False) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEmbedder:
    """A deterministic stand-in for a model, without meaning: equal texts have equal vectors, others are far apart."""

    dim: int = 64
    id: str = "hash"

    def embed(self, texts: Sequence[str], query: bool = False) -> np.ndarray:
        out = np.empty((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            seed = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=16).digest(), "big")
            out[i] = unit(np.random.Generator(np.random.PCG64(seed)).standard_normal(self.dim))
        return out


@dataclass(frozen=True)
class WordEmbedder:
    """Hashed bags of words with signs: texts that share words are near each other."""

    dim: int = 256
    id: str = "words"

    def embed(self, texts: Sequence[str], query: bool = False) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        return np.array([unit(v) for v in out], dtype=np.float32)


@dataclass(frozen=True)
class Prefixed:
    """An embedder whose queries and documents get different prefixes, and whose vectors may be cut to fewer dimensions.
    Texts longer than ``most_chars`` characters with their prefix are cut there (0: never)."""

    base: Embedder
    query_prefix: str = ""
    document_prefix: str = ""
    dim: int = 0
    most_chars: int = 0

    def __post_init__(self):
        if not self.dim:
            object.__setattr__(self, "dim", self.base.dim)
        if self.dim > self.base.dim:
            raise ValueError(f"{self.base.id} has {self.base.dim} dimensions, not {self.dim}")

    @property
    def id(self) -> str:
        return self.base.id

    def embed(self, texts: Sequence[str], query: bool = False) -> np.ndarray:
        prefix = self.query_prefix if query else self.document_prefix
        out = self.base.embed([(prefix + t)[: self.most_chars or None] for t in texts], query)
        return np.array([unit(v, self.dim) for v in out], dtype=np.float32)


def unit(v: np.ndarray, dim: int | None = None) -> np.ndarray:
    """To unit length after cutting to the leading ``dim`` elements; a zero vector stays zero."""
    v = np.asarray(v, dtype=np.float64)[:dim]
    n = np.linalg.norm(v)
    return v / n if n else v


def embed_all(embedder: Embedder, texts: Sequence[str], waits: Sequence[float] = WAITS) -> np.ndarray:
    """In batches, each tried again after a failure; the last failure is raised."""
    parts = []
    for at in range(0, len(texts), BATCH):
        for n in range(len(waits) + 1):
            try:
                parts.append(np.asarray(embedder.embed(texts[at : at + BATCH]), dtype=np.float32))
                break
            except Exception:
                if n == len(waits):
                    raise
                time.sleep(waits[n])
    return np.concatenate(parts) if parts else np.zeros((0, embedder.dim), dtype=np.float32)
