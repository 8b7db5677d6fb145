"""Known model files: matching by size and digest, names for collections, and fetching with a check.

A catalog is a table of known models, ``CATALOG``. Files are compared by size first, so that only those of a known size
are read; digests are taken in tasks, a block at a time.
"""

from __future__ import annotations

import hashlib
import os
import urllib.request
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.errors import EngineError, require

CATALOG = "profile string, file_name string, size long, sha256 string, embedding boolean, dim int, truncatable boolean, url string"
GENERIC = "generic"
BLOCK = 1 << 20


@contextmanager
def opened(path: str):
    """A file for reading; a path with a scheme is read from the store that it names."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at) as f:
            yield f
    else:
        with open(path, "rb") as f:
            yield f


def digest(path: str) -> str | None:
    """SHA-256 of a file, or None if it cannot be read."""
    h = hashlib.sha256()
    try:
        with opened(path) as f:
            while block := f.read(BLOCK):
                h.update(block)
    except OSError:
        return None
    return h.hexdigest()


def with_digests(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """``files`` (path, size) with ``sha256``: read are those whose size a known model has; null for others and unreadable ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:  # a row a file: reading one may take long
                yield pd.DataFrame({"path": [path], "sha256": [digest(path)]})

    read = files.select("path", "size").join(catalog.select("size").distinct(), "size", "left_semi").select("path").distinct()
    return files.join(read.repartition("path").mapInPandas(run, "path string, sha256 string"), "path", "left")


def match_known(files: DataFrame, catalog: DataFrame, by_name: bool = False) -> DataFrame:
    """``path, profile``: the known model that each file is, by size and ``sha256``, or ``by_name``, by size and base name (which
    reads no file); null for a file that is none, the least profile of several."""
    own = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    keys = ["size", "file_name"] if by_name else ["size", "sha256"]
    known = catalog.groupBy(*keys).agg(F.min("profile").alias("profile"))
    return own.join(known, keys, "left").select("path", "profile")


def model_id(profile: str | None, name: str) -> str:
    """How a collection names its model: the profile, or the model's own name if it has none of its own."""
    return profile if profile and profile != GENERIC else f"gguf:{name or 'unnamed'}"


def check_dim(dim: int, native: int, truncatable: bool, embedding: bool = True) -> int:
    """The dimension of a collection for a model, the model's own for 0; fewer only if its vectors can be cut."""
    require(embedding, "the model gives no vectors", "MODEL_MISMATCH")
    dim = dim or native
    require(1 <= dim <= native and (dim == native or truncatable), f"the model's vectors of {native} cannot have {dim} dimensions")
    return dim


def fetch(url: str, target: str, size: int, sha256: str) -> bool:
    """Get a file that is not there yet, beside its place and then moved; False if it was there. IO if what came is another
    file, which is not kept."""
    if os.path.exists(target) and os.path.getsize(target) == size and digest(target) == sha256:
        return False
    part, n, h = f"{target}.part", 0, hashlib.sha256()
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    try:
        with urllib.request.urlopen(url) as source, open(part, "wb") as out:  # noqa: S310
            while (block := source.read(BLOCK)) and n <= size:
                n += len(block)
                h.update(block)
                out.write(block)
        require((n, h.hexdigest()) == (size, sha256), f"{url} is not the file that is known", "IO")
        os.replace(part, target)
    except OSError as e:
        raise EngineError("IO", f"cannot fetch {url}: {e}") from e
    finally:
        if os.path.exists(part):
            os.remove(part)
    return True
