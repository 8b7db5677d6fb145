"""How the quality classifier's constants were judged: log loss and errors by cross-validation, on rows that are not held out.

    python -m docspark.llm.quality_constants /root/testdata/sf0.1

prints a line for each pair of SHRINK and RIDGE, the least loss first. Held-out rows are never read.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import quality
from docspark.llm.common import read

SHRINKS, RIDGES, FOLDS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.4), (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2), 5


def training_rows(docs: DataFrame, labels: DataFrame, most: int = quality.MOST_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels and folds of the labelled rows that are not held out, ``most`` of them."""
    y = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~quality.held_out()).select("doc_id", "quality")
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches):
        for b in batches:
            b["x"] = list(quality.vectors(b["text"].tolist()))
            yield b[["doc_id", "quality", "x"]]

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, x array<double>"
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").mapInPandas(run, kind).orderBy("doc_id", "x").collect()
    fold = [zlib.crc32(f"fold {r['doc_id']}".encode()) % FOLDS for r in rows]
    return np.array([r["x"] for r in rows]).reshape(-1, len(quality.FEATURES)), np.array([r["quality"] for r in rows]), np.array(fold)


def judged(spark: SparkSession, sf_dir: str) -> list[tuple[float, int, float, float]]:
    """Mean log loss, errors, SHRINK and RIDGE, the least loss first."""
    x, y, fold = training_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return sorted((*quality.cross_validate(x, y, fold, s, r), s, r) for s in SHRINKS for r in RIDGES)


if __name__ == "__main__":
    for loss, errors, s, r in judged(SparkSession.builder.getOrCreate(), sys.argv[1]):
        print(f"shrink {s} ridge {r}: log loss {loss:.5f}, errors {errors}")
