"""The engine's functions under names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docspark.functions.text import normalize_text
from docspark.operators.chunk import MOST, OVERLAP, TARGET, chunk_text

#: SQL functions, inlined by the optimizer.
NATIVE = {
    "l2_squared(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
    "dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "base_name(path STRING) RETURNS STRING": "element_at(split(path, '/'), -1)",
    "rrf_term(weight DOUBLE, rank INT) RETURNS DOUBLE": "coalesce(weight / (60 + rank), 0D)",
}


class ChunkText:
    def eval(self, text: str):
        if text:
            raw = text.encode()
            for i, (offset, length, page) in enumerate(chunk_text(text, (), TARGET, MOST, OVERLAP)):
                yield i, offset, length, page, raw[offset : offset + length].decode()


def register(spark: SparkSession) -> None:
    """normalize_text, chunk_text (a table function), l2_squared, dot_product, base_name, rrf_term."""
    for head, body in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("normalize_text", normalize_text)
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index: int, offset: long, length: long, page: long, text: string"))
