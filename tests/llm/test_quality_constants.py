"""The classifier's constants stand up among those that could have been chosen, on training rows alone."""

import os
import zlib

import pytest

from docspark.llm import quality, quality_constants

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the labelled tables")
def test_constants_are_on_the_plateau(spark):
    rows = quality_constants.judged(spark, DATA)
    loss, errors, _, _ = rows[0]
    own = next(r for r in rows if r[2:] == (quality.SHRINK, quality.RIDGE))
    assert own[0] < 1.05 * loss and own[1] <= errors + 1 and rows.index(own) < 12


def test_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    x, y, _ = quality_constants.training_rows(docs, labels)
    want = [i % 3 for i in range(60) if i % 3 < 2 and zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(y.tolist()) == sorted(want) and len(x) == len(want)
