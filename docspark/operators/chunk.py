"""Splitting normalised text into overlapping passages.

Offsets and lengths are in bytes of UTF-8, limits in characters. Properties: passages are in order and within the text,
each is at most ``most`` characters, none begins or ends in white space, and together they cover every character that is
not white space.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, MOST, OVERLAP = 1000, 1500, 150
SENTENCE_ENDS = ".!?।॥。"
#: White space between words: space, tab, line feed and the Unicode separators.
_SEPARATORS = "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xA0)))
SPACES = frozenset(" \t\n" + _SEPARATORS)
SCHEMA = "array<struct<chunk_index:long,offset:long,length:long,page:long>>"
#: Texts that are Python strings at once in a task.
TEXTS = 256

Span = tuple[int, int]


def check_limits(target: int, most: int, overlap: int) -> None:
    if not (target >= 1 and most >= target and 0 <= overlap < target):
        raise ValueError(f"passage limits out of range: target {target}, most {most}, overlap {overlap}")


def _trim(text: str, span: Span) -> Span:
    a, b = span
    while a < b and text[a] in SPACES:
        a += 1
    while b > a and text[b - 1] in SPACES:
        b -= 1
    return a, b


def _paragraphs(text: str) -> Iterator[Span]:
    """Maximal runs of lines that are not blank."""
    begin, at = None, 0
    for line in text.split("\n"):
        blank = all(c in SPACES for c in line)
        if blank and begin is not None:
            yield _trim(text, (begin, at))
            begin = None
        elif not blank and begin is None:
            begin = at
        at += len(line) + 1
    if begin is not None:
        yield _trim(text, (begin, len(text)))


def _sentences(text: str, span: Span) -> Iterator[Span]:
    begin, end = span
    for i in range(*span):
        last = i + 1 >= end
        if text[i] == "\n" or (text[i] in SENTENCE_ENDS and (last or text[i + 1] in SPACES)):
            s = _trim(text, (begin, i + 1))
            if s[0] < s[1]:
                yield s
            begin = i + 1
    s = _trim(text, (begin, end))
    if s[0] < s[1]:
        yield s


def _cuts(text: str, span: Span, most: int) -> Iterator[Span]:
    """Pieces of a sentence that is too long, cut at the last white space within the limit if there is one."""
    begin, end = span
    while end - begin > most:
        at = next((i for i in range(begin + most, begin, -1) if text[i] in SPACES), begin + most)
        yield _trim(text, (begin, at))
        begin = _trim(text, (at, end))[0]
    if begin < end:
        yield begin, end


def _units(text: str, most: int) -> Iterator[Span]:
    for p in _paragraphs(text):
        if p[1] - p[0] <= most:
            yield p
            continue
        for s in _sentences(text, p):
            yield from [s] if s[1] - s[0] <= most else _cuts(text, s, most)


def _shared_start(text: str, previous: Span, overlap: int) -> int:
    """Where the next passage may begin inside the one before: at the first word start in its last characters."""
    at = max(previous[0], previous[1] - overlap)
    while at < previous[1] and text[at] not in SPACES:
        at += 1
    while at < previous[1] and text[at] in SPACES:
        at += 1
    return at


def page_of(offset: int, pages: Sequence[int]) -> int:
    """The page, from 1, on which a byte lies; 0 for text without pages."""
    return max(1, bisect_right(pages, offset)) if pages else 0


class _Bytes:
    """Byte offsets of ascending or nearby character positions."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()
        self.marks = [0]
        if not self.plain:
            for i in range(0, len(text), 256):
                self.marks.append(self.marks[-1] + len(text[i : i + 256].encode()))

    def __call__(self, at: int) -> int:
        return at if self.plain else self.marks[at // 256] + len(self.text[at - at % 256 : at].encode())


def chunk_text(text: str, pages: Sequence[int] = (), target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(offset, length, page) of each passage. ``pages``: byte offsets at which pages start."""
    check_limits(target, most, overlap)
    to_bytes = _Bytes(text)
    spans: list[Span] = []
    current: Span | None = None
    page = 0
    for unit in _units(text, most):
        unit_page = page_of(to_bytes(unit[0]), pages) if len(pages) > 1 else 0
        if current is not None:
            turned = unit_page != page and current[1] - current[0] >= target // 3
            if unit[1] - current[0] > target or turned:
                spans.append(current)
                current = None
        current = unit if current is None else (current[0], unit[1])
        page = unit_page
    if current is not None:
        spans.append(current)
    out = []
    for i, (begin, end) in enumerate(spans):
        if i and overlap:
            shared = _shared_start(text, spans[i - 1], overlap)
            if shared < spans[i - 1][1] and end - shared <= most:
                begin = shared
        a = to_bytes(begin)
        out.append((a, to_bytes(end) - a, page_of(a, pages)))
    return out


def chunker(target: int = TARGET, most: int = MOST, overlap: int = OVERLAP):
    """A column function (text, page offsets) to an array of passages; null text gives an empty array."""
    check_limits(target, most, overlap)

    @F.arrow_udf(SCHEMA)
    def chunk(text: pa.Array, pages: pa.Array) -> pa.Array:
        sizes, columns = [0], [[] for _ in range(4)]
        for at in range(0, len(text), TEXTS):
            rows: list[tuple[int, int, int, int]] = []
            for t, p in zip(text.slice(at, TEXTS).to_pylist(), pages.slice(at, TEXTS).to_pylist(), strict=True):
                found = chunk_text(t or "", p or [], target, most, overlap)
                rows += [(i, *x) for i, x in enumerate(found)]
                sizes.append(len(found))
            for c, own in zip(columns, np.array(rows, dtype=np.int64).reshape(-1, 4).T, strict=True):
                c.append(own.copy())
        values = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns], ["chunk_index", "offset", "length", "page"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values)

    return chunk


def chunk_documents(docs: DataFrame, text_col: str = "text", pages_col: str | None = None, **limits) -> DataFrame:
    """The passages of each document: its columns but the text, chunk_index, offset, length, page and the passage's text."""
    pages = F.col(pages_col) if pages_col else F.array().cast("array<long>")
    rows = docs.withColumn("__chunk", F.explode(chunker(**limits)(F.col(text_col), pages)))
    piece = F.substring(F.col(text_col).cast("binary"), (F.col("__chunk.offset") + 1).cast("int"), F.col("__chunk.length").cast("int")).cast("string")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, pages_col)]
    return rows.select(*rest, "__chunk.chunk_index", "__chunk.offset", "__chunk.length", "__chunk.page", piece.alias("text"))
