"""Decoding and normalising text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ligatures and what stands for them; U+FFFE and U+FFFF stand for "fi" in texts of some converters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "￾": "fi", "￿": "fi"}
#: Characters that go: control characters but line feed and tab, soft hyphens and byte order marks.
DROPPED = [chr(c) for c in (*range(9), *range(11, 32), *range(127, 160), 0xAD, 0xFEFF) if c not in (12, 13)]
_table = str.maketrans(LIGATURES | dict.fromkeys(DROPPED, "") | {"\f": "\n\n"})


def decode(raw: bytes) -> str:
    """UTF-16 if a byte order mark says so, else UTF-8, else the whole file as Windows-1252 without its undefined bytes."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw[2 : len(raw) - len(raw) % 2].decode("utf-16-le" if raw[0] == 0xFF else "utf-16-be", "replace")
    body = raw.removeprefix(b"\xef\xbb\xbf")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "ignore")


def clean(text: str) -> str:
    """Line ends as line feeds, form feeds as blank lines, ligatures spelt out, control characters gone, NFC."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", text.translate(_table))


def normalize(raw: bytes) -> str:
    return clean(decode(raw))


#: Files that are Python strings at once in a task.
FILES = 256


@F.arrow_udf(StringType())
def normalize_text(content: pa.Array) -> pa.Array:
    """Column of file contents (binary) to normalised text; null stays null."""
    parts = [pa.array([None if b is None else normalize(b) for b in content.slice(at, FILES).to_pylist()], pa.string()) for at in range(0, len(content), FILES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def clean_native(text: Column) -> Column:
    """``clean`` without NFC as JVM expressions, for text that is known to be composed."""
    text = F.regexp_replace(text, "\r\n|\r", "\n")
    text = F.regexp_replace(text, "\f", "\n\n")
    for k, v in LIGATURES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return F.regexp_replace(text, "[\\u0000-\\u0008\\u000B\\u000E-\\u001F\\u007F-\\u009F\\u00AD\\uFEFF]", "")


def fold(text: str) -> str:
    """Lower case, and letters of Latin, Greek and Cyrillic without their diacritics."""
    out = []
    for c in unicodedata.normalize("NFD", text.lower()):
        if unicodedata.category(c) == "Mn" and out and out[-1] < "֐":
            continue
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def _folds() -> tuple[str, str]:
    """Precomposed letters and their base letters, from the decompositions."""
    src, dst = "", ""
    for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x500), *range(0x1E00, 0x2000))):
        f = fold(c)
        if f != c.lower() and len(f) == 1 and len(c.lower()) == 1:
            src, dst = src + c.lower(), dst + f
    return src, dst


def fold_native(text: Column) -> Column:
    """Lower case and base letters for precomposed characters, as one JVM expression."""
    src, dst = _folds()
    return F.translate(F.lower(text), src, dst)
