"""Search terms: how texts are indexed and how query texts are read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import fold, fold_native

#: A token: letters, marks, digits and private-use characters. ``COMPAT`` leaves marks out, so that Indic vowel signs
#: split words, as the full-text engine of SQLite does.
TOKEN, COMPAT = r"[\p{L}\p{M}\p{N}\p{Co}]+", r"[\p{L}\p{N}\p{Co}]+"


def tokens(text: Column, compat: bool = False) -> Column:
    """The folded tokens of a text column, in order. Texts of ASCII alone need neither base letters nor classes of Unicode."""
    of = lambda folded, token: F.regexp_extract_all(folded, F.lit(token), F.lit(0))
    return F.when(F.octet_length(text) == F.length(text), of(F.lower(text), "[0-9a-z]+")).otherwise(of(fold_native(text), COMPAT if compat else TOKEN))


def count_tokens(text: Column, compat: bool = False) -> Column:
    """How many tokens a text has. Folding neither joins nor splits tokens that keep their marks."""
    return F.regexp_count(fold_native(text), F.lit(COMPAT)) if compat else F.regexp_count(text, F.lit(TOKEN))


def query_phrases(text: str, compat: bool = False) -> list[list[str]]:
    """A query's words, each a phrase of one token or more. A word that is repeated is repeated here.

    Words are what white space separates; those without a letter, digit or character beyond ASCII are left out.
    """
    import regex

    out = []
    for w in re.split(r"[ \t\r\n]+", text):
        if not any(c.isascii() and c.isalnum() or ord(c) > 127 for c in w):
            continue
        found = regex.findall(COMPAT if compat else TOKEN, fold(w))
        if found:
            out.append(found)
    return out
