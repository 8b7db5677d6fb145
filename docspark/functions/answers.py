"""Functions on answers: citations, refusals, escaping, snippets and lenient fact matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sentence that stands for "no answer".
NOT_FOUND = "I could not find this in your documents."
MOST_IN_BRACKET = 16
_BRACKET = r"\[\s*[sS]?\s*\d+\s*(?:,\s*[sS]?\s*\d+\s*)*\]"


def cited(answer: str, count: int) -> list[int]:
    """Passage numbers 1..count that an answer cites, in the order of their first appearance."""
    out: list[int] = []
    for b in re.findall(_BRACKET, answer):
        for x in re.findall(r"\d+", b)[:MOST_IN_BRACKET]:
            n = int(x) if len(x) < 10 else 0
            if 1 <= n <= count and n not in out:
                out.append(n)
    return out


def cited_native(answer: Column, count: Column | int) -> Column:
    """``cited`` as a column of arrays, in the JVM."""
    count = F.lit(count) if isinstance(count, int) else count
    inside = F.regexp_extract_all(answer, F.lit(_BRACKET), F.lit(0))
    numbers = F.flatten(F.transform(inside, lambda b: F.slice(F.regexp_extract_all(b, F.lit(r"\d+"), F.lit(0)), 1, MOST_IN_BRACKET)))
    valid = F.filter(F.transform(numbers, lambda x: x.try_cast("int")), lambda n: n.between(1, count))
    return F.array_distinct(valid)


def is_not_found(answer: Column) -> Column:
    return answer.rlike(r"^[ \t\r\n]*I could not find this in your documents\.?[ \t\r\n]*$")


def escape_markup(text: Column) -> Column:
    """A space inside each "<|" and "|>", so that passages cannot carry chat markup."""
    return F.regexp_replace(text, r"(?<=<)(?=\|)|(?<=\|)(?=>)", " ")


def escape_markup_text(text: str) -> str:
    return text.replace("<|", "< |").replace("|>", "| >")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def snippet(text: Column, size: int = 200) -> Column:
    """The first ``size`` bytes on one line without a split character; "..." if there is more."""
    line = F.translate(F.substring(text, 1, size), "\r\n", "  ")  # as many characters as bytes: the rest of a text is not looked at

    def cut(line: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.length(line)), lambda n: F.octet_length(F.substring(line, F.lit(1), n)) <= size)
        return F.when(F.octet_length(line) <= size, line).otherwise(F.substring(line, F.lit(1), F.coalesce(F.array_max(ends), F.lit(0))))

    # as an array's element, so that the line is made once and not for each length that is tried
    head = F.get(F.transform(F.array(line), cut), F.lit(0))
    return F.when(F.octet_length(text) <= size, head).otherwise(F.concat(head, F.lit("...")))


def states_fact(answer: Column, fact: str) -> Column:
    """Whether an answer states a fact, but for case, commas and spaces; digits may not match inside a longer number."""
    strip = lambda s: re.sub(r"[, ]", "", s.lower())
    f = strip(fact)
    pattern = (r"(?<!\d)" if f[:1].isdigit() else "") + re.escape(f) + (r"(?!\d)" if f[-1:].isdigit() else "")
    return F.regexp_replace(F.lower(answer), "[, ]", "").rlike(pattern)


#: Questions that open by asking for files or documents, or what became of them.
_ABOUT = r"(?i)^\s*(what|which|how many|list|show)\b.*\b(documents?|files?|folders?)\b"


def is_collection_question(text: str) -> bool:
    """Whether a question is about the collection itself, which its documents cannot tell."""
    return re.search(_ABOUT, text) is not None


def about_collection(question: Column) -> Column:
    """``is_collection_question`` as a column."""
    return question.rlike(_ABOUT)
