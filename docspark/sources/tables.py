"""Delimited text as labelled lines, and the labelling that spreadsheets share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from docspark.functions.text import normalize
from docspark.sources.extracted import Extracted

#: The most rows and columns that are read.
MOST_ROWS, MOST_COLUMNS = 200_000, 512
#: Rows after which a blank line ends a paragraph.
GROUP = 10
_NUMBER = re.compile(r"\s*[+-]?(?:inf(?:inity)?|nan(?:\([\w]*\))?|0x[0-9a-f]*\.?[0-9a-f]+(?:p[+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*", re.I)


def is_number(cell: str) -> bool:
    return bool(_NUMBER.fullmatch(cell))


class Labeller:
    """Turns rows into lines: a header is given once, later rows as "Header: value", without empty cells."""

    def __init__(self):
        self.header: list[str] | None = None
        self.begun, self.rows, self.lines = False, 0, []

    def add(self, cells: list[str]) -> None:
        self.rows += 1
        filled = [c for c in cells if c]
        if filled:
            if not self.begun:
                self.begun = True
                if len(filled) > 1 and not any(map(is_number, filled)):
                    self.header = cells
                    self.lines.append(" | ".join(filled))
                    self._gap()
                    return
            names = self.header or []
            label = lambda i: names[i] + ": " if i < len(names) and names[i] else ""
            self.lines.append(" | ".join(label(i) + c for i, c in enumerate(cells) if c))
            self._gap()

    def _gap(self) -> None:
        if self.rows % GROUP == 0:
            self.lines.append("")

    def text(self) -> str:
        return "\n".join(self.lines).strip("\n")


def delimiter(text: str, extension: str) -> str:
    """Tab by extension; else by counts on the first line outside quotes, comma unless another is strictly ahead."""
    if extension.lower().startswith("t"):
        return "\t"
    line = re.sub(r'"[^"\n]*"?', "", text).partition("\n")[0]
    tabs, semis, commas = line.count("\t"), line.count(";"), line.count(",")
    if tabs > max(semis, commas):
        return "\t"
    return ";" if semis > commas else ","


def records(text: str, sep: str) -> Iterator[list[str]]:
    """A quote opens at the start of a field only; what follows a closing quote is kept up to the separator."""
    at, n = 0, len(text)
    stop = re.compile(f"[{re.escape(sep)}\n]")
    while at < n:
        row: list[str] = []
        while True:
            cell = ""
            if text[at : at + 1] == '"':
                at += 1
                while True:
                    end = text.find('"', at)
                    end = n if end < 0 else end
                    cell += text[at:end]
                    at = end + 1
                    if text[at : at + 1] != '"':
                        break
                    cell += '"'
                    at += 1
            m = stop.search(text, at)
            end = m.start() if m else n
            cell += text[at:end]
            row.append(re.sub(r"[\n\t]", " ", cell).strip(" "))
            at = end + 1
            if not m or m[0] == "\n":
                break
        yield row[:MOST_COLUMNS]


def extract_csv(raw: bytes, extension: str = "csv") -> Extracted:
    text, out = normalize(raw), Labeller()
    for row in records(text, delimiter(text, extension)):
        out.add(row)
        if out.rows >= MOST_ROWS:
            break
    return Extracted(out.text())
