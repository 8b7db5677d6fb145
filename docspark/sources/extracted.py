"""What extractors give, and how pages are put together."""

from __future__ import annotations

from dataclasses import dataclass, field

from docspark.functions.text import clean


class ExtractError(Exception):
    """A file that cannot be read as what its name says. ``status``: UNSUPPORTED, CORRUPT, ENCRYPTED or TOO_LARGE."""

    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status = status


@dataclass
class Extracted:
    """Normalised text, the byte offset at which each page starts (none: no pages), and a title or ""."""

    text: str
    pages: list[int] = field(default_factory=list)
    title: str = ""


def from_pages(pages: list[str], title: str = "") -> Extracted:
    """Pages normalised and joined by a blank line; an empty page keeps its number."""
    parts, offsets, at = [], [], 0
    for p in pages:
        p = clean(p).strip("\n ")
        if parts and p:
            parts.append("\n\n")
            at += 2
        offsets.append(at)
        if p:
            parts.append(p)
            at += len(p.encode())
    return Extracted("".join(parts), offsets, clean(title).strip())
