"""Markdown as the words a reader sees: a line scanner for blocks, then one pass over inline marks."""

from __future__ import annotations

import html
import re

from docspark.functions.text import normalize
from docspark.sources.extracted import Extracted

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)(.*?)(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"\s*(?:[-+*]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?")
_RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_TABLE_RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r" {0,3}<(?:/?[a-zA-Z][\w-]*[\s/>]|!--|\?|![A-Z]|/?[a-zA-Z][\w-]*$)")
_REFERENCE = re.compile(r" {0,3}\[[^\]]+\]:\s*\S+.*$")


def inline(text: str) -> str:
    """Visible words: code spans keep their text, links and images their label, tags and emphasis go, entities are decoded."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue100{len(kept) - 1}\ue101"

    text = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(m[2].strip() or m[2]), text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    text = re.sub(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w.-]+)>", lambda m: keep(m[1].removeprefix("mailto:")), text)
    text = re.sub(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", "", text)
    for _ in range(4):  # images in links
        new = re.sub(r"!?\[((?:[^\[\]])*)\]\((?:<[^>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)", r"\1", text)
        new = re.sub(r"!?\[([^\[\]]+)\]\[[^\[\]]*\]", r"\1", new)
        if new == text:
            break
        text = new
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", text)
    for mark in ("___", "__", "_"):
        text = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", text)
    text = html.unescape(text)
    return re.sub("\ue100(\\d+)\ue101", lambda m: kept[int(m[1])], text)


def _cells(line: str) -> list[str]:
    return [inline(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def render(source: str) -> tuple[str, str]:
    """(text, title): blocks separated by blank lines; the title is the first heading of level one."""
    blocks: list[str] = []
    title, paragraph, tight = "", [], False
    lines = source.split("\n")

    def close() -> None:
        nonlocal paragraph, tight
        if paragraph:
            joined = ""
            for p in paragraph:
                hard = p.endswith("  ") or p.endswith("\\")
                joined += p.strip().removesuffix("\\") + ("\n" if hard else " ")
            text = inline(joined.strip())
            if text:
                if tight and blocks:
                    blocks[-1] += "\n" + text
                else:
                    blocks.append(text)
            paragraph, tight = [], False

    at, in_list = 0, False
    while at < len(lines):
        line = re.sub(r"^(?: {0,3}> ?)+", "", lines[at])
        fence = _FENCE.match(line)
        if fence:
            close()
            body, at = [], at + 1
            while at < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[at]):
                body.append(lines[at])
                at += 1
            if any(body):
                blocks.append("\n".join(body).strip("\n"))
            at, in_list = at + 1, False
            continue
        if not line.strip():
            close()
        elif m := _ATX.match(line):
            close()
            text, in_list = inline(m[2].strip()), False
            if len(m[1]) == 1 and not title:
                title = text
            if text:
                blocks.append(text)
        elif paragraph and not in_list and re.match(r" {0,3}(=+|-+)\s*$", line):
            level, text = line.strip()[0], inline(" ".join(p.strip() for p in paragraph))
            paragraph = []
            if level == "=" and not title:
                title = text
            blocks.append(text)
        elif _RULE.match(line):
            close()
        elif "|" in line and at + 1 < len(lines) and _TABLE_RULE.match(lines[at + 1]) and "-" in lines[at + 1] and not paragraph:
            rows = [" | ".join(_cells(line))]
            at += 2
            while at < len(lines) and lines[at].strip() and "|" in lines[at]:
                rows.append(" | ".join(_cells(lines[at])))
                at += 1
            blocks.append("\n".join(rows))
            in_list = False
            continue
        elif not paragraph and _HTML.match(line):
            while at < len(lines) and lines[at].strip():  # a block of raw HTML, to the next blank line
                at += 1
            continue
        elif not paragraph and _REFERENCE.match(line):
            pass
        elif m := _ITEM.match(line):
            close()
            paragraph, tight, in_list = ["- " + line[m.end() :]], in_list and at > 0 and bool(lines[at - 1].strip()), True
        elif not paragraph and not in_list and line.startswith(("    ", "\t")):
            body = []
            while at < len(lines) and (lines[at].startswith(("    ", "\t")) or not lines[at].strip()):
                body.append(lines[at].removeprefix("\t").removeprefix("    "))
                at += 1
            blocks.append("\n".join(body).strip("\n"))
            continue
        else:
            if not paragraph and not line.startswith(" "):
                in_list = False
            paragraph.append(line)
        at += 1
    close()
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for b in blocks if b.strip())), title


def extract_markdown(raw: bytes) -> Extracted:
    text, title = render(normalize(raw))
    return Extracted(text, title=title)
