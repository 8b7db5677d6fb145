"""Word, PowerPoint and Excel files: zip archives of XML, read with a lenient scan for the tags that carry text."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

from docspark.functions.text import clean
from docspark.sources.extracted import Extracted, ExtractError, from_pages
from docspark.sources.tables import Labeller

#: The most bytes of a part, slides, sheets, rows, columns and shared strings.
MOST_PART, MOST_SLIDES, MOST_SHEETS, MOST_ROWS, MOST_COLUMNS, MOST_STRINGS = 256 << 20, 2000, 256, 100_000, 512, 2_000_000
_ENTITY = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_TAG = re.compile(r"<(/?)([\w.:-]+)([^<>]*?)(/?)>")


def unescape(text: str) -> str:
    """Named and numeric entities; an ampersand without a semicolon nearby stays, an unknown name goes."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name.startswith("#"):
            try:
                return chr(int(name[2:], 16) if name[1:2] in "xX" else int(name[1:]))
            except ValueError:
                return ""
        return _ENTITY.get(name, "")

    return re.sub(r"&([^;&<>\s]{1,11});", one, text)


def attribute(attrs: str, name: str) -> str:
    m = re.search(rf"""(?<![\w:.-]){re.escape(name)}\s*=\s*("[^"]*"|'[^']*')""", attrs)
    return unescape(m[1][1:-1]) if m else ""


class Package:
    def __init__(self, raw: bytes):
        if raw[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ExtractError("ENCRYPTED", "the file is encrypted or in an old format")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile:
            raise ExtractError("CORRUPT", "not an Office file") from None

    def part(self, name: str, needed: bool = False) -> str:
        try:
            if self.zip.getinfo(name).file_size > MOST_PART:
                raise ExtractError("TOO_LARGE", f"{name} is too large")
            return self.zip.read(name).decode("utf-8", "replace")
        except (KeyError, zipfile.BadZipFile, RuntimeError, OSError):
            if needed:
                raise ExtractError("CORRUPT", f"{name} is missing or broken") from None
            return ""

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (type, target), targets relative to the part resolved."""
        folder, base = posixpath.split(part)
        out = {}
        for m in re.finditer(r"<(?:\w+:)?Relationship\b([^<>]*)>", self.part(f"{folder}/_rels/{base}.rels")):
            to = attribute(m[1], "Target")
            to = to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to))
            out[attribute(m[1], "Id")] = (attribute(m[1], "Type").rpartition("/")[2], to)
        return out

    def title(self) -> str:
        m = re.search(r"<dc:title[^<>]*>([^<]*)</dc:title>", self.part("docProps/core.xml"))
        return clean(unescape(m[1])).strip() if m else ""


def events(xml: str) -> Iterator[tuple[str, str, str]]:
    """(kind, local name or text, attributes) with kinds open, close, empty and text."""
    at = 0
    for m in _TAG.finditer(xml):
        if m.start() > at:
            yield "text", xml[at : m.start()], ""
        at = m.end()
        kind = "close" if m[1] else "empty" if m[4] else "open"
        yield kind, m[2], m[3]


def extract_docx(raw: bytes) -> Extracted:
    package = Package(raw)
    out: list[str] = []
    cells, deleted, in_text = 0, 0, False
    for kind, name, _ in events(package.part("word/document.xml", needed=True)):
        if kind == "text":
            if in_text and not deleted:
                out.append(unescape(name))
        elif name == "w:t":
            in_text = kind == "open"
        elif name in ("w:del", "w:moveFrom"):
            deleted += {"open": 1, "close": -1}.get(kind, 0)
        elif name == "w:tab" and kind == "empty" and not deleted:
            out.append("\t")
        elif name in ("w:br", "w:cr") and kind == "empty" and not deleted:
            out.append("\n")
        elif name == "w:p" and kind in ("close", "empty"):
            out.append(" " if cells else "\n\n")
        elif name == "w:tc":
            cells += {"open": 1, "close": -1}.get(kind, 0)
            if kind == "close":
                while out and out[-1] == " ":
                    out.pop()
                out.append("\t")
        elif name == "w:tr" and kind == "close":
            while out and out[-1] == "\t":
                out.pop()
            out.append("\n")
        elif name == "w:tbl" and kind == "close":
            out.append("\n")
    text = re.sub(r"\n{3,}", "\n\n", clean("".join(out)))
    return Extracted(text.strip("\n "), title=package.title())


def _slide_text(xml: str) -> str:
    out: list[str] = []
    field, table, in_text = 0, 0, False
    for kind, name, _ in events(xml):
        if kind == "text":
            if in_text and not field:
                out.append(unescape(name))
        elif name == "a:t":
            in_text = kind == "open"
        elif name == "a:fld":
            field += {"open": 1, "close": -1}.get(kind, 0)
        elif name == "a:br":
            out.append(" " if table else "\n")
        elif name == "a:tbl":
            table += {"open": 1, "close": -1}.get(kind, 0)
        elif name == "a:p" and kind == "close":
            out.append(" " if table else "\n")
        elif name == "a:tc" and kind == "close":
            while out and out[-1] == " ":
                out.pop()
            out.append(" | ")
        elif name == "a:tr" and kind == "close":
            if out and out[-1] == " | ":
                out.pop()
            out.append("\n")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def extract_pptx(raw: bytes) -> Extracted:
    package = Package(raw)
    show, relations = package.part("ppt/presentation.xml"), package.relations("ppt/presentation.xml")
    names = [relations[r][1] for r in re.findall(r'<p:sldId\b[^<>]*\br:id="([^"]+)"', show) if r in relations]
    if not names:
        have = set(package.zip.namelist())
        n = 1
        while f"ppt/slides/slide{n}.xml" in have:
            names.append(f"ppt/slides/slide{n}.xml")
            n += 1
    if not names:
        raise ExtractError("CORRUPT", "no slides")
    pages = []
    for name in names[:MOST_SLIDES]:
        text = _slide_text(package.part(name))
        for kind, to in package.relations(name).values():
            if kind == "notesSlide" and (notes := _slide_text(package.part(to))):
                text += f"\nNotes: {notes}"
        pages.append(text)
    return from_pages(pages, package.title())


def column_index(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(xml: str) -> str:
    xml = re.sub(r"<rPh\b.*?</rPh>", "", xml, flags=re.S)  # phonetic guides
    return unescape("".join(re.findall(r"<t(?:\s[^<>]*)?>([^<]*)</t>", xml)))


def extract_xlsx(raw: bytes) -> Extracted:
    package = Package(raw)
    book, relations = package.part("xl/workbook.xml", needed=True), package.relations("xl/workbook.xml")
    shared = [_texts(s) for s in re.findall(r"<si\b[^<>]*>(.*?)</si>|<si/>", package.part("xl/sharedStrings.xml"), re.S)[:MOST_STRINGS]]
    pages = []
    for attrs in re.findall(r"<sheet\b([^<>]*)>", book)[:MOST_SHEETS]:
        xml = package.part(relations.get(attribute(attrs, "r:id"), ("", ""))[1])
        table = Labeller()
        for row in re.finditer(r"<row\b[^<>]*?(?:/>|>(.*?)</row>)", xml, re.S):
            if table.rows >= MOST_ROWS:
                break
            cells: dict[int, str] = {}
            for c in re.finditer(r"<c\b([^<>]*?)(?:/>|>(.*?)</c>)", row[1] or "", re.S):
                at, kind = column_index(attribute(c[1], "r")), attribute(c[1], "t")
                at = at if at >= 0 else max(cells, default=-1) + 1
                value = re.search(r"<v[^<>]*>([^<]*)</v>", c[2] or "")
                value = unescape(value[1]) if value else ""
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = _texts(c[2] or "")
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                if at < MOST_COLUMNS:
                    cells[at] = re.sub(r"[\n\t\r]", " ", value).strip(" ")
            table.add([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        body = table.text()
        pages.append(f"Sheet: {attribute(attrs, 'name')}\n{body}" if body else "")
    return from_pages(pages, package.title())
