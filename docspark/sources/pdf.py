"""The text layer of PDF files, page by page: no rendering, no pictures.

Objects are found by their marks and not through the cross-reference table, so that files whose table is damaged are read
too. Strings are decoded by their font's ToUnicode map, else as Windows-1252 for fonts of one byte a character. Files that
open with the empty password are decrypted. Streams that go through filters of pictures give no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from docspark.functions.text import clean
from docspark.sources.extracted import Extracted, ExtractError, from_pages
from docspark.sources.pdf_filters import Cipher, decode

#: Fixed value: a file whose pages have fewer visible characters than this has no text layer worth the name.
LEAST_VISIBLE = 16
#: Thousandths of the font size by which a gap inside a shown array counts as a space; nesting of page trees.
GAP, MOST_DEPTH = 200, 64
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|<[0-9A-Fa-f\s]*>|\(|\[|\]|/[^\s()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*][A-Za-z0-9'\"*]*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of another object."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from after its opening parenthesis: its bytes and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            digits = re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4])
            if digits:
                out.append(int(digits[0], 8) & 255)
                at += 1 + len(digits[0])
                continue
            n = data[at + 1 : at + 2]
            out += b"" if n in b"\r\n" else _ESCAPES.get(n, n)
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def _tokens(data: bytes) -> Iterator[object]:
    """Numbers, names (str with "/"), strings (bytes), brackets and operators (str)."""
    at = 0
    while m := _TOKEN.search(data, at):
        t, at = m[0], m.end()
        if t == b"(":
            value, at = _string(data, at)
            yield value
        elif t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t[:1] in b"+-.0123456789":
            yield float(t)
        elif t[:1] != b"%":
            yield t.decode("latin-1")


def _value(tokens: list, at: int) -> tuple[object, int]:
    """The value that begins at a token: a dictionary, list, reference or plain value."""
    t = tokens[at]
    if t == "<<":
        out: dict = {}
        at += 1
        while at + 1 < len(tokens) and tokens[at] != ">>":
            key = tokens[at]
            out[key], at = _value(tokens, at + 1)
        return out, at + 1
    if t == "[":
        items: list = []
        at += 1
        while at < len(tokens) and tokens[at] != "]":
            item, at = _value(tokens, at)
            items.append(item)
        return items, at + 1
    if isinstance(t, float) and tokens[at + 2 : at + 3] == ["R"]:
        return Ref(int(t)), at + 3
    return t, at + 1


def parse(data: bytes) -> object:
    tokens = list(_tokens(data))
    return _value(tokens, 0)[0] if tokens else None


class File:
    def __init__(self, raw: bytes):
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        generation: dict[int, int] = {}
        for m in _OBJECT.finditer(raw):
            s = _STREAM.search(m[3])
            head, body = parse(m[3][: s.start()] if s else m[3]), s[1] if s else None
            n = head.get("/Length") if isinstance(head, dict) else None
            if s and isinstance(n, float) and m[3][s.start(1) + int(n) :].lstrip()[:9] == b"endstream":
                body = m[3][s.start(1) : s.start(1) + int(n)]  # to the byte, which encryption needs
            self.objects[int(m[1])], generation[int(m[1])] = (head, body), int(m[2])
        self._decrypt(raw, generation)
        for head, body in list(self.objects.values()):
            if isinstance(head, dict) and head.get("/Type") == "/ObjStm" and body is not None:
                self._unfold(head, self._inflate(head, body))

    def _decrypt(self, raw: bytes, generation: dict[int, int]) -> None:
        """Strings and streams in clear, of a file that opens with the empty password."""
        m = re.search(rb"/Encrypt\s*(\d+)\s+\d+\s+R|/Encrypt\s*(<<.*?>>\s*(?:/|>>))", raw, re.S)
        if not m:
            return
        own = int(m[1]) if m[1] else -1
        entry = self.objects.get(own, (None, None))[0] if m[1] else parse(m[2])
        ids = re.search(rb"/ID\s*\[\s*(<[^>]*>|\(.*?(?<!\\)\))", raw, re.S)
        try:
            resolved = {k: self.get(v) for k, v in entry.items()}
            cipher = Cipher(resolved, parse(ids[1]) if ids else b"")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ExtractError("ENCRYPTED", f"the file is encrypted: {e}") from e

        def clear(x: object, n: int) -> object:
            if isinstance(x, bytes):
                return cipher.decrypt(x, n, generation[n], True)
            if isinstance(x, dict):
                return {k: clear(v, n) for k, v in x.items()}
            return [clear(v, n) for v in x] if isinstance(x, list) else x

        for n, (head, body) in self.objects.items():
            plain = n == own or isinstance(head, dict) and head.get("/Type") == "/XRef"
            if not plain:
                self.objects[n] = (clear(head, n), None if body is None else cipher.decrypt(body, n, generation[n]))

    def _unfold(self, head: dict, data: bytes) -> None:
        """Objects that a stream holds: numbers and places first, then the objects."""
        first, n = int(head.get("/First", 0)), int(head.get("/N", 0))
        index = [int(x) for x in data[:first].split()[: 2 * n]]
        starts = index[1::2] + [len(data) - first]
        for number, a, b in zip(index[::2], starts, starts[1:], strict=False):
            self.objects.setdefault(number, (parse(data[first + a : first + b]), None))

    def get(self, x: object) -> object:
        for _ in range(MOST_DEPTH):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(int(x), (None, None))[0]
        return x

    def _inflate(self, head: dict, body: bytes) -> bytes:
        listed = lambda x: [self.get(y) for y in x] if isinstance(x, list) else [x]
        kinds = self.get(head.get("/Filter", head.get("/F")))
        parameters = listed(self.get(head.get("/DecodeParms", head.get("/DP"))))
        return (decode(body, listed(kinds), parameters) if kinds else body) or b""

    def stream(self, x: object) -> bytes:
        """The decoded bytes of a stream, or of a list of streams."""
        if isinstance(x, Ref) and (found := self.objects.get(int(x))):
            head, body = found
            if body is not None and isinstance(head, dict):
                return self._inflate(head, body)
        x = self.get(x)
        return b"\n".join(map(self.stream, x)) if isinstance(x, list) else b""

    def pages(self) -> list[dict]:
        """Page dictionaries in reading order, with the resources that they inherit."""
        heads = [h for h, _ in self.objects.values() if isinstance(h, dict)]
        root = next((h for h in heads if h.get("/Type") == "/Catalog"), {})
        out: list[dict] = []

        def visit(node: object, inherited: object, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > MOST_DEPTH:
                return
            resources = node.get("/Resources", inherited)
            if "/Kids" in node:
                for kid in self.get(node["/Kids"]) or []:
                    visit(kid, resources, depth + 1)
            else:
                out.append({**node, "/Resources": resources})

        visit(root.get("/Pages"), None, 0)
        return out or [h for h in heads if h.get("/Type") == "/Page"]


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "ignore")


class Font:
    """How a font's codes are read: ``width`` bytes a code, and what each stands for."""

    def __init__(self, file: File, font: dict):
        self.width, self.map = 2 if font.get("/Subtype") == "/Type0" else 1, {}
        self.known = "/ToUnicode" in font
        tokens = list(_tokens(file.stream(font["/ToUnicode"]))) if self.known else []
        for i, t in enumerate(tokens):
            if t == "endcodespacerange" and isinstance(tokens[i - 1], bytes):
                self.width = max(1, len(tokens[i - 1]))
        begin = 0
        for i, t in enumerate(tokens):
            if t in ("beginbfchar", "beginbfrange"):
                begin = i + 1
            elif t == "endbfchar":
                own = tokens[begin:i]
                self.map |= {int.from_bytes(a, "big"): _utf16(b) for a, b in zip(own[::2], own[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif t == "endbfrange":
                self._ranges(tokens[begin:i])

    def _ranges(self, tokens: list) -> None:
        at = 0
        while at + 2 < len(tokens):
            lo, hi = (int.from_bytes(x, "big") for x in tokens[at : at + 2])
            to, at = _value(tokens, at + 2)
            for k in range(min(hi - lo + 1, 65_536)):
                if isinstance(to, list):
                    self.map[lo + k] = _utf16(to[k]) if k < len(to) else ""
                elif to:
                    self.map[lo + k] = _utf16(to[:-2]) + chr(int.from_bytes(to[-2:], "big") + k)

    def text(self, raw: bytes) -> str:
        if not self.known:
            return raw.decode("cp1252", "ignore") if self.width == 1 else ""
        codes = (int.from_bytes(raw[i : i + self.width], "big") for i in range(0, len(raw), self.width))
        return "".join(self.map.get(c, "") for c in codes)


def page_text(file: File, page: dict) -> str:
    """What a page shows, line by line in the order in which it is drawn."""
    resources = file.get(page.get("/Resources")) or {}
    dicts = file.get(resources.get("/Font")) or {}
    fonts = {name: Font(file, d) for name, ref in dicts.items() if isinstance(d := file.get(ref), dict)}
    out, stack, font = [], [], Font(file, {})
    line = None  # the height of the last line

    def moved(y: float | None) -> None:
        nonlocal line
        if out and not out[-1].endswith("\n"):
            out.append("\n" if y is None or line is None or abs(y - line) > 0.5 else " ")
        line = y if y is not None else line

    for t in _tokens(file.stream(page.get("/Contents"))):
        if not isinstance(t, str) or t[:1] in "/[]<>":
            stack.append(t)
            continue
        numbers = [x for x in stack if isinstance(x, float)]
        if t == "Tf" and stack:
            font = fonts.get(next((x for x in stack if isinstance(x, str)), ""), font)
        elif t in ("Td", "TD") and len(numbers) >= 2:
            moved((line or 0.0) + numbers[-1])
        elif t == "Tm" and len(numbers) >= 6:
            moved(numbers[-1])
        elif t in ("T*", "BT"):
            moved(None)
        elif t in ("Tj", "'", '"', "TJ"):
            if t in ("'", '"'):
                moved(None)
            for x in stack:
                if isinstance(x, bytes):
                    out.append(font.text(x))
                elif t == "TJ" and isinstance(x, float) and x < -GAP:
                    out.append(" ")
        stack = []
    return re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(out)))


def extract_pdf(raw: bytes) -> Extracted:
    """Pages joined by a blank line, with their offsets and the title of the file's record; an unreadable page keeps its number."""
    if not raw.lstrip()[:5].startswith(b"%PDF-"):
        raise ExtractError("CORRUPT", "not a PDF file")
    file, texts = File(raw), []
    for page in file.pages():
        try:
            texts.append(page_text(file, page))
        except (ValueError, IndexError, TypeError, AttributeError):
            texts.append("")
    if not texts:
        raise ExtractError("CORRUPT", "the file has no pages")
    title = ""
    if m := re.search(rb"/Info\s+(\d+)\s+\d+\s+R", raw):
        info = file.get(Ref(int(m[1])))
        own = info.get("/Title", b"") if isinstance(info, dict) else b""
        title = (_utf16(own[2:]) if own[:2] == b"\xfe\xff" else own.decode("cp1252", "ignore")) if isinstance(own, bytes) else ""
    if sum(not c.isspace() for t in texts for c in clean(t)) < LEAST_VISIBLE:
        return Extracted("", [], clean(title).strip())
    return from_pages(texts, title)
