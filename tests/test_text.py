"""Text functions, extractors and the passage splitter on golden inputs."""

import io
import random
import zipfile
import zlib

import pytest

from docspark.functions.answers import cited, escape_markup_text
from docspark.functions.text import clean, fold, normalize
from docspark.operators.chunk import SPACES, chunk_text, page_of
from docspark.sources.extract import extract, safe_extract
from docspark.sources.extracted import ExtractError, from_pages
from docspark.sources.office import column_index, unescape
from docspark.sources.tables import is_number


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (b"a\r\nb\rc\nd\x01\x7fe\tf\fg", "a\nb\nc\nde\tf\n\ng"),
        (b"\xef\xbb\xbfhello", "hello"),
        (b"\xff\xfeh\x00\xe9\x00", "hé"),
        (b"\xfe\xff\x20\xac", "€"),
        (b"\x93quoted\x94 caf\xe9", "“quoted” café"),
        ("é".encode(), "é"),
        ("नमस्ते दुनिया".encode(), "नमस्ते दुनिया"),
        ("ﬁve soft­hy ￾".encode(), "five softhy fi"),
    ],
)
def test_normalize(raw, want):
    assert normalize(raw) == want


def test_fold():
    assert fold("CAFÉ Ñandú Ångström straße") == "cafe nandu angstrom straße"
    assert clean("x​y") == "x​y"


def test_chunk_small_cases():
    assert chunk_text("\t\n \n") == []
    assert chunk_text("\n\n One line of verse.\n") == [(3, 18, 0)]
    for bad in ((80, 40, 5), (80, 90, 80), (0, 5, 0), (5, 5, -1)):
        with pytest.raises(ValueError):
            chunk_text("x", (), *bad)
    text = "oats barley\n\nrye wheat\n\nmillet corn"
    starts = [0, text.index("rye"), text.index("millet")]
    assert [c[2] for c in chunk_text(text, starts, 12, 20, 0)] == [1, 2, 3]
    assert page_of(3, []) == 0 and page_of(0, [4, 8]) == 1 and page_of(8, [4, 8]) == 2 and page_of(7, [0, 4, 8]) == 2


def test_chunk_long_paragraph_ends_with_sentences():
    text = " ".join(["Ferries leave the north quay on the hour!"] * 15 + ["नाव सुबह छूटती है।"] * 15)
    raw = text.encode()
    for o, n, _ in chunk_text(text, (), 200, 300, 40):
        assert raw[o : o + n].decode()[-1] in "!।"


def check_properties(text, target, most, overlap):
    raw, found = text.encode(), chunk_text(text, (), target, most, overlap)
    covered, last = 0, -1
    for o, n, _ in found:
        piece = raw[o : o + n].decode()
        assert 0 < len(piece) <= most and piece[0] not in SPACES and piece[-1] not in SPACES
        assert o > last
        assert not raw[covered:o].decode().strip("".join(SPACES)) if o > covered else True
        covered, last = max(covered, o + n), o
    assert not raw[covered:].decode().strip("".join(SPACES))


def test_chunk_properties():
    r = random.Random(7)
    check_properties("x" * 5000, 1000, 1500, 150)
    for _ in range(200):
        words = ["".join(r.choice("abcdeé€🙂") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 300))]
        text = "".join(w + r.choice([" ", " ", " ", ". ", "\n", "\n\n", "\t", "　"]) for w in words)
        target = r.randint(20, 419)
        check_properties(text, target, target + r.randint(0, 200), r.randint(0, target - 1))


def test_chunks_overlap():
    text = "\n\n".join(f"Stanza {i}: " + "a tide that turns, " * 6 for i in range(16))
    found = chunk_text(text, (), 300, 500, 60)
    assert len(found) >= 5
    assert all(b[0] < a[0] + a[1] for a, b in zip(found, found[1:], strict=False))


def office(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return raw.getvalue()


def test_markdown():
    source = "# Harbour *Almanac*\n\nSee [tide tables](http://t.example/1) or\nask the pilot.\n\n* Moor at dawn\n* Sound the horn &lt;twice&gt;\n\nBerth | Depth\n:--- | ---:\nEast | 7 m\n\n<table>\n<i>markup</i>\n</table>\n\n```\nkeep __this__ line\n```\n\n\n\nThe **end**."
    x = extract(source.encode(), "notes/ALMANAC.md")
    assert x.title == "Harbour Almanac"
    for there in ("See tide tables or ask the pilot.", "- Moor at dawn\n- Sound the horn <twice>", "Berth | Depth\nEast | 7 m", "keep __this__ line", "The end."):
        assert there in x.text
    for gone in ("t.example", "<i>", "markup", "\n\n\n", "**", ":---"):
        assert gone not in x.text


@pytest.mark.parametrize(
    ("name", "raw", "want"),
    [
        ("b.csv", 'Ship,Flag,Remark\nTern,NO,"Two\ndecks"\n\n"Gull, old",DK,"Called ""the kettle"" by all"\n', ["Ship: Tern | Flag: NO | Remark: Two decks", 'Ship: Gull, old | Flag: DK | Remark: Called "the kettle" by all']),
        ("b.csv", "Port;Pier\nBergen;4b\n", ["Port: Bergen | Pier: 4b"]),
        ("b.tsv", "sku\tleft\nk9\t31\n", ["sku: k9 | left: 31"]),
        ("b.csv", "10,20\n30,40\n", ["10 | 20", "30 | 40"]),
    ],
)
def test_csv(name, raw, want):
    lines = extract(raw.encode(), name).text.split("\n")
    assert all(w in lines for w in want)


def test_csv_groups_rows():
    lines = extract(("p,q\n" + "y,2\n" * 14).encode(), "g.csv").text.split("\n")
    assert lines[10] == "" and lines.count("") == 1
    assert is_number("0xfe") and is_number("  +2.5E3") and is_number("inf") and not is_number("7 up") and not is_number("")


def test_docx():
    run = lambda *texts: "".join(f"<w:r><w:t xml:space='preserve'>{t}</w:t></w:r>" for t in texts)
    paragraph = lambda inner: f"<w:p>{inner}</w:p>"
    cell = lambda t: f"<w:tc>{paragraph(run(t))}</w:tc>"
    body = "<w:document><w:body>" + paragraph(run("The ferry ", "Tern ", "sails at 06:40."))
    body += paragraph(f"<w:del><w:r><w:delText>cancelled</w:delText><w:t>cancelled</w:t></w:r></w:del>{run('Crew &lt;6&gt;')}<w:r><w:br/></w:r>{run('on deck')}")
    body += f"<w:tbl><w:tr>{cell('Cabin')}{cell('2 berths')}</w:tr><w:tr>{cell('Lounge')}</w:tr></w:tbl></w:body></w:document>"
    x = extract(office({"word/document.xml": body, "docProps/core.xml": "<cp><dc:title>Timetable</dc:title></cp>"}), "f.docx")
    assert x.title == "Timetable"
    assert "The ferry Tern sails at 06:40.\n\nCrew <6>\non deck" in x.text
    assert "Cabin\t2 berths\nLounge" in x.text and "cancelled" not in x.text


def test_pptx():
    words = lambda *ts: "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ts)
    row = lambda *ts: "<a:tr>" + "".join(f"<a:tc>{words(t)}</a:tc>" for t in ts) + "</a:tr>"
    slide = lambda inner: f"<p:sld>{inner}</p:sld>"
    rel = lambda *r: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="http://k/{t}" Target="{to}"/>' for i, t, to in r) + "</Relationships>"
    number = "<a:p><a:fld><a:t>17</a:t></a:fld></a:p>"  # a slide number is no text of the slide
    x = extract(
        office({
            "ppt/presentation.xml": '<p:presentation><p:sldId id="9" r:id="q"/><p:sldId id="8" r:id="p"/></p:presentation>',
            "ppt/_rels/presentation.xml.rels": rel(("p", "slide", "slides/slide1.xml"), ("q", "slide", "slides/slide2.xml")),
            "ppt/slides/slide1.xml": slide(f"<a:tbl>{row('Mooring', 'Length')}{row('South', '40 m')}</a:tbl>"),
            "ppt/slides/slide2.xml": slide(words("Welcome aboard") + number),
            "ppt/slides/_rels/slide2.xml.rels": rel(("n", "notesSlide", "../notesSlides/one.xml")),
            "ppt/notesSlides/one.xml": slide(words("smile") + number),
        }),
        "deck.pptx",
    )
    first, second = x.text.split("\n\n")
    assert first == "Welcome aboard\nNotes: smile" and second == "Mooring | Length\nSouth | 40 m" and x.pages == [0, len(first) + 2]


def test_xlsx():
    shared = "<sst><si><t>Berth</t><rPh><t>SPOKEN</t></rPh></si><si><r><t>In </t></r><r><t>use</t></r></si><si><t>East</t></si></sst>"
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Depth</t></is></c><c r="D1" t="s"><v>1</v></c></row>'
    line = '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7.5</v></c><c r="D2" t="b"><v>0</v></c></row>'
    x = extract(
        office({
            "xl/workbook.xml": '<workbook><sheet name="Quays" r:id="x"/><sheet name="Tolls" r:id="y"/></workbook>',
            "xl/_rels/workbook.xml.rels": '<R><Relationship Id="x" Type="t/w" Target="worksheets/one.xml"/><Relationship Id="y" Type="t/w" Target="/xl/worksheets/two.xml"/></R>',
            "xl/sharedStrings.xml": shared, "xl/worksheets/one.xml": head + line, "xl/worksheets/two.xml": "<row><c><v>12</v></c></row>",
        }),
        "port.xlsx",
    )
    assert x.text.startswith("Sheet: Quays\n") and "Berth: East | Depth: 7.5 | In use: FALSE" in x.text
    assert "SPOKEN" not in x.text and len(x.pages) == 2 and x.text.endswith("Sheet: Tolls\n12")
    assert column_index("C12") == 2 and column_index("BA3") == 52 and unescape("x &#67; &#x44; &lt; & y &none;") == "x C D < & y "


def pdf(contents, fonts, extra=(), title="", flate=True, packed=False):
    """A PDF file of some pages; ``fonts``: bodies of font dictionaries F0, F1, ...; ``extra``: further streams, from object 50 on."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Title (" + title.encode("cp1252") + b") >>"}
    objects |= {10 + i: f.encode() for i, f in enumerate(fonts)}
    names = " ".join(f"/F{i} {10 + i} 0 R" for i in range(len(fonts)))
    kids = " ".join(f"{20 + i} 0 R" for i in range(len(contents)))
    objects[2] = f"<< /Type /Pages /Kids [{kids}] /Count {len(contents)} /Resources << /Font << {names} >> >> >>".encode()
    streams = {50 + i: x for i, x in enumerate(extra)}
    for i, c in enumerate(contents):
        objects[20 + i] = f"<< /Type /Page /Parent 2 0 R /Contents {30 + i} 0 R >>".encode()
        streams[30 + i] = c
    out = b"%PDF-1.5\n"
    if packed:  # all plain objects inside one stream
        head, body = b"", b""
        for n, x in objects.items():
            head, body = head + b"%d %d " % (n, len(body)), body + x + b" "
        data = zlib.compress(head + body)
        out += b"90 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(objects), len(head), len(data), data)
    else:
        for n, x in objects.items():
            out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    for n, x in streams.items():
        data = zlib.compress(x) if flate else x
        out += b"%d 0 obj\n<< /Length %d%s >>\nstream\n%s\nendstream\nendobj\n" % (n, len(data), b" /Filter /FlateDecode" if flate else b"", data)
    return out + b"trailer\n<< /Root 1 0 R /Info 3 0 R >>\n%%EOF"


@pytest.mark.parametrize(("flate", "packed"), [(True, False), (False, False), (True, True)])
def test_pdf(flate, packed):
    plain = "<< /Type /Font /Subtype /Type1 >>"
    mapped = "<< /Type /Font /Subtype /Type0 /ToUnicode 50 0 R >>"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0048> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660069> <20AC>] endbfrange"
    one = b"BT /F0 12 Tf 72 700 Td (The lock \\(north\\) opens) Tj 0 -14 Td [(at ) -20 (s) 10 (even) -400 (sharp\\056)] TJ T* (caf\\351) Tj ET"
    two = b"BT /F1 9 Tf 1 0 0 1 50 600 Tm <000100100011> Tj 1 0 0 1 90 600 Tm <0012> Tj 1 0 0 1 50 580 Tm <00200021> Tj ET"
    x = extract(pdf([one, b"BT ET", two], [plain, mapped], [cmap], "Lock book", flate, packed), "a.PDF")
    first, second = "The lock (north) opens\nat seven sharp.\ncafé", "Hab c\nfi€"
    assert x.title == "Lock book" and x.text == f"{first}\n\n{second}" and x.pages[0] == 0 and x.pages[2] == len(first.encode()) + 2 and len(x.pages) == 3


def test_pdf_without_a_text_layer():
    x = extract(pdf([b"BT (3) Tj ET"], ["<< >>"], title="Scan"), "b.pdf")
    assert (x.text, x.title) == ("", "Scan")
    for raw, status in ((b"no pdf", "CORRUPT"), (b"%PDF-1.4\ntrailer << /Encrypt 5 0 R >>", "ENCRYPTED"), (b"%PDF-1.4\n", "CORRUPT")):
        assert safe_extract(raw, "c.pdf")["status"] == status


def test_extract_failures():
    with pytest.raises(ExtractError) as e:
        extract(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest", "x.docx")
    assert e.value.status == "ENCRYPTED"
    assert safe_extract(b"x", "a.zip")["status"] == "UNSUPPORTED" and safe_extract(b"x", "a.docx")["status"] == "CORRUPT"
    assert safe_extract(None, "a.txt")["message"] == "cannot read file"
    assert from_pages(["a", "", "b"]).pages == [0, 1, 3]


@pytest.mark.parametrize(("text", "want"), [("A [S2]. B [S1][S3]. C [S2].", [2, 1, 3]), ("[S3, S1]", [3, 1]), ("[0] [4] [a] [1 [ 2 x] [99999999999]", []), ("[ 2 ]", [2])])
def test_citations(text, want):
    assert cited(text, 3) == want


def test_markup():
    out = escape_markup_text("<|im_start|> <|> ok")
    assert "<|" not in out and "|>" not in out
