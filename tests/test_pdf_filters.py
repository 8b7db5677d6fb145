"""Filters, predictors and decryption of PDF streams, each by an encoder of its own, and files that use them."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from docspark.sources import pdf_filters as P
from docspark.sources.extract import extract, safe_extract

TEXT = b"BT /F0 12 Tf 72 700 Td (A sentence that is long enough.) Tj 0 -14 Td (Its second line.) Tj ET"
SHOWN = "A sentence that is long enough.\nIts second line."


def lzw_encode(data, early=1):
    table, bits, n, width, next_code = {bytes([i]): i for i in range(256)}, 0, 0, 9, 258
    w, codes = b"", [256]
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        codes.append(table[w])
        if next_code < 4096:
            table[w + bytes([c])] = next_code
            next_code += 1
        w = bytes([c])
        if next_code == 4094:  # begin again
            codes += [table[w], 256]
            table, next_code, w = {bytes([i]): i for i in range(256)}, 258, b""
    codes += ([table[w]] if w else []) + [257]
    size, fresh = 258, True
    for code in codes:
        bits, n = bits << width | code, n + width
        if code == 256:
            size, fresh, width = 258, True, 9
        else:
            size += not fresh and size < 4096
            fresh = False
            width = min(12, max(9, (size + early).bit_length()))
    return (bits << -n % 8).to_bytes((n + 7) // 8, "big")


def run_lengths(data):
    out, at = b"", 0
    while at < len(data):
        n = 1
        while n < 128 and data[at + n : at + n + 1] == data[at : at + 1]:
            n += 1
        out += bytes([257 - n]) + data[at : at + 1] if n > 1 else bytes([0]) + data[at : at + 1]
        at += n
    return out + b"\x80"


def png_rows(data, columns, kinds):
    out, above = b"", bytes(columns)
    for r, at in enumerate(range(0, len(data), columns)):
        row, kind = data[at : at + columns], kinds[r % len(kinds)]
        made = bytearray()
        for i, c in enumerate(row):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            guess = left + up - corner
            paeth = left if abs(guess - left) <= abs(guess - up) and abs(guess - left) <= abs(guess - corner) else up if abs(guess - up) <= abs(guess - corner) else corner
            made.append(c - (0, left, up, (left + up) // 2, paeth)[kind] & 255)
        out, above = out + bytes([kind]) + made, row
    return out


def test_filters_give_back_what_was_encoded():
    r = random.Random(3)
    for data in (b"", b"a", TEXT, b"a" * 9000, bytes(r.randrange(256) for _ in range(20_000)), TEXT * 300):
        assert P.lzw(lzw_encode(data)) == data and P.lzw(lzw_encode(data, 0), 0) == data
        assert P.run_length(run_lengths(data)) == data
        assert P.ascii85(base64.a85encode(data) + b"~>") == data and P.ascii_hex(data.hex().encode() + b" >") == data
    data = bytes(r.randrange(256) for _ in range(40 * 25))
    for kinds in ([0], [1], [2], [3], [4], [0, 1, 2, 3, 4]):
        assert P.unpredict(png_rows(data, 25, kinds), 15, 1, 8, 25) == data
    rows = np.frombuffer(data[:960], np.uint8).reshape(-1, 8, 3)
    assert P.unpredict(np.diff(rows, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes(), 2, 3, 8, 8) == data[:960]
    assert P.decode(b"x", ["/DCTDecode"], []) is None and P.decode(b"nothing", ["/Fl"], []) is None
    assert P.decode(base64.a85encode(zlib.compress(TEXT)), ["/A85", "/Fl"], [None]) == TEXT


def test_ciphers_on_published_vectors():
    assert P.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    for key, block in ((bytes(range(16)), "69c4e0d86a7b0430d8cdb78070b4c55a"), (bytes(range(32)), "8ea2b7ca516745bfeafc49904b496089")):
        assert P.aes_cbc(key, bytes(16) + bytes.fromhex(block)).hex() == "00112233445566778899aabbccddeeff"


def file_of(stream, filters, more=b"", trailer=b""):
    objects = [
        b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n", b"2 0 obj\n<< /Type /Pages /Kids [4 0 R] /Count 1 >>\nendobj\n",
        b"4 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F0 6 0 R >> >> >>\nendobj\n",
        b"5 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (len(stream), filters, stream), b"6 0 obj\n<< /Type /Font /Subtype /Type1 >>\nendobj\n",
    ]
    return b"%PDF-1.5\n" + b"".join(objects) + more + b"trailer\n<< /Root 1 0 R " + trailer + b" >>\n%%EOF"


@pytest.mark.parametrize(("stream", "filters"), [
    (lzw_encode(TEXT), b"/Filter /LZWDecode"),
    (base64.a85encode(lzw_encode(TEXT, 0)) + b"~>", b"/Filter [/ASCII85Decode /LZWDecode] /DecodeParms [null << /EarlyChange 0 >>]"),
    (TEXT.hex().encode() + b">", b"/Filter /AHx"),
    (run_lengths(TEXT), b"/Filter [ /RunLengthDecode ]"),
    (zlib.compress(png_rows(TEXT.ljust(100), 20, [1, 2, 3, 4])), b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 20 >>"),
])
def test_files_with_filters(stream, filters):
    assert extract(file_of(stream, filters), "a.pdf").text == SHOWN


def aes_encrypt(key, data, start):
    """One block after the other, by AES's definition with the box that the reader makes."""
    box = P._sbox()
    words, once = [list(key[i : i + 4]) for i in range(0, 16, 4)], 1
    while len(words) < 44:
        w = words[-1]
        if len(words) % 4 == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= once
            once = P._times(once, 2)
        words.append([a ^ b for a, b in zip(w, words[-4], strict=True)])
    keys = [sum(words[i : i + 4], []) for i in range(0, 44, 4)]
    out, before = start, start
    data += bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
    for at in range(0, len(data), 16):
        s = [a ^ b ^ k for a, b, k in zip(data[at : at + 16], before, keys[0], strict=True)]
        for r in range(1, 11):
            s = [int(box[s[(i + 4 * (i % 4)) % 16]]) for i in range(16)]
            if r < 10:
                s = [P._times(s[4 * (i // 4) + i % 4], 2) ^ P._times(s[4 * (i // 4) + (i + 1) % 4], 3) ^ s[4 * (i // 4) + (i + 2) % 4] ^ s[4 * (i // 4) + (i + 3) % 4] for i in range(16)]
            s = [a ^ k for a, k in zip(s, keys[r], strict=True)]
        before = bytes(s)
        out += before
    return out


@pytest.mark.parametrize("kind", ["rc4-40", "rc4-128", "aes-128"])
@pytest.mark.parametrize("password", [b"", b"secret"])
def test_encrypted_files(kind, password):
    """With the empty password texts and titles are read; with another the file says that it is encrypted."""
    version, revision, n = {"rc4-40": (1, 2, 5), "rc4-128": (2, 3, 16), "aes-128": (4, 4, 16)}[kind]
    owner, permissions, file_id = bytes(range(32, 64)), -44, b"0123456789abcdef"
    key = hashlib.md5((password + P.PAD)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:n]).digest()
    key = key[:n]
    if revision == 2:
        user = P.rc4(key, P.PAD)
    else:
        user = hashlib.md5(P.PAD + file_id).digest()
        for i in range(20):
            user = P.rc4(bytes(k ^ i for k in key), user)
        user += bytes(16)

    def hidden(data, number):
        own = hashlib.md5(key + number.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if version == 4 else b"")).digest()[: min(n + 5, 16)]
        return aes_encrypt(own, data, bytes(range(16))) if version == 4 else P.rc4(own, data)

    more = b" /CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if version == 4 else b""
    entry = b"8 0 obj\n<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s>%s >>\nendobj\n" % (version, revision, n * 8, permissions, owner.hex().encode(), user.hex().encode(), more)
    info = b"9 0 obj\n<< /Title <%s> >>\nendobj\n" % hidden(b"Kept title", 9).hex().encode()
    raw = file_of(hidden(zlib.compress(TEXT), 5), b"/Filter /FlateDecode", entry + info, b"/Info 9 0 R /Encrypt 8 0 R /ID [<%s> <00>]" % file_id.hex().encode())
    if password:
        assert safe_extract(raw, "a.pdf")["status"] == "ENCRYPTED"
    else:
        x = extract(raw, "a.pdf")
        assert (x.text, x.title) == (SHOWN, "Kept title")


def test_cross_reference_streams_hold_the_roots():
    """A file without a trailer: roots in a stream's dictionary, objects in another stream with a predictor."""
    body = [b"<< /Type /Catalog /Pages 2 0 R >> ", b"<< /Type /Pages /Kids [4 0 R] /Count 1 >> ", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >> ", b"<< /Title (In a stream) >> "]
    head, at = b"", 0
    for n, x in zip((1, 2, 4, 3), body, strict=True):
        head, at = head + b"%d %d " % (n, at), at + len(x)
    data = head + b"".join(body)
    data += b" " * (-len(data) % 16)
    packed = zlib.compress(png_rows(data, 16, [2]))
    raw = b"%PDF-1.5\n" + b"7 0 obj\n<< /Type /ObjStm /N 4 /First %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 16 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    raw += b"5 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(TEXT), TEXT)
    raw += b"6 0 obj\n<< /Type /XRef /Root 1 0 R /Info 3 0 R /Size 8 /W [1 2 1] /Length 4 >>\nstream\nabcd\nendstream\nendobj\nstartxref\n0\n%%EOF"
    x = extract(raw, "a.pdf")
    assert (x.text, x.title) == (SHOWN, "In a stream")
