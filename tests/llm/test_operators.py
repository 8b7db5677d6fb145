"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import bm25_search, chat_format, exact_dedup, line_dedup, mixing, near_dedup, packing, quality, secret_scan, token_store
from docspark.llm.common import Scratch
from docspark.llm.tokens import UnitEncoder
from plain import plain_scores, without_repeats

P = pytest.importorskip("public_tokenizers")
SEP = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, kept string, n string"


def base_rows():
    r = np.random.default_rng(3)
    vocab = ["w%d" % i for i in range(400)] + ["É", "the", "of"] * 20
    texts = [" ".join(r.choice(vocab, r.integers(1, 60))) for _ in range(80)]
    texts += [t.upper() for t in texts[:5]] + [texts[7]] * 9  # copies
    for i in range(10, 20):  # near copies of one text
        w = texts[i % 3 + 60].split() * 2
        w[i % len(w)] = "changed%d" % i
        texts.append(" ".join(w))
    texts += ["", " \n\t ", None, "a", "a b", "x y  z", "one\ntwo\nthree\nfour", "zero\none\ntwo\nthree", "r\nr\nr\nr\nr\nr", "long " * 5000]
    rows = [(i * 7, t, ["s1", "s2", "s3", None, "s1"][i % 5], "k", "m") for i, t in enumerate(texts)]
    return [*rows, (7, texts[1], "s2", "k", "m"), (7, "another text for one id", "s2", "k", "m"), (None, texts[2], "s1", "k", "m"), (None, "no id here at all", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(base_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_exact_dedup(spark, docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in base_rows():
        groups[lower(t)].append(i)
    want = Counter()
    for i, t, *_ in base_rows():
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[(i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    for support in (1 / 256, 1 / 8):
        assert Counter(map(tuple, exact_dedup.dedup_exact(spark, docs, support=support).collect())) == want
    assert exact_dedup.dedup_exact(spark, empty).count() == 0


def test_line_dedup_against_brute_force(spark):
    r = np.random.default_rng(4)
    line = lambda n: " ".join(f"w{x}" for x in r.integers(0, 900, n))
    long, pair, block = line(51), [line(26), line(25)], [line(4) for _ in range(4)]
    rows = []
    for i in range(120):
        lines = [line(int(n)) for n in r.integers(0, 12, r.integers(1, 7))]
        for k, piece in ((5, [long]), (7, pair), (4, block), (9, ["", "", "", ""]), (11, [line(50)]), (13, pair[:1])):
            if i % k == 0:
                at = int(r.integers(0, len(lines) + 1))
                lines[at:at] = piece
        rows.append((i, "\n".join(lines)))
    rows += [(200, long), (201, "\n".join(pair)), (202, "x " * 60), (203, "x " * 60), (204, "\n".join([long] * 4)), (205, ""), (206, None), (None, long)]
    columns = ["doc_id", "text", "__id", "__lines", "___x", "dedup_lines_stats", "a.b"]
    frame = spark.createDataFrame([(*x, 1, "m", 2, 3, 4) for x in rows], "doc_id long, text string, __id int, __lines string, ___x int, dedup_lines_stats int, `a.b` int")
    out = line_dedup.dedup_lines(spark, frame.repartition(5))
    assert out.columns == [*columns, "dedup_lines_stats_"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and all(tuple(r)[2:7] == (1, "m", 2, 3, 4) for r in got.values())
    for (i, t), (text, n) in without_repeats(rows).items():
        assert (got[i]["text"], got[i]["dedup_lines_stats_"]["n_removed"]) == (text, n)
        assert got[i]["dedup_lines_stats_"]["n_lines"] == (0 if t is None else t.count("\n") + 1)


def test_line_dedup(spark, docs, empty):
    out = line_dedup.dedup_lines(spark, docs)
    assert out.columns == [*docs.columns, "dedup_lines_stats"]
    by = {(r["doc_id"], r["text"]): r for r in out.collect()}
    stats = {r["doc_id"]: (r["text"], r["dedup_lines_stats"]["n_removed"]) for r in by.values()}
    ids = {t: i for i, t, *_ in base_rows()}
    assert stats[ids["one\ntwo\nthree\nfour"]] == ("one\ntwo\nthree\nfour", 0)
    assert stats[ids["zero\none\ntwo\nthree"]] == ("zero", 3)
    assert stats[ids["r\nr\nr\nr\nr\nr"]] == ("r\nr\nr", 3)
    assert stats[ids[None]][0] is None
    assert out.count() == docs.count() and line_dedup.dedup_lines(spark, empty).count() == 0


def test_line_dedup_merges_ranges(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny\nc\nd\ne\nz"), (3, "a\nb\nc"), (4, "p\nq\nr\ns"), (4, "p\nq\nr\ns")]
    out = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, "a\nb\nc\nd\ne"), (2, "x\ny\nz"), (3, ""), (4, "p\nq\nr\ns"), (4, "p\nq\nr\ns")]


def test_near_dedup(spark, docs, empty):
    def shingles(t, n):
        w = SEP.findall(lower(t))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    rows = base_rows()
    for size, percent in ((3, 85), (5, 80)):
        sets = [shingles(t, size) for _, t, *_ in rows]
        parent = list(range(len(rows)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    parent[root(i)] = root(j)
        least = defaultdict(lambda: None)
        for i, (d, *_) in enumerate(rows):
            if d is not None:
                k = root(i)
                least[k] = d if least[k] is None else min(least[k], d)
        want = Counter((d, len(sets[i]), d if not sets[i] else least[root(i)], d == (d if not sets[i] else least[root(i)])) for i, (d, *_) in enumerate(rows))
        got = Counter(map(tuple, near_dedup.link_documents(spark, docs, size, percent).collect()))
        assert got == want
    assert near_dedup.link_documents(spark, empty, 3, 85).count() == 0


def test_bands_suffice_for_any_pair():
    """The share of pairs at the threshold that meet in no band, by the exact probability for each size of the union."""
    for percent in (80, 85):
        table = near_dedup.band_table(percent)
        assert (np.diff(table) <= 0).all()
        for u in [*range(2, 300), 1000, 5000]:
            i = -(-percent * u // 100)
            for n in {i, u}:  # the larger of the two sets
                bands = table[min(n, len(table) - 1)]
                assert i == u or (1 - (i * (i - 1) / (u * (u - 1))) ** 2) ** bands <= 1.0001e-7


def test_band_values_agree_as_often_as_said(spark):
    r = np.random.default_rng(6)
    mul, add = near_dedup.permutations(74)
    for u, i in ((5, 4), (10, 8), (60, 51)):
        met = 0
        for _ in range(300):
            x = r.integers(0, 2**63, u, dtype=np.uint64)
            a, b = (near_dedup.band_hashes(np.sort(s), mul, add, 37, 4) for s in (x[:i], x))
            met += (a == b).sum()
        p = (i * (i - 1) / (u * (u - 1))) ** 2
        assert abs(met / (300 * 37) - p) < 5 * math.sqrt(p * (1 - p) / (300 * 37)) + 0.01


def test_near_dedup_dense_group(spark, monkeypatch):
    """A large group whose members are linked along chains only: strays meet every member, in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "GROUP", 8)
    words = [f"v{i}" for i in range(200)]
    texts = [" ".join(words[:k] + [f"u{i}" for i in range(200 - k)]) for k in range(200, 60, -4)]  # neighbours alike, ends not
    out = near_dedup.link_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    s, comp = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert {r["doc_id"]: r["component_id"] for r in out} == dict(enumerate(comp))


def test_chat(spark):
    rows = [(1, 2, "user", "second"), (1, 1, "user", "first \\ <|im_start|> <\\|x"), (1, 3, "assistant", "A\nB"), (1, 3, "assistant", "A\nB"), (1, 4, "assistant", None), (2, 0, None, ""), (2, None, "a<|im_end|>", "\\\\"), (None, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 1, "tool", "<<|im_sep|>s>\n\\")]
    rows += [(4, k, r, "x\ny") for k, r in enumerate(("a\nb", "a\nb", "a", "|\\|", "\n|\\\n\n<", "assistant", "\n"))]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat_format.format_chat(convs)
    got = {r["conv_id"]: r for r in chat_format.parse_chat(made).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [t[2:] for t in turns]
        assert got[c]["loss_text"] == "".join(t[3] for t in turns if t[2] == "assistant")
    one = got[1]["formatted"]
    assert one.count("<|im_start|>") == 2 and one.count("<|im_sep|>") == 3 and "[INST]" not in got[None]["formatted"]
    masks = {r["conv_id"]: (r["formatted"], r["loss_mask"]) for r in made.collect()}
    text, at = "", 0
    for m in masks[1][1]:
        at += m["skip"]
        text += masks[1][0][at : at + m["take"]]
        at += m["take"]
    assert text == "A\nBA\nB"
    assert chat_format.format_chat(convs.limit(0)).count() == 0


def test_mix(spark, docs, empty):
    rows = mixing.mix(spark, docs).collect()
    assert len(rows) == docs.count()
    want_size = Counter((i, len(SEP.findall(t or ""))) for i, t, *_ in base_rows())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == want_size
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * total)
    taken = sum(r["taken"] for r in rows)
    assert taken <= 1.5 * total and taken > 1.5 * total - max(r["size"] for r in rows) - 1
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own) and own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.mix(spark, docs.repartition(5)).collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))
    assert mixing.mix(spark, empty).count() == 0 == mixing.take(spark, empty).count()


def test_taken_words_are_those_of_the_plan(spark):
    """Ids that repeat with other texts or sources, rows without an id, equal rows, and columns with clashing names."""
    r = np.random.default_rng(8)
    rows = [(None if i % 3 == 0 else i // 2 % 40, " ".join(["w"] * int(r.integers(0, 12))), "u" if i % 5 else None, i % 2, 1, 2) for i in range(240)]
    rows += rows[:30]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, __row int, times int")
    plan = mixing.mix(spark, frame).collect()
    out = mixing.take(spark, frame)
    got = out.collect()
    assert out.columns == frame.columns
    want = Counter()
    for p in plan:
        want[(p["doc_id"], p["source"], p["size"])] += p["copies"]
    assert Counter((x["doc_id"], x["source"], len(SEP.findall(x["text"]))) for x in got) == +want
    given = Counter(rows)
    assert all(n <= 2 * given[tuple(x)] for x, n in Counter(map(tuple, got)).items())


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_plan(spark, sizes).collect()}
    # weights 3, 1, 2 and 3; a stops at 20, c at 0, null at 180; the rest is b's
    assert got == {"a": 20.0, "c": 0.0, None: 180.0, "b": pytest.approx(1650 - 200)}


def test_secrets(spark, docs, empty, tmp_path):
    texts = ['password = "abcdefgh1"; Token:short secret=token=abcdefghij', "password: secret: abcdefgh12", "AKIA1234567890AB AKIA12 xAKIAAKIAAKIAAKIA", "ab" * 16 + "g" + "0" * 31, "é🙂 API_KEY='" + "Z" * 9 + "' " + "f" * 40, "ſecret=abcdefghij", "api_key: 12345678 apikey=x=======1", "-----BEGIN RSA PRIVATE KEY-----"]
    frame = spark.createDataFrame([*((1000 + i, t) for i, t in enumerate(texts)), (1000, texts[4])], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = Counter(map(tuple, secret_scan.query(spark, frame).collect()))
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0, 16, 0), ("hex", "[0-9a-f]+", 0, 32, 0)]
    want = Counter()
    for i, t in [(r["doc_id"], r["text"]) for r in frame.collect()]:
        found, n = [], []
        for k, (kind, p, group, least, flags) in enumerate(kinds):
            own = [m for m in re.finditer(p, t or "", flags) if len(m[group]) >= least]
            n.append(len(own))
            found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in own]
        base = ",".join(x[2] for x in sorted(found))
        found += [(m.start(), 3, f"pem:{m.start()}:{m.end()}") for m in re.finditer("-----BEGIN [A-Z ]*PRIVATE KEY-----", t or "")]
        want[(i, *n, hashlib.sha256(base.encode()).hexdigest(), ",".join(x[2] for x in sorted(found)))] += 1
    assert got == want
    assert secret_scan.query(spark, empty).count() == 0


def test_secret_ledger_is_incremental(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([(1, "AKIA1234567890AB"), (2, "AKIA1234567890AB"), (3, "clean")], "doc_id long, text string")
    secret_scan.scan_secrets(spark, one, ledger, secret_scan.RULES).collect()
    assert spark.read.parquet(ledger).count() == 2 * 3
    two = one.union(spark.createDataFrame([(4, "new")], one.schema))
    out = secret_scan.scan_secrets(spark, two, ledger, (*secret_scan.RULES, secret_scan.Rule("word", "clean"))).collect()
    assert spark.read.parquet(ledger).count() == 3 * 3 + 3  # the new blob for all rules, the old ones for the new rule
    assert {r["doc_id"]: r["findings"] and r["findings"][0]["kind"] for r in out} == {1: "access", 2: "access", 3: "word", 4: None}


def test_seen_texts_are_kept_out(spark, tmp_path, monkeypatch):
    """With more unseen blobs than are broadcast: a second scan packs what is new, and the odd one that the filter lets by."""
    monkeypatch.setattr(secret_scan, "BROADCAST_BLOBS", 0)
    ledger, packed, pack = f"file://{tmp_path}/ledger", tmp_path / "packed", secret_scan._pack
    packed.mkdir()

    def counted(batches, words=None):
        import os
        import uuid

        for b in pack(batches, words):
            os.mkdir(f"{packed}/{len(b)}-{uuid.uuid4().hex}")
            yield b

    monkeypatch.setattr(secret_scan, "_pack", counted)
    texts = [f"text {i} token=abcdefgh{i % 7}" for i in range(600)]
    frame = lambda t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(4)

    def scan(t):
        out = secret_scan.scan_secrets(spark, frame(t), ledger, secret_scan.RULES).collect()
        n = sum(int(p.name.split("-")[0]) for p in packed.iterdir())
        for p in packed.iterdir():
            p.rmdir()
        return {r["doc_id"]: r["findings"] for r in out}, n

    first, n = scan(texts)
    assert n == 600 and all(len(f) == 1 for f in first.values())
    assert scan(texts) == (first, 0)
    more, n = scan(texts + [f"new {i} secret=abcdefghij" for i in range(40)])
    assert 40 <= n < 60 and len(more) == 640 and all(len(f) == 1 for f in more.values())


NASTY = ["", " ", "a", "The  double", "tail ", " head", "line\nbreak,\nand. more\n\nblank", "tab\there \t x", "it's we'll 'sword", "x<|endoftext|>y", "<|startoftext|>", "a <|STARTOFTEXT|> b", "x<|EndOfText|>", "É́cole é ﬁ", "a b   c", "\x1c odd \x1f", "\x01mark \x01", "日本語 テキスト", "🙂🙂 ok", "end. end, End.,", "İstanbul ΣΑΣ", "12345 6,7", "\r\nwin\r\n"]
#: Lower-casing and NFC do not commute here: each first letter has no composed form with the mark, its lower case has.
NASTY += ["a b\u1fb9\u0342\u0345 c", *(f"x {c}{m} y" for c in "\u0389\u038f\u1fba\u1fbb\u1fca\u1fcb\u1ffa\u1ffb" for m in "\u0345"), *(f"x {c}\u0301 y" for c in "\u03aa\u03ab\u1fbc\u1fcc\u1ffc")]


def mixed_texts(n):
    """Words of letters with and without composed forms, combining marks anywhere, control tokens and odd white space."""
    r = random.Random(5)
    marks = [chr(c) for c in (*range(0x300, 0x315), 0x323, 0x327, 0x328, 0x342, 0x345, 0x3099, 0x5B0, 0x93C, 0x11A8)]
    letters = [*"abcDEFxyzXYZ01.,!'-_/|<>", "'s", "'LL", *"\u0130\u03a3\u03c2\u1e9e\u00df\u212b\u00c5\u212a\u023a\u023e\u0181\u00c9\u00e9\u00d1\u0386\u0389\u1fbc\u03aa\u1f88\ufb01\u65e5\u1100\uac00\u304b\U0001f642\u0915\u01c5\u017f\u0416", "<|endoftext|>", "<|STARTOFTEXT|>"]
    spaces = [" "] * 12 + ["  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\x85", "\x1c", "\x01", "\u3000", "\u200b"]
    word = lambda: "".join(r.choice(letters) + (r.choice(marks) if r.random() < 0.25 else "") for _ in range(r.randint(1, 4)))
    return ["".join(word() + r.choice(spaces) for _ in range(r.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_unit_encoder(name, monkeypatch):
    from tokenizers import Tokenizer

    import docspark.llm.tokens as tokens

    monkeypatch.setattr(tokens, "KEEP", 150)  # generations turn over
    enc, plain = UnitEncoder(P.path(name)), Tokenizer.from_file(P.path(name))
    assert enc.mode in ("prefix", "drop")
    texts = NASTY + [t or "" for _, t, *_ in base_rows()] + mixed_texts(3000)
    for part in (texts, texts[::-1], texts):
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(part)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_token_store_finds_an_id_of_many_rows(spark):
    """An id and the lack of one that a third of the rows share each, over several tasks and shards."""
    rows = [(6 if i % 3 == 0 else None if i % 3 == 1 else i, f"{i % 40} text {i}") for i in range(600)]
    path = Scratch(spark, "test").path("store")
    manifest = token_store.write_store(spark, spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("byte_bpe_50k.json"), shard_bytes=300)
    assert manifest.filter("lo <= 6 AND hi >= 6").count() > 3
    found = token_store.lookup(manifest, spark.createDataFrame([(6,), (8,)], "doc_id long")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in found} == {6: 200, 8: 1}
    back = token_store.read_store(manifest).collect()
    assert Counter(r["doc_id"] for r in back) == Counter(i for i, _ in rows)
    at = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_token_store(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate(NASTY)], SCHEMA)
    every = docs.unionByName(extra)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in every.collect()))
    want, at = [], 0
    for known, i, t in rows:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        want.append((i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    path = Scratch(spark, "test").path("store")
    manifest = token_store.write_store(spark, every, path, P.path("byte_bpe_50k.json"), shard_bytes=2000)
    assert manifest.count() > 3
    assert Counter(map(tuple, token_store.read_store(manifest).collect())) == Counter(want)
    asked = spark.createDataFrame([(7,), (14,), (10_003,), (5,)], "doc_id long")
    asked = asked.unionByName(spark.createDataFrame([(None,), (7,), (10**15,), (-5,)], "doc_id long"))
    for many, most in ((1, 10**6), (256, 10**6), (256, 0)):  # whole shards, short reads, ranges joined
        monkeypatch.setattr(token_store, "MANY_KEYS", many)
        monkeypatch.setattr(token_store, "MOST_RANGES", most)
        found = Counter((r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in token_store.lookup(manifest, asked).collect())
        assert found == Counter((i, c) for i, _, _, c in want if i in (7, 14, 10_003))
    ranges = manifest.orderBy("part", "seq").select("lo", "hi").collect()
    assert all(a["hi"] is None or a["hi"] <= b["lo"] for a, b in zip(ranges, ranges[1:], strict=False))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = token_store.query(spark, every)
    assert whole.columns == columns and Counter(map(tuple, whole.collect())) == Counter(want)
    assert token_store.read_store(token_store.write_store(spark, empty, path + "-none", P.path("byte_bpe_50k.json"))).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert token_store.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_hilbert_is_a_curve():
    pts = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    key = packing.hilbert(pts, 3)
    steps = np.abs(np.diff(pts[np.argsort(key)], axis=0)).sum(1)
    assert sorted(key.tolist()) == list(range(512)) and (steps == 1).all()


def test_packing(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "RANGE_TOKENS", 3000)
    pieces = packing.pack(spark, docs, packing.vocabulary(), length=256, with_ids=True).collect()
    want = Counter()
    for i, t, *_ in base_rows():
        want[(i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1]))] += 1
    by = defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        by[p["sequence_id"]].append(p)
    assert sorted(by) == list(range(len(by)))
    line = []
    for s in sorted(by):
        own = sorted(by[s], key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(p["length"] for p in own) == 256 or s == len(by) - 1
        line += own
    got, at = Counter(), 0
    while at < len(line):
        ids = []
        doc, n = line[at]["doc_id"], line[at]["doc_tokens"]
        while len(ids) < n:
            assert line[at]["doc_id"] == doc and line[at]["start"] == len(ids)
            ids += line[at]["ids"]
            at += 1
        got[(doc, tuple(ids))] += 1
    assert got == want
    assert packing.pack(spark, empty, packing.vocabulary()).count() == 0
    whole = packing.query(spark, docs)
    assert whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = whole.collect()
    assert sum(p["length"] for p in rows) == sum(len(ids) for _, ids in want.elements()) and max(p["length"] for p in rows) <= 2048


def test_quality(spark, docs, empty):
    good = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(20 + i % 30)) + ".", i, 1) for i in range(150)]
    bad = [(1000 + i, " ".join(["SPAM!!"] * (15 + i % 20)), i, 0) for i in range(60)]
    frame = spark.createDataFrame([(a, b) for a, b, *_ in good + bad], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(a, q, 0) for a, _, _, q in good + bad] + [(5, None, 0), (6, 3, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(spark, frame, labels).collect()
    assert len(rows) == frame.count()
    truth = {a: q for a, _, _, q in good + bad}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth and r["doc_id"] > 900]
    assert judged and all(a == b for a, b in judged)
    # plain class densities, by numpy alone
    texts = [(r["doc_id"], r["text"]) for r in frame.collect()]
    known = {i: q for i, q in [*truth.items(), (5, None), (6, 3)] if q in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1}
    want = plain_scores([t for _, t in texts], [known.get(i) for i, _ in texts])
    got, brute = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r["score"])
    for (i, _), s in zip(texts, want, strict=True):
        brute[i].append(s)
    assert all(sorted(got[i]) == pytest.approx(sorted(brute[i]), rel=1e-4, abs=1e-9) for i in brute)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Counter(map(tuple, quality.classify(spark, frame, flipped).collect())) == Counter(map(tuple, rows))
    alone = quality.classify(spark, frame, labels.limit(0)).collect()
    assert {r["score"] for r in alone} == {0.5}
    assert quality.classify(spark, empty, labels).count() == 0
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    few = quality.fit(spark, frame, labels, most=20)  # a bounded number of labelled rows
    assert few.means.shape[0] in (0, 2)


def test_bm25(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(bm25_search, "QUERY_BLOCK", 8)
    monkeypatch.setattr(bm25_search, "SHARD_DOCS", 50)
    rows = [(i, t or "") for i, t, *_ in base_rows() if i is not None]
    tf = [Counter(re.findall(r"\w+", t.lower())) for _, t in rows]
    n, df, length = len(rows), Counter(w for c in tf for w in c), [sum(c.values()) for c in tf]
    average = sum(length) / n
    queries = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows[::5])] + [(9000, None), (9001, "unknownword")], "query_id long, text string")
    got = defaultdict(list)
    for r in sorted(bm25_search.search(spark, docs, queries, k=7).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for q, (_, t) in enumerate(rows[::5]):
        scores = []
        words = Counter(re.findall(r"\w+", t.lower()))
        for (i, _), c, size in zip(rows, tf, length, strict=True):
            s = sum(k * max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / average)) for w, k in words.items() if w in c)
            if s > 0:
                scores.append((round(s, 9), i))
        want = sorted(scores, key=lambda x: (-x[0], x[1]))[:7]
        assert [round(s, 6) for _, s in got[q]] == pytest.approx([round(s, 6) for s, _ in want], abs=2e-6)
        assert [i for i, _ in got[q]] == [i for _, i in want]
    assert 9000 not in got and 9001 not in got
    assert bm25_search.search(spark, empty, queries).count() == 0


def test_bm25_skips_blocks():
    """Two kinds of documents: a query of one kind leaves the other kind's blocks unscored, and finds what all blocks hold."""
    r = np.random.default_rng(2)
    kinds = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    found = [bm25_search.terms(" ".join([f"top{c}"] * 30 + list(r.choice(kinds[c], 40)))) for c in (0, 1) for _ in range(640)]
    vocab, term = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
    ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in found])])
    length = np.array([c.sum() for _, c in found])
    arrays = {"ids": np.arange(len(found)), "length": length, "vocab": vocab, "ptr": ptr, "term": term.astype(np.int32), "tf": np.concatenate([c for _, c in found]).astype(np.int32)}
    shard = bm25_search.Shard(arrays, length.mean())
    weight = bm25_search.idf(np.bincount(term), len(found))
    queries = [(t, c * weight[np.searchsorted(vocab, t)]) for t, c in (found[5], found[700])]
    best = [[], []]
    shard.search(queries, best, 10, [0, 1])
    assert shard.passed <= shard.scored <= 0.55 * shard.possible
    for hits, (t, w) in zip(best, queries, strict=True):
        every = sorted((-shard.exact(d, np.searchsorted(vocab, t), w), d) for d in range(len(found)))
        assert hits == every[:10]


def test_bm25_batches_fill(monkeypatch):
    """Queries that have nothing in common share batches all the same, and few blocks of many queries open many shards."""
    r = np.random.default_rng(6)
    found = [bm25_search.terms(" ".join([f"w{int(i)}" for i in r.zipf(1.3, 60) if i < 5000] + [f"top{n}"] * 9)) for n in range(400)]
    vocab, term = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
    ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in found])])
    length = np.array([c.sum() for _, c in found])
    arrays = {"ids": np.arange(len(found)), "length": length, "vocab": vocab, "ptr": ptr, "term": term.astype(np.int32), "tf": np.concatenate([c for _, c in found]).astype(np.int32)}
    shard = bm25_search.Shard(arrays, length.mean())
    weight, sizes, own = bm25_search.idf(np.bincount(term), len(found)), [], shard._batch
    monkeypatch.setattr(shard, "_batch", lambda q, best, k: (sizes.append(len(q)), own(q, best, k)))
    queries = [(t, c * weight[np.searchsorted(vocab, t)]) for t, c in found[:256]]
    best = [[] for _ in queries]
    shard.search(queries, best, 10, list(range(256)))
    assert len(sizes) <= 8
    for hits, (t, w) in zip(best, queries, strict=True):
        every = sorted((-shard.exact(d, np.searchsorted(vocab, t), w), d) for d in range(len(found)))
        assert hits == [h for h in every[:10] if h[0] < 0]
    # with many shards there is a block for each 16,384 queries, and not for each 2,048
    assert bm25_search.query_blocks(5_130, 32, 18) == 3 and bm25_search.query_blocks(62_000, 200, 36) == 4


def test_bm25_a_pair_is_a_task(spark, monkeypatch):
    """Each pair of a group of shards and a block of queries is a task of its own; by a hash several met in one."""
    import re

    from docspark.llm import bm25_search

    for name, value in (("SHARD_DOCS", 3), ("QUERY_BLOCK", 4), ("MOST_QUERIES", 4)):
        monkeypatch.setattr(bm25_search, name, value)
    docs = spark.createDataFrame([(i, f"w{i % 5} v{i % 3} u") for i in range(12)], "doc_id long, text string").coalesce(1)
    found = bm25_search.search(spark, docs, docs.selectExpr("doc_id AS query_id", "text"), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.search(r"Range \(0, (\d+), step=1, splits=Some\((\d+)\)\)", plan)
    assert dealt and int(dealt[1]) == int(dealt[2]) > 1 and "Window" not in plan
    assert found.groupBy("query_id").count().filter("count = 3").count() == 12
