"""Source divergence, token counts and vector codes against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docspark.llm import source_divergence, token_counts, vector_codes
from docspark.llm.common import Scratch

P = pytest.importorskip("public_tokenizers")


# source divergence


def plain_audit(rows, least=3, top=200):
    """By dictionaries and Python's integers, every pair for every term."""
    docs = [[x or "" for x in r] for r in rows]
    found = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]) for t, lang, source in docs]
    df, n, groups, out = Counter(), Counter(), defaultdict(set), []
    for lang, source, words in found:
        groups[lang].add(source)
        df.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    for lang, sources in groups.items():
        kept = [w for (x, w), k in df.items() if x == lang and k >= least]
        total = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        p = lambda count, of: 1 + 10**9 * (count + 1) // (of + len(kept))  # noqa: E731, B023
        in_lang = {w: sum(n[lang, s, w] for s in sources) for w in kept}
        for s in sources:
            pairs = {t: sum((p(n[lang, s, w], total[s]) - p(n[lang, t, w], total[t])) ** 2 // p(n[lang, t, w], total[t]) for w in kept) for t in sources - {s}}
            terms = {}
            for w in kept:
                a, q = p(n[lang, s, w], total[s]), p(in_lang[w], sum(total.values()))
                if n[lang, s, w] and a > q:
                    terms[w] = (a - q) ** 2 // q
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(values, key=lambda x: (-values[x], x.encode()))[:most]  # noqa: B023
                out += [(lang, s, part, x, values[x], i) for i, x in enumerate(order, 1)]
    return sorted(out)


def audit_rows():
    r = random.Random(8)
    words = ["ab", "Ab", "c'd", "é", "É", "ß", "日本語", "x1y", "z_z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(r.choice(words) for _ in range(r.randrange(1, 40))), r.choice(["en", "fr"]), f"s{min(r.randrange(9), 6)}") for _ in range(120)]
    rows += [("same text here", "de", "s1")] * 5 + [("same text here", "de", "s2")] * 2  # ties and repeats
    rows += [("only once each", "xx", "a"), ("nothing else kept", "xx", "b"), ("", "xx", "c"), (None, "xx", None)]  # no kept term
    rows += [("ab ab", None, None), ("ab", None, "s1"), ("AB-ab 12", "", ""), ("lone lone lone", "one", "one")]
    rows += [("long ab é " * 3000, "en", "s0"), ("\x00\x7f@[`{~", "en", "s8"), ("ﬁ 😀😀", "en", "s8")]
    return rows


@pytest.fixture(scope="module")
def audited(spark):
    rows = [(*r, i % 5, "x", None) for i, r in enumerate(audit_rows())]
    return spark.createDataFrame(rows, "text string, lang string, source string, n int, term string, i string").repartition(5)


@pytest.mark.parametrize("block", [256, 2])
def test_source_divergence(spark, audited, block):
    """Also with a matrix of many blocks."""
    got = sorted(map(tuple, source_divergence.audit(spark, audited, block=block).collect()))
    assert got == plain_audit(audit_rows())


def test_source_divergence_ranks_and_limits(spark, audited):
    got = sorted(map(tuple, source_divergence.audit(spark, audited, least=1, top=3).collect()))
    assert got == plain_audit(audit_rows(), 1, 3)
    assert source_divergence.audit(spark, spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_counts_are_given_away_in_parts(monkeypatch):
    """What a task holds is bounded, and what it gives away adds up."""
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "KEEP", 20)

    class Frame:
        """Takes the function that the operator gives to Spark."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            Frame.run = staticmethod(run)
            raise StopIteration

    with pytest.raises(StopIteration):
        source_divergence.term_counts(Frame())
    rows = [(f"w{chr(97 + i % 7)} {chr(97 + i % 26) * 3}", "en", f"s{i % 3}") for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 200), pa.array([r[2] for r in rows]), pa.array([r[0].encode() for r in rows], pa.binary())], ["lang", "source", "text"])
    parts = list(Frame.run([batch]))
    assert len(parts) > 20 and max(map(len, parts)) <= 22
    got = Counter()
    for b in parts:
        for x in b.to_pylist():
            got[x["source"], x["term"]] += x["n"]
    want = Counter((s, w.encode()) for t, _, s in rows for w in t.split())
    assert {k: v for k, v in got.items() if k[1]} == want


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(2000):
        total = r.randrange(1, 2 * 10**14) if r.random() < 0.5 else r.randrange(1, 50)
        count = r.randrange(0, total)
        assert source_divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def test_share_column_is_exact(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(c, t) for t in (r.randrange(1, 2 * 10**14) for _ in range(300)) for c in (0, r.randrange(0, t), t - 1)]
    frame = spark.createDataFrame(rows, "c long, t long")
    got = frame.select("c", "t", source_divergence.share_column(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(x["p"] == 1 + 10**9 * (x["c"] + 1) // x["t"] for x in got)


# token counts


def token_rows():
    r = random.Random(1)
    texts = ["", None, "a" * 3000, "short", " " * 2000, "<|endoftext|>" * 300, "é😀" * 900, "\n\n \t" * 700, "word " * 3000]
    bits = ["a", "bc", "'re", "'s", " ", "  ", "\n", "é", "😀", "12", "!!", "<|endoftext|>", "<|endo", "ftext|>", "　", "words", "’", "的", "'", "é"]
    texts += ["".join(r.choice(bits) for _ in range(r.randrange(900))) for _ in range(120)]
    texts += ["".join(r.choice("abc") for _ in range(700)) + " " + "x" * r.randrange(100, 400) + " y" * 100 for _ in range(10)]
    return [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(1, texts[9], "x", 1)] * 2


@pytest.mark.parametrize(("long", "overlap"), [(200, 40), (64, 20), (100, 8), (65_536, 512)])
def test_token_counts(spark, long, overlap):
    """Chunks of a few words and overlaps that often, or always, have to widen."""
    from tokenizers import Tokenizer

    tool, rows = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_rows()
    want = Counter((i, len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, key int").repartition(3)
    got = token_counts.count_tokens(spark, frame, P.path("byte_bpe_50k.json"), long=long, overlap=overlap)
    assert Counter(map(tuple, got.collect())) == want


def test_token_counts_of_other_vocabularies(spark):
    """Those whose texts cannot be cut get them whole; sentencepiece too."""
    import sentencepiece
    from tokenizers import Tokenizer

    rows = token_rows()[:40]
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, key int")
    tool, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for path, count in ((P.path("word_bpe_49k.json"), lambda t: len(tool.encode(t, add_special_tokens=False).ids)), (P.path("piece_bpe_32k.model"), lambda t: len(pieces.encode(t)))):
        got = Counter(map(tuple, token_counts.count_tokens(spark, frame, path, long=100, overlap=20).collect()))
        assert got == Counter((i, len((t or "").encode()), count(t or "")) for i, t, *_ in rows) and token_counts.splice_margin(path) is None


def test_token_count_query(spark, tmp_path):
    frame = spark.createDataFrame([(1, "word " * 512), (2, "word " * 511), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in token_counts.query(spark, frame).collect()}
    assert got == {1: (513, True), 2: (512, False), 3: (0, False)}  # the last space is a token
    assert token_counts.query(spark, frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark, frame, P.path("byte_bpe_50k.json"), long=10, overlap=10)
    # special strings that meet, or take white space along, are not cut
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    first = spec["added_tokens"][0]
    for tokens, margin in (([first], token_counts.MARGIN + 13), ([first | {"content": "<a>"}, first | {"content": ">b"}], None), ([first | {"lstrip": True}], None), ([first | {"content": "aXa"}], None)):
        (tmp_path / "v.json").write_text(json.dumps({k: v for k, v in spec.items() if k != "model"} | {"added_tokens": tokens}))
        assert token_counts.splice_margin(f"{tmp_path}/v.json") == margin


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Rows of (vec_id, vector, label): codes and errors by plain Lloyd rounds over Python's integers."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(cut(v)[p], books[p])].append(cut(v)[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else b for e, b in enumerate(books[p])]
    out, by = [], Counter()
    for i, v, label in kept:
        code = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(far(x, books[p][c]) for p, (x, c) in enumerate(zip(cut(v), code, strict=True)))
        by[label] += error
        out.append((i, "".join(f"{c:02x}" for c in code), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, by[label], digest) for i, code, error, label in out)


def vector_rows(n, dim=16, grid=4):
    """Coarse vectors, so that distances tie; rows that are dropped, repeat, or lack an id or a label."""
    r = np.random.default_rng(n)
    rows = [(i * 3 + 5, (r.integers(-grid, grid + 1, dim) / grid).tolist(), int(i % 3) if i % 4 else None) for i in range(n)]
    rows += [(rows[1][0], rows[1][1], 7), (rows[2][0], rows[3][1], 1), (None, rows[0][1], 2), (None, [0.3] * dim, None), (9000, rows[0][1], 2)]
    return rows + [(0, None, 1), (1, [float("nan")] * dim, 1), (2, [float("inf")] + [0.0] * (dim - 1), 1), (3, [None] + [0.5] * (dim - 1), None)]


SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, code string"


@pytest.mark.parametrize("n", [4, 12, 200])
def test_vector_codes(spark, n):
    rows = [(*r, "k", 1, "c") for r in vector_rows(n)]
    got = vector_codes.query(spark, spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_codes(vector_rows(n))


def test_bounds_spare_most_comparisons(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + 0.05 * r.normal(size=32)).astype(np.float32).tolist(), 0) for i in range(600)]
    done = vector_codes.compress(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert done.scanned[0] == 600 * 8 and done.scanned[-1] < 600 * 8 / 5
    want = plain_codes(rows)
    assert Counter((i, e) for i, _, e, *_ in want) == Counter((x["vec_id"], x["error"]) for x in done.rows.collect())


def test_vector_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.query(spark, empty).count() == 0
    odd = [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1), (3, [1.0] * 7, 1), (4, [], 1), (5, [0.0] * 8, 1)]
    got = vector_codes.query(spark, spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")).collect()
    assert {x["vec_id"] for x in got} == {1, 5}  # those of the first one's size
    with pytest.raises(Exception, match="too large"):
        vector_codes.query(spark, spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int"))


def test_label_errors_of_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS", 4)
    rows = [(i, i % 50 if i % 2 else None, i) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, error long")
    got = {r["vec_id"]: r["label_error"] for r in vector_codes.label_errors(frame, Scratch(spark, "t")).collect()}
    by = Counter()
    for _, label, e in rows:
        by[label] += e
    assert got == {i: by[label] for i, label, _ in rows}
