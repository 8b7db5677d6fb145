"""The pipeline's stages against plain Python over one small corpus."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from docspark.llm import mixing, near_dedup, packing, tokens
from plain import plain_scores, without_repeats

P = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = np.random.default_rng(9)
    vocab = ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(600)]
    line = lambda: (" ".join(r.choice(vocab, r.integers(6, 14)))).capitalize() + "."
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(160):
        lines = [line() for _ in range(r.integers(1, 9))]
        if i % 9 == 0:
            lines[1:1] = shared
        rows.append("\n".join(lines))
    for i in range(20, 30):
        rows[i] = " ".join(line() for _ in range(7))
    rows += rows[:6] + [t.replace(".", ". extra", 1) for t in rows[20:30]]
    rows += [" ".join(["JUNK!!"] * int(n)) for n in r.integers(20, 60, 40)] + [" | ".join(r.choice(vocab, 30)) + " |" for _ in range(40)]
    docs = [(i, t, "en", ["a", "b", None, "a", "c"][i % 5], len(t)) for i, t in enumerate(rows)] + [(900, None, None, "a", None), (901, "", "en", "b", 0)]
    labels = [(i, int(i < 176), 0) for i in range(len(rows)) if i % 2 == 0]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs, labels


def step(spark, sf_dir, k, docs):
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    path = f"{sf_dir}/stage{k}.parquet"
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plain(frame):
    return Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_stages(spark, corpus):
    sf_dir, docs, labels = corpus
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")

    # quality: plain class densities over labelled rows that are not held out
    label = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    scores = plain_scores([t for _, t, *_ in docs], [label.get(i) for i, *_ in docs])
    good = [(i, t) for (i, t, *_), s in zip(docs, scores, strict=True) if s >= 0.5]
    a = step(spark, sf_dir, 0, frame)
    assert a.columns == frame.columns and plain(a) == Counter(good)
    assert {i for i, *_ in docs if i < 176} <= {i for i, _ in good} and not any(176 <= i < 256 for i, _ in good)

    # lines: repeated windows in document order
    fresh = [(i, left) for (i, t), (left, gone) in without_repeats(good).items() if not gone or gone < (t or "").count("\n") + 1]
    b = step(spark, sf_dir, 1, a)
    assert plain(b) == Counter(fresh) and b.columns == frame.columns
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in b.collect())

    # near duplicates: five words, 0.8
    def shingles(t):
        w = WORDS.findall((t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, parent = {i: shingles(t) for i, t in fresh}, {i: i for i, _ in fresh}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    kept = [(i, t) for i, t in fresh if root(i) == i]
    c = step(spark, sf_dir, 2, b)
    assert plain(c) == Counter(kept) and len(kept) < len(fresh)

    # the mix: queues by hash, virtual finish times, cut at the budget
    source = {i: s for i, _, _, s, _ in docs}
    size = {i: len(WORDS.findall(t or "")) for i, t in kept}
    names = sorted({source[i] for i in size}, key=lambda s: (s is None, s or ""))
    entries = []
    for k, s in enumerate(names):
        key = {i: int(hashlib.md5(f"{mixing.SEED}:{i}:{size[i]}".encode()).hexdigest()[:15], 16) for i in size if source[i] == s}
        total, run = sum(size[i] for i in key), 0
        for i in sorted(key, key=lambda i: (key[i], i)):
            run += size[i]
            entries += [((run + e * total) / mixing.WEIGHTS[k % 3], k, key[i], i) for e in range(2)]
    budget, run, copies = 1.5 * sum(size.values()), 0, Counter()
    for _, _, _, i in sorted(entries):
        run += size[i]
        if run > budget:
            break
        copies[i] += 1
    d = step(spark, sf_dir, 3, c)
    assert Counter(r["doc_id"] for r in d.collect()) == +copies

    # packing: every copy's ids in pieces without gaps
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for r in d.collect():
        want[(r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1)] += 1
    pieces = step(spark, sf_dir, 4, d).collect()
    line = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    at, got, done = 0, Counter(), defaultdict(int)
    for p in line:
        assert p["sequence_id"] * 2048 + p["offset"] == at and p["start"] == done[p["doc_id"]] % p["doc_tokens"]
        at += p["length"]
        done[p["doc_id"]] += p["length"]
        if p["start"] + p["length"] == p["doc_tokens"]:
            got[(p["doc_id"], p["doc_tokens"])] += 1
    assert got == want


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, corpus):
    """Ids that repeat with the same or another text, rows without an id, null and very long texts, clashing columns."""
    r = np.random.default_rng(12)
    line = lambda n: " ".join(f"k{x}" for x in r.integers(0, 700, n))
    texts = ["\n".join(line(int(n)) for n in r.integers(5, 30, r.integers(1, 6))) for _ in range(60)]
    long = " ".join(f"z{x}" for x in r.integers(0, 5000, 60_000))
    rows = [(i % 40, texts[i % 60], ["a", None, "b"][i % 3]) for i in range(80)]
    rows += [(3, texts[3], "a")] * 3 + [(None, t, "c") for t in (*texts[:4], texts[0], None, "")] + [(500, long, "a"), (501, long + " tail", "b"), (502, None, None), (503, "", "b"), (504, " ", "b")]
    rows = [(i, t, "en", s, None if t is None else len(t), f"m{k}", k, k, k, k) for k, (i, t, s) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text string, __id int, size int, dedup_lines_stats int, `a.b` int"
    return corpus[0], spark.createDataFrame(rows, schema).repartition(4).cache()


def rows_of(frame):
    return Counter(map(tuple, frame.collect()))


def test_stages_on_odd_rows(spark, odd):
    sf_dir, docs = odd
    given = rows_of(docs)

    # quality: rows as they are, each by its own text
    a = corpus_pipeline.good_quality.whole(spark, docs, sf_dir)
    got = rows_of(a)
    assert a.columns == docs.columns and not got - given
    verdict = {}
    for x, n in given.items():
        assert got[x] in (0, n) and verdict.setdefault(x[1] or "", got[x] > 0) == (got[x] > 0)

    # lines: nothing but texts and their lengths change, and only rows that lost all lines go
    b = corpus_pipeline.fresh_lines.whole(spark, docs, sf_dir)
    assert b.columns == docs.columns
    kept = {x["__text"]: x for x in b.collect()}
    for x in docs.collect():
        y = kept.get(x["__text"])
        if y is None:
            assert x["text"]
            continue
        assert tuple(x)[5:] == tuple(y)[5:] and (x["doc_id"], x["source"]) == (y["doc_id"], y["source"])
        left, own = (y["text"] or "").split("\n"), iter((x["text"] or "").split("\n"))
        assert (y["text"] is None) == (x["text"] is None) and all(any(k == w for w in own) for k in left)
        assert y["n_chars"] == (None if y["text"] is None else len(y["text"]))

    # near duplicates: rows without an id stay, of rows with one id and text one stays
    c = corpus_pipeline.one_of_each.whole(spark, docs, sf_dir)
    got = rows_of(c)
    assert c.columns == docs.columns and not got - given
    assert sum(n for x, n in got.items() if x[0] is None) == sum(n for x, n in given.items() if x[0] is None)
    named = Counter((x[0], x[1]) for x, n in got.items() for _ in range(n) if x[0] is not None)
    assert max(named.values()) == 1
    first = {}
    for i, t in ((x[0], x[1]) for x in given if x[0] is not None):
        first[t] = min(i, first.get(t, i))
    # the long texts, which differ in a word, are one group; all others differ or are equal; texts without words stay all
    long = sorted((t for t in first if t and len(t) > 10_000), key=len)
    del first[long[1]]
    assert set(named) == {(i, t) for t, i in first.items()} | {(i, t) for i, t in ((x[0], x[1]) for x in given) if i is not None and not (t or "").strip()}

    # the mix: each source's words near its target, no row more than twice
    d = corpus_pipeline.mixed.whole(spark, docs, sf_dir)
    got = rows_of(d)
    assert d.columns == docs.columns and all(n <= 2 * given[x] for x, n in got.items())
    size = lambda t: len(WORDS.findall(t or ""))
    words, plan = Counter(), {}
    for x, n in got.items():
        words[x[3]] += n * size(x[1])
    for p in mixing.mix(spark, docs).collect():
        plan[p["source"]] = plan.get(p["source"], 0) + p["taken"]
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in plan.items() if n}

    # packing: every row by itself
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    pieces = corpus_pipeline.packed.whole(spark, docs, sf_dir).collect()
    assert sum(p["length"] for p in pieces) == sum(n * (len(tokenizer.encode(x[1] or "", add_special_tokens=False).ids) + 1) for x, n in given.items())
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(x[0] for x in given.elements())


def test_stages_on_an_empty_table(spark, odd):
    sf_dir, docs = odd
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_two_runs_at_a_time_keep_apart(spark, corpus):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda _: rows_of(corpus_pipeline.run(spark, corpus[0])), range(2))
    assert one == two and one


def test_a_worker_forgets_what_other_operators_kept():
    near_dedup._words.clear()
    enc = tokens.encoder(packing.vocabulary())
    enc.encode(["some words here"])
    assert enc.young and tokens.encoder(packing.vocabulary()) is enc  # kept between tasks of one operator
    list(near_dedup.describe(5, near_dedup.band_table(80))(iter([])))
    assert not tokens._encoders
    sets = near_dedup.Sets(5)
    near_dedup.shingles(b"some words here", 5)
    near_dedup.Sets(5)
    assert near_dedup._words and sets.size == 5
    tokens.encoder(packing.vocabulary())
    assert not near_dedup._words and tokens._encoders
