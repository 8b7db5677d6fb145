"""The library's queries over small tables of their own, held against plain Python."""

import math
import random
import re

import pytest

from docspark import queries as Q
from docspark.evaluate import holders
from docspark.functions.embed import HashEmbedder
from docspark.operators.asof import as_of, pages_of
from docspark.operators.chunk import chunk_text, page_of
from docspark.operators.keyword import keyword_top, text_index
from docspark.plans.batch import asked_phrases, keyword_lists


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes documents (id, text) and unit vectors of some ids; gives the folder."""

    def write(texts, vectors=()):
        rows = [(i, t, "en", f"src{i % 2 + 1}", len(t or "")) for i, t in texts]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        unit = [(i, [1.0 if j == i % 4 else 0.0 for j in range(4)], i % 10) for i in vectors]
        spark.createDataFrame(unit, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return write


def bm25(texts, words):
    """Scores by id, of plain lower-case texts."""
    found = {i: re.findall(r"\w+", t.lower()) for i, t in texts}
    n, average, out = len(found), sum(map(len, found.values())) / len(found), {}
    for w in words:
        df = sum(w in t for t in found.values())
        idf = math.log((n - df + 0.5) / (df + 0.5)) if df else 0
        for i, t in found.items():
            if tf := t.count(w):
                out[i] = out.get(i, 0) + (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
    return out


def test_documents_without_a_vector_are_searched(spark, tables):
    texts = [(i, f"plain filler number{i} " * (i % 3 + 1)) for i in range(20)]
    texts += [(20, "eau and hetion here"), (21, "ering once, then eau"), (22, "hetion alone in a longer text of words")]
    d = tables(texts, range(5))
    want = {i: round(s, 6) for i, s in bm25(texts, Q.WORDS).items()}
    assert {r["id"]: r["keyword_score"] for r in Q.keyword_only(spark, d).collect()} == want and set(want) == {20, 21, 22}
    rows = Q.rrf_hybrid(spark, d).collect()
    assert {r["id"] for r in rows} == {0, 1, 2, 3, 4, 20, 21, 22}
    assert {r["id"]: r["keyword_score"] for r in rows if r["keyword_rank"]} == want
    assert {r["id"] for r in Q.hits_with_text(spark, d).collect()} == {0, 1, 2, 3, 4, 20, 21, 22}


def test_ask_reads_whole_documents(spark, tables):
    begin = "Plain filler sentence of the beginning. " * 40
    told = "The hetion and the ering of an eau are told here."
    d = tables([(3, begin + told), (4, begin + "Nothing of it."), *((i, f"other {i}") for i in range(5, 12))])
    got = Q.ask_extractive(spark, d).first()
    assert got["found"] and got["answer"].startswith(told)
    assert [i >> 20 for i in got["cited"]] == [3] and got["cited"][0] % (1 << 20) > 0


def test_snippets_of_all_documents(spark, tables):
    texts = [(0, "plain " * 20), (1, "é" * 40), (2, "a" + "é" * 40), (3, "कंपन रखरखाव\n" * 5), (4, "a😀" * 20), (5, "é" * 30), (6, ""), (7, None), (8, "x" * 59 + "é")]

    def cut(text):
        line = re.sub("[\r\n]", " ", text)
        return line if len(line.encode()) <= 60 else line.encode()[:60].decode(errors="ignore") + "..."

    got = {r["doc_id"]: r["snippet"] for r in Q.snippets(spark, tables(texts)).collect()}
    assert got == {i: None if text is None else cut(text) for i, text in texts}


def test_overlap_dedupe_takes_the_best_passages(spark, tables):
    texts = [(0, "hetion ering eau"), (1, "hetion ering eau"), (2, "hetion hetion hetion"), *((i, f"nothing {i} here") for i in range(3, 12))]
    got = [(r["doc_id"], r["offset"]) for r in Q.overlap_dedupe(spark, tables(texts)).collect()]
    scores = bm25(texts, Q.WORDS)
    order = [i for i in sorted(scores, key=lambda i: (-scores[i], i)) if i != 1]
    assert got == [(str(i), 0) for i in order]


def test_term_df_has_rare_terms(spark, tables):
    got = {r["term"]: (r["tf"], r["df"]) for r in Q.term_df(spark, tables([(0, "rare common common"), (1, "common"), (2, None)])).collect()}
    assert got == {"rare": (1, 1), "common": (3, 2)}


def test_recall_is_of_the_engines_search(spark, tables):
    """The passage alone, or among 4,000 other words, where ten short texts of its rarest words stand before it; one passage is nowhere."""
    told = "alpha beta gamma"
    texts = [(0, f"{told} " + "long " * 4000), *((i, "alpha beta") for i in range(1, 12)), (12, "delta epsilon"), *((i, f"other {i}") for i in range(13, 60))]
    d = tables(texts)
    items = [(0, told), (1, "delta epsilon"), (2, "zeta eta")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    place = lambda words, i: sorted((-s, j) for j, s in bm25(texts, words.split()).items()).index((-bm25(texts, words.split())[i], i))
    assert place(told, 0) >= 10 and place("delta epsilon", 12) == 0
    assert tuple(Q.recall_at_10(spark, d).first()) == (2, 0.5)


def test_batched_keyword_search_is_the_single_one(spark):
    rows = spark.createDataFrame([(0, "a b c"), (1, "b b x-y"), (2, "x y"), (3, "c c d"), (4, None)], "id long, text string")
    queries = spark.createDataFrame([(7, "b b"), (8, "x-y c"), (9, "nowhere")], "query_id long, text string")
    index = text_index(rows, asked_phrases(queries).selectExpr("explode(words) AS term"))
    got = [(r["query_id"], r["id"], round(r["keyword_score"], 9)) for r in keyword_lists(index, queries, 2).orderBy("query_id", "keyword_rank").collect()]
    assert got == [(q, r["id"], round(r["score"], 9)) for q, text in queries.collect() for r in keyword_top(rows, text, 2).collect()]


def test_holders_are_found_whatever_stands_around(spark):
    texts = ["unalpha beta gamma delta epsilonic", "alpha  beta gamma delta epsilon", "x alpha beta", "alphabet", None, "", "alpha beta gamma delta epsilon twice alpha beta gamma delta epsilon"]
    asked = [(0, "alpha beta gamma delta epsilon"), (1, "alpha beta"), (2, "alpha"), (3, ""), (4, None), (5, "beta gamma delta epsilon twice")]
    rows, questions = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    index = text_index(rows, asked_phrases(questions).selectExpr("explode(words) AS term"))
    got = {tuple(r) for r in holders(rows, questions, index).collect()}
    assert got == {(q, i) for q, a in asked for i, t in enumerate(texts) if a is not None and t is not None and a in t}


def test_embedded_documents(spark, tables):
    """The vectors of the passages, one by one."""
    texts = [(0, "One paragraph.\n\n" * 90), (1, "Éa"), (2, ""), (3, None)]
    got = {(r["doc_id"], r["chunk_index"]): r["embedding"] for r in Q.embed_documents(spark, tables(texts)).collect()}
    want = {}
    for i, t in texts:
        for k, (o, n, _) in enumerate(chunk_text(t or "")):
            want[i, k] = HashEmbedder(16).embed([(t or "").encode()[o : o + n].decode()])[0].tolist()
    assert got == want and len(want) > 2


def test_as_of(spark):
    r = random.Random(6)
    marks = [(r.choice(["a", "b", None]), r.choice([None, *range(0, 4000, 7)]), r.choice([None, 1, 2, 3])) for _ in range(200)]
    rows = [(r.choice(["a", "b", "c", None]), r.choice([None, *range(-5, 4000)]), i) for i in range(300)]
    schema = "g string, t long, {} int"
    found = lambda width: as_of(spark.createDataFrame(rows, schema.format("value")), spark.createDataFrame(marks, schema.format("v")), "g", "t", "v", width)

    def plain(g, t):
        own = [(m[1], m[2]) for m in marks if g is not None and t is not None and m[0] == g and m[1] is not None and m[1] <= t and m[2] is not None]
        return max(own)[1] if own else None

    for width in (1 << 20, 50):
        assert sorted(found(width).collect(), key=lambda x: x["value"]) == [(g, t, i, plain(g, t)) for g, t, i in rows]


def test_pages_of(spark):
    starts = spark.createDataFrame([("a", 0), ("a", 100), ("a", 100), ("a", 250), ("b", 50), ("x", None)], "doc_id string, page_start long")
    offsets = [("a", 0), ("a", 99), ("a", 100), ("a", 249), ("a", 9999), ("b", 10), ("b", 60), ("c", 5), ("x", 5)]
    got = {(r["doc_id"], r["offset"]): r["page"] for r in pages_of(spark.createDataFrame(offsets, "doc_id string, offset long"), starts).collect()}
    by = {"a": [0, 100, 250], "b": [50]}
    assert got == {(d, o): page_of(o, by.get(d, [])) for d, o in offsets}
