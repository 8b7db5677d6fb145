"""Questions in one plan against one plan a question."""

import random

import numpy as np
import pytest

from docspark.api import Collection
from docspark.functions.embed import WordEmbedder
from docspark.operators.block_scores import BlockScores, in_order
from docspark.operators.keyword import KeywordIndex, index_terms, text_index
from docspark.operators.lists import LISTS, merged_lists
from docspark.plans import batch
from docspark.plans.batch import TextBlocks, asked_phrases, keyword_lists, search_many
from docspark.plans.hybrid import Query, search

WORDS = ["ash", "birch", "Cedar", "x-ray", "élan", "fir", "gum", "common", "common"]


@pytest.fixture(scope="module")
def tables(spark):
    r, g = random.Random(4), np.random.default_rng(4)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 25))) for _ in range(60)]
    texts += [texts[3]] * 3 + ["", None, "ray x", "x ray ray x x-ray"]
    rows = [(i, f"/{i % 3}/t.txt", t, None if i % 9 == 4 else g.normal(size=4).round(1).astype(np.float32).tolist()) for i, t in enumerate(texts)]
    asked = [(1, "ash common"), (2, "common common birch ash"), (3, "x-ray ÉLAN"), (4, "nowhere"), (5, ""), (6, None), (9, "x-ray x-ray fir ray"), (10, "gum"), (11, "cedar, fir? ash!")]
    questions = [(q, t, g.normal(size=4).astype(np.float32).tolist() if q not in (4, 10) else None) for q, t in asked]
    return (
        spark.createDataFrame(rows, "id long, source_path string, text string, embedding array<float>").repartition(3).cache(),
        spark.createDataFrame(questions, "query_id long, text string, embedding array<float>").repartition(2).cache(), questions,
    )


@pytest.mark.parametrize("blocks", [(4096, 256), (7, 2)])
def test_search_many_is_search(spark, tables, monkeypatch, blocks):
    monkeypatch.setattr(batch, "ROWS_A_BLOCK", blocks[0])
    monkeypatch.setattr(batch, "QUESTIONS_A_BLOCK", blocks[1])
    rows, questions, plain = tables
    index = KeywordIndex(index_terms(rows).cache(), rows.count(), index_terms(rows).groupBy("id").agg({"n_tokens": "first"}).agg({"first(n_tokens)": "sum"}).first()[0])
    allowed = rows.filter("id % 2 = 0").select("id") if blocks[0] == 7 else None
    got = {}
    for r in search_many(rows, questions, index, 6, 1.0, 2.0, allowed).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 12), r["vector_rank"], r["keyword_rank"], r["keyword_score"] and round(r["keyword_score"], 9)))
    for q, text, vector in plain:
        if text is None and vector is None:
            continue
        one = Query(vector=vector, text=text or "", top_k=6, keyword_weight=2.0, mode="hybrid" if vector else "keyword")
        hits = search(rows, one, acl=allowed).collect()
        assert got.get(q, []) == [(h["id"], round(h["score"], 12), h["vector_rank"], h["keyword_rank"], h["keyword_score"] and round(h["keyword_score"], 9)) for h in hits]
    if blocks[0] == 4096:  # the postings of the questions' terms alone do as well
        lists = lambda i: sorted(map(tuple, keyword_lists(i, questions, 6).collect()))
        assert lists(text_index(rows, asked_phrases(questions).selectExpr("explode(words) AS term"))) == lists(index)


def test_ask_many_is_ask(spark, tmp_path):
    embedder = WordEmbedder()
    c = Collection.create(spark, f"file://{tmp_path}/c", embedder)
    texts = ["The pump bearing is replaced every 500 hours. Other facts.", "Employees get twenty days of annual leave.", "The canteen opens at noon.", "The canteen opens at noon."]
    rows = [(f"/d/{i}.txt", 0, f"/d/{i}.txt", 0, len(t), t, "h", 0, embedder.embed([t])[0].tolist()) for i, t in enumerate(texts)]
    c.add(spark.createDataFrame(rows, "doc_id string, chunk_index long, source_path string, offset long, length long, text string, content_hash string, page long, embedding array<float>"))
    asked = [(1, "how often is the pump bearing replaced"), (2, "When does the canteen open?"), (3, "zzz qqq"), (4, None), (5, "word " * 5000)]
    got = {r["query_id"]: r for r in c.ask_many(spark.createDataFrame(asked, "query_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and not got[4]["found"] and (got[5]["found"], got[5]["answer"]) == (False, "")
    for q, text in asked[:3]:
        a, r = c.ask(text), got[q]
        assert (a.text, a.found, [x.chunk_id for x in a.citations], [p.id for p in a.passages]) == (r["answer"], r["found"], r["cited"], r["kept"])
    assert len(got[2]["kept"]) < 4  # the second canteen passage repeats the first
    c.retrieval_filter = lambda frame, who: frame.filter("id = 1")
    assert c.ask_many(spark.createDataFrame(asked[:1], "query_id long, text string"), least_similarity=-1.0).first()["kept"] == [1]
    assert c.ask_many(spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_blocks_meet_once(spark, tables):
    """Blocks of rows are made once, whatever the number of blocks of questions, and no token is shuffled for the postings."""
    rows, questions, _ = tables
    terms = spark.createDataFrame([("ash",), ("common",)], "term string")
    index = text_index(rows, terms)
    plan = index.postings._jdf.queryExecution().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
    assert "CartesianProduct" not in keyword_lists(index, questions, 6)._jdf.queryExecution().toString()
    assert sorted(map(tuple, index.postings.filter("id < 2").select("term", "id", "tf", "positions", "n_tokens").collect())) == [
        (t, r["id"], len(at), at, len(r["text"].replace("-", " ").split()))
        for t in ("ash", "common") for r in rows.filter("id < 2").orderBy("id").collect()
        if (at := [i for i, w in enumerate(r["text"].replace("-", " ").lower().split()) if w == t])
    ]


@pytest.mark.parametrize("blocks", [(4096, 8192), (7, 3)])
def test_text_blocks_are_the_index(spark, tables, monkeypatch, blocks):
    """No posting is a row: the texts' blocks give the lists of the postings, phrases of several words and other rows' ids alike."""
    monkeypatch.setattr(batch, "ROWS_A_BLOCK", blocks[0])
    monkeypatch.setattr(batch, "TEXTS_A_BLOCK", blocks[1])
    rows, questions, _ = tables
    index = text_index(rows, asked_phrases(questions).selectExpr("explode(words) AS term"))
    whole = TextBlocks.of(rows, questions)
    assert (whole.n, whole.n_tokens) == (index.n, index.n_tokens) == (67, sum(len((r["text"] or "").replace("-", " ").split()) for r in rows.collect()))
    lists = lambda i, asked, k, may=None: sorted(map(tuple, keyword_lists(i, asked, k, may).collect()))
    for asked in (questions, questions.filter("query_id IN (1, 2, 4, 6)"), questions.limit(0)):
        assert lists(TextBlocks.of(rows, asked), asked, 6) == lists(index, asked, 6)
    assert len(lists(whole, questions, 100)) > len(lists(whole, questions, 6)) > 0
    may = rows.filter("id % 3 = 0").select("id")
    assert lists(whole, questions, 6, may) == lists(index, questions, 6, may)
    none = rows.filter("text = '' OR text IS NULL")
    assert lists(TextBlocks.of(none, questions), questions, 6) == []


def test_blocks_pass_by_name(spark, tables):
    """A pair of blocks reaches its task as names of files: no postings or phrases go through a join, a shuffle or a broadcast."""
    rows, questions, _ = tables
    index = TextBlocks.of(rows, questions)
    lists = keyword_lists(index, questions, 6)
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Range" in plan
    assert index.files and all(path.startswith("file:") and 0 < n <= batch.TEXTS_A_BLOCK for path, n in index.files)
    assert batch._even([("a", 3), ("b", 1), ("c", 1), ("d", 3)], 2) == [["a", "b"], ["c", "d"]]
    assert batch._even([], 2) == [] and batch._even([("a", 1)], 5) == [["a"]]


def test_rows_below_a_score_are_left_out():
    """Ids of a block need not ascend, ties go by id all the same, and what is listed at the least score is kept."""
    rows = BlockScores(np.array([9, 2, 5]), np.array([0, 1, 2, 3]), np.array([0, 0, 0]), np.array([1.0, 1.0, 2.0]), 1)
    best = lambda k, least: [x.tolist() for x in rows.best(np.array([0]), np.array([1.0]), k, least)]
    assert best(3, 0.0) == [[5, 2, 9], [2.0, 1.0, 1.0]] and best(2, 1.0) == [[5, 2], [2.0, 1.0]] and best(2, 1.5) == [[5], [2.0]]


def test_block_scores_are_plain_sums():
    g = np.random.default_rng(5)
    x = g.integers(0, 200_000, 1000) // 1000 * 1000
    assert (in_order(x, 200_000) == np.argsort(x, kind="stable")).all()
    dense = np.where(g.random((300, 40)) < np.linspace(0.01, 0.9, 40), g.integers(1, 4, (300, 40)) / 4, 0)
    row, term = np.nonzero(dense)
    rows = BlockScores(np.arange(300) * 7, np.concatenate([[0], np.cumsum((dense > 0).sum(1))]), term, dense[row, term], 40)
    assert 0 < len(rows.columns) < 40
    for k in (1, 5, 50, 1000):
        for _ in range(20):
            asked = np.sort(g.choice(40, g.integers(0, 9), replace=False))
            weight = g.integers(1, 3, len(asked)) / 2
            score = dense[:, asked] @ weight
            want = sorted((-s, i * 7) for i, s in enumerate(score) if s > 0)[:k]
            ids, got = rows.best(asked, weight, k)
            assert list(zip((-got).tolist(), ids.tolist(), strict=True)) == want


def test_lists_are_merged_over_batches(spark):
    """A query's packed lists meet, whatever batches they lie in, and a list of ids is one row while it is shuffled."""
    lists = [(q, np.array([q + 10 * j, 5], "<i8").tobytes(), np.array([j % 3, 2.0], "<f8").tobytes()) for q in (1, 2, 3) for j in range(4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = merged_lists(spark.createDataFrame(lists, LISTS).repartition(3), 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(q, i, v, r) for q in (1, 2, 3) for i, v, r in ((q, 0.0, 1), (q + 10, 1.0, 3), (q + 30, 0.0, 2))]
