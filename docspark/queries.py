"""The engine's queries over the driver's tables, and the SQL that gives the same rows.

``documents`` stands for passages (path ``/source/doc_id.txt``), ``embeddings`` for their vectors. Hybrid queries pair
vec_id with doc_id: the two have nothing to do with each other, and the pairing only serves to have both lists. Documents
without a vector stay in the keyword list and its statistics; only the vector list passes them over.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.api import problems, summarize
from docspark.evaluate import growth, holders
from docspark.functions import answers, vectors
from docspark.functions.embed import HashEmbedder, embed_all
from docspark.functions.terms import query_phrases, tokens
from docspark.functions.text import clean_native, normalize_text
from docspark.operators.asof import pages_of
from docspark.operators.chunk import TEXTS, chunk_documents
from docspark.operators.fusion import best, fuse, ranked
from docspark.operators.keyword import keyword_top, text_index, text_scores
from docspark.operators.pivot_index import PivotIndex
from docspark.operators.rows import best_of_equal, dealt, spread
from docspark.operators.vector_search import top_k, top_k_joined
from docspark.plans import answer as A
from docspark.plans.batch import TextBlocks, answer_many, asked_phrases, keyword_lists, search_many
from docspark.plans.hybrid import Query, sentinels, with_similarity
from docspark.plans.hybrid import search as hybrid_search
from docspark.plans.store import Store, largest
from docspark.plans.sync import content_digest_column, plan_sync, removals
from docspark.scratch import kept_table, shared_dir
from docspark.sources.extract import extract_files
from docspark.sources.models import match_known

WORDS = ["hetion", "ering", "eau", "hetion"]
TEXT = " ".join(WORDS)
K, POOL = 10, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name == "documents" else rows


def passages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), path.alias("source_path"), "text")


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_of(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    row = stored_vectors(spark, d).filter(F.col("id") == vec_id).first()
    return list(row["embedding"]) if row else [0.0] * 64


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).join(stored_vectors(spark, d).select("id", "embedding"), "id", "left")


def pieces(rows: DataFrame, **limits) -> DataFrame:
    """The passages of each row's text, with ids of their own: the row's times 2^20, plus the place."""
    return chunk_documents(rows, **limits).withColumn("id", F.col("id") * (1 << 20) + F.col("chunk_index"))


def six(c, name: str):
    return F.round(c, 6).alias(name)


# vectors


def vector_topk(spark, d):
    return top_k(stored_vectors(spark, d), vector_of(spark, d), K).select("id", six(F.col("distance"), "distance"))


def vector_topk_pivots(spark, d):
    """``vector_topk`` by an index of blocks around pivots."""
    rows = stored_vectors(spark, d)
    index = PivotIndex.build(spark, rows, f"{shared_dir(spark)}/docspark-pivots-{uuid.uuid4().hex}", a_block=32)
    return index.search(rows, vector_of(spark, d), K, limited=False).select("id", six(F.col("distance"), "distance"))


def vector_topk_masked(spark, d):
    return top_k(stored_vectors(spark, d), vector_of(spark, d), K, F.col("label") % 2 == 0).select("id", six(F.col("distance"), "distance"))


def vector_topk_batched(spark, d):
    """Every stored vector whose id is divisible by 50 is a query."""
    rows = stored_vectors(spark, d)
    return top_k_joined(rows, rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 5).select("query_id", "id", six(F.col("distance"), "distance"), "rank")


def similarities(spark, d):
    q = vectors.as_vector(vector_of(spark, d))
    rows = stored_vectors(spark, d)
    distance = vectors.l2_squared(F.col("embedding"), q)
    return rows.select("id", six(vectors.dot(F.col("embedding"), q), "dot"), six(vectors.cosine_from_distance(distance), "cosine"))


def l2_normalize(spark, d):
    v = vectors.normalized(F.transform("embedding", lambda x: x.cast("double") * 3), 16, "double")
    return stored_vectors(spark, d).select("id", six(v[0], "first"), six(vectors.norm(v), "norm"), F.size(v).alias("dim"))


# keywords


def bm25_topk(spark, d):
    return keyword_top(passages(spark, d), TEXT, K).select("id", six(F.col("score"), "score"))


def bm25_prefix(spark, d):
    rows = passages(spark, d)
    allowed = rows.filter(F.col("source_path").startswith("/src1/"))
    return keyword_top(rows, TEXT, K, allowed=allowed).select("id", six(F.col("score"), "score"))


def bm25_phrase(spark, d):
    """Words that stand together: the quoted form of a word that is several tokens."""
    scores = text_scores(passages(spark, d), [["of", "the"]])
    return scores.orderBy(F.desc("score"), "id").limit(K).select("id", six(F.col("score"), "score"))


def term_df(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("df"))


def doc_stats(spark, d):
    rows = table(spark, d, "documents").select(F.size(tokens(F.col("text"))).alias("n"))
    return rows.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), six(F.avg("n"), "avg_tokens"))


# hybrid


def _hybrid(spark, d, **more):
    q = Query(vector=vector_of(spark, d), text=TEXT, top_k=K, **more)
    rows = with_vectors(spark, d)
    return sentinels(hybrid_search(rows, q)).select("id", six(F.col("score"), "score"), six(F.col("distance"), "distance"), six(F.col("keyword_score"), "keyword_score"), "vector_rank", "keyword_rank")


def rrf_hybrid(spark, d):
    return _hybrid(spark, d)


def rrf_weighted(spark, d):
    return _hybrid(spark, d, vector_weight=0.5, keyword_weight=2.0)


def vector_only(spark, d):
    return _hybrid(spark, d, mode="vector")


def keyword_only(spark, d):
    return _hybrid(spark, d, mode="keyword")


def prefix_hybrid(spark, d):
    return _hybrid(spark, d, path_prefix="/src1/")


def acl_filtered_search(spark, d):
    """An access list of ids; both lists see only its rows, statistics are of all rows."""
    rows = with_vectors(spark, d)
    acl = stored_vectors(spark, d).filter("label < 4").select("id")
    hits = hybrid_search(rows, Query(vector=vector_of(spark, d), text=TEXT, top_k=K), acl=acl)
    return sentinels(hits).select("id", six(F.col("score"), "score"), "vector_rank", "keyword_rank")


def hits_with_text(spark, d):
    """Hits joined to their passages: path, base name, similarity and JSON."""
    rows, v = with_vectors(spark, d), vector_of(spark, d)
    hits = hybrid_search(rows, Query(vector=v, text=TEXT, top_k=K))
    out = with_similarity(hits, rows, v)
    return out.select("id", answers.base_name(F.col("source_path")).alias("name"), six(F.col("similarity"), "similarity"), F.to_json(F.struct("id", "source_path")).alias("json"))


def similarity_floor(spark, d):
    q = vectors.as_vector(vector_of(spark, d))
    cosine = vectors.cosine_from_distance(vectors.l2_squared(F.col("embedding"), q))
    rows = stored_vectors(spark, d).select("id", cosine.alias("similarity"))
    return A.similar(rows, 0.25).select("id", six(F.col("similarity"), "similarity"))


def passage_exact_dedupe(spark, d):
    return best_of_equal(table(spark, d, "documents"), "text", "-n_chars", "doc_id").select("doc_id", "n_chars")


# collections


def records(spark, d):
    """Document records of the table: status by content, one passage a thousand characters."""
    docs = table(spark, d, "documents")
    status = F.when(F.length(F.trim("text")) == 0, "no_text").when(F.col("doc_id") % 97 == 0, "error").otherwise("ok")
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    chunks = F.when(status == "ok", F.ceil(F.col("n_chars") / 1000)).otherwise(0).cast("long")
    return docs.select(path.alias("source_path"), F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"), status.alias("status"), chunks.alias("chunk_count"), "doc_id")


def collection_summary(spark, d):
    return summarize(records(spark, d)).select("ok", "no_text", "failed", "chunks")


def document_listing(spark, d):
    return records(spark, d).filter(F.col("source_path").startswith("/src1/")).orderBy("source_path").select("source_path", "size", "status", "chunk_count")


def problem_documents(spark, d):
    return problems(records(spark, d))


def largest_documents(spark, d):
    return largest(records(spark, d), 20).select("source_path", "chunk_count")


def _listing(spark, d):
    """A later state of the folder: every eleventh file gone, every seventh edited, every thirteenth touched, some new."""
    r = records(spark, d)
    now = r.filter("doc_id % 11 <> 0").select(
        F.col("source_path").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("doc_id") % 13 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
    )
    new = r.filter("doc_id % 50 = 1").select(F.concat(F.lit("/new"), "source_path").alias("path"), "size", "mtime_ns")
    return now.unionByName(new)


def sync_plan(spark, d):
    plan = plan_sync(_listing(spark, d), records(spark, d))
    action = F.when(~F.col("look"), "unchanged").when(~F.col("known"), "new").when(F.col("old_status") == "error", "retry").otherwise("look")
    return plan.select("source_path", action.alias("action"))


def sync_removals(spark, d):
    seen = _listing(spark, d).withColumnRenamed("path", "source_path")
    return removals(records(spark, d), seen, ["/src1", "/src2/"]).select("source_path", "chunk_count")


def sync_counters(spark, d):
    return sync_plan(spark, d).groupBy("action").agg(F.count("*").alias("files"))


# functions


def page_of_offset(spark, d):
    """Pages of 700 bytes; the offset asked for is half of the length."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    starts = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(700))).alias("page_start"))
    return pages_of(docs.select("doc_id", F.floor(F.col("n") / 2).alias("offset")), starts).select("doc_id", "page")


def passage_pages(spark, d):
    """The passages of all documents with their pages of 2,000 bytes, by an as-of join over the offsets."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    starts = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(2000))).alias("page_start"))
    return pages_of(chunk_documents(docs).select("doc_id", "chunk_index", "offset"), starts)


def chunk_pages(spark, d):
    """The passages of texts with pages of 2,000 bytes: a passage ends where a page turns, unless it is short."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.sequence(F.lit(0), F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(2000)).cast("array<long>").alias("starts"))
    return chunk_documents(docs, pages_col="starts").select("doc_id", "chunk_index", "offset", "length", "page")


def collection_questions(spark, d):
    rows = table(spark, d, "conversations").filter("turn = 0")
    opening = F.element_at(F.array(*map(F.lit, ("How many", "which ", "Tell me of", " List the"))), (F.col("conv_id") % 4 + 1).cast("int"))
    thing = F.element_at(F.array(*map(F.lit, ("Files", "documents of today", "profiles", "pumps", "folder"))), (F.col("conv_id") % 5 + 1).cast("int"))
    return rows.select("conv_id", answers.about_collection(F.concat(opening, F.lit(" old "), thing, F.lit("?"))).alias("about"))


def citation_parse(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    n = F.col("conv_id") % 7 + 1
    text = F.concat("text", F.lit(" [S"), n, F.lit(", S"), (F.col("turn") % 9), F.lit("] and [3] [S"), n, F.lit("] [S99]"))
    found = answers.cited_native(text, 8)
    return rows.select("conv_id", "turn", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("cited"))


def answer_citations(spark, d):
    """What an answer over each conversation's turns rests on: made-up citations of some, of none that there are, or a refusal."""

    def made(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, c = rows.sort_values("turn"), int(key[0])
        passages = [A.Passage(int(t), "d", "", "", 0, 0, 1, x or "", 0.0, 1.0) for t, x in zip(rows["turn"], rows["text"], strict=True)]
        text = A.NOT_FOUND if c % 10 == 9 else f"So it is [S{c % 7 + 1}, S{c % 3 + 1}] and [S{c % 7 + 1}][S99]."
        a = A.make_answer(A.State("", passages, answer=text))
        return pd.DataFrame({"conv_id": [c], "found": [a.found], "cited": [",".join(str(x.chunk_id) for x in a.citations)]})

    return table(spark, d, "conversations").select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(made, "conv_id long, found boolean, cited string")


def known_files(spark, d):
    """Which documents are files of a catalog, by size and digest: it has every seventh, under another name, and twice some."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = docs.select(F.concat(F.lit("/f/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    own = docs.filter("doc_id % 7 = 0")
    catalog = own.unionByName(own.filter("doc_id % 14 = 0")).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("profile"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    return match_known(files, catalog)


def answer_checks(spark, d):
    """Refusals, fact matches and escaped markup on made-up answers over the conversations."""
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    text = F.when(F.col("conv_id") % 5 == 0, F.lit(" I could not find this in your documents ")).otherwise(F.concat("text", F.lit(" costs 1,2"), F.col("turn"), F.lit("0 <|x|>")))
    return rows.select(
        "conv_id", "turn", answers.is_not_found(text).alias("refused"), answers.states_fact(text, "Costs 1210").alias("states"),
        answers.escape_markup(F.concat(F.lit("<|"), F.col("role"), F.lit("|> <|>"))).alias("escaped"),
    )


def snippets(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", answers.snippet(F.col("text"), 60).alias("snippet"))


def clean_text(spark, d):
    docs = table(spark, d, "documents")
    raw = F.concat(F.lit("﻿"), "text", F.lit("\r\nﬁn­\f"), F.lit("end\r\x01"))
    return docs.select("doc_id", clean_native(raw).alias("text"))


def recall_at_10(spark, d):
    """Texts of the benchmark as queries to the keyword search over all documents: of those that stand in some document, the share for which such a document is among ten."""
    docs, items = passages(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = text_index(docs, asked_phrases(items).select(F.explode("words").alias("term")))
    top = keyword_lists(index, items, 10).select("query_id", "id", "keyword_rank")
    hits = holders(docs, items, index).join(top, ["query_id", "id"], "left").groupBy("query_id").agg(F.max(F.col("keyword_rank").isNotNull().cast("int")).alias("hit"))
    return hits.agg(F.count("*").alias("queries"), six(F.avg("hit"), "recall"))


def soak_growth(spark, d):
    """Median value of the first and of the last eighth of the events, and the growth between them in percent."""
    g = growth(table(spark, d, "events"), "ts", "event_id", "value")
    return g.select(*(six(F.col(c), c) for c in ("first_eighth", "last_eighth", "growth")))


def list_union(spark, d):
    """Two ranked lists, the second with a repeated id: fused without renumbering."""
    rows = spark.createDataFrame([(1, 0.0), (1, 0.1), (2, 0.2), (3, 0.3)], "id long, distance double")
    b = spark.createDataFrame([(3, 9.0), (4, 8.0)], "id long, keyword_score double")
    both = fuse(ranked(rows, "distance", name="vector_rank"), ranked(b, F.desc("keyword_score"), name="keyword_rank"))
    return best(both, 10).select("id", six(F.col("score"), "score"), "vector_rank", "keyword_rank")


# files


def normalize_files(spark, d):
    """Texts in four encodings, with line ends, a ligature, a soft hyphen, a form feed, a decomposed letter and a control
    character after them; Latin-1 only for texts that have it."""
    rows = table(spark, d, "documents")
    more = F.concat(F.coalesce("text", F.lit("")), F.lit("\r\nn\u0301 \ufb01n\u00ad\f"), F.lit("end\r\x01"))
    utf16 = lambda mark, kind: F.concat(F.unhex(F.lit(mark)), F.encode(more, kind))
    kind = F.col("doc_id") % 4
    narrow = F.coalesce(F.col("text").rlike("^[\\x00-\\x7f\\xa0-\\xff]*$"), F.lit(False))
    raw = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(more, "UTF-8"))).when(kind == 1, utf16("FFFE", "UTF-16LE")).when(kind == 2, utf16("FEFF", "UTF-16BE"))
        .when(narrow, F.encode(F.concat(F.when(narrow, F.col("text")).otherwise(""), F.lit("\r\u00e9\r\nend")), "ISO-8859-1")).otherwise(F.encode(more, "UTF-8"))
    )
    return rows.select("doc_id", normalize_text(raw).alias("text"))


def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", content_digest_column(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"))


def extract_tables(spark, d):
    """The customers of each nation as a CSV file, with quoted names that hold commas and quotes."""
    c = table(spark, d, "customer")
    line = F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('"""," '), "c_mktsegment", F.lit(' ",'), "c_custkey", F.lit("\n"))
    files = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("x"))
    files = files.select("c_nationkey", F.lit("c.csv").alias("path"), F.concat(F.lit("Name,Segment,Key\r\n"), F.array_join("x.line", "")).cast("binary").alias("content"))
    return extract_files(files).select("c_nationkey", "status", "text")


def extract_markups(spark, d):
    """Each part as a Markdown file with a heading, a table, a list, a link and markup."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type"))
    text = F.concat(
        F.lit("# Part *"), "p_name", F.lit("*\n\nBrand | Size\n--- | ---\n"), "p_brand", F.lit(" | "), "p_size", F.lit("\n\n- **"), "p_type", F.lit("**\n- "), "p_name",
        F.lit("\n\nSee [the "), "p_brand", F.lit("](http://x.example/a)\nand `more`.\n"),
    )
    out = extract_files(p.select("p_partkey", F.lit("p.md").alias("path"), text.cast("binary").alias("content")))
    return out.select("p_partkey", "status", "title", "text")


def _office(kind: int, name: str, segment: str) -> tuple[str, bytes]:
    """A file of one of three formats that says a customer's name and segment."""
    raw = io.BytesIO()
    rels = lambda to: f'<R><Relationship Id="r1" Type="x/k" Target="{to}1.xml"/><Relationship Id="r2" Type="x/k" Target="{to}2.xml"/></R>'
    if kind == 0:
        p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
        cells = "".join(f"<w:tc>{p(t)}</w:tc>" for t in (name, segment))
        parts = {"word/document.xml": f"<w:document><w:body>{p(name)}{p('R&amp;D ' + segment)}<w:tbl><w:tr>{cells}</w:tr></w:tbl></w:body></w:document>"}
    elif kind == 1:
        slide = lambda t: f"<p:sld><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>"
        parts = {
            "ppt/presentation.xml": '<p:presentation><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:presentation>',
            "ppt/_rels/presentation.xml.rels": rels("slides/s").replace("x/k", "x/slide"), "ppt/slides/s1.xml": slide(segment), "ppt/slides/s2.xml": slide(name),
        }
    else:
        cell = lambda at, t: f'<c r="{at}" t="inlineStr"><is><t>{t}</t></is></c>'
        rows = f"<row>{cell('A1', 'Name')}{cell('C1', 'Segment')}</row><row>{cell('A2', name)}{cell('C2', segment)}</row>"
        parts = {
            "xl/workbook.xml": '<workbook><sheet name="One" r:id="r1"/></workbook>', "xl/_rels/workbook.xml.rels": rels("worksheets/w").replace("x/k", "x/worksheet"),
            "xl/worksheets/w1.xml": rows,
        }
    with zipfile.ZipFile(raw, "w") as z:
        for n, body in parts.items():
            z.writestr(n, body)
    return ("a.docx", "a.pptx", "a.xlsx")[kind], raw.getvalue()


def extract_office(spark, d):
    """Each customer as a document, a presentation or a workbook, by the key."""

    def files(batches):
        for b in batches:
            made = [_office(k % 3, n, s) for k, n, s in zip(b["c_custkey"], b["c_name"], b["c_mktsegment"], strict=True)]
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "path": [p for p, _ in made], "content": [c for _, c in made]})

    made = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")).mapInPandas(files, "c_custkey long, path string, content binary")
    return extract_files(made).select("c_custkey", "status", "text", F.size("pages").alias("pages"))


# the store


def stored_rows(spark, d) -> DataFrame:
    """Every document as a passage that a store takes; ``n`` is its number."""
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), path.alias("source_path"), zero.alias("chunk_index"), zero.alias("offset"), F.octet_length(text).cast("long").alias("length"), text.alias("text"),
        F.sha2(text, 256).alias("content_hash"), zero.alias("page"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).cast("array<float>").alias("embedding"), F.col("doc_id").alias("n"),
    )


def new_store(spark, keywords: bool) -> Store:
    return Store.create(spark, f"{shared_dir(spark)}/docspark-store-{uuid.uuid4().hex}", "none", 2, keywords=keywords)


def store_changes(spark, d):
    """Every document a passage of a new collection: two additions, a removal of passages and one of documents, compaction; what is left."""
    rows = stored_rows(spark, d)
    record = lambda r: r.select("doc_id", "source_path", "content_hash", F.col("length").alias("size"), F.col("n").alias("mtime_ns"), F.lit("").alias("title"), F.lit(1).cast("long").alias("chunk_count"), F.lit("ok").alias("status"), F.lit("").alias("message"))
    store = new_store(spark, keywords=False)
    for part in (rows.filter("n % 2 = 0"), rows.filter("n % 2 = 1")):
        store.commit(add=part.drop("n"), records=record(part))
    store.commit(remove_ids=store.chunks().filter(F.col("doc_id").cast("long") % 5 == 0).select("id"))
    gone = rows.filter("n % 7 = 3").select("doc_id")
    store.commit(remove_ids=store.chunks().join(gone, "doc_id", "left_semi").select("id"), drop_documents=gone)
    store.compact()
    store.vacuum()
    store.close()
    kept = Store.open(spark, store.root)
    left = kept.chunks().select("id", "doc_id", "length", F.col("embedding")[1].cast("double").alias("second"))
    return kept.documents().select("doc_id", "source_path").join(left, "doc_id", "left")


def _asked(spark, d) -> tuple[DataFrame, DataFrame, TextBlocks]:
    """Documents, questions and the documents' blocks for them: the opening turn of each conversation is a question, with the vector
    of its number if there is one."""
    rows = with_vectors(spark, d)
    opening = table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    questions = opening.join(stored_vectors(spark, d).select(F.col("id").alias("query_id"), "embedding"), "query_id", "left")
    return rows, questions, TextBlocks.of(passages(spark, d), questions)


def batched_hybrid(spark, d):
    """The hits of all questions in one plan."""
    found = search_many(*_asked(spark, d), top_k=8)
    return found.select("query_id", "place", "id", six(F.col("score"), "score"), six(F.coalesce("keyword_score", F.lit(0.0)), "keyword_score"), "vector_rank", "keyword_rank")


def batched_prompts(spark, d):
    """The passages that each question's prompt of 1,100 tokens takes, of its eight best without those that repeat a better one."""
    rows, questions, index = _asked(spark, d)
    zero = F.lit(0).cast("long")
    whole = rows.withColumns({"offset": zero, "length": F.octet_length("text").cast("long"), "page": zero})
    out = answer_many(whole, questions, index, least_similarity=-1.0)
    return out.select("query_id", F.array_join(F.transform("kept", lambda i: i.cast("string")), ",").alias("kept"), "prompt_bytes")


def bm25_collection(spark, d):
    """``bm25_topk`` by the keyword index of a new collection of all documents."""
    store = new_store(spark, keywords=True)
    store.add(stored_rows(spark, d).drop("n"))
    names = store.chunks().select("id", "doc_id")
    scores = store.terms().scores(query_phrases(TEXT)).join(names, "id").withColumn("id", F.col("doc_id").cast("long"))
    return scores.orderBy(F.desc("score"), "id").limit(K).select("id", six(F.col("score"), "score"))


def keyword_index_changes(spark, d):
    """Scores of all matches by a keyword index that has seen four additions, a removal after two of them, and folds of like segments."""
    rows, store = stored_rows(spark, d), new_store(spark, keywords=True)
    for i in range(4):
        store.add(rows.filter(F.pmod("n", F.lit(4)) == i).drop("n"))
        if i == 1:
            store.commit(remove_ids=store.chunks().filter(F.col("doc_id").cast("long") % 5 == 0).select("id"))
    store.tidy(1 << 40)
    scores = store.terms().scores(query_phrases(TEXT)).join(store.chunks().select("id", "doc_id"), "id")
    return scores.select("doc_id", six(F.col("score"), "score"))


def answer_budget(spark, d):
    """Each conversation's turns as ranked passages: repeats go, then as many as a prompt of 700 tokens takes."""

    def stages(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = A.State("What was said?", [A.Passage(int(t), f"d{t}", "", f"t{t % 3}", int(t) % 2, 0, 1, x or "", -float(t), 1.0) for t, x in zip(rows["turn"], rows["text"], strict=True)])
        A.run([("rank", A.rank), ("dedupe", A.drop_repeats), ("budget", A.fit_budget(700))], s)
        return pd.DataFrame({"conv_id": [key[0]], "kept": [",".join(str(p.id) for p in s.passages)], "prompt_bytes": [len(s.prompt.encode())]})

    return table(spark, d, "conversations").select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(stages, "conv_id long, kept string, prompt_bytes long")


# without SQL


def chunk_all(spark, d):
    return chunk_documents(table(spark, d, "documents").select("doc_id", "text"))


def embed_documents(spark, d):
    embedder = HashEmbedder(16)

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        parts = [embed_all(embedder, texts.slice(at, TEXTS).to_pylist()) for at in range(0, len(texts), TEXTS)]
        values = np.concatenate([np.zeros(0, np.float32), *(p.ravel() for p in parts)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * embedder.dim, pa.int32()), pa.array(values))

    return chunk_all(spark, d).select("doc_id", "chunk_index", embed("text").alias("embedding"))


def overlap_dedupe(spark, d):
    """The best 100 passages of all documents for a query text: those that repeat a better one go. Ids are places in the list."""
    rows = kept_table(spark, pieces(passages(spark, d), target=400, most=600, overlap=80))
    top = rows.join(F.broadcast(keyword_top(rows, TEXT, 100)), "id").orderBy(F.desc("score"), "id").collect()
    s = A.State(TEXT, [A.Passage(i, r["doc_id"], r["source_path"], "", r["page"], r["offset"], r["length"], r["text"], r["score"], 1.0) for i, r in enumerate(top)])
    A.drop_repeats(s)
    return spark.createDataFrame([(p.id, p.doc_id, p.offset) for p in s.passages], "id long, doc_id string, offset long")


def ask_extractive(spark, d):
    """A question answered from the best passages by the generator without a model. A passage has its document's vector."""
    rows, v = kept_table(spark, pieces(with_vectors(spark, d))), vector_of(spark, d)
    hits = with_similarity(hybrid_search(rows, Query(vector=v, text=TEXT, top_k=8)), rows, v)
    best_first = hits.orderBy(F.desc("score"), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()).collect()
    own = [A.Passage(r["id"], r["doc_id"], r["source_path"], "", r["page"], r["offset"], r["length"], r["text"], r["score"], r["similarity"]) for r in best_first]

    def retrieve(s: A.State) -> None:
        s.passages = own

    made = A.make_answer(A.run(A.standard_stages(retrieve, A.ExtractiveGenerator(), -1.0, 1100), A.State(TEXT)))
    return spark.createDataFrame([(made.text, made.found, [c.chunk_id for c in made.citations])], "answer string, found boolean, cited array<long>")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_pivots, vector_topk_masked, vector_topk_batched, similarities, l2_normalize, bm25_topk, bm25_prefix, bm25_phrase, term_df, doc_stats,
        rrf_hybrid, rrf_weighted, vector_only, keyword_only, prefix_hybrid, acl_filtered_search, hits_with_text, similarity_floor,
        passage_exact_dedupe, collection_summary, document_listing, problem_documents, sync_plan, sync_removals, sync_counters, page_of_offset, passage_pages, chunk_pages,
        collection_questions, largest_documents, content_hashes, extract_tables, extract_markups, extract_office, store_changes, bm25_collection, keyword_index_changes, batched_hybrid, batched_prompts, answer_budget,
        citation_parse, answer_citations, known_files, answer_checks, snippets, clean_text, recall_at_10, soak_growth, list_union, normalize_files, chunk_all, embed_documents,
        overlap_dedupe, ask_extractive,
    )
}

# SQL

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DIST = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_TOK = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{M}\p{N}\p{Co}]+')"
_PATH = "'/' || source || '/' || doc_id || '.txt'"


def _bm25(where: str = "true", limit: str = f"ORDER BY score DESC, id LIMIT {K}", words: list[str] = WORDS, docs: str = "documents") -> str:
    values = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    return rf"""
t AS (SELECT doc_id AS id, source, {_TOK} AS tok FROM {docs}),
c AS (SELECT count(*) AS n, avg(len(tok)) AS av FROM t),
w(i, term) AS (VALUES {values}),
m AS (SELECT t.id, t.source, w.i, len(list_filter(t.tok, lambda x: x = w.term)) AS tf, len(t.tok) AS dl FROM t, w WHERE list_contains(t.tok, w.term)),
f AS (SELECT i, count(*) AS df FROM m GROUP BY i),
s AS (SELECT m.id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score
      FROM m JOIN f USING (i), c WHERE {where} GROUP BY m.id {limit})"""


def _rrf(wv: float = 1.0, wk: float = 1.0, vector: bool = True, keyword: bool = True, only: str = "true", columns: str = "") -> str:
    columns = columns or "id, round(score, 6) AS score, round(coalesce(distance, -1), 6) AS distance, round(coalesce(ks, 0), 6) AS keyword_score, coalesce(vr, 0)::INTEGER AS vector_rank, coalesce(kr, 0)::INTEGER AS keyword_rank"
    return f"""
WITH p AS (SELECT d.*, e.embedding, e.label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
v0 AS (SELECT e.doc_id AS id, {_DIST} AS distance FROM p e, {_Q} q WHERE {vector} AND {only} AND e.embedding IS NOT NULL),
v AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS vr FROM v0 ORDER BY distance, id LIMIT {POOL}),
{_bm25(f"{keyword} AND m.id IN (SELECT doc_id FROM p WHERE {only})", f"ORDER BY score DESC, id LIMIT {POOL}", docs="p")},
k AS (SELECT id, score AS ks, row_number() OVER (ORDER BY score DESC, id) AS kr FROM s),
u AS (SELECT id, coalesce({wv} / (60 + vr), 0) + coalesce({wk} / (60 + kr), 0) AS score, distance, ks, vr, kr FROM v FULL JOIN k USING (id))
SELECT {columns} FROM u ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST LIMIT {K}"""


_ASKED = rf"""
asked AS (SELECT conv_id AS query_id, coalesce(text, '') AS text FROM conversations WHERE turn = 0),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vr FROM (
  SELECT a.query_id, e.vec_id AS id, {_DIST} AS distance FROM asked a JOIN embeddings q ON q.vec_id = a.query_id, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)) QUALIFY vr <= {POOL}),
t AS MATERIALIZED (SELECT doc_id AS id, {_TOK} AS tok FROM documents), c AS (SELECT count(*) AS n, avg(len(tok)) AS av FROM t),
p AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tok) AS term FROM t) GROUP BY ALL),
f AS MATERIALIZED (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, c GROUP BY term, n),
w AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK}) AS term FROM asked) GROUP BY ALL),
s AS (SELECT query_id, p.id, list_sum(list(times * (CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tok) / av))) ORDER BY term)) AS score
      FROM w JOIN p USING (term) JOIN f USING (term) JOIN t ON t.id = p.id, c GROUP BY query_id, p.id),
k AS (SELECT query_id, id, score AS ks, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS kr FROM s QUALIFY kr <= {POOL}),
u AS (SELECT query_id, id, coalesce(1 / (60 + vr), 0) + coalesce(1 / (60 + kr), 0) AS score, ks, vr, kr FROM v FULL JOIN k USING (query_id, id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST) AS place FROM u QUALIFY place <= 8)"""


_REC = f"""r AS (SELECT {_PATH} AS source_path, n_chars AS size, doc_id * 1000 AS mtime_ns, doc_id,
  CASE WHEN length(trim(text)) = 0 THEN 'no_text' WHEN doc_id % 97 = 0 THEN 'error' ELSE 'ok' END AS status FROM documents),
rec AS (SELECT *, CASE WHEN status = 'ok' THEN ceil(size / 1000.0)::BIGINT ELSE 0 END AS chunk_count FROM r)"""
_LIST = """l AS (SELECT source_path, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size,
  CASE WHEN doc_id % 13 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns FROM rec WHERE doc_id % 11 <> 0
  UNION ALL SELECT '/new' || source_path, size, mtime_ns FROM rec WHERE doc_id % 50 = 1)"""
_PLAN = f"""WITH {_REC}, {_LIST}, a AS (SELECT l.source_path, CASE WHEN rec.status IS NULL THEN 'new' WHEN rec.status = 'error' THEN 'retry'
  WHEN l.size = rec.size AND l.mtime_ns = rec.mtime_ns THEN 'unchanged' ELSE 'look' END AS action FROM l LEFT JOIN rec USING (source_path))"""
_ANS = """a AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN ' I could not find this in your documents '
  ELSE text || ' costs 1,2' || turn || '0 <|x|>' END AS t FROM conversations WHERE role = 'assistant')"""

#: White space of the passage splitter.
_SP = r" \t\n\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _chunks(target: int, most: int, overlap: int, page: int = 1 << 40) -> str:
    """``page``: bytes of a page, at whose turn a passage of a third of the target ends. CTEs up to c(doc_id, chunk_index, a, b): passages as ranges of characters. Paragraphs, or their sentences, or pieces of
    sentences, are joined as long as a passage stays within ``target``; then each reaches back into the one before."""
    return rf"""
t AS MATERIALIZED (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t)),
m AS (SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS a, sum(regexp_full_match(line, '[{_SP}]*')::INTEGER) OVER w AS g FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p0 AS (SELECT doc_id, g, min(a) AS a, string_agg(line, chr(10) ORDER BY i) AS x FROM m WHERE NOT regexp_full_match(line, '[{_SP}]*') GROUP BY doc_id, g),
p AS MATERIALIZED (SELECT doc_id, (a + length(x) - length(regexp_replace(x, '^[{_SP}]+', '')))::BIGINT AS a, regexp_replace(regexp_replace(x, '^[{_SP}]+', ''), '[{_SP}]+$', '') AS x FROM p0),
-- sentences of long paragraphs
h AS (SELECT doc_id, a, x, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i, unnest(list_append(cs[2:], ' ')) AS follows FROM (SELECT *, string_split(x, '') AS cs FROM p WHERE length(x) > {most})),
e AS (SELECT doc_id, a, x, i FROM h WHERE c = chr(10) OR (contains('.!?।॥。', c) AND regexp_full_match(follows, '[{_SP}]')) UNION SELECT doc_id, a, x, length(x) FROM p WHERE length(x) > {most}),
s0 AS (SELECT doc_id, a, lag(i, 1, 0) OVER w AS i0, x[lag(i, 1, 0) OVER w + 1:i] AS x FROM e WINDOW w AS (PARTITION BY doc_id, a ORDER BY i)),
s AS (SELECT doc_id, (a + i0 + length(x) - length(regexp_replace(x, '^[{_SP}]+', '')))::BIGINT AS a, regexp_replace(regexp_replace(x, '^[{_SP}]+', ''), '[{_SP}]+$', '') AS x FROM s0),
-- pieces of long sentences, cut at the last white space within the limit
k(doc_id, a, x, rest_a, rest) AS (
  SELECT doc_id, 0::BIGINT, '', a, x FROM s WHERE length(x) > {most}
  UNION ALL
  SELECT doc_id, rest_a, regexp_replace(rest[1:cut], '[{_SP}]+$', ''), rest_a + cut + length(rest[cut + 1:]) - length(regexp_replace(rest[cut + 1:], '^[{_SP}]+', '')), regexp_replace(rest[cut + 1:], '^[{_SP}]+', '')
  FROM (SELECT *, CASE WHEN length(rest) <= {most} THEN length(rest) WHEN regexp_matches(rest[1:{most + 1}], '[{_SP}]') THEN length(regexp_replace(rest[1:{most + 1}], '[{_SP}][^{_SP}]*$', '')) ELSE {most} END AS cut
        FROM k WHERE rest <> '')),
u AS MATERIALIZED (
  SELECT doc_id, a, a + length(x) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n, {"0" if page == 1 << 40 else f"strlen(text[1:a]) // {page}"} AS g
  FROM (SELECT doc_id, a, x FROM p WHERE length(x) <= {most} UNION ALL SELECT doc_id, a, x FROM s WHERE length(x) BETWEEN 1 AND {most} UNION ALL SELECT doc_id, a, x FROM k WHERE x <> ''){"" if page == 1 << 40 else " JOIN t USING (doc_id)"}),
j(doc_id, n, a, c, b, g) AS (
  SELECT doc_id, n, a, 0, b, g FROM u WHERE n = 1
  UNION ALL
  SELECT u.doc_id, u.n, CASE WHEN {(ends := f"(u.b - j.a > {target} OR (u.g <> j.g AND j.b - j.a >= {target // 3}))")} THEN u.a ELSE j.a END, j.c + {ends}::INTEGER, u.b, u.g FROM j JOIN u ON u.doc_id = j.doc_id AND u.n = j.n + 1),
q AS (SELECT j.doc_id, j.c, min(j.a) AS a, max(u.b) AS b FROM j JOIN u USING (doc_id, n) GROUP BY j.doc_id, j.c),
o AS (SELECT q.*, text, text[greatest(lag(a) OVER w, lag(b) OVER w - {overlap}) + 1:lag(b) OVER w] AS tail, greatest(lag(a) OVER w, lag(b) OVER w - {overlap}) AS begin_at FROM q JOIN t USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
c AS (SELECT doc_id, c AS chunk_index, text, CASE WHEN w < length(tail) AND b - begin_at - w <= {most} THEN begin_at + w ELSE a END AS a, b FROM (SELECT *, length(regexp_extract(tail, '^[^{_SP}]*[{_SP}]*')) AS w FROM o))"""


ORACLE: dict[str, str] = {
    "overlap_dedupe": rf"""WITH RECURSIVE {_chunks(400, 600, 80)},
g AS MATERIALIZED (SELECT doc_id, doc_id * 1048576 + chunk_index AS id, strlen(text[1:a]) AS o, strlen(text[a + 1:b]) AS n, text[a + 1:b] AS text FROM c),
x AS MATERIALIZED (SELECT id, {_TOK} AS tok FROM g),
y AS (SELECT count(*) AS n, avg(len(tok)) AS av FROM x),
v AS (SELECT id, len(tok) AS dl, i, list_count(list_filter(tok, lambda z: z = term)) AS tf FROM x, (VALUES {', '.join(f"({i}, '{w}')" for i, w in enumerate(WORDS))}) w(i, term) WHERE list_contains(tok, term)),
f AS (SELECT i, count(*) AS df FROM v GROUP BY i),
z AS (SELECT id, list_sum(list(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) ORDER BY i)) AS score FROM v JOIN f USING (i), y GROUP BY id),
b AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, id) - 1 AS i, g.* FROM z JOIN g USING (id) ORDER BY score DESC, id LIMIT 100),
-- the better passages that each repeats
r AS MATERIALIZED (SELECT w.i, list(k.i) FILTER (k.i IS NOT NULL) AS better FROM b w LEFT JOIN b k ON k.i < w.i AND (k.text = w.text OR (k.doc_id = w.doc_id AND least(k.n, w.n) > 0
  AND least(k.o + k.n, w.o + w.n) - greatest(k.o, w.o) > least(k.n, w.n) // 2)) GROUP BY w.i),
kept(i, own) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL
  SELECT r.i, CASE WHEN list_has_any(kept.own, coalesce(r.better, [])) THEN kept.own ELSE list_append(kept.own, r.i) END FROM kept JOIN r ON r.i = kept.i + 1)
SELECT b.i AS id, b.doc_id::VARCHAR AS doc_id, b.o AS offset FROM b WHERE list_contains((SELECT arg_max(own, i) FROM kept), b.i)""",
    "chunk_all": f"WITH RECURSIVE {_chunks(1000, 1500, 150)} SELECT doc_id, chunk_index::BIGINT AS chunk_index, strlen(text[1:a])::BIGINT AS offset, strlen(text[a + 1:b])::BIGINT AS length, 0::BIGINT AS page, text[a + 1:b] AS text FROM c",
    "passage_pages": f"WITH RECURSIVE {_chunks(1000, 1500, 150)} SELECT doc_id, chunk_index::BIGINT AS chunk_index, strlen(text[1:a])::BIGINT AS offset, (strlen(text[1:a]) // 2000 + 1)::INTEGER AS page FROM c",
    "chunk_pages": f"WITH RECURSIVE {_chunks(1000, 1500, 150, 2000)} SELECT doc_id, chunk_index::BIGINT AS chunk_index, strlen(text[1:a])::BIGINT AS offset, strlen(text[a + 1:b])::BIGINT AS length, (strlen(text[1:a]) // 2000 + 1)::BIGINT AS page FROM c",
    "vector_topk": f"SELECT vec_id AS id, round({_DIST}, 6) AS distance FROM embeddings e, {_Q} q ORDER BY {_DIST}, vec_id LIMIT {K}",
    "vector_topk_pivots": f"SELECT vec_id AS id, round({_DIST}, 6) AS distance FROM embeddings e, {_Q} q ORDER BY {_DIST}, vec_id LIMIT {K}",
    "vector_topk_masked": f"SELECT vec_id AS id, round({_DIST}, 6) AS distance FROM embeddings e, {_Q} q WHERE label % 2 = 0 ORDER BY {_DIST}, vec_id LIMIT {K}",
    "vector_topk_batched": f"""WITH x AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DIST} AS dist FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id)::INTEGER AS rank FROM x)
SELECT query_id, id, round(dist, 6) AS distance, rank FROM r WHERE rank <= 5""",
    "similarities": f"SELECT vec_id AS id, round({_DOT}, 6) AS dot, round(1 - {_DIST} / 2, 6) AS cosine FROM embeddings e, {_Q} q",
    "l2_normalize": """WITH v AS (SELECT vec_id AS id, list_transform(embedding[1:16], lambda x: x::DOUBLE * 3) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT id, round(v[1] / n, 6) AS first, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS norm, len(v)::INTEGER AS dim FROM n""",
    "bm25_topk": f"WITH {_bm25()} SELECT id, round(score, 6) AS score FROM s",
    "batched_hybrid": f"WITH {_ASKED} SELECT query_id, place::INTEGER AS place, id, round(score, 6) AS score, round(coalesce(ks, 0), 6) AS keyword_score, vr::INTEGER AS vector_rank, kr::INTEGER AS keyword_rank FROM hits",
    "batched_prompts": f"""WITH RECURSIVE {_ASKED},
x AS (SELECT h.query_id, h.place, h.id, h.score, d.text FROM hits h JOIN documents d ON d.doc_id = h.id),
y AS (SELECT query_id, id, text, row_number() OVER (PARTITION BY query_id ORDER BY place) AS i, strlen('[S] (' || id || '.txt)') + 3 + strlen(replace(replace(text, '<|', '< |'), '|>', '| >')) AS size
  FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY place) = 1)),
b(query_id, i, bytes, n, kept) AS (
  SELECT query_id, 0::BIGINT, strlen('Passages:') + 2 + strlen('Question: ' || replace(replace(text, '<|', '< |'), '|>', '| >')), 0, []::BIGINT[] FROM asked
  UNION ALL
  SELECT b.query_id, y.i, CASE WHEN fits THEN b.bytes + y.size + strlen((b.n + 1)::VARCHAR) ELSE b.bytes END, CASE WHEN fits THEN b.n + 1 ELSE b.n END, CASE WHEN fits THEN list_append(b.kept, y.id) ELSE b.kept END
  FROM b JOIN y ON y.query_id = b.query_id AND y.i = b.i + 1,
       LATERAL (SELECT ceil({len(A.SYSTEM_PROMPT.encode())} / 4.0) + ceil((b.bytes + y.size + strlen((b.n + 1)::VARCHAR)) / 4.0) <= 1100 AS fits))
SELECT query_id, arg_max(array_to_string(kept, ','), i) AS kept, CASE WHEN arg_max(n, i) > 0 THEN arg_max(bytes, i) ELSE 0 END::BIGINT AS prompt_bytes FROM b GROUP BY query_id""",
    "bm25_collection": f"WITH {_bm25()} SELECT id, round(score, 6) AS score FROM s",
    "keyword_index_changes": f"WITH {_bm25(limit='', docs='(SELECT * FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 4 > 1)')} SELECT id::VARCHAR AS doc_id, round(score, 6) AS score FROM s",
    "bm25_prefix": f"WITH {_bm25(where=chr(39) + '/' + chr(39) + ' || m.source || ' + chr(39) + '/' + chr(39) + ' LIKE ' + chr(39) + '/src1/%' + chr(39))} SELECT id, round(score, 6) AS score FROM s",
    "bm25_phrase": rf"""WITH t AS (SELECT doc_id AS id, {_TOK} AS tok FROM documents), c AS (SELECT count(*) AS n, avg(len(tok)) AS av FROM t),
m AS (SELECT id, len(tok) AS dl, len(list_filter(range(1, len(tok)), lambda i: tok[i] = 'of' AND tok[i + 1] = 'the')) AS tf FROM t),
h AS (SELECT * FROM m WHERE tf > 0), f AS (SELECT count(*) AS df FROM h)
SELECT id, round((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS score
FROM h, f, c ORDER BY (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) DESC, id LIMIT {K}""",
    "term_df": f"WITH x AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM x GROUP BY term",
    "doc_stats": f"WITH x AS (SELECT len({_TOK}) AS n FROM documents) SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(avg(n), 6) AS avg_tokens FROM x",
    "rrf_hybrid": _rrf(),
    "rrf_weighted": _rrf(0.5, 2.0),
    "vector_only": _rrf(keyword=False),
    "keyword_only": _rrf(vector=False),
    "prefix_hybrid": _rrf(only="'/' || source || '/' LIKE '/src1/%'"),
    "acl_filtered_search": _rrf(only="label < 4", columns="id, round(score, 6) AS score, coalesce(vr, 0)::INTEGER AS vector_rank, coalesce(kr, 0)::INTEGER AS keyword_rank"),
    "hits_with_text": "WITH hits AS (" + _rrf(columns="id") + f""")
SELECT h.id, h.id || '.txt' AS name, round(coalesce({_DOT}, -1), 6) AS similarity, '{{"id":' || h.id || ',"source_path":"/' || d.source || '/' || h.id || '.txt"}}' AS json
FROM hits h JOIN documents d ON d.doc_id = h.id LEFT JOIN embeddings e ON e.vec_id = h.id, {_Q} q""",
    "similarity_floor": f"SELECT vec_id AS id, round(1 - {_DIST} / 2, 6) AS similarity FROM embeddings e, {_Q} q WHERE 1 - {_DIST} / 2 >= 0.25",
    "passage_exact_dedupe": "SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) = 1",
    "collection_summary": f"WITH {_REC} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'no_text') AS no_text, count(*) FILTER (status = 'error') AS failed, sum(chunk_count)::BIGINT AS chunks FROM rec",
    "document_listing": f"WITH {_REC} SELECT source_path, size, status, chunk_count FROM rec WHERE source_path LIKE '/src1/%'",
    "problem_documents": f"WITH {_REC} SELECT source_path, status FROM rec WHERE status <> 'ok'",
    "sync_plan": f"{_PLAN} SELECT source_path, action FROM a",
    "sync_removals": f"WITH {_REC}, {_LIST} SELECT source_path, chunk_count FROM rec WHERE (source_path LIKE '/src1/%' OR source_path LIKE '/src2/%') AND source_path NOT IN (SELECT source_path FROM l)",
    "sync_counters": f"{_PLAN} SELECT action, count(*) AS files FROM a GROUP BY action",
    "page_of_offset": "SELECT doc_id, greatest(1, len(list_filter(list_transform(range(0, n_chars // 700 + 1), lambda i: i * 700), lambda p: p <= n_chars // 2)))::INTEGER AS page FROM documents",
    "citation_parse": """WITH a AS (SELECT conv_id, turn, [conv_id % 7 + 1, turn % 9, 3, conv_id % 7 + 1, 99] AS c FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, turn, list_filter(c, lambda x: x BETWEEN 1 AND 8) AS c FROM a)
SELECT conv_id, turn, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS cited FROM f""",
    "answer_citations": """WITH n AS (SELECT conv_id, count(*) AS n, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
c AS (SELECT *, list_filter([conv_id % 7 + 1, conv_id % 3 + 1], lambda x: x <= n) AS asked FROM n),
u AS (SELECT *, list_filter(asked, lambda x, i: list_position(asked, x) = i) AS own FROM c)
SELECT conv_id, conv_id % 10 <> 9 AS found, CASE WHEN conv_id % 10 = 9 THEN '' WHEN len(own) = 0 THEN array_to_string(turns, ',')
  ELSE array_to_string(list_transform(own, lambda x: turns[x]), ',') END AS cited FROM u""",
    "known_files": """WITH f AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT '/f/' || f.doc_id AS path, min('p' || k.doc_id) AS profile FROM f LEFT JOIN f k ON k.doc_id % 7 = 0 AND k.text = f.text GROUP BY f.doc_id""",
    "answer_checks": f"""WITH {_ANS} SELECT conv_id, turn, trim(t) IN ('I could not find this in your documents', 'I could not find this in your documents.') AS refused,
regexp_matches(regexp_replace(lower(t), '[, ]', '', 'g'), 'costs1210($|[^0-9])') AS states, '< |' || role || '| > < | >' AS escaped FROM a""",
    "snippets": r"""WITH l AS (SELECT doc_id, regexp_replace(text, '[\r\n]', ' ', 'g') AS line FROM documents)
SELECT doc_id, CASE WHEN strlen(line) <= 60 THEN line ELSE line[1:list_max(list_filter(range(0, 61), lambda n: strlen(line[1:n]) <= 60))] || '...' END AS snippet FROM l""",
    "clean_text": "SELECT doc_id, text || chr(10) || 'fin' || chr(10) || chr(10) || 'end' || chr(10) AS text FROM documents",
    # the benchmark's words are single tokens
    "recall_at_10": f"""WITH t AS MATERIALIZED (SELECT doc_id AS id, {_TOK} AS tok FROM documents), c AS (SELECT count(*) AS n, avg(len(tok)) AS av FROM t),
p AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tok) AS term FROM t) GROUP BY ALL),
f AS MATERIALIZED (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, c GROUP BY term, n),
q AS (SELECT item_id AS q, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT q, p.id, list_sum(list(times * (CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tok) / av)) ORDER BY term)) AS score
      FROM q JOIN p USING (term) JOIN f USING (term) JOIN t ON t.id = p.id, c GROUP BY q, p.id),
r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s),
h AS (SELECT b.item_id AS q, d.doc_id AS id FROM benchmark b, documents d WHERE contains(d.text, b.text)),
g AS (SELECT h.q, max((r.rank IS NOT NULL)::INTEGER) AS hit FROM h LEFT JOIN r ON r.q = h.q AND r.id = h.id AND r.rank <= 10 GROUP BY h.q)
SELECT count(*) AS queries, round(avg(hit), 6) AS recall FROM g""",
    "soak_growth": """WITH p AS (SELECT value, ntile(8) OVER (ORDER BY ts, event_id) AS part FROM events),
m AS (SELECT median(value) FILTER (part = 1) AS a, median(value) FILTER (part = 8) AS b FROM p)
SELECT round(a, 6) AS first_eighth, round(b, 6) AS last_eighth, round((b - a) / a * 100, 6) AS growth FROM m""",
    "normalize_files": r"""SELECT doc_id, nfc_normalize(CASE WHEN doc_id % 4 = 3 AND regexp_full_match(coalesce(text, 'Ā'), '[\x00-\x7f\x{a0}-\x{ff}]*')
  THEN text || chr(10) || 'é' || chr(10) || 'end' ELSE coalesce(text, '') || chr(10) || 'ń fin' || chr(10) || chr(10) || 'end' || chr(10) END) AS text FROM documents""",
    "content_hashes": "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS content_hash FROM documents",
    "collection_questions": """SELECT conv_id, regexp_matches(['How many', 'which ', 'Tell me of', ' List the'][conv_id % 4 + 1] || ' old ' || ['Files', 'documents of today', 'profiles', 'pumps', 'folder'][conv_id % 5 + 1] || '?',
  '^ *(what|which|how many|list|show)( .* | )(documents?|files?|folders?)[ ?]', 'i') AS about FROM conversations WHERE turn = 0""",
    "largest_documents": f"WITH {_REC} SELECT source_path, chunk_count FROM rec ORDER BY chunk_count DESC, source_path LIMIT 20",
    # a header row, and a blank line after every tenth row
    "extract_tables": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS i FROM customer)
SELECT c_nationkey, 'ok' AS status, rtrim('Name | Segment | Key' || chr(10) || string_agg('Name: ' || c_name || ', "' || c_mktsegment || '" | Segment: ' || c_mktsegment || ' | Key: ' || c_custkey
  || CASE WHEN i % 10 = 0 THEN chr(10) ELSE '' END, chr(10) ORDER BY i), chr(10)) AS text FROM r GROUP BY c_nationkey""",
    "extract_markups": """SELECT p_partkey, 'ok' AS status, 'Part ' || p_name AS title, 'Part ' || p_name || chr(10) || chr(10) || 'Brand | Size' || chr(10) || p_brand || ' | ' || p_size || chr(10) || chr(10)
  || '- ' || p_type || chr(10) || '- ' || p_name || chr(10) || chr(10) || 'See the ' || p_brand || ' and more.' AS text FROM part""",
    "extract_office": """SELECT c_custkey, 'ok' AS status, CASE c_custkey % 3 WHEN 0 THEN c_name || chr(10) || chr(10) || 'R&D ' || c_mktsegment || chr(10) || chr(10) || c_name || chr(9) || c_mktsegment
  WHEN 1 THEN c_name || chr(10) || chr(10) || c_mktsegment ELSE 'Sheet: One' || chr(10) || 'Name | Segment' || chr(10) || 'Name: ' || c_name || ' | Segment: ' || c_mktsegment END AS text,
  [0, 2, 1][c_custkey % 3 + 1]::INTEGER AS pages FROM customer""",
    "store_changes": """WITH d AS (SELECT doc_id AS n, '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS source_path, strlen(coalesce(text, '')) AS length FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY n % 2 ORDER BY source_path) - 1 + CASE WHEN n % 2 = 1 THEN (SELECT count(*) FROM d WHERE n % 2 = 0) ELSE 0 END AS id FROM d)
SELECT n::VARCHAR AS doc_id, source_path, CASE WHEN n % 5 <> 0 THEN id END AS id, CASE WHEN n % 5 <> 0 THEN length END AS length, CASE WHEN n % 5 <> 0 THEN n::DOUBLE END AS second FROM a WHERE n % 7 <> 3""",
    "answer_budget": f"""WITH RECURSIVE c AS (SELECT *, coalesce(text, '') AS x FROM conversations),
u AS (SELECT conv_id, x, min(turn) AS turn FROM c GROUP BY conv_id, x),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
        strlen('[S] (t' || turn % 3 || CASE WHEN turn % 2 = 1 THEN ', page 1' ELSE '' END || ')') + 3 + strlen(replace(replace(x, '<|', '< |'), '|>', '| >')) AS size FROM u),
s(conv_id, i, bytes, n, kept) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, strlen('Passages:') + 2 + strlen('Question: What was said?'), 0, []::BIGINT[] FROM c
  UNION ALL
  SELECT s.conv_id, p.i, CASE WHEN fits THEN s.bytes + p.size + strlen((s.n + 1)::VARCHAR) ELSE s.bytes END, CASE WHEN fits THEN s.n + 1 ELSE s.n END, CASE WHEN fits THEN list_append(s.kept, p.turn) ELSE s.kept END
  FROM s JOIN p ON p.conv_id = s.conv_id AND p.i = s.i + 1,
       LATERAL (SELECT ceil({len(A.SYSTEM_PROMPT.encode())} / 4.0) + ceil((s.bytes + p.size + strlen((s.n + 1)::VARCHAR)) / 4.0) <= 700 AS fits))
SELECT conv_id, arg_max(array_to_string(kept, ','), i) AS kept, CASE WHEN arg_max(n, i) > 0 THEN arg_max(bytes, i) ELSE 0 END AS prompt_bytes FROM s GROUP BY conv_id""",
    "list_union": """SELECT * FROM (VALUES (3::BIGINT, round(1 / 64.0 + 1 / 61.0, 6)::DOUBLE, 4, 1), (1, round(1 / 61.0, 6), 1, NULL),
(2, round(1 / 63.0, 6), 3, NULL), (4, round(1 / 62.0, 6), NULL, 2)) t(id, score, vector_rank, keyword_rank)""",
}
