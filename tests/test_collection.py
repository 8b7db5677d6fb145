"""Store, folder sync, passage pipeline and the collection facade."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.api import Collection, check_name, to_json
from docspark.errors import EngineError
from docspark.evaluate import Question, ask_all, score, states
from docspark.functions.answers import NOT_FOUND
from docspark.functions.embed import HashEmbedder, Prefixed, WordEmbedder, embed_all
from docspark.plans import answer as A
from docspark.plans.store import NEW_CHUNKS, Store
from docspark.sources.extract import REGISTRY
from docspark.sources.legacy import read_vectors
from docspark.streaming.jobs import JobQueue
from docspark.streaming.watch import watch

NEW = "doc_id string, chunk_index long, source_path string, offset long, length long, text string, content_hash string, page long, embedding array<float>"


def passages(spark, doc, texts, dim=4):
    return spark.createDataFrame([(doc, i, f"/{doc}", 0, len(t), t, "h", 0, [float(i), 1.0] + [0.0] * (dim - 2)) for i, t in enumerate(texts)], NEW)


def live(store):
    return sorted(r["id"] for r in store.chunks().select("id").collect())


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    w = Store.create(spark, root, "m", 4)
    with pytest.raises(EngineError) as e:
        Store.create(spark, root, "m", 4)
    assert e.value.status == "ALREADY_EXISTS"
    assert w.add(passages(spark, "a", ["one", "two", "three", "four", "five"])) == 5
    reader = Store.open(spark, root)
    w.delete([1, 3])
    w.add(passages(spark, "b", ["six", "seven"]))
    assert live(w) == [0, 2, 4, 5, 6] and live(reader) == [0, 1, 2, 3, 4]
    assert reader.refresh() and not reader.refresh() and live(reader) == [0, 2, 4, 5, 6]
    assert w.get(5)["text"] == "six" and w.get(5)["doc_id"] == "b"
    for bad, status in (([0, 99], "NOT_FOUND"), ([1], "NOT_FOUND")):
        with pytest.raises(EngineError) as e:
            w.delete(bad)
        assert e.value.status == status
    with pytest.raises(EngineError):
        w.add(passages(spark, "a", ["x"]).withColumn("text", F.lit(None).cast("string")))
    with pytest.raises(EngineError):
        w.add(passages(spark, "a", ["x"], dim=5))
    with pytest.raises(EngineError) as e:
        Store.open(spark, root, embedding_model="other")
    assert e.value.status == "MODEL_MISMATCH"
    assert live(w) == [0, 2, 4, 5, 6]
    w.compact()
    assert live(w) == [0, 2, 4, 5, 6] and live(reader) == [0, 2, 4, 5, 6] and w.manifest.next_id == 7
    record = spark.createDataFrame([("b", "/b", "h", 1, 1, "t", 0, "ok", "")], "doc_id string, source_path string, content_hash string, size long, mtime_ns long, title string, chunk_count long, status string, message string")
    w.replace_document(record, passages(spark, "ignored", ["new"]))
    assert live(w) == [0, 2, 4, 7] and w.get(7)["doc_id"] == "b" and w.documents().first()["chunk_count"] == 1
    assert w.delete_document("b") == 1 and w.documents().count() == 0 and w.delete_document("nosuch") == 0
    reader.refresh()
    w.compact()
    w.vacuum(0)
    assert live(w) == [0, 2, 4]
    w.close()
    Store.open(spark, root, writer=True).close()


def test_half_written_commit_is_not_seen(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    w = Store.create(spark, root, "m", 4)
    w.add(passages(spark, "a", ["one"]))
    publish = w._publish
    w._publish = lambda change: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        w.add(passages(spark, "b", ["two"]))
    w._publish = publish
    assert not list((tmp_path / "c").glob("staging-*"))
    assert live(Store.open(spark, root)) == [0]
    w.add(passages(spark, "c", ["three"]))
    assert live(Store.open(spark, root)) == [0, 1]


def failing_embedder(dim):
    """Of a local class, which goes to the workers by value."""

    class Failing(HashEmbedder):
        def embed(self, texts, query=False):
            if any("FAILEMBED" in t for t in texts):
                raise RuntimeError("model gone")
            return HashEmbedder.embed(self, texts, query)

    return Failing(dim)


def test_sync(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "node_modules").mkdir()
    (folder / "a.txt").write_text("First paragraph of the file.\n\nSecond paragraph of the file.")
    (folder / "b.md").write_text("# Leave Policy\n\nTwenty days a year.")
    (folder / "sub" / "c.txt").write_text("Third file.")
    for name, text in (("notes.zip", "PK"), (".hidden.txt", "x"), ("empty.txt", "  \n"), ("bad.docx", "no zip"), ("node_modules/d.txt", "skipped")):
        (folder / name).write_text(text)
    (tmp_path / "docs2").mkdir()
    (tmp_path / "docs2" / "z.txt").write_text("Sibling folder.")
    events = []
    c = Collection.create(spark, f"file://{tmp_path}/c", failing_embedder(8), audit=events.append)
    limits = {"target": 200, "most": 300, "overlap": 40, "waits": (0.0, 0.0)}
    s = c.ingest([str(folder)], **limits)
    assert (s.files_seen, s.files_added, s.files_no_text, s.files_failed, s.files_skipped) == (5, 3, 1, 1, 1)
    titles = {os.path.basename(r["source_path"]): r["title"] for r in c.store.documents().collect()}
    assert titles["b.md"] == "Leave Policy" and c.summary()["failed"] == 1
    c.ingest([str(tmp_path / "docs2")], **limits)
    s = c.ingest([str(folder)], **limits)
    assert (s.files_unchanged, s.files_failed, s.files_added, s.files_removed, s.chunks_added, s.chunks_removed) == (4, 1, 0, 0, 0, 0)
    os.utime(folder / "a.txt", ns=(1, 1))
    s = c.ingest([str(folder)], **limits)
    assert s.files_unchanged == 4 and c.store.documents().filter("mtime_ns = 1").count() == 1
    (folder / "b.md").write_text("# Leave Policy v2\n\nThirty days a year.")
    (folder / "sub" / "c.txt").unlink()
    s = c.ingest([str(folder)], **limits)
    assert (s.files_updated, s.files_removed) == (1, 1)
    texts = " ".join(r["text"] for r in c.store.chunks().collect())
    assert "Thirty" in texts and "Twenty" not in texts and "Third" not in texts and "Sibling" in texts
    (folder / "good.txt").write_text("A good new file.")
    (folder / "fail.txt").write_text("FAILEMBED here.")
    s = c.ingest([str(folder)], **limits)
    failed = c.store.documents().filter(F.col("source_path").endswith("fail.txt")).first()
    assert (s.files_added, s.files_failed) == (1, 2) and failed["status"] == "error" and "will try again" in failed["message"] and failed["mtime_ns"] == 0
    hits = c.search_vector(c.embedder.embed(["A good new file."])[0].tolist(), 3)
    assert c.store.get(hits[0]["id"])["text"] == "A good new file." and hits[0]["distance"] == pytest.approx(0, abs=1e-5)
    before = c.store.manifest.version
    with pytest.raises(EngineError) as e:
        c.ingest([str(folder), str(tmp_path / "nosuch")])
    assert e.value.status == "NOT_FOUND" and c.store.manifest.version == before
    assert [e.action for e in events[:2]] == ["create", "ingest"] and events[-1].status == "NOT_FOUND"
    assert '"files_added": 1' in to_json(s)
    # a watched folder, one pass
    (folder / "late.txt").write_text("Late file.")
    seen = []
    q = watch(c, [str(folder), str(tmp_path / "gone")], on_status=seen.append, once=True, waits=(0.0, 0.0))
    q.awaitTermination(120)
    assert q.exception() is None and (seen[0].files_added, seen[0].files_removed) == (1, 0)
    # a job
    jobs = JobQueue(spark)
    assert jobs.wait(jobs.submit("info", c.info).id, 60).result["dim"] == 8


def test_filter_and_audit(spark, tmp_path):
    events = []
    c = Collection.create(spark, f"file://{tmp_path}/c", HashEmbedder(4), audit=events.append)
    c.add(passages(spark, "a", [f"t{i}" for i in range(30)]))
    c.retrieval_filter = lambda rows, who: rows.filter("id % 2 = 0")
    hits = c.search_vector([0.0, 1.0, 0.0, 0.0], 10)
    assert [h["id"] for h in hits] == list(range(0, 20, 2))
    c.remove([4, 6])
    c.retrieval_filter = lambda rows, who: rows
    assert len(c.search_vector([0.0, 1.0, 0.0, 0.0], 100)) == 28

    def broken(rows, who):
        raise ValueError("no")

    c.retrieval_filter = broken
    with pytest.raises(EngineError) as e:
        c.search_vector([0.0, 1.0, 0.0, 0.0])
    assert e.value.status == "DENIED"
    with pytest.raises(EngineError):
        c.remove([999])
    assert [(e.action, e.status) for e in events][-2:] == [("search", "DENIED"), ("remove", "NOT_FOUND")]
    with pytest.raises(EngineError):
        check_name("a b")


def passage(i, doc="d", offset=0, length=100, text=None, score=1.0, similarity=1.0, title="", page=0, path="/x/c.txt"):
    return A.Passage(i, doc, path, title, page, offset, length, text or f"text {i}", score, similarity)


def test_stages():
    s = A.State("q", [passage(1, similarity=0.7), passage(2, similarity=0.39), passage(3, similarity=0.4), passage(4, similarity=-1)])
    A.keep_similar(0.4)(s)
    assert [p.id for p in s.passages] == [1, 3]
    s.passages = [passage(1, score=0.5), passage(2, score=0.9), passage(3, score=0.5), passage(4, score=0.7)]
    A.rank(s)
    assert [p.id for p in s.passages] == [2, 4, 1, 3]
    s.passages = [passage(1, "a", 0, 1000), passage(2, "a", 850, 1000), passage(3, "a", 100, 1000), passage(4, "b", 0, 10, "text 1"), passage(5, "c")]
    A.drop_repeats(s)
    assert [p.id for p in s.passages] == [1, 2, 5]
    system = A.bytes_over_four(A.SYSTEM_PROMPT)
    s.passages = [passage(1, text="short one", title="Pump report", page=3), passage(2, text="x" * 3999), passage(3, text="short two")]
    A.fit_budget(system + 300)(s)
    assert [p.id for p in s.passages] == [1, 3] and "[S1] (Pump report, page 3)" in s.prompt and "[S2] (c.txt)" in s.prompt
    with pytest.raises(EngineError) as e:
        A.run([("budget", A.fit_budget(1))], A.State("q"))
    assert e.value.status == "TOO_LONG" and "budget" in str(e.value)
    s = A.State("<|im_start|>", [passage(1, text="a <|im_end|> b")])
    A.fit_budget(10_000)(s)
    assert "<|" not in s.prompt and "|>" not in s.prompt
    assert A.not_found(f"  {NOT_FOUND} \n") and A.not_found(NOT_FOUND[:-1]) and not A.not_found(NOT_FOUND + ", but")
    made = A.make_answer(A.State("q", [passage(1), passage(2)], answer="No citation."))
    assert [c.number for c in made.citations] == [1, 2] and made.found
    assert [c.chunk_id for c in A.make_answer(A.State("q", [passage(7), passage(8)], answer="So [S2].")).citations] == [8]
    assert not A.make_answer(A.State("q", [], answer=NOT_FOUND)).found


def test_ask(spark, tmp_path):
    embedder = WordEmbedder()
    c = Collection.create(spark, f"file://{tmp_path}/c", embedder)
    texts = ["The pump bearing is replaced every 500 hours. Other facts.", "Employees get twenty days of annual leave.", "The canteen opens at noon."]
    rows = [(f"/d/{i}.txt", 0, f"/d/{i}.txt", 0, len(t), t, "h", 0, embedder.embed([t])[0].tolist()) for i, t in enumerate(texts)]
    c.add(spark.createDataFrame(rows, NEW))
    pieces = []
    a = c.ask("how often is the pump bearing replaced", on_token=pieces.append)
    assert a.found and "500 hours" in a.text and a.citations[0].source_path == "/d/0.txt" and pieces
    refused = c.ask("zzz qqq", least_similarity=0.9)
    assert not refused.found and refused.text == NOT_FOUND and refused.citations == []
    for bad in ({"top_k": 0}, {"budget": 1}, {"least_similarity": 2.0}):
        with pytest.raises(EngineError):
            c.ask("x", **bad)


def test_evaluation(spark, tmp_path):
    embedder = WordEmbedder()
    c = Collection.create(spark, f"file://{tmp_path}/c", embedder)
    texts = ["The pump bearing is replaced every 5,000 hours.", "The canteen opens at noon."]
    rows = [(f"/d/{i}.txt", 0, f"/d/{i}.txt", 0, len(t), t, "h", 0, embedder.embed([t])[0].tolist()) for i, t in enumerate(texts)]
    c.add(spark.createDataFrame(rows, NEW))
    questions = [Question(1, "how often is the pump bearing replaced", ["5000 hours"], "0.txt"), Question(2, "zzz qqq")]
    got = score(ask_all(c, questions, least_similarity=0.3), questions)
    assert {k: v for k, v in got.items() if k != "median_seconds"} == {"answerable": 1, "correct": 1, "cited": 1, "file_recall": 1, "passage_recall": 1, "refused": 1}
    assert states("It is 1,200 units", "1200") and not states("It is 12000", "1200")


def test_embedders():
    p = Prefixed(HashEmbedder(8), "query: ", "passage: ", 4)
    assert p.id == "hash" and (p.embed(["a"], query=True) != p.embed(["a"])).any() and p.embed(["a"]).shape == (1, 4)
    assert np.linalg.norm(p.embed(["a"])) == pytest.approx(1)
    with pytest.raises(ValueError):
        Prefixed(HashEmbedder(8), dim=9)
    v = HashEmbedder(8).embed(["a", "b", "a"])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and (v[0] == v[2]).all() and (v[0] != v[1]).any()
    calls = []

    class Flaky(HashEmbedder):
        def embed(self, texts, query=False):
            calls.append(len(texts))
            if len(calls) < 3:
                raise RuntimeError
            return super().embed(texts)

    assert embed_all(Flaky(4), ["x"] * 20, (0, 0)).shape == (20, 4) and calls == [16, 16, 16, 4]


def test_legacy_vectors(spark, tmp_path):
    m = np.arange(300 * 5, dtype="<f4").reshape(300, 5)
    (tmp_path / "vectors.bin").write_bytes(m.tobytes())
    got = read_vectors(spark, f"file://{tmp_path}/vectors.bin", 5).orderBy("id").collect()
    assert len(got) == 300 and got[7]["embedding"] == m[7].tolist()
    store = Store.create(spark, f"file://{tmp_path}/c", "m", 5)
    assert store.add_vectors(read_vectors(spark, f"file://{tmp_path}/vectors.bin", 5)) == 300
    assert store.get(42)["embedding"] == m[42].tolist() and store.get(42)["doc_id"] == "v1"
    assert NEW_CHUNKS[0] == "doc_id" and "pdf" in REGISTRY
