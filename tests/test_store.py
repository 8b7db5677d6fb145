"""Commits of several writers, killed writers, the keyword index, folding and point reads of the store."""

import math
import os
import random
import signal
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docspark.errors import EngineError
from docspark.operators.keyword import text_scores
from docspark.plans.store import DOCUMENTS, FAN, Store

NEW = "doc_id string, chunk_index long, source_path string, offset long, length long, text string, content_hash string, page long, embedding array<float>"
WORDS = ["ash", "birch", "cedar", "dogwood", "elm", "fir", "x-ray"]


def passages(spark, doc, texts):
    return spark.createDataFrame([(doc, i, f"/{doc}", 0, len(t), t, "h", 0, [float(i), 1.0]) for i, t in enumerate(texts)], NEW)


def record(spark, doc, chunks=1):
    return spark.createDataFrame([(doc, f"/{doc}", "h", 1, 1, "t", chunks, "ok", "")], DOCUMENTS)


def texts_of(store):
    return sorted(r["text"] for r in store.chunks().select("text").collect())


def test_two_writers_both_succeed(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    a = Store.create(spark, root, "m", 2)
    b = Store.open(spark, root, writer=True)
    a.add(passages(spark, "a", ["ash one", "ash two"]))
    assert b.manifest.version == 0  # has not looked since
    b.add(passages(spark, "b", ["birch"]))
    a.set_meta("k", "v")
    a.delete([0])
    b.delete([2])
    now = Store.open(spark, root)
    assert texts_of(now) == ["ash two"] and now.get_meta("k") == "v"
    assert (now.manifest.next_id, now.manifest.count, now.manifest.n_tokens, now.manifest.removed_count) == (3, 1, 2, 2)
    a.refresh()
    a.commit(remove_ids=spark.createDataFrame([(1,), (2,), (99,)], "id long"))  # one of three is live
    assert (a.manifest.count, a.manifest.n_tokens, a.manifest.removed_count) == (0, 0, 3)


def test_changes_of_one_document_do_not_merge(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    a = Store.create(spark, root, "m", 2)
    a.commit(add=passages(spark, "d", ["first"]), records=record(spark, "d"))
    b = Store.open(spark, root, writer=True)
    a.commit(remove_ids=a.chunks().select("id"), add=passages(spark, "d", ["by a"]), records=record(spark, "d"))
    with pytest.raises(EngineError) as e:
        b.commit(remove_ids=b.chunks().select("id"), add=passages(spark, "d", ["by b"]), records=record(spark, "d"))
    assert e.value.status == "CONFLICT" and texts_of(Store.open(spark, root)) == ["by a"]
    assert not list((tmp_path / "c").glob("staging-*"))
    b = Store.open(spark, root, writer=True)
    a.commit(records=record(spark, "other"))
    a.compact()
    b.replace_document(record(spark, "d"), passages(spark, "x", ["b again"]))  # folded: looked at again by itself
    now = Store.open(spark, root)
    assert texts_of(now) == ["b again"] and {r["doc_id"] for r in now.documents().collect()} == {"d", "other"}
    assert now.get_document("d")["chunk_count"] == 1


KILLED = """
import os, signal, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from docspark.plans.store import Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
store, puts, put = Store.open(spark, {root!r}, writer=True), [], Store._put
def dying(self, new):
    puts.append(new)
    if len(puts) == {at}:
        os.kill(os.getpid(), signal.SIGKILL)
    return put(self, new)
Store._put = dying
rows = spark.createDataFrame([("k", 0, "/k", 0, 1, "killed", "h", 0, [0.0, 1.0])], {new!r})
store.commit(add=rows)
"""


@pytest.mark.parametrize("at", [1, 2])
def test_a_killed_writer_holds_nobody_up(spark, tmp_path, at):
    """Killed before its numbers are reserved, and between that and the commit."""
    root = f"file://{tmp_path}/c"
    w = Store.create(spark, root, "m", 2)
    w.add(passages(spark, "a", ["ash"]))
    code = textwrap.dedent(KILLED.format(repo=str(Path(__file__).resolve().parent.parent), root=root, at=at, new=NEW))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "pyspark-shell"})
    assert done.returncode == -signal.SIGKILL, done.stderr[-2000:]
    other = Store.open(spark, root, writer=True)
    assert texts_of(other) == ["ash"]
    other.add(passages(spark, "b", ["birch"]))
    w.add(passages(spark, "c", ["cedar"]))
    assert texts_of(w) == ["ash", "birch", "cedar"] and w.get(at)["text"] == "birch"  # a number is lost at most
    w.vacuum(0)
    assert not list((tmp_path / "c").glob("staging-*")) and len(list((tmp_path / "c" / "chunks").iterdir())) == 3
    assert texts_of(Store.open(spark, root)) == ["ash", "birch", "cedar"]


def test_keyword_index_follows_changes(spark, tmp_path):
    """After each change the index gives the scores of the texts, to the last digit, and compaction changes none."""
    w = Store.create(spark, f"file://{tmp_path}/c", "m", 2)
    text = lambda i: " ".join(WORDS[(i * k) % 7] for k in range(1, 2 + i % 9)) + " अं Été" * (i % 2)

    def same():
        rows = w.chunks().select("id", "text")
        for phrases in ([["ash"]], [["ash"], ["ash"], ["fir"], ["nowhere"]], [["x", "ray"], ["ete"]], [["ash"], ["birch", "cedar"]], []):
            for allowed in (None, rows.filter("id % 2 = 0")):
                got = {r["id"]: r["score"] for r in w.terms().scores(phrases, allowed).collect()}
                assert got == {r["id"]: r["score"] for r in text_scores(rows, phrases, allowed).collect()}
        return len(got)

    same()
    w.add(passages(spark, "a", [text(i) for i in range(20)] + [""]))
    same()
    w.add(passages(spark, "b", [text(i) for i in range(20, 30)]))
    w.delete([1, 2, 25])
    same()
    assert w.compact() and not w.manifest.removed
    same()
    w.delete([3])
    w.add(passages(spark, "c", [text(31)]))
    same()
    plans = w.terms().postings.filter("term = 'ash'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,ash)" in plans
    bare = Store.create(spark, f"file://{tmp_path}/bare", "m", 2, keywords=False)
    bare.add(passages(spark, "a", [text(i) for i in range(9)]))
    bare.delete([4])
    assert bare.terms() is None and bare.manifest.count == 8
    assert bare.compact(index=True)
    w = bare
    same()
    assert bare.manifest.n_tokens == sum(len(text(i).replace("x-ray", "x ray").split()) for i in range(9) if i != 4)


def test_folds_write_a_logarithm(spark, tmp_path):
    w = Store.create(spark, f"file://{tmp_path}/c", "m", 2, keywords=False)
    written, fold = [], w._fold_chunks

    def counted(old, indexed):
        out = fold(old, indexed)
        written.append(sum(s.rows for s in out))
        return out

    w._fold_chunks = counted
    n, each = 16, 50
    rng = random.Random(1)
    batch = lambda i: passages(spark, f"d{i}", [rng.randbytes(300).hex() for _ in range(each)]).coalesce(1)
    w.add(batch(0))
    size = w.manifest.chunks[0].bytes
    for i in range(1, n):
        w.add(batch(i))
        w.tidy(size + size // 2)
        assert len(w.manifest.chunks) <= FAN * (1 + math.log(n, FAN))
    assert w.chunks().count() == n * each and sum(written) <= n * each * math.log(n, FAN)
    w.commit(remove_ids=w.chunks().filter("id < 120").select("id"))
    w.tidy(1 << 40)
    assert w.chunks().count() == w.manifest.count == n * each - 120 and w.chunks().agg(F.min("id")).first()[0] == 120


def test_a_commit_during_a_fold_stays(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    a = Store.create(spark, root, "m", 2)
    for t in ("ash", "birch"):
        a.add(passages(spark, t, [t, f"{t} two"]))
    b, fold = Store.open(spark, root, writer=True), a._fold_chunks

    def meanwhile(old, indexed):
        out = fold(old, indexed)
        b.delete([0])
        b.add(passages(spark, "cedar", ["cedar"]))
        return out

    a._fold_chunks = meanwhile
    assert a.compact() and texts_of(a) == ["ash two", "birch", "birch two", "cedar"] and a.manifest.count == 4
    assert {r["id"] for r in a.terms().scores([["ash"]]).collect()} == {1}
    c = Store.open(spark, root, writer=True)
    a._fold_chunks = fold
    keep = c._fold_chunks
    c._fold_chunks = lambda old, indexed: (keep(old, indexed), a.compact())[0]
    assert not c.compact() and texts_of(c) == ["ash two", "birch", "birch two", "cedar"]


def test_point_reads_open_one_file(spark, tmp_path):
    w = Store.create(spark, f"file://{tmp_path}/c", "m", 2)
    for d in range(3):
        w.add(passages(spark, f"d{d}", [f"text {d} {i}" for i in range(40)]).repartition(4))
    w.delete([41])
    rows = w._of_ids([57])
    assert len(rows.inputFiles()) == 1 and rows.first()["text"] == "text 1 17"
    assert len(w._of_ids([5000]).inputFiles()) == 0
    assert {i: r["text"] for i, r in w.get_many([3, 41, 119, 700]).items()} == {3: "text 0 3", 119: "text 2 39"}
    with pytest.raises(EngineError) as e:
        w.get(41)
    assert e.value.status == "NOT_FOUND" and w.get_vector(119) == [39.0, 1.0]
