"""Changes of folders as a stream, and listings that fail."""

import os

from docspark.api import Collection
from docspark.functions.embed import HashEmbedder
from docspark.plans.sync import removals
from docspark.sources import changes
from docspark.sources.changes import FolderReader, compare, outermost, place
from docspark.sources.listing import walk
from docspark.streaming.watch import watch


def took(reader, start, end):
    rows = [r for p in reader.partitions({"listing": start}, {"listing": end}) for r in reader.read(p)]
    return [(os.path.basename(r[0]), r[3], r[4]) for r in rows]


def test_listings_are_offsets(tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "PART", 2)
    root = tmp_path / "f"
    (root / "a").mkdir(parents=True)
    for name in ("a/x.txt", "a.txt", "b.txt", "ü.txt"):
        (root / name).write_text(name)
    (root / ".git").mkdir()
    (root / ".git" / "c.txt").write_text("skipped")
    new = lambda: FolderReader([str(root), str(root / "a")], f"file://{tmp_path}/state", False)
    r = new()
    assert r.initialOffset() == {"listing": 0} and r.latestOffset() == {"listing": 1} == r.latestOffset() == new().latestOffset()
    assert len(r.partitions({"listing": 0}, {"listing": 1})) == 2
    assert took(r, 0, 1) == [("x.txt", "added", 1), ("a.txt", "added", 1), ("b.txt", "added", 1), ("ü.txt", "added", 1)]
    (root / "b.txt").write_text("longer")
    (root / "a" / "x.txt").unlink()
    assert new().latestOffset() == {"listing": 2} and took(new(), 1, 2) == [("x.txt", "removed", 2), ("b.txt", "changed", 2)]
    (root / "c.txt").write_text("c")
    assert r.latestOffset() == {"listing": 3} and took(r, 1, 3)[-1] == ("c.txt", "added", 3)
    (tmp_path / "f").rename(tmp_path / "away")  # unknown, not gone
    assert r.latestOffset() == {"listing": 3}
    (tmp_path / "away").rename(root)
    (root / "d.txt").write_text("d")
    for n in range(4, 8):
        (root / "d.txt").write_text("d" * n)
        assert r.latestOffset() == {"listing": n}
    r.commit({"listing": 7})
    assert sorted(p.name[:9] for p in (tmp_path / "state").glob("*.listing.gz")) == ["000000005", "000000006", "000000007"]


def test_compare_keeps_what_is_unknown():
    old = [("/r/a/x", 1, 1), ("/r/a.txt", 1, 1), ("/r/b", 1, 1)]
    assert old == sorted(old, key=lambda e: place(e[0]))
    got = list(compare(iter(old), iter([("/r/b", 1, 2), ("/r/c", 1, 1)]), ["/r/a"]))
    assert got == [(old[0], ""), (old[1], "removed"), (("/r/b", 1, 2), "changed"), (("/r/c", 1, 1), "added")]
    assert outermost(["/r/b", "/r", "/r/", "/rr"]) == ["/r", "/rr"]


def test_restart_reads_no_unchanged_file(spark, tmp_path, monkeypatch):
    folder = tmp_path / "docs"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.txt").write_text(f"File number {i}.")
    c = Collection.create(spark, f"file://{tmp_path}/c", HashEmbedder(4))
    seen = []

    def once():
        del seen[:]
        q = watch(Collection.open(spark, f"file://{tmp_path}/c", HashEmbedder(4), writer=True), [str(folder)], on_status=seen.append, once=True)
        q.awaitTermination(240)
        assert q.exception() is None
        return [(s.files_seen, s.files_added, s.files_updated, s.files_removed) for s in seen if s.files_seen or s.files_removed]

    assert once() == [(5, 5, 0, 0)]
    assert once() == []
    (folder / "1.txt").write_text("Another text.")
    (folder / "2.txt").unlink()
    (folder / "new.txt").write_text("New.")
    assert once() == [(2, 1, 1, 1)]
    assert once() == []
    c.refresh()
    assert sorted(r["text"] for r in c.store.chunks().collect()) == ["Another text.", "File number 0.", "File number 3.", "File number 4.", "New."]
    # a batch that is repeated changes nothing
    rows = spark.createDataFrame([(str(folder / "new.txt"), 4, os.stat(folder / "new.txt").st_mtime_ns, "added", 2), (str(folder / "2.txt"), 1, 1, "removed", 3), (str(folder / "2.txt"), 1, 1, "added", 1)], changes.SCHEMA)
    version = c.store.manifest.version
    s = c.apply_changes(rows)
    assert (s.files_seen, s.files_unchanged, s.files_removed) == (1, 1, 0) and c.store.manifest.version == version


def test_a_folder_that_cannot_be_listed_keeps_its_documents(spark, tmp_path, monkeypatch):
    from docspark.sources import listing

    for name in ("a", "b"):
        (tmp_path / "docs" / name).mkdir(parents=True)
        (tmp_path / "docs" / name / "x.txt").write_text(f"File of {name}.")
    (tmp_path / "docs" / "top.txt").write_text("On top.")
    real = os.listdir

    def failing(path="."):
        if str(path).endswith("docs/b"):
            raise PermissionError(13, "no", path)
        return real(path)

    failed = []
    monkeypatch.setattr(listing.os, "listdir", failing)
    assert [p for p, *_ in walk(str(tmp_path / "docs"), failed=failed)] == [str(tmp_path / "docs/a/x.txt"), str(tmp_path / "docs/top.txt")]
    assert failed == [str(tmp_path / "docs/b")]
    monkeypatch.undo()
    stored = spark.createDataFrame([("/d/a/x",), ("/d/b/x",), ("/d/b/deep/y",), ("/d/bb/x",), ("/d/here",)], "source_path string")
    gone = removals(stored, spark.createDataFrame([("/d/here",)], "source_path string"), ["/d"], spark.createDataFrame([("/d/b",)], "path string"))
    assert {r["source_path"] for r in gone.collect()} == {"/d/a/x", "/d/bb/x"}


def test_what_cannot_be_looked_at_is_not_removed(spark, tmp_path):
    """A folder and a file that a link to itself has taken the place of; one more file is gone."""
    c = Collection.create(spark, f"file://{tmp_path}/c", HashEmbedder(4))
    docs = tmp_path / "docs"
    (docs / "a").mkdir(parents=True)
    for name in ("a/x.txt", "y.txt", "z.txt"):
        (docs / name).write_text(f"File {name}.")
    c.ingest([str(docs)])
    (docs / "a").rename(tmp_path / "away")
    for name in ("y.txt", "z.txt"):
        (docs / name).unlink()
    for name in ("a", "y.txt"):
        (docs / name).symlink_to(docs / name)
    s = c.ingest([str(docs)])
    assert s.files_removed == 1 and sorted(r["text"] for r in c.store.chunks().collect()) == ["File a/x.txt.", "File y.txt."]
