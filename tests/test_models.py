"""Known model files."""

import hashlib

import pytest

from docspark.errors import EngineError
from docspark.sources import models
from docspark.sources.models import CATALOG, check_dim, digest, fetch, match_known, model_id, with_digests


def test_files_are_known_by_size_and_digest(spark, tmp_path):
    bodies = {"a.gguf": b"a" * 3_000_000, "b.gguf": b"b" * 3_000_000, "renamed.bin": b"c" * 10, "other.gguf": b"d" * 11, "b2.gguf": b"b" * 3_000_000}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    sha = lambda name: hashlib.sha256(bodies[name]).hexdigest()
    known = [("pa", "a.gguf", 3_000_000, sha("a.gguf")), ("pb", "b.gguf", 3_000_000, sha("b.gguf")), ("pb-again", "b.gguf", 3_000_000, sha("b.gguf")), ("pc", "c.gguf", 10, sha("renamed.bin")), ("pd", "other.gguf", 11, "0" * 64)]
    catalog = spark.createDataFrame([(*k, True, 8, False, "") for k in known], CATALOG)
    files = [(str(tmp_path / n), len(b)) for n, b in bodies.items()] + [(str(tmp_path / "gone.gguf"), 10), (str(tmp_path / "unknown size"), 12)]
    frame = with_digests(spark.createDataFrame(files, "path string, size long"), catalog)
    short = lambda rows: {r["path"].rpartition("/")[2]: r["profile"] for r in rows.collect()}
    assert short(match_known(frame, catalog)) == {"a.gguf": "pa", "b.gguf": "pb", "b2.gguf": "pb", "renamed.bin": "pc", "other.gguf": None, "gone.gguf": None, "unknown size": None}
    assert short(match_known(frame, catalog, by_name=True)) == {"a.gguf": "pa", "b.gguf": "pb", "b2.gguf": None, "renamed.bin": None, "other.gguf": "pd", "gone.gguf": None, "unknown size": None}
    assert {r["path"].rpartition("/")[2] for r in frame.filter("sha256 IS NULL").collect()} == {"gone.gguf", "unknown size"}


def test_names_and_dimensions():
    assert model_id("small-embed", "x") == "small-embed" and model_id("generic", "x") == "gguf:x" and model_id(None, "") == "gguf:unnamed"
    assert check_dim(0, 384, False) == 384 and check_dim(128, 384, True) == 128
    for bad in ((128, 384, False), (385, 384, True), (-1, 384, True)):
        with pytest.raises(EngineError):
            check_dim(*bad)
    with pytest.raises(EngineError) as e:
        check_dim(0, 384, True, embedding=False)
    assert e.value.status == "MODEL_MISMATCH"


def test_fetch(tmp_path, monkeypatch):
    body = b"model" * 1000
    (tmp_path / "source").write_bytes(body)
    url, target, sha = f"file://{tmp_path}/source", f"{tmp_path}/models/m.gguf", hashlib.sha256(body).hexdigest()
    assert fetch(url, target, len(body), sha) and digest(target) == sha and not fetch(url, target, len(body), sha)
    (tmp_path / "models" / "m.gguf").write_bytes(b"broken")
    monkeypatch.setattr(models, "BLOCK", 64)
    assert fetch(url, target, len(body), sha) and digest(target) == sha
    for size, name in ((len(body) - 1, sha), (len(body), "0" * 64), (10, sha)):
        with pytest.raises(EngineError) as e:
            fetch(url, f"{tmp_path}/models/n.gguf", size, name)
        assert e.value.status == "IO"
    with pytest.raises(EngineError):
        fetch(f"file://{tmp_path}/nothing", f"{tmp_path}/models/n.gguf", 1, sha)
    assert [p.name for p in (tmp_path / "models").iterdir()] == ["m.gguf"]
