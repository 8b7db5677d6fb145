"""The driver's contract."""

import importlib

import __spark_entry__ as entry


def test_queries_and_sql_name_the_same_things():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 30


def test_library_stands_without_the_llm_subpackage(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("docspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    assert not any(k.startswith("op1") or k == "pipeline" for k in alone.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_sql_is_text():
    assert all(isinstance(v, str) for v in entry.oracle_sql().values())
