"""The entry module with and without the training-data subpackage."""

import importlib
import sys

import __spark_entry__ as entry


def test_names():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 35


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "c_mean" in df.columns


def test_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("leafspan.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "leafspan.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr(sys.modules["leafspan"], "llm", raising=False)
    try:
        bare = importlib.reload(entry)
        assert not any(n.startswith("op") and n[2].isdigit() for n in bare.queries()) and "pipeline" not in bare.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
