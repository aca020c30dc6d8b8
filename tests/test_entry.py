import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_contract():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_optional_parts(monkeypatch):
    """The rest works where the optional subpackage is gone."""
    for name in [m for m in sys.modules if m.startswith("lexmill.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lexmill.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "ranked_query_top10" in entry.queries() and not any(k.startswith("p1_") for k in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["rank", "doc_id", "score"]
    assert entry.entry(spark).count() == 10
