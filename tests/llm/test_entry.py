import importlib
import os
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)


def test_entry_imports_without_the_subpackage(monkeypatch):
    import __spark_entry__ as e

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "flowmill.llm" or name.startswith("flowmill.llm.") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m.startswith("flowmill.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    import flowmill

    monkeypatch.delattr(flowmill, "llm", raising=False)
    importlib.reload(e)
    assert e.queries() and not any(n.startswith("op") for n in e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_mixing_matches_sql(spark):
    from flowmill.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(map(tuple, QUERIES["op2_mixing"](spark, SF).collect()))
    assert got == sorted(con.sql(ORACLE["op2_mixing"]).fetchall())
