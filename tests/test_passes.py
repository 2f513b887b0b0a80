"""The facts are read once by queries that use flows and accounts several times."""

import os

import pytest

from flowmill import source_queries  # noqa: F401
from flowmill.plans import run
from flowmill.queries import QUERIES
from flowmill.sources import market

SF = "/root/testdata/sf0.001"
ONCE = ["o163_strict_allocation", "m_wiodr13", "m_ochoa_1", "v_ledger", "i25_capital_depreciation", "m_alternative_1", "m_ochoa_2"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ONCE)
def test_facts_are_read_once(spark, monkeypatch, name):
    made, cells = [], market.cells
    monkeypatch.setattr(market, "cells", lambda *a, **k: made.append(a) or cells(*a, **k))
    got = QUERIES[name](spark, SF)
    assert len(made) == 1
    assert not [f for f in got.inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["m_ochoa_2", "o144_lambda"])
def test_labour_values_need_no_valued_flows(spark, monkeypatch, name):
    """All flows were valued and their sums by destination written, for a result that has neither."""
    made, kept = [], run.kept
    monkeypatch.setattr(run, "kept", lambda df, what: made.append(what) or kept(df, what))
    got = QUERIES[name](spark, SF)
    assert sorted(made) == ["labour", "prepared", "solution"]
    assert not [f for f in got.inputFiles() if "/traded-" in f]
