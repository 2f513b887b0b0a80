"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from flowmill import source_queries
from flowmill.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
#: One of each family; the driver compares all of them.
CHOSEN = [f for f in vars(source_queries) if f in ORACLE] + ["o43_imports_key", "o49_execution_order", "o54_special_values", "o55_declared_states", "o70_bijection", "o71_exact_set", "p1_long_years", "o89_two_levels", "o103_scoped_summary", "o144_lambda", "o144_lambda_nations", "o150_diagnostics_figures", "o162_column_allocation", "o173_transfers_dp", "i18_multiplier_relative_wages", "i35_surplus_value_productive", "a4_rest_of_world", "m_wiodr13", "m_petrovic", "p6_accounting_identity", "p8_table_keys", "p5_disaggregation", "v_ledger", "x1_deviations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
