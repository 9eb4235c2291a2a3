from __future__ import annotations

import os

import pytest

import __spark_entry__ as e
from landweave.queries import analytics

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and set(analytics.QUERIES) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["a2_transition_meta", "d1_training_matrix", "l5_visible_slices", "v1_adjusted_potentials", "r2_fuzzy_cells"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "lineitem", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = analytics.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    wanted = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({analytics.ORACLE_SQL[name]})").fetchall()
    clean = lambda rows: sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert clean(map(tuple, df.select(*cols).collect())) == clean(wanted)
