"""Registered queries against their SQL on the smallest tables, and the registration without the training-data part."""

import os
import sys

import pytest

from posledger import catalogue

DATA = "/root/testdata/sf0.001"
SOME = ("position_fold", "position_fold_retracted", "liquidation_legs", "collateral_flag_latest", "hub_additive_fold", "hub_latest_wins", "fork_point", "price_asof", "oracle_batches", "scaled_amounts")


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and len(catalogue.QUERIES) >= 48


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    want = sorted(repr(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


def test_without_the_training_data_part(monkeypatch):
    import __spark_entry__ as driver

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(driver.queries()) == set(catalogue.QUERIES) and set(driver.oracle_sql()) == set(catalogue.ORACLES)
