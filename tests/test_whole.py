"""Queries over whole tables, where the first registered ones keep to a part of them: against their SQL, and that they grow."""

import os

import pytest

from posledger import catalogue
from posledger.plans import mapping as m

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n.endswith("_whole")))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    want = sorted(repr(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert got == want and got


def test_every_part_is_a_snapshot(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet")
    assert m.price_snapshots(spark, DATA).count() == parts.where("p_partkey % 14 <> 13").count() > 56
    assert m.label_rows(spark, DATA).count() == parts.where("p_partkey % 17 NOT IN (3, 11)").count() > 40
    assert m.price_snapshots(spark, DATA).where("price = 0").count() > 1
    assert all(r.priced_at > m.T0 + 56 for r in catalogue.QUERIES["latest_prices_whole"](spark, DATA).collect())


def test_health_counts_the_flag_and_keeps_every_digit(spark):
    from posledger.operators import risk

    schema = "chain_id int, user string, spoke string, using_as_collateral boolean, supplied_value decimal(38,0), debt_value decimal(38,0), factor_bps long"
    v, d = 123456789012345678901234567890123, 98765432109876543210987654321
    from decimal import Decimal

    rows = [(1, "a", "s", True, Decimal(v), Decimal(d), 5100), (1, "a", "s", False, Decimal(v), Decimal(0), 5100), (1, "b", "s", False, Decimal(v), Decimal(d), 5100), (1, "c", "s", True, Decimal(v), Decimal(0), 5100)]
    got = {r.user: r.health_factor for r in risk.health_factor_wide(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": str(v * 5100 * 10**14 // d), "b": "0", "c": None}


def test_some_wallet_has_no_collateral(spark):
    got = [r.health_factor for r in catalogue.QUERIES["health_factor_whole"](spark, DATA).collect()]
    assert "0" in got and any(x not in (None, "0") for x in got)
