"""Amounts of any width: exact up to what is declared, an error or a told fault beyond, and never a cut."""

import random

import pytest
from pyspark.sql import functions as F
from test_ingest import event, events, ranges

from posledger.functions import wideint as w
from posledger.operators import folds, risk
from posledger.operators import ledger as lg
from posledger.streaming import ingest


def test_limbs_and_sums_against_python_integers(spark):
    r = random.Random(8)
    numbers = [r.choice((-1, 1)) * r.randrange(10 ** r.choice((1, 20, 26, 27, 52, 53, 77, 78))) for _ in range(400)] + [10**78 - 1, 1 - 10**78, 10**26, -(10**26), 10**52, -(10**52), 0]
    rows = [(i % 23, str(n) if r.random() < 0.8 else ("-" if n < 0 else "") + "0" * (78 - len(str(abs(n)))) + str(abs(n))) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "k int, t string")
    for count in (3, 6):
        sums = df.groupBy("k").agg(*w.sums_wide({"x": w.limbs(F.col("t"), count)}))
        got = {k: int(x) for k, x in sums.select("k", w.joined_sums("x", count)).collect()}
        assert got == {k: sum(int(t) for j, t in rows if j == k) for k in got}
        named = sums.select("k", w.joined_columns(*[f"_x_{i}" for i in range(count)]).alias("x"))
        assert {k: int(x) for k, x in named.collect()} == got
    for k in range(3):
        for t, got in df.withColumn("scale", F.lit(k)).select("t", F.expr(w.limb("t"))).collect():
            n, sign = abs(int(t)), -1 if int(t) < 0 else 1
            assert got == (None if k and len(t) <= w.LIMB else sign * (n // 10 ** (26 * k) % 10**26))


def test_more_than_declared_is_an_error(spark):
    df = spark.createDataFrame([("1" + "0" * 84,)], "t string")
    with pytest.raises(Exception, match="more than 78 digits"):
        df.agg(*w.sums_wide({"x": w.limbs(F.col("t"))})).collect()
    with pytest.raises(Exception, match="suppliedShares"):
        folds.positions_current(lg.append(events(spark, event(1, 10**84)), 1)).collect()
    priced = spark.createDataFrame([(1, "u", "s", "9" * 94, "1"), (1, "u", "s", "9" * 94, "-" + "7" * 90)], "chain_id int, user string, spoke string, supplied_value string, debt_value string")
    (total,) = risk.spoke_totals(priced).collect()
    assert int(total.supplied_value) == 2 * int("9" * 94) and int(total.net_worth) == 2 * int("9" * 94) - 1 + int("7" * 90)


def test_one_wide_wallet_stops_no_other(spark):
    rows = [event(1, 10**77), event(2, 10**77, 1), event(3, 5, 2)]
    rows += [(*event(4, 1)[:7], '{"reserveId": "7", "user": "0xB", "suppliedShares": "3", "suppliedAmount": "3"}')]
    got = {r.user: r.supplied_shares for r in folds.open_positions(folds.positions_current(lg.append(events(spark, *rows), 1))).collect()}
    assert got == {"0xa": str(2 * 10**77 + 5), "0xb": "3"}


def test_poison_goes_aside_and_comes_back_by_retraction(spark, tmp_path):
    at = str(tmp_path)
    ingest.start(spark, f"{at}/ledger", f"{at}/progress")
    more = {"deltas": f"{at}/deltas", "view": f"{at}/view", "poison": f"{at}/poison"}
    bad = (*event(2, 1)[:7], '{"reserveId": "7", "user": "0xB", "suppliedShares": "x", "suppliedAmount": "3"}')
    lost = (*event(3, 1)[:6], "SetUsingAsCollateral", '{"reserveId": "7", "user": "0xB"}')
    ingest.dispatch(ingest.dispatches(events(spark, event(1, 4), bad, lost, event(4, 10**90)), ranges(spark, (0, 9, 1, None, False))), 0, f"{at}/ledger", f"{at}/progress", **more)
    assert sorted((r.block_number, r.fault, r.sign) for r in spark.read.parquet(f"{at}/poison").collect()) == [(2, "suppliedShares", 1), (3, "usingAsCollateral", 1), (4, "suppliedShares", 1)]
    assert [(r.user, r.supplied_shares) for r in ingest.positions(spark, f"{at}/deltas").collect()] == [("0xa", "4")]
    good = (*bad[:7], bad[7].replace('"x"', '"6"'))
    ingest.dispatch(ingest.dispatches(events(spark, good), ranges(spark, (2, 2, 2, None, False))), 1, f"{at}/ledger", f"{at}/progress", **more)
    assert sorted((r.block_number, r.sign) for r in spark.read.parquet(f"{at}/poison").where("block_number = 2").collect()) == [(2, -1), (2, 1)]
    want = [("0xa", "4"), ("0xb", "6")]
    assert sorted((r.user, r.supplied_shares) for r in ingest.positions(spark, f"{at}/deltas").collect()) == want
    ingest.rebuild(spark, f"{at}/ledger", f"{at}/deltas", f"{at}/view", sound_only=True)
    assert sorted((r.user, r.supplied_shares) for r in ingest.positions(spark, f"{at}/deltas").collect()) == want


def test_an_order_of_digits(spark):
    values = ["-12", "-3", "0", "7", "10", "1" + "0" * 50, "-1" + "0" * 50, "-13"]
    df = spark.createDataFrame([(v, "u", "s", i) for i, v in enumerate(values)], "x string, user string, spoke string, reserve_id long")
    assert [r.x for r in risk.largest_positions(df, "x", 9).collect()] == sorted(values, key=int, reverse=True)
