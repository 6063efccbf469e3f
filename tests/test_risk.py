"""State at many instants, pinned risk parameters and time to liquidation against plain models."""

import json
import random

from pyspark.sql import functions as F

from posledger.functions import wideint as w
from posledger.operators import asof, folds, risk, valuation
from posledger.operators import ledger as lg

SPOKE, HUB = "0x" + "9" * 40, "0x" + "c" * 40
SCHEMA = "chain_id int, address string, block_number long, log_index int, block_timestamp long, tx_hash string, event_name string, body string"


def row(name, block, log=0, address=SPOKE, **body):
    return (1, address, block, log, 1000 + 12 * block, "0xt", name, json.dumps({k: v if isinstance(v, (bool, dict)) else str(v) for k, v in body.items()}))


def test_many_instants_equal_single_runs(spark):
    r, rows = random.Random(3), []
    for b in range(60):
        for log in range(2):
            a = r.randrange(3)
            rows.append(r.choice([
                row("Add", b, log, HUB, assetId=a, shares=r.choice((9, 10**40)), amount=10), row("Draw", b, log, HUB, assetId=a, drawnShares=3, drawnAmount=3),
                row("UpdateAsset", b, log, HUB, assetId=a, drawnIndex=10**27 + b, drawnRate=10**25, accruedFees=b), row("AddAsset", b, log, HUB, assetId=a, underlying="0x%040x" % a, decimals=6),
            ]))
    ledger = lg.append(spark.createDataFrame(rows, SCHEMA), 1)
    ledger = ledger.unionByName(lg.retract_range(ledger, 1, 20, 29)).unionByName(lg.append(spark.createDataFrame(rows[44:50], SCHEMA), 2))
    instants = [999, 1012, 1301, 5000]
    asks = spark.createDataFrame([(1, HUB, a, t, t % 7) for a in range(4) for t in [*instants, 1300]], "chain_id int, hub string, asset_id long, at long, drawn long")
    got = {}
    for bucket in (100, 10**6):
        many = valuation.asset_at(asof.assets_at(asks, ledger, bucket=bucket), F.col("at")).drop("drawn")
        assert many.count() == 20
        for x in many.collect():
            got.setdefault((x.at, x.asset_id), set()).add(tuple(x[c] for c in (*folds.ASSET_SUMS, *folds.STATE, "events", "index_at", "total_added_assets")))
    for t in instants:
        one = valuation.asset_at(folds.hub_assets_current(ledger.where(F.col("block_timestamp") <= t)), t)
        want = {x.asset_id: tuple(x[c] for c in (*folds.ASSET_SUMS, *folds.STATE, "events", "index_at", "total_added_assets")) for x in one.collect()}
        for a in range(4):
            (have,) = got[t, a]
            assert have == want[a] if a in want else have[:7] == ("0",) * 7 and have[-3] == 0 and have[-1] is None


def test_positions_at_instants(spark):
    r, rows = random.Random(5), []
    for b in range(40):
        user = "0x%d" % r.randrange(3)
        rows.append(r.choice([row("Supply", b, reserveId=1, user=user, suppliedShares=5 + b, suppliedAmount=1), row("SetUsingAsCollateral", b, reserveId=1, user=user, usingAsCollateral=r.random() < 0.5)]))
    ledger = lg.append(spark.createDataFrame(rows, SCHEMA), 1)
    ledger = ledger.unionByName(lg.retract_range(ledger, 1, 10, 14))
    asks = spark.createDataFrame([(1, "0x%d" % u, SPOKE, 1, 1000 + 12 * b) for u in range(3) for b in range(0, 40, 9)], "chain_id int, user string, spoke string, reserve_id long, at long")
    got = {(x.user, x.at): (x.supplied_shares, x.using_as_collateral, x.events) for x in asof.positions_at(asks, ledger, bucket=60).collect()}
    for t in sorted({k[1] for k in got}):
        want = {x.user: (x.supplied_shares, x.using_as_collateral, x.events) for x in folds.positions_current(ledger.where(F.col("block_timestamp") <= t)).collect()}
        assert all(got[u, t] == want.get(u, ("0", False, 0)) for u in ("0x0", "0x1", "0x2"))


def test_a_wallet_keeps_the_factor_it_is_pinned_to(spark):
    config = lambda name, b, reserve, key, factor: row(name, b, reserve, reserveId=reserve, dynamicConfigKey=key, config={"collateralFactor": factor})
    supply = lambda b, user, reserve=7: row("Supply", b, 10 + ord(user[-1]) * 2 + reserve, reserveId=reserve, user=user, suppliedShares=1, suppliedAmount=1)
    rows = [
        config("AddDynamicReserveConfig", 1, 7, 0, 8000), config("AddDynamicReserveConfig", 1, 8, 0, 5000), supply(2, "0xA"), supply(2, "0xB"), supply(2, "0xB", 8), supply(2, "0xC"), supply(0, "0xE"),
        config("AddDynamicReserveConfig", 5, 7, 1, 7000), config("AddDynamicReserveConfig", 5, 8, 1, 0), supply(6, "0xD"),
        row("RefreshAllUserDynamicConfig", 7, user="0xB"), row("RefreshSingleUserDynamicConfig", 7, 2, user="0xC", reserveId=7), config("UpdateDynamicReserveConfig", 9, 7, 0, 7500),
        row("RefreshAllUserDynamicConfig", 1, 5, user="0xD"),
    ]
    ledger = lg.append(spark.createDataFrame(rows, SCHEMA), 1)
    of = lambda x: {(p.user, p.reserve_id): (p.config_key, p.factor_bps) for p in risk.pinned_factors(x, 2 * risk.PLACE).collect()}
    assert of(ledger) == {("0xa", 7): (0, 7500), ("0xb", 7): (1, 7000), ("0xb", 8): (1, 0), ("0xc", 7): (1, 7000), ("0xd", 7): (1, 7000), ("0xe", 7): (None, None)}
    assert of(ledger.unionByName(lg.retract_range(ledger, 1, 7, 7)))["0xb", 8] == (0, 5000)


def test_time_to_liquidation_is_the_first_second(spark):
    r = random.Random(9)
    debts, weighted, want = [], [], {}
    for k in range(60):
        own = [(r.randrange(1, 10**18), r.choice((0, 5)), w.RAY + r.randrange(w.RAY), r.choice((0, 1, w.RAY // 20, 5 * w.RAY)), r.choice((6, 18, 20)), 10**8) for _ in range(r.randint(1, 4))]
        value = lambda s, own=own: sum(risk_value(d, s) for d in own)
        have = value(0) * 10_000 * r.choice((50, 100, 101, 130, 10**6)) // 100 + r.choice((0, -1, 1))
        debts += [(1, "u%d" % k, "s", *map(str, d)) for d in own]
        weighted.append((1, "u%d" % k, "s", str(have)))
        want["u%d" % k] = (have, value)
    names = "chain_id int, user string, spoke string, drawn_shares string, premium_debt string, `index` string, rate string, decimals string, price string"
    got = risk.time_to_liquidation(spark.createDataFrame(debts + [(1, "none", "s", "1", "0", None, "1", "6", "1")], names), spark.createDataFrame(weighted, "chain_id int, user string, spoke string, weighted string"))
    got = {x.user: x.seconds for x in got.collect()}
    assert got.pop("none") is None and 0 in got.values() and None in got.values() and len(set(got.values())) > 10
    for user, seconds in got.items():
        have, value = want[user]
        under = lambda s, value=value, have=have: value(s) * 10_000 > have
        assert not under(risk.HORIZON) if seconds is None else under(seconds) and (seconds == 0 or not under(seconds - 1))


def risk_value(debt, seconds):
    drawn, premium, index, rate, decimals, price = debt
    now = index if not seconds else -(-(index * (w.RAY + rate * seconds // w.YEAR_SECONDS)) // w.RAY)
    amount = -(-(drawn * now) // w.RAY) + premium
    return amount * price * 10 ** (18 - decimals) if decimals <= 18 else amount * price // 10 ** (decimals - 18)


def test_samples_of_strata_are_bounded_and_the_same_again(spark):
    from posledger.operators import reconcile

    rows = [(1, "u%d" % i, "s", i % 3, i % 7, None if i % 11 == 0 else i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "chain_id int, user string, spoke string, reserve_id long, block long, size long")
    strata = {"touched": (F.col("block") > 4, None), "largest": (None, F.col("size")), "none": (F.col("block") > 99, None), "random": (None, None)}
    got = [sorted(map(tuple, reconcile.triage(x, strata, 9, 3).collect())) for x in (df, df.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == 27
    assert all(r[4] > 4 for r in got[0] if r[-1] == "touched") and all(r[5] == 4 for r in got[0] if r[-1] == "largest")
    assert got[0] != sorted(map(tuple, reconcile.triage(df, strata, 9, 4).collect()))
