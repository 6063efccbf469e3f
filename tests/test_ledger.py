import json
import random

import pytest
from pyspark.sql import functions as F

from posledger.operators import folds, page, valuation
from posledger.operators import ledger as lg

SPOKE, SECOND, HUB = "0x94e7a5dcbe816e498b89ab752661904e2f56c485", "0x973a023a77420ba610f06b3858ad991df6d85a08", "0xcca852bc40e560adc3b1cc58ca5b55638ce826c9"
ALICE, BOB = "0x82D16fF1C724ab72F218A3f7f6DD3E5385ee87E8", "0xB8516f75DCf450b5b455b5114F5a92F6abD37dCa"
RAY, T0 = 10**27, 1785000000
SCHEMA = "chain_id int, address string, block_number long, log_index int, block_timestamp long, tx_hash string, event_name string, body string"


def event(name, block, log=0, address=SPOKE, **body):
    nested = {k: {x: str(y) for x, y in v.items()} if isinstance(v, dict) and k == "premiumDelta" else v if isinstance(v, (bool, dict)) or k == "decimals" else str(v) for k, v in body.items()}
    return (1, address, block, log, T0 + block, "0x%d" % block, name, json.dumps(nested))


def supply(n, block=100, reserve=7, user=ALICE, log=0):
    return event("Supply", block, log, reserveId=reserve, caller=user, user=user, suppliedShares=n, suppliedAmount=n)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def positions(ledger):
    return {(r.user, r.reserve_id): r for r in folds.positions_current(ledger).collect()}


def test_dispatch_and_retraction(spark):
    a = frame(spark, supply(500))
    first = lg.append(a, 1)
    twice = lg.replace_range(first, a, 1, 100, 100, 2)
    (p,) = positions(twice).values()
    assert (int(p.supplied_shares), p.events, p.user) == (500, 1, ALICE.lower())
    gone = first.unionByName(lg.retract_range(first, 1, 100, 200))
    assert folds.open_positions(folds.positions_current(gone)).count() == 0
    again = gone.unionByName(lg.append(frame(spark, supply(60)), 2))
    assert [int(p.supplied_shares) for p in positions(again).values()] == [60]
    doubled = first.unionByName(lg.append(a, 2))
    assert [int(p.supplied_shares) for p in positions(doubled).values()] == [1000]
    assert lg.current(doubled).count() == 2 and lg.current(twice).count() == 1


def flag(value, block, log=0):
    return event("SetUsingAsCollateral", block, log, reserveId=7, caller=ALICE, user=ALICE, usingAsCollateral=value)


def test_flags_follow_the_chain_and_not_the_version(spark):
    ledger = lg.append(frame(spark, flag(True, 100)), 1000).unionByName(lg.append(frame(spark, flag(False, 200)), 2000))
    of = lambda x: next(iter(positions(x).values())).using_as_collateral
    assert of(ledger) is False
    assert of(ledger.unionByName(lg.retract_range(ledger, 1, 200, 200))) is True
    assert of(lg.replace_range(ledger, frame(spark, flag(True, 100)), 1, 100, 100, 5000)) is False


def liquidation(collateral, debt, receive=False, to=0):
    return event(
        "LiquidationCall", 300, collateralReserveId=collateral, debtReserveId=debt, user=ALICE, liquidator=BOB, receiveShares=receive, debtAmountRestored=100, drawnSharesLiquidated=100,
        premiumDelta={"sharesDelta": 0, "offsetRayDelta": 0, "restoredPremiumRay": 0}, collateralAmountRemoved=150, collateralSharesLiquidated=150, collateralSharesToLiquidator=to,
    )


def test_liquidation_legs(spark):
    borrow = lambda r: event("Borrow", 150, reserveId=r, caller=ALICE, user=ALICE, drawnShares=400, drawnAmount=400)
    got = positions(lg.append(frame(spark, supply(500), borrow(13), liquidation(7, 13)), 1))
    assert {(k[1], int(p.supplied_shares), int(p.drawn_shares)) for k, p in got.items()} == {(7, 350, 0), (13, 0, 300)}
    got = positions(lg.append(frame(spark, supply(500), borrow(7), liquidation(7, 7, True, 140)), 1))
    assert {(k[0], int(p.supplied_shares), int(p.drawn_shares)) for k, p in got.items()} == {(ALICE.lower(), 350, 300), (BOB.lower(), 140, 0)}


def test_a_missing_number_is_an_error(spark):
    bad = event("Supply", 1, reserveId=7, caller=ALICE, user=ALICE, suppliedAmount=5)
    with pytest.raises(Exception, match="suppliedShares"):
        folds.positions_current(lg.append(frame(spark, bad), 1)).collect()


def hub(name, block, **body):
    return event(name, block, 0, HUB, assetId=7, **body)


def pool(spark, *rows):
    (r,) = folds.hub_assets_current(lg.append(frame(spark, *rows), 1)).collect()
    return r


def test_pool_folds(spark):
    premium = lambda s, o: {"sharesDelta": s, "offsetRayDelta": o, "restoredPremiumRay": 0}
    r = pool(spark, hub("Add", 1, shares=1000, amount=1000), hub("Draw", 2, drawnShares=300, drawnAmount=300), hub("Restore", 3, drawnShares=300, premiumDelta=premium(0, 0), drawnAmount=300, premiumAmount=25))
    assert (int(r.liquidity), int(r.drawn_shares), int(r.added_shares)) == (1025, 0, 1000)
    big = 295 * 10**28
    rows = [hub("Add", 1, shares=1000, amount=1000), hub("Draw", 2, drawnShares=300, drawnAmount=300), hub("ReportDeficit", 3, drawnShares=300, premiumDelta=premium(0, 0), deficitAmountRay=big)]
    assert pool(spark, *rows).deficit_ray == str(big) and int(pool(spark, *rows).liquidity) == 700
    r = pool(spark, *rows, hub("EliminateDeficit", 4, shares=250, deficitAmountRay=big))
    assert r.deficit_ray == "0" and int(r.added_shares) == 750
    r = pool(spark, hub("RefreshPremium", 1, premiumDelta=premium(1000, -500)), hub("RefreshPremium", 2, premiumDelta=premium(250, -125)))
    assert int(r.premium_shares) == 1250 and r.premium_offset_ray == "-625"
    r = pool(spark, hub("Add", 1, shares=1000, amount=1000), hub("Sweep", 2, amount=400), hub("Reclaim", 3, amount=150), hub("MintFeeShares", 4, shares=40, assets=1))
    assert (int(r.liquidity), int(r.swept), int(r.added_shares)) == (750, 250, 1040)


def update(block, index, rate=RAY // 20, fees=0):
    return hub("UpdateAsset", block, drawnIndex=index, drawnRate=rate, accruedFees=fees)


def test_latest_wins_per_column(spark):
    token = "0xA0b86991c6218b36c1d19d4a2e9eb0ce3606eb48"
    r = pool(spark, hub("AddAsset", 100, underlying=token, decimals=6), hub("UpdateAssetConfig", 200, config={"liquidityFee": 1000}), update(300, RAY + 9, 60, 20), update(250, RAY))
    assert (r.underlying, r.decimals, r.liquidity_fee, int(r.drawn_index), int(r.drawn_rate), int(r.realized_fees), r.index_timestamp) == (token.lower(), 6, 1000, RAY + 9, 60, 20, T0 + 300)
    ledger = lg.append(frame(spark, update(100, RAY, 50), update(200, RAY + 9, 60)), 1)
    (r,) = folds.hub_assets_current(ledger.unionByName(lg.retract_range(ledger, 1, 200, 200))).collect()
    assert (int(r.drawn_index), int(r.drawn_rate)) == (RAY, 50)


def test_valued_page(spark):
    hub_rows = [
        hub("AddAsset", 10, underlying="0x" + "1" * 40, decimals=6), hub("Add", 20, shares=10**6, amount=10**6), hub("Draw", 30, drawnShares=4 * 10**5, drawnAmount=4 * 10**5), update(100, RAY),
    ]
    reserve = event("AddReserve", 5, reserveId=7, assetId=7, hub=HUB)
    borrow = event("Borrow", 101, reserveId=7, caller=BOB, user=BOB, drawnShares=10**6, drawnAmount=10**6)
    spoke = lg.append(frame(spark, reserve, supply(1000), supply(5, 102, 99), supply(1, 103, 13), supply(1, 104, 3), borrow), 1)
    pool_view = folds.hub_assets_current(lg.append(frame(spark, *hub_rows), 1))

    def views(at):
        return {"positions": folds.positions_current(spoke), "reserves": folds.reserves_current(spoke), "assets_at": valuation.asset_at(pool_view, at)}

    now, later = views(T0 + 100), views(T0 + 100 + 31536000)
    rows = page.positions_page(now, 1, ALICE).collect()
    assert [r.reserve_id for r in rows] == [3, 7, 13, 99]
    assert rows[1].value.supplied == 1000 and rows[0].asset is None and rows[0].value is None and rows[0].next_key is None
    first = page.positions_page(now, 1, ALICE, limit=2).collect()
    assert [r.reserve_id for r in first] == [3, 7] and (first[0].next_key.spoke, first[0].next_key.reserve_id) == (SPOKE, 7)
    assert [r.reserve_id for r in page.positions_page(now, 1, ALICE, limit=2, after=(SPOKE, 7)).collect()] == [13, 99]
    assert page.positions_page(now, 1, BOB).first().value.total_debt == 10**6
    assert page.positions_page(later, 1, BOB).first().value.total_debt == 1050000
    for bad in ({"limit": 0}, {"limit": 201}, {"spoke": "0x1"}):
        with pytest.raises(ValueError):
            page.positions_page(now, 1, ALICE, **bad)


def test_random_ledgers_against_a_model(spark):
    """Shuffled rows, retracted and re-dispatched ranges: the fold is a function of what is live."""
    r = random.Random(5)
    live, ledger, version = {}, None, 0
    for _ in range(6):
        lo = r.randint(0, 40)
        hi, version = lo + r.randint(0, 20), version + 1
        rows = {b: supply(r.randint(1, 10**30), b, b % 3, r.choice((ALICE, BOB))) for b in range(lo, hi + 1) if r.random() < 0.7}
        live = {b: x for b, x in live.items() if not lo <= b <= hi} | rows
        new = frame(spark, *rows.values()) if rows else spark.createDataFrame([], SCHEMA)
        ledger = lg.append(new, version) if ledger is None else lg.replace_range(ledger, new, 1, lo, hi, version)
        ledger = spark.createDataFrame(r.sample(x := ledger.collect(), len(x)), ledger.schema)
    want = {}
    for x in live.values():
        b = json.loads(x[7])
        k = (b["user"].lower(), int(b["reserveId"]))
        want[k] = want.get(k, 0) + int(b["suppliedShares"])
    got = {k: int(p.supplied_shares) for k, p in positions(ledger).items() if p.events}
    assert got == want and lg.current(ledger).count() == len(live)


def test_values_of_realistic_size_against_python(spark):
    """Shares of 1e24, an index of 1.2e27, offsets of 61 digits, a position of a billion dollars; one bad position stops no other."""
    from decimal import Decimal

    from posledger.functions import wideint as w

    r = random.Random(9)
    index, rate, total, added, at = 12 * 10**26 + 7, RAY // 20, 3 * 10**25 + 1, 2 * 10**25 + 3, T0 + 100 + 12345
    kind = "chain_id int, hub string, asset_id long, liquidity decimal(38,0), added_shares decimal(38,0), drawn_shares decimal(38,0), premium_shares decimal(38,0), swept decimal(38,0), drawn_index decimal(38,0), drawn_rate decimal(38,0), realized_fees decimal(38,0), index_timestamp long, liquidity_fee int, underlying string, decimals int, premium_offset_ray string, deficit_ray string"
    D = Decimal
    rows = [
        (1, HUB, 7, D(total), D(added), D(10**24 + 9), D(10**23), D(5), D(index), D(rate), D(77), T0 + 100, 1000, "0x1", 6, str(-(10**51) - 3), str(10**40 + 1)),
        (1, HUB, 8, D(1), D(1), D(1), D(0), D(0), D(index), D(rate), D(0), at + 1, 0, "0x2", 6, "0", "0"),
    ]
    pool_df = spark.createDataFrame(rows, kind)
    pool = {x.asset_id: x for x in valuation.asset_at(pool_df, at).collect()}
    up = lambda x: -(-x // RAY)
    now = up(index * (RAY + rate * 12345 // 31536000))
    owed = lambda i: (10**24 + 9) * i + 10**23 * i + 10**51 + 3 + 10**40 + 1
    fees = (up(owed(now)) - up(owed(index))) * 1000 // 10000
    assets = total + 5 + up(owed(now)) - 77 - fees
    assert (int(pool[7].index_at), int(pool[7].unrealized_fees), int(pool[7].total_added_assets), pool[7].unvalued, pool[7].at) == (now, fees, assets, None, at)
    assert pool[8].index_at is None and pool[8].unvalued == "instant before the checkpoint"
    held = [(1, "u%d" % i, SPOKE, 7, r.randrange(10**24), r.randrange(10**24), r.randrange(10**24), -r.randrange(10**60, 10**61)) for i in range(30)]
    held += [(1, "neg", SPOKE, 7, -1, 5, 0, 0), (1, "premium", SPOKE, 7, 1, 5, 1, 10**60), (1, "early", SPOKE, 8, 1, 5, 0, 0), (1, "none", SPOKE, 99, 1, 5, 0, 0), (1, "real", SPOKE, 7, 0, 422166581625087607993, 0, 0)]
    kind = "chain_id int, user string, spoke string, reserve_id long, supplied_shares decimal(38,0), drawn_shares decimal(38,0), premium_shares decimal(38,0), premium_offset_ray string"
    df = spark.createDataFrame([(*x[:4], *map(D, x[4:7]), str(x[7])) for x in held], kind)
    reserves = spark.createDataFrame([(1, SPOKE, 7, 7, HUB), (1, SPOKE, 8, 8, HUB)], "chain_id int, spoke string, reserve_id long, asset_id long, hub string")
    got = {x.user: x for x in valuation.value_positions(df, reserves, valuation.asset_at(pool_df, at)).collect()}
    for _, user, _, _, s, d, p, o in held[:30] + held[-1:]:
        v, ray = got[user].value, p * now - o
        assert (int(v.supplied), int(v.drawn_debt), int(v.premium_debt), int(v.total_debt), v.premium_ray, v.at) == (s * (assets + 10**6) // (added + 10**6), up(d * now), up(ray), up(d * now) + up(ray), str(ray), at)
        assert got[user].unvalued is None
    assert {u: (got[u].value, got[u].unvalued) for u in ("neg", "premium", "early", "none")} == {
        "neg": (None, "negative balance"), "premium": (None, "negative premium"), "early": (None, "instant before the checkpoint"), "none": (None, "unknown reserve"),
    }
    amounts = spark.createDataFrame([(str(a), d, str(p)) for a, d, p in ((1_100_000 * 10**6, 6, 10**8), (10**27, 18, 187522000000), (10**30, 27, 10**13), (7, 20, 10**8))], "a string, d int, p string")
    worth = [x.v for x in amounts.select(w.value_wide("a", "d", "p").alias("v")).collect()]
    assert worth == [str(11 * 10**31), str(10**27 * 187522000000), str(10**34), str(7 * 10**8 // 100)]


def test_health_of_realistic_size(spark):
    from posledger.operators import risk

    c, d = 10**3 * 10**26, 500 * 10**26
    kind = "chain_id int, user string, spoke string, using_as_collateral boolean, supplied_value string, debt_value string, factor_bps long"
    rows = [(1, "a", "s", True, str(c), "0", 7800), (1, "a", "s", False, "0", str(d), 7800), (1, "b", "s", True, str(10**45), str(10**44), 9999)]
    got = {x.user: x.health_factor for x in risk.health_factor(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": str(c * 7800 * 10**14 // d), "b": str(10**45 * 9999 * 10**14 // 10**44)}
    totals = {x.user: (x.supplied_value, x.debt_value, x.net_worth) for x in risk.spoke_totals(spark.createDataFrame(rows, kind)).collect()}
    assert totals["a"] == (str(c), str(d), str(c - d)) and totals["b"][2] == str(9 * 10**44)
