import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from posledger.operators import chain, page, reconcile, risk
from posledger.sources import dimensions, logs

TOPIC = {"Supply": "0x" + "d9" * 32, "Repay": "0x" + "e7" * 32, "SetUsingAsCollateral": "0x" + "a1" * 32}
SPOKE = "0x94e7a5dcbe816e498b89ab752661904e2f56c485"
USER = "a0f5c2bb" + "0" * 32


def word(x):
    return f"{x % 2**256:064x}"


def raw(topics, data, address=SPOKE, time=5):
    return (1, address, topics, data, 10, time, "0xb", "0xt", 0, 1)


def decode(spark, *rows):
    return logs.decode_logs(spark.createDataFrame(list(rows), logs.RAW_LOG), TOPIC, SPOKE)


def test_decode(spark):
    user = "0x" + word(int(USER, 16))
    supply = raw([TOPIC["Supply"], "0x" + word(7), user, user], "0x" + word(13123603535) + word(13281460753), SPOKE.upper().replace("0X", "0x"))
    big = -(2**199) - 5
    repay = raw([TOPIC["Repay"].upper().replace("0X", "0x"), "0x" + word(2**255), user, user], "0x" + "".join(map(word, (1, 2, -3, big, 2**256 - 1))))
    get = lambda p: F.get_json_object("body", f"$.{p}")
    paths = ("reserveId", "user", "suppliedShares", "suppliedAmount", "premiumDelta.sharesDelta", "premiumDelta.offsetRayDelta", "premiumDelta.restoredPremiumRay")
    a, b = decode(spark, supply, repay).select("event_name", "address", *[get(p) for p in paths]).collect()
    assert tuple(a) == ("Supply", SPOKE, "7", "0x" + USER, "13123603535", "13281460753", None, None, None)
    assert tuple(b) == ("Repay", SPOKE, str(2**255), "0x" + USER, None, None, "-3", str(big), str(2**256 - 1))


def test_decode_the_longest_and_a_nested_event(spark):
    topic, person = {"LiquidationCall": "0x" + "2a" * 32, "UpdateAssetConfig": "0x" + "ea" * 32}, "0x" + word(int(USER, 16))
    call = raw([topic["LiquidationCall"], "0x" + word(7), "0x" + word(13), person], "0x" + "".join(map(word, (5, 1, 100, 101, -2, -3, 4, 150, 151, 140))))
    config = raw([topic["UpdateAssetConfig"], "0x" + word(7)], "0x" + "".join(map(word, (1, 1000, 2, 3))))
    made = logs.decode_logs(spark.createDataFrame([call, config], logs.RAW_LOG), topic, SPOKE, {**logs.SPOKE_EVENTS, **logs.HUB_EVENTS})
    a, b = (json.loads(r.body) for r in made.orderBy("event_name").collect())
    assert (a["debtReserveId"], a["user"], a["receiveShares"], a["premiumDelta"]["offsetRayDelta"], a["collateralSharesToLiquidator"]) == ("13", "0x" + USER, True, "-3", "140")
    assert b["assetId"] == "7" and b["config"]["liquidityFee"] == "1000" and b["config"]["reinvestmentController"] == "0x" + f"{3:040x}"


@pytest.mark.parametrize("bad,why", [
    (raw([TOPIC["Supply"], "0x" + word(1), "0x" + word(1), "0x" + word(1)], "0x" + word(1)), "malformed"), (raw(["0x" + "00" * 32], "0x"), "unknown"), (raw([], "0x"), "anonymous"),
    (raw([TOPIC["Supply"], "0x" + word(1), "0x" + word(1), "0x" + word(1)], "0x" + word(1) * 2, "0x" + "1" * 40), "another contract"),
])
def test_bad_logs_are_errors(spark, bad, why):
    with pytest.raises(Exception, match=why):
        decode(spark, bad).collect()


def test_timestamps(spark):
    log = spark.createDataFrame([raw([], "0x", time=None)], logs.RAW_LOG)
    head = lambda n: spark.createDataFrame([(1, n, 77)], "chain_id int, block_number long, block_timestamp long")
    assert logs.fill_timestamps(log, head(10)).first().block_timestamp == 77
    with pytest.raises(Exception, match="timestamp"):
        logs.fill_timestamps(log, head(11)).collect()


def headers(spark, *rows):
    return spark.createDataFrame([(1, n, h, p) for n, h, p in rows], "chain_id int, block_number long, hash string, parent_hash string")


def test_chain(spark):
    own = headers(spark, (1, "a", "z"), (2, "b", "a"), (3, "c", "b"))
    assert chain.contiguity_breaks(own).count() == 0
    assert [tuple(r)[1:] for r in chain.contiguity_breaks(headers(spark, (1, "a", "z"), (3, "c", "b"), (4, "d", "x"))).orderBy("block_number").collect()] == [(3, "gap"), (4, "parent")]
    fork = lambda *rows, **k: tuple(chain.fork_point(own, headers(spark, *rows), **k).first())[1:]
    assert fork((1, "a", ""), (2, "b", ""), (3, "c", "")) == ("continuous", 3, None, None)
    assert fork((1, "a", ""), (2, "b", ""), (3, "C", "")) == ("reorg", 2, 3, 3)
    assert fork((1, "A", ""), (2, "B", ""), (3, "C", ""))[0] == "unrecoverable"
    assert fork((1, "A", ""), (2, "b", ""), (3, "c", ""), safe=1)[0] == "continuous"
    assert [r.block_number for r in chain.retain(own, 1).collect()] == [2, 3] and chain.safe_head(100) == -1
    assert [tuple(r) for r in chain.replay_plan(spark, 5, 14, 4, 14).collect()] == [(5, 8), (9, 12), (13, 14)]
    for lo, hi, width, safe in ((5, 14, 4, 13), (5, 4, 1, 9), (1, 2, 0, 9)):
        with pytest.raises(ValueError):
            chain.replay_plan(spark, lo, hi, width, safe)


def test_dimensions(spark):
    raw_labels = spark.createDataFrame(
        [(1, "0xAB", " US\x00DC\x9f ", "\t", 6, 1), (1, "0xCD", "0x" + b"MKR".hex().ljust(64, "0"), "n" * 99, 256, 1)], "chain_id int, token string, symbol string, name string, decimals int, fetched_at long"
    )
    assert [tuple(r)[1:5] for r in dimensions.labels(raw_labels).collect()] == [("0xab", "USDC", None, 6), ("0xcd", "MKR", "n" * 64, None)]
    batches = spark.createDataFrame([(1, SPOKE, 9, [1, 2], [Decimal(5), Decimal(0)]), (1, SPOKE, 9, [1, 2], [Decimal(5)])], "chain_id int, spoke string, priced_at long, reserve_ids array<long>, answers array<decimal(38,0)>")
    assert sorted((r.reserve_id, r.accepted) for r in dimensions.price_rows(batches).collect() if r.reserve_id) == [(1, True), (2, False)]
    assert dimensions.price_rows(batches).where("reserve_id IS NULL").count() == 1
    rows = spark.createDataFrame([(1, SPOKE, 1, 5, 1), (1, SPOKE, 1, 0, 2), (1, SPOKE, 1, 7, 0)], "chain_id int, spoke string, reserve_id long, price long, fetched_at long")
    assert page.latest_snapshot(page.valid_prices(rows), ["chain_id", "spoke", "reserve_id"]).first().price == 5


def test_gap_and_stamps(spark):
    listed = spark.createDataFrame([(1, "0xa"), (1, "0xb")], "chain_id int, underlying string")
    known = spark.createDataFrame([(1, "0xa", None)], "chain_id int, token string, symbol string")
    assert [r.underlying for r in page.label_gap(listed, known).collect()] == ["0xb"] and page.label_gap(listed, known, True).count() == 2
    cursor = spark.createDataFrame([(1, 5, "0x", 100)], "chain_id int, last_block long, last_hash string, updated_at long")
    assert tuple(page.sync_stamp(cursor, 1, 161).first())[3:] == (61, True) and page.sync_stamp(cursor, 1, 160).first().stale is False
    with pytest.raises(ValueError, match="not indexed"):
        page.sync_stamp(cursor, 2, 1)


def test_reconcile_and_prices(spark):
    names = ("liquidity", "added_shares", "drawn_shares", "premium_shares", "swept", "drawn_index", "drawn_rate", "realized_fees")
    kind = "chain_id int, hub string, asset_id long, " + ", ".join(f"{n} decimal(38,0)" for n in names)
    pool = lambda *rows: spark.createDataFrame([(*r[:3], *[None if x is None else Decimal(x) for x in r[3:]]) for r in rows], kind)
    fold = pool((1, "h", 1, 5, 0, 0, 0, 0, None, 1, 1))
    after = pool((1, "h", 1, 25, 0, 0, 0, 0, 9, 1, 2), (1, "h", 2, 1, 1, 1, 1, 1, 1, 1, 1))
    before = pool((1, "h", 1, 20, 0, 0, 0, 0, 9, 1, 2))
    of = lambda df: {(r.asset_id, r.field): r.status for r in df.collect()}
    delta, absolute = of(reconcile.reconcile_hub(fold, after, before)), of(reconcile.reconcile_hub(fold, after))
    assert [delta[1, f] for f in ("liquidity", "drawn_index", "realized_fees")] == ["match", "skipped", "mismatch"] and delta[2, "swept"] == "untouched"
    assert absolute[1, "liquidity"] == "mismatch" and absolute[2, "swept"] == "mismatch"
    asked = spark.createDataFrame([(1, t) for t in (0, 5, 10, 11, 4000, 99999)], "asset_id long, at long")
    steps = spark.createDataFrame([(1, 5, 50), (1, 11, 60), (1, 5000, 70)], "asset_id long, from_time long, price long")
    got = risk.price_as_of(asked, steps).orderBy("at").collect()
    assert [r.price and int(r.price) for r in got] == [None, 50, 50, 60, 60, 70]
