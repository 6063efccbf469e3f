"""Ingest by explicit ranges: gaps, doubled and empty ranges, rewinds, replays of a batch, progress and listings."""

import json

import pytest
from pyspark.sql import functions as F

from posledger.operators import chain, folds, generations
from posledger.operators import ledger as lg
from posledger.streaming import ingest

SPOKE = "0x" + "9" * 40


def event(block, n, log=0):
    body = json.dumps({"reserveId": "7", "user": "0xA", "suppliedShares": str(n), "suppliedAmount": str(n)})
    return (1, SPOKE, block, log, 5, "0xt", "Supply", body)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "chain_id int, address string, block_number long, log_index int, block_timestamp long, tx_hash string, event_name string, body string")


def ranges(spark, *rows):
    return spark.createDataFrame([(1, lo, hi, n, head, back) for lo, hi, n, head, back in rows], "chain_id int, range_from long, range_to long, dispatch long, head long, rewind boolean")


class Stream:
    def __init__(self, spark, at, **more):
        self.spark, self.at, self.more = spark, at, more

    def run(self, *landed):
        for rows, some in landed:
            ingest.land(ingest.dispatches(some, rows).coalesce(1), f"{self.at}/source")
        ingest.start_ingest(self.spark, f"{self.at}/source", f"{self.at}/ledger", f"{self.at}/checkpoint", f"{self.at}/progress", **self.more).awaitTermination()
        rows = ingest.ledger(self.spark, f"{self.at}/ledger")
        live = sorted((r.block_number, json.loads(r.body)["suppliedShares"]) for r in lg.current(rows).collect())
        total = sum(int(r.supplied_shares) for r in folds.positions_current(rows).collect())
        assert total == sum(int(n) for _, n in live)
        return live


def test_only_the_landed_ranges_are_replaced(spark, tmp_path):
    s = Stream(spark, str(tmp_path))
    all_ten = events(spark, *[event(b, 1) for b in range(10)])
    assert len(s.run((ranges(spark, (0, 9, 1, 100, False)), all_ten))) == 10
    # blocks 0 and 9 land again in one batch, as ranges of their own
    again = events(spark, event(0, 5), event(9, 6))
    assert s.run((ranges(spark, (0, 0, 2, 101, False), (9, 9, 3, 101, False)), again)) == [(0, "5"), *[(b, "1") for b in range(1, 9)], (9, "6")]
    # one block twice in a batch, in two files, and a range that lands twice under one number: the last dispatch counts
    got = s.run((ranges(spark, (3, 4, 4, None, False)), events(spark, event(3, 7), event(4, 7))), (ranges(spark, (4, 5, 5, 90, False), (4, 5, 5, 90, False)), events(spark, event(4, 8))))
    assert got == [(0, "5"), (1, "1"), (2, "1"), (3, "7"), (4, "8"), *[(b, "1") for b in (6, 7, 8)], (9, "6")]
    cursor = ingest.cursors(spark.read.parquet(f"{tmp_path}/progress"))
    assert [tuple(r) for r in cursor.collect()] == [(1, 5, 101, 96)]
    # an empty range empties, a rewind sets the cursor back
    assert s.run((ranges(spark, (6, 9, 6, 102, True)), events(spark))) == [(0, "5"), (1, "1"), (2, "1"), (3, "7"), (4, "8")]
    assert [tuple(r) for r in ingest.cursors(spark.read.parquet(f"{tmp_path}/progress")).collect()] == [(1, 5, 102, 97)]
    told = {r.batch_id: r for r in ingest.throughput(spark.read.parquet(f"{tmp_path}/progress")).collect()}
    assert [told[k].depth for k in sorted(told)][-1] == 0 and told[0].depth is None and told[0].appended == 10 and 0 < told[0].rows_per_second < 10 / 0.001
    s.run((ranges(spark, (2, 9, 7, 102, True)), events(spark)))
    assert ingest.throughput(spark.read.parquet(f"{tmp_path}/progress")).where("depth = 4").count() == 1
    headers = spark.createDataFrame([(1, b) for b in range(10)], "chain_id int, block_number long")
    assert ingest.rewind(headers, 5).count() == 6


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    s = Stream(spark, str(tmp_path))
    s.run((ranges(spark, (0, 9, 1, None, False)), events(spark, *[event(b, 1) for b in range(10)])))
    batch = ingest.dispatches(events(spark, event(4, 9)), ranges(spark, (3, 5, 2, None, False)))
    want = None
    for _ in range(2):
        ingest.dispatch(batch, 7, f"{tmp_path}/ledger", f"{tmp_path}/progress")
        got = sorted((r.block_number, r.sign, r.version) for r in ingest.ledger(spark, f"{tmp_path}/ledger").collect())
        want = want or got
        assert got == want and len(got) == 14
    past = spark.read.schema(ingest.STORED).parquet(f"{tmp_path}/ledger").where((F.col("batch_id") != 7) & F.col("block_part").isin([0]))
    assert "PartitionFilters: [isnotnull(batch_id" in past._jdf.queryExecution().executedPlan().toString() or "block_part" in past._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_listings_and_gaps_of_a_batch(spark, tmp_path):
    token = lambda k: "0x" + f"{k:040X}"
    listed = lambda b, k: (1, SPOKE, b, 0, 5, "0xt", "AddAsset", json.dumps({"assetId": "1", "underlying": token(k), "decimals": 6}))
    labels = spark.createDataFrame([(1, token(1).lower(), None)], "chain_id int, token string, symbol string")
    s = Stream(spark, str(tmp_path), listings=f"{tmp_path}/listings", labels=labels)
    ingest.land(ingest.dispatches(events(spark, listed(1, 1), listed(2, 2), listed(3, 2)), ranges(spark, (0, 9, 1, None, False))), f"{tmp_path}/source")
    ingest.start_ingest(spark, f"{tmp_path}/source", f"{tmp_path}/ledger", f"{tmp_path}/checkpoint", f"{tmp_path}/progress", **s.more).awaitTermination()
    assert sorted((r.underlying, r.n) for r in spark.read.parquet(f"{tmp_path}/listings/counts").collect()) == [(token(1).lower(), 1), (token(2).lower(), 2)]
    assert [r.underlying for r in spark.read.parquet(f"{tmp_path}/listings/gaps").collect()] == [token(2).lower()]


def test_stored_deltas_prune_by_wallet_and_rebuild(spark, tmp_path):
    body = lambda u, n: json.dumps({"reserveId": "7", "user": u, "suppliedShares": str(n), "suppliedAmount": str(n)})
    rows = [(1, SPOKE, b, 0, 5, "0xt", "Supply", body("0x%040x" % (b % 50), b)) for b in range(200)]
    rows += [(1, SPOKE, 300 + b, 0, 5, "0xt", "SetUsingAsCollateral", json.dumps({"reserveId": "7", "user": "0x%040x" % b, "usingAsCollateral": b % 2 == 0})) for b in range(50)]
    ledger = lg.append(events(spark, *rows), 1)
    for _ in range(2):
        generations.rebuild(folds.position_rows(ledger), str(tmp_path / "d"), 0, lambda rows, folder: folds.store_positions(rows, folder, "overwrite", 4))
    own = ingest.positions(spark, str(tmp_path / "d")).where(F.col("user") == "0x%040x" % 4)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(user,0x%040x" % 4) >= 2
    (r,) = own.collect()
    assert (int(r.supplied_shares), r.using_as_collateral, r.events) == (4 + 54 + 104 + 154, True, 4)


def test_replay(spark):
    ledger = lg.append(events(spark, *[event(b, 1) for b in range(10)]), 1)
    again, resume = chain.replay(ledger, events(spark, event(3, 5), event(8, 5)), 1, 2, 5, 2, 9)
    assert resume == 6 and sorted(r.block_number for r in lg.current(again).collect()) == [0, 1, 3, 6, 7, 8, 9]
    with pytest.raises(ValueError, match="safe"):
        chain.replay(ledger, ledger, 1, 2, 50, 2, 9)


def test_all_that_landed_is_one_batch_of_several_files(spark, tmp_path):
    """Without a number of files a run takes all of them as one batch, so that a landing needn't be one file of one task."""
    s = Stream(spark, str(tmp_path), files_per_batch=None)
    for k in (0, 1):
        rows = [(lo, lo + 9, k, 200, False) for lo in range(0, 100, 10)]
        ingest.land(ingest.dispatches(events(spark, *[event(b, b + k) for b in range(100)]), ranges(spark, *rows)).repartition(4, "range_from"), f"{tmp_path}/source")
        assert s.run() == sorted((b, str(b + k)) for b in range(100))
    batches = {r.batch_id for r in spark.read.schema(ingest.PROGRESS).parquet(f"{tmp_path}/progress").collect()}
    assert batches == {0, 1} and len([x for x in (tmp_path / "source").iterdir() if x.name.endswith(".json")]) > 2
