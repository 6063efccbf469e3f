"""Rebuilds beside a stream, and positions kept in buckets: crashes, replays, retractions, what is read and what is written."""

import random

import pytest
from pyspark.sql import functions as F
from test_ingest import event, events, ranges

from posledger.operators import folds, generations, maintained
from posledger.sources import files
from posledger.streaming import ingest

USERS = ["0x%040x" % k for k in range(12)]


def some_events(spark, blocks, seed):
    r, rows = random.Random(seed), []
    for b in blocks:
        for log in range(3):
            user = r.choice(USERS)
            if r.random() < 0.4:
                body = '{"reserveId": "%d", "user": "%s", "usingAsCollateral": %s}' % (r.randrange(3), user, r.choice(("true", "false")))
                rows.append((*event(b, 1, log)[:6], "SetUsingAsCollateral", body))
            else:
                n = str(r.choice((5, 10**30, 10**77)))
                body = '{"reserveId": "%d", "user": "%s", "suppliedShares": "%s", "suppliedAmount": "1"}' % (r.randrange(3), user, n)
                rows.append((*event(b, 1, log)[:6], "Supply", body))
    return events(spark, *rows)


class Kept:
    """A stream with deltas and a view, and what a batch fold of its ledger gives."""

    def __init__(self, spark, at):
        self.spark, self.at, self.batch = spark, at, 0
        self.ledger, self.deltas, self.view = (f"{at}/{x}" for x in ("ledger", "deltas", "view"))
        ingest.start(spark, self.ledger, f"{at}/progress")

    def dispatch(self, lo, hi, seed, empty=False, batch=None):
        n = self.batch if batch is None else batch
        some = some_events(self.spark, [] if empty else range(lo, hi + 1), seed)
        landed = ingest.dispatches(some, ranges(self.spark, (lo, hi, n, None, empty)))
        ingest.dispatch(landed, n, self.ledger, f"{self.at}/progress", deltas=self.deltas, view=self.view)
        self.batch = max(self.batch, n + 1)

    def same(self):
        want = self.rows(folds.positions_current(ingest.ledger(self.spark, self.ledger)))
        assert self.rows(ingest.positions(self.spark, self.deltas)) == want
        assert self.rows(folds.stored_positions(maintained.view(self.spark, self.view))) == want
        return len(want)

    @staticmethod
    def rows(df):
        return sorted(map(tuple, df.select(*folds.POSITION, *folds.SUMS, "using_as_collateral", "events").collect()))


@pytest.fixture
def kept(spark, tmp_path):
    return Kept(spark, str(tmp_path))


def test_rebuild_beside_a_stream_loses_nothing(kept):
    spark = kept.spark
    kept.dispatch(0, 9, 1)
    kept.dispatch(10, 19, 2)
    early = ingest.positions(spark, kept.deltas)
    before = kept.rows(early)
    assert ingest.rebuild(spark, kept.ledger, kept.deltas, kept.view) == 1
    kept.same()
    kept.dispatch(20, 29, 3)
    kept.dispatch(5, 14, 4)  # blocks that the base holds are dispatched again
    kept.same()
    assert kept.rows(early) == before  # a plan that was made reads what it was made of
    ingest.rebuild(spark, kept.ledger, kept.deltas, kept.view)
    kept.dispatch(0, 4, 5, empty=True)
    kept.dispatch(0, 4, 5, empty=True, batch=kept.batch - 1)  # a batch that runs again
    kept.same()
    generations.expire(spark, kept.deltas)
    maintained.expire(spark, kept.view)
    assert len(files.names(spark, f"{kept.deltas}/base")) == 1 and files.names(spark, f"{kept.deltas}/batches") == ["batch_id=4"]
    kept.same()
    with pytest.raises(ValueError, match="in the base only"):
        maintained.maintain(spark, kept.deltas, f"{kept.at}/late", kept.batch - 1)


def test_a_crash_before_a_pointer_moves_changes_nothing(kept, monkeypatch):
    spark, publish = kept.spark, files.publish
    kept.dispatch(0, 9, 1)
    want = kept.rows(ingest.positions(spark, kept.deltas))

    def fails_at(name):
        def failing(spark, path, value):
            if path.endswith(name):
                raise RuntimeError(name)
            publish(spark, path, value)

        monkeypatch.setattr(files, "publish", failing)

    fails_at("_base")
    with pytest.raises(RuntimeError):
        ingest.rebuild(spark, kept.ledger, kept.deltas, kept.view)
    for name in ("_head", "_view"):
        fails_at(name)
        with pytest.raises(RuntimeError):
            kept.dispatch(10, 19, 2, batch=1)
        if name == "_head":
            assert kept.rows(ingest.positions(spark, kept.deltas)) == want
        assert kept.rows(folds.stored_positions(maintained.view(spark, kept.view))) == want
    monkeypatch.setattr(files, "publish", publish)
    kept.dispatch(10, 19, 2, batch=1)
    kept.same()


def test_a_batch_rewrites_touched_buckets_and_a_page_reads_one(kept):
    spark = kept.spark
    kept.dispatch(0, 30, 1)
    folders = files.pointer(spark, f"{kept.view}/_view")["folders"]
    touched = {str(maintained.bucket_of(1, r.user, maintained.BUCKETS)) for r in folds.position_rows(ingest.ledger(spark, kept.ledger)).select("user").distinct().collect()}
    assert set(folders) == touched and len(touched) > 5
    kept.dispatch(31, 31, 7)
    some = {str(maintained.bucket_of(1, r.user, maintained.BUCKETS)) for r in folds.position_rows(ingest.ledger(spark, kept.ledger).where("block_number = 31")).select("user").distinct().collect()}
    now = files.pointer(spark, f"{kept.view}/_view")["folders"]
    assert {k for k in now if now[k] != folders.get(k)} == some and len(some) < len(touched)
    kept.dispatch(3, 12, 0, empty=True)
    kept.same()
    user = USERS[3]
    own = maintained.view(spark, kept.view, 1, user.upper().replace("0X", "0x"))
    bucket = maintained.bucket_of(1, user, maintained.BUCKETS)
    assert own.inputFiles() and all(f"/bucket={bucket}/" in x for x in own.inputFiles())
    want = [r for r in kept.rows(folds.positions_current(ingest.ledger(spark, kept.ledger))) if r[1] == user]
    assert kept.rows(folds.stored_positions(own)) == want
    # one row of sums for a position, and flags that were taken back are gone
    rows = maintained.view(spark, kept.view)
    assert rows.where("flag IS NULL").groupBy(*folds.POSITION, "scale").count().where("count > 1").isEmpty()
    assert rows.where(F.col("flag").isNotNull() & F.col("block_number").between(3, 12)).isEmpty()


def test_a_view_that_comes_late_catches_up(kept):
    for k in range(3):
        kept.dispatch(10 * k, 10 * k + 9, k)
    assert maintained.maintain(kept.spark, kept.deltas, f"{kept.at}/late", 1, buckets=3) == [0, 1, 2]
    maintained.maintain(kept.spark, kept.deltas, f"{kept.at}/late", 2)
    assert maintained.maintain(kept.spark, kept.deltas, f"{kept.at}/late", 2) == []
    kept.view = f"{kept.at}/late"
    kept.same()
    assert maintained.view(kept.spark, f"{kept.at}/none").isEmpty()
