"""Replay by consumers: subsets, refusals, stops and resumption."""

import pytest
from test_ingest import event, events

from posledger.operators import ledger as lg
from posledger.operators import replay


def test_a_replay_stops_and_goes_on_at_the_slice(spark, tmp_path):
    ledger = lg.append(events(spark, *[event(b, 1) for b in range(20)]), 1)
    seen, work = [], f"{tmp_path}/work"

    def count(name):
        return lambda rows, lo, hi: seen.append((name, lo, hi, rows.count()))

    consumers = {"deltas": count("deltas"), "listings": count("listings")}
    run = lambda **more: replay.replay(ledger, work, 1, 3, 12, 4, 15, consumers, **more)
    assert [tuple(r) for r in run(dry_run=True).collect()] == [(3, 6), (7, 10), (11, 12)] and not seen
    with pytest.raises(ValueError, match="prices"):
        run(only=("deltas", "prices"))
    with pytest.raises(ValueError, match="safe head"):
        replay.replay(ledger, work, 1, 3, 16, 4, 15, consumers)
    assert run(only=("deltas",), stop=lambda: len(seen) == 1) == {"deltas": 7} and seen == [("deltas", 3, 6, 4)]

    def fails(rows, lo, hi):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        replay.replay(ledger, work, 1, 3, 12, 4, 15, {**consumers, "deltas": fails})
    assert run() == {"deltas": 13, "listings": 13}
    assert seen[1:] == [("deltas", 7, 10, 4), ("deltas", 11, 12, 2), ("listings", 3, 6, 4), ("listings", 7, 10, 4), ("listings", 11, 12, 2)]
    assert run() == {"deltas": 13, "listings": 13} and len(seen) == 6
    with pytest.raises(ValueError, match="another replay"):
        replay.replay(ledger, work, 1, 3, 12, 5, 15, consumers)
