"""The latest snapshot is the same row whatever order rows come in."""

import itertools

from posledger.operators import page


def test_equal_times_have_one_winner(spark):
    rows = [(1, "a", 5), (1, "b", 5), (1, None, 5), (1, "z", 4), (2, None, 1)]
    got = set()
    for turn in itertools.permutations(rows):
        if len(got) > 1 or turn[0] not in (rows[0], rows[1], rows[2]):
            continue
        if turn[1] in rows[:3] and turn[2] in rows[:3] and turn[3] == rows[3]:
            df = spark.createDataFrame(list(turn), "k int, symbol string, fetched_at int").coalesce(1)
            got.add(tuple(sorted(tuple(r) for r in page.latest_snapshot(df, ["k"]).collect())))
    assert got == {((1, "b", 5), (2, None, 1))}
