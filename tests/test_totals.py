import random

import pytest
from pyspark.sql import functions as F

from posledger.operators import totals

RAY = 10**27
P = "chain_id int, user string, spoke string, reserve_id long, supplied_shares string, drawn_shares string, premium_shares string, premium_offset_ray string, more string"
Q = "chain_id int, spoke string, reserve_id long, index_at string, total_added_assets string, pool_added_shares string, decimals int, price string"


def model(positions, quotes):
    out = {}
    for (user, spoke, r), (sup, dr, pr, off) in positions.items():
        if (sup or dr) and (spoke, r) in quotes:
            i, total, added, dec, price = quotes[spoke, r]
            ray = pr * i - off
            if ray < 0 or price is None:
                continue
            up = lambda x: -(-x // RAY)
            worth = [x * price * 10 ** (18 - dec) for x in (sup * (total + 10**6) // (added + 10**6), up(dr * i) + up(ray))]
            s, d = out.get((user, spoke), (0, 0))
            out[user, spoke] = s + worth[0], d + worth[1]
    return {k: (str(s), str(d), str(s - d)) for k, (s, d) in out.items()}


def test_steps(spark, tmp_path):
    """Random changes over several steps equal a plain model; only what changed is valued and written."""
    r, path = random.Random(5), str(tmp_path)
    positions, quotes = {}, {}
    quote = lambda: (RAY + r.randrange(RAY), r.randrange(10**12), r.randrange(1, 10**12), r.choice((6, 18)), r.choice((None, r.randrange(10**10), 10**30)))
    for step in range(5):
        new = {(f"0x{r.randrange(9)}", f"0xs{r.randrange(2)}", r.randrange(6)): (r.choice((0, r.randrange(10**20))), r.choice((0, r.randrange(10**9))), r.randrange(9), r.randrange(-RAY, 3 * RAY)) for _ in range((30, 4, 0, 6, 0)[step])}
        fresh = {(f"0xs{r.randrange(2)}", r.randrange(5)): quote() for _ in range((8, 0, 1, 2, 0)[step])}
        positions |= new
        quotes |= fresh
        rows = spark.createDataFrame([(1, *k, *map(str, v), "x") for k, v in new.items()] * 2, P) if new else None
        told = spark.createDataFrame([(1, *k, *[str(x) if x is not None and n != 3 else x for n, x in enumerate(v)]) for k, v in fresh.items()], Q) if fresh else None
        done = totals.apply(spark, path, step, rows, told, buckets=8)
        assert done["valued"] == sum(k in new or k[1:] in fresh for k in positions)
        assert {(x.user, x.spoke): tuple(x)[3:] for x in totals.view(spark, path).collect()} == model(positions, quotes)
    assert done == {"valued": 0, "reserve_buckets": [], "wallet_buckets": []}
    assert totals.apply(spark, path, 3, rows, told)["valued"] == 0
    (user, spoke), wanted = next(iter(model(positions, quotes).items()))
    one = totals.view(spark, path, 1, user, spoke)
    assert [tuple(x)[3:] for x in one.collect()] == [wanted] and len({f.split("/bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1


def test_untouched_buckets_and_failure(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    rows = spark.createDataFrame([(1, f"0x{k}", "0xs", k, "5", "0", "0", "0", "") for k in range(12)], P)
    told = spark.createDataFrame([(1, "0xs", k, str(RAY), "0", "0", 18, "2") for k in range(12)], Q)
    totals.apply(spark, path, 1, rows, told, buckets=16)
    before = totals.files.pointer(spark, f"{path}/_totals")
    change = told.where("reserve_id = 3").withColumn("price", F.lit("4"))
    monkeypatch.setattr(totals.files, "publish", lambda *a: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        totals.apply(spark, path, 2, None, change)
    assert {x.user: x.supplied_value for x in totals.view(spark, path).collect()} == {f"0x{k}": "10" for k in range(12)}
    monkeypatch.undo()
    done = totals.apply(spark, path, 2, None, change)
    after = totals.files.pointer(spark, f"{path}/_totals")
    assert done["valued"] == 1 and len(done["reserve_buckets"]) == len(done["wallet_buckets"]) == 1
    assert all(sum(after[k][b] != before[k][b] for b in after[k]) == 1 for k in totals.KINDS)
    assert {x.user: x.supplied_value for x in totals.view(spark, path).collect()} == {f"0x{k}": "20" if k == 3 else "10" for k in range(12)}
    with pytest.raises(Exception, match="two states"):
        totals.apply(spark, path, 3, rows.unionByName(rows.withColumn("drawn_shares", F.lit("7"))))


def test_empty(spark, tmp_path):
    assert totals.view(spark, str(tmp_path)).count() == 0
    assert totals.apply(spark, str(tmp_path), 1, spark.createDataFrame([], P), spark.createDataFrame([], Q))["valued"] == 0
    assert totals.view(spark, str(tmp_path)).count() == 0
