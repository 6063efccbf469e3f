"""Clustering with filtered centroids against the plain algorithm in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from posledger.llm import op12_centroids as op


def plain(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda i: (0, hashlib.sha256(b"2:%d" % i).hexdigest()) if i is not None else (1, "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in set(own):
            group = [v for (_, v), o in zip(kept, own) if o == n]
            centroids[n] = [sum(c) // len(group) for c in zip(*group)]
    last = [near(v) for _, v in kept]
    total = lambda n: sum(d for d, o in last if n in (None, o))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), n, d, total(n), total(None), sha[n]) for (i, _), (d, n) in zip(kept, last))


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string")


def found(df):
    return sorted((str(r.vec_id), *r[1:]) for r in df.collect())


def rows_of(seed, n, width, spread):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(7)]
    out = [(i, [m + r.gauss(0, spread) for m in middles[i % 7]]) for i in range(n)]
    out += [(1000 + i, out[3][1]) for i in range(n // 3)] + [out[5], out[5]]  # one vector has a third of the rows
    out += [(None, out[1][1]), (7000, None), (7001, []), (7002, [0.5] * (width + 1)), (7003, [None] + [0.1] * (width - 1))]
    return out + [(7004 + j, [x] + [0.0] * (width - 1)) for j, x in enumerate([float("nan"), float("inf"), float("-inf"), -0.0, 1e-30, -1e-30])]


@pytest.mark.parametrize("seed, width, spread, k", [(1, 6, 0.05, 5), (2, 16, 0.5, 12), (3, 64, 0.1, 40)])
def test_equals_the_plain_algorithm(spark, seed, width, spread, k):
    rows = rows_of(seed, 90, width, spread)
    got = op.cluster_digest(table(spark, rows), k, 5, width)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(got) == plain(rows, k, 5, width)


def test_ties_few_vectors_and_empty_tables(spark):
    tied = [(i, [float(i % 2), 1.0]) for i in range(12)] + [(50 + i, [0.5, 1.0]) for i in range(4)]
    assert found(op.cluster_digest(table(spark, tied), 4, 5, 2)) == plain(tied, 4, 5, 2)
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert found(op.cluster_digest(table(spark, few), 40, 5, 2)) == plain(few, 40, 5, 2)
    assert op.cluster_digest(table(spark, [(1, [1.0])]), 40, 5, 2).count() == 0
    with pytest.raises(Exception, match="too large"):
        op.cluster_digest(table(spark, [(1, [600_000.0, 0.0])]), 1, 1, 2).collect()


def test_the_bound_leaves_most_centroids_out_and_never_the_nearest():
    r = np.random.default_rng(5)
    middles = r.integers(-300, 300, (40, 64))
    x = middles[r.integers(0, 40, 3000)] + r.integers(-40, 40, (3000, 64))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :12]
    best, distance, measured = op.nearest(x, *op._form(x.astype(float), axes), middles, axes)
    all_of = ((x[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (best == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()
    assert measured < 0.2 * all_of.size
