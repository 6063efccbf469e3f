import random

import pytest

from posledger.llm.shared import components


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    r = random.Random(small)
    edges = [(r.randrange(60) * 7 - 100, r.randrange(60) * 7 - 100) for _ in range(45)] + [(1000 + i, 1001 + i) for i in range(20)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), small).count() == 0
