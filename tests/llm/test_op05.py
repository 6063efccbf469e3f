import random
import re

import pytest

from corpus import DOCS, corpus
from posledger.llm.op05_jaccard import jaccard_components, keep_one
from posledger.llm.op05_jaccard import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def copies(seed, n=60):
    """Near copies of few texts, at all distances around the threshold, with a passage that all have."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(20, 90))] for _ in range(4)]
    shared = [r.choice(words) for _ in range(30)]
    out = []
    for i in range(n):
        t = list(base[i % 4])
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = "e%d" % r.randrange(10**6)
        out.append((i * 3 + 1, " ".join(shared + t if i % 2 else t + shared), None, None, None))
    return out


@pytest.mark.parametrize("rows,sizes", [(corpus(8), {}), (copies(1), {}), (copies(2), {"group": 4, "pivots": 3, "chunk": 5})])
def test_against_brute_force(spark, rows, sizes):
    df = spark.createDataFrame(rows, DOCS)
    got = near_duplicates(df, **sizes).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "key")
    kept = keep_one(df)
    assert kept.columns == df.columns
    want = brute(rows)
    assert kept.count() == len({c for _, n, c in want if n}) + sum(not n for _, n, _ in want)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def brute_links(rows):
    sets = [shingles(r[1]) for r in rows]
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    return sorted(((r[0], sum(linked(a, b) for j, b in enumerate(sets) if j != i)) for i, (r, a) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("rows,sizes", [(corpus(8) + copies(1)[:20], {}), (copies(2, 80) + copies(2, 9), {"group": 4, "pivots": 3, "chunk": 5})])
def test_every_link_is_counted(spark, rows, sizes):
    got = near_duplicates(spark.createDataFrame(rows, DOCS), **sizes).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_sets_of_all_sizes_in_one_group(spark):
    """One group with sets from 20 to 400 words, in chains of just similar ones: bands lose no link."""
    r = random.Random(6)
    words = ["w%d" % i for i in range(2000)]
    long = [r.choice(words) for _ in range(400)]
    rows = [(i, " ".join(long[: 20 + 5 * i]), None, None, None) for i in range(76)]
    got = near_duplicates(spark.createDataFrame(rows, DOCS), group=5, chunk=3, pivots=2).collect()
    assert sorted(((x.doc_id, x.n_links) for x in got), key=str) == brute_links(rows)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)


def test_hot_keys_are_dealt_out(spark):
    rows = [(i, "the same five words here and on" if i % 2 else "text %d has other words of its own" % i, None, None, None) for i in range(600)]
    got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (1, 299) if i % 2 else (i, 0) for i in range(600)}
