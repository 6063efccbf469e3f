import hashlib
from collections import Counter

import numpy as np
import pytest

from corpus import DOCS, corpus
from posledger.llm.op02_suffix import ordered_repeats, suffix_digest, suffix_repeats


def brute(rows, length):
    docs = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + length] for _, t in docs for i in range(len(t) - length + 1))
    for doc_id, t in docs:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        gone[-1] = False
        yield doc_id, t, gone


@pytest.mark.parametrize("length,hot", [(400, 512), (60, 512), (60, 2)])
def test_digest_against_brute_force(spark, length, hot):
    rows = corpus(4)
    got = suffix_digest(spark.createDataFrame(rows, DOCS), length, hot).collect()
    want = []
    for doc_id, t, gone in brute(rows, length):
        inner = gone[1:-1]
        kept = bytes(b for b, g in zip(t, inner) if not g)
        want.append((doc_id, len(t), int(inner.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spans(spark):
    rows = corpus(5)
    got = sorted((tuple(r) for r in suffix_repeats(spark.createDataFrame(rows, DOCS), 80).collect()), key=str)
    want = [
        (d, int(a), int(b))
        for d, _, g in brute(rows, 80)
        for a, b in zip(np.flatnonzero(g[1:] & ~g[:-1]), np.flatnonzero(g[:-1] & ~g[1:]))
    ]
    assert got == sorted(want, key=str)


def test_ordered_repeats():
    rng = np.random.default_rng(3)
    symbols = rng.integers(97, 99, (40, 12)).astype(np.uint8)
    group = np.sort(rng.integers(0, 4, 40))
    first, last = rng.integers(0, 3, 40), 12 - rng.integers(0, 3, 40)
    got = ordered_repeats(group, symbols, first, last, 5, 8)
    for i in range(40):
        for j in range(8):
            has = lambda k: first[k] <= j and j + 5 <= last[k]
            want = has(i) and any(k != i and group[k] == group[i] and has(k) and (symbols[k, j : j + 5] == symbols[i, j : j + 5]).all() for k in range(40))
            assert got[i, j] == want


def test_passages_of_over_50_words(spark):
    """A passage that two documents share goes from 400 bytes on, however many words it has; shorter ones and clean documents stay whole."""
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))
    passages = {size: f" {prose(120)[: size - 2]} " for size in (339, 399, 400, 520)}
    assert all(len(p) == size and len(p.split()) > 50 for size, p in passages.items())
    sizes = [size for size in passages for _ in "ab"] + [0] * 4
    texts = [f"{prose(90)}{side}{passages.get(size, ' ')}{side}{prose(40)}" for size, side in zip(sizes, "ab" * 6)]
    got = {tuple(r)[:4] for r in suffix_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(i, len(t), size * (size >= 400), int(size >= 400)) for i, (t, size) in enumerate(zip(texts, sizes))}


def test_empty(spark):
    assert suffix_digest(spark.createDataFrame([], DOCS)).count() == 0
