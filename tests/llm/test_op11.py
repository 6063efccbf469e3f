"""Spelling variants against pairs of all words compared one by one."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from posledger.llm import op11_spelling as op

from corpus import DOCS, corpus


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, every):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def plain(words):
    rows, form = [], {}
    found = {w: [x for x in words if near(w, x)] for w in words}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(found[w]), words.get(form[w])))
    return sorted(rows, key=str)


def texts(seed):
    r = random.Random(seed)
    alphabet = "abcdeÀÉéÿ×"
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "x" * 400, "x" * 399]
    rows = []
    for i in range(60):
        words = [w for w in base for _ in range(r.choice((0, 1, 3, 30)))]
        for k in range(60):
            w = list(r.choice(base))
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice(["", r.choice(alphabet)])
            words += ["".join(w).upper() if k % 9 == 0 else "".join(w)] * r.choice((1, 2, 6))
        rows.append((None if i == 7 else i % 50, r.choice((" ", ",", "1", "\n", "ß", "日")).join(words)))
    return rows + [(70, None), (71, ""), (72, "éa" * 30)]


@pytest.mark.parametrize("seed, every, symbols", [(1, 199, None), (2, 7, 2), (3, None, 5), (4, 3, 1), (5, 2, 40)])
def test_equals_comparing_all_words(spark, seed, every, symbols):
    rows = texts(seed)
    docs = spark.createDataFrame([(*r, "w", "x") for r in rows], "doc_id long, text string, word string, key string")
    words = counted(rows, every)
    assert len(words) > 50
    got = op.spelling_variants(op.word_counts(docs, every=every), symbols=symbols)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(words)


def test_long_chains_ties_and_empty_tables(spark):
    words = {"abcdefgh"[:-i] + "x" * i if i else "abcdefgh": 5**i for i in range(7)} | {"tiedone": 10, "tiedtwo": 9, "xtiedone": 50, "ytiedone": 50}
    got = op.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(words)
    empty = spark.createDataFrame(corpus(), DOCS).limit(0)
    assert op.spelling_variants(op.word_counts(empty, every=199)).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 3])
@pytest.mark.parametrize("piece", [1 << 20, 1])
def test_neighbourhoods_are_whole_and_distinct(monkeypatch, symbols, piece):
    monkeypatch.setattr(op, "AT_ONCE", piece)
    r = np.random.default_rng(3)
    s = r.integers(0, symbols, (6, 5))
    key = lambda w: int(op._key((op._values(symbols)[w] * op._powers(len(w))[: len(w)]).sum(dtype=np.uint64, keepdims=True), len(w))[0])
    for row, w in enumerate(s.tolist()):
        around = {tuple(w)} | {tuple(w[:i] + w[i + 1 :]) for i in range(5)}
        around |= {tuple(w[:i] + [c] + w[i + 1 :]) for i in range(5) for c in range(symbols)} | {tuple(w[:i] + [c] + w[i:]) for i in range(6) for c in range(symbols)}
        got = [int(k) for keys, rows in op.neighbours(s, symbols) for k in keys[rows == row]]
        assert sorted(got) == sorted(key(np.array(x, dtype=int)) for x in around)
