import random

import numpy as np

from corpus import DOCS
from posledger.llm.op10_decontamination import Budget, Index, align, decontaminated, folded, leaks, search

ITEMS = "item_id long, text string"


def sellers(item, text):
    """Least edits of the whole item against any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    columns = np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (text != c)]))
        row = np.minimum.accumulate(new - columns) + columns
    return row.min()


def brute(docs, items, budget):
    out = set()
    for d, t, *_ in docs:
        text = folded((t or "").encode())
        for k, item in items:
            value = folded((item or "").encode())
            if len(value) < budget.least:
                continue
            n, e = budget.of(len(value))
            if any(sellers(value[s : s + n], text) <= e for s in range(len(value) - n + 1)):
                out.add((d, k))
    return out


def make(seed=3):
    r = random.Random(seed)
    words = ["the", "of", "and", "tion", "er"] + ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(80)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randint(8, 24)).capitalize()) for i in range(8)] + [(20, None), (21, ""), (22, "short"), (23, "a medium sized item here"), (24, "la " * 40)]
    docs = []
    for i in range(40):
        t = say(r.randint(20, 60))
        if i % 2:
            s = list(items[i % 8][1])
            for _ in range(r.randint(0, 9)):
                at = r.randrange(len(s))
                s[at : at + r.randint(0, 1)] = [r.choice("xyz ")] * r.randint(0, 1)
            s = "".join(s)
            s = s[r.randint(0, 20) :] if i % 3 else s.upper().replace(" ", "\n")
            t = t[:50] + " " + s + " " + t[50:]
        docs.append((i, t, None, None, None))
    return docs + [(90, None, None, None, None), (91, "", None, None, None), (92, "la " * 60, None, None, None), (93, "x A medium sized\titem here x", None, None, None), (None, items[0][1], None, None, None)], items


def test_against_brute_force(spark):
    docs, items = make()
    budget = Budget(window=60, edits=4, q=8)
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for block in (1 << 20, 300):
        got = leaks(df, bench, budget, block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, budget)
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    clean = decontaminated(df.withColumnRenamed("lang", "item_id"), bench, budget)
    dirty = {d for d, _ in brute(docs, items, budget)}
    assert {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - dirty


def test_spans_of_an_exact_leak():
    item = "Every benchmark item is a sentence of its own that no honest corpus would ever hold by chance, or so they say."
    index = Index([(7, item)], Budget())
    text = ("filler " * 30 + item + " and more filler" * 9).encode()
    (k, (start, end, first, last, edits)), = search(index, [b"x", text, b""])[1].items()
    assert (index.ids[k], text[start:end].decode(), first, last, edits) == (7, item, 0, len(item), 0)


def test_align():
    r = np.random.default_rng(1)
    for _ in range(30):
        item, text = r.integers(0, 3, 20).astype(np.uint8), r.integers(0, 3, 25).astype(np.uint8)
        at = np.arange(6)
        cost, _ = align(item, at, text, at - 20, 0 * at, 0 * at + 25, 15, 60, 15)
        assert cost.tolist() == [sellers(item[s : s + 15], text) for s in range(6)]


def test_empty(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaks(none, items).count() == 0 and decontaminated(none, items).count() == 0


def test_two_edits_in_an_item_of_32_to_35_bytes(spark):
    r = random.Random(2)
    items = [(n, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))) for n in (24, 31, 32, 33, 34, 35, 36, 48)]
    docs = []
    for n, t in items[2:7]:
        docs.append((n, "1234 " + t[:10] + "#" + t[11:21] + "#" + t[22:] + " 5678", None, None, None))
        docs.append((100 + n, "1234 " + t[:11] + "#" + t[12:23] + "#" + t[24:] + " 5678", None, None, None))
    got = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == brute(docs, items, Budget()) >= {(k + n, n) for k in (0, 100) for n in (32, 33, 34, 35)}


def test_every_edit_within_the_budget_is_found_at_every_length(spark):
    """Items of 24 to 90 bytes with 0 to e random edits: all found (recall 1.0)."""
    r, budget = random.Random(4), Budget()
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).strip().ljust(n, "q")
    items, docs = [], []
    for n in range(24, 91, 3):
        items.append((n, say(n)))
        for e in range(budget.of(n)[1] + 1):
            for k in range(6):
                text = items[-1][1]
                for _ in range(e):
                    at = r.randrange(len(text))
                    text = text[:at] + r.choice(["", "#", "#" + text[at]]) + text[at + 1 :]
                docs.append((1000 * n + 100 * e + k, "1234567 " + text + " 7654321", None, None, None))
    got = {(x.doc_id, x.item_id) for x in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert {d for d, i in got if d // 1000 == i} == {d[0] for d in docs}
    assert got == brute(docs, items, budget)


def test_short_items_are_found_whole_and_exact(spark, monkeypatch):
    from posledger.llm import op10_decontamination as op

    items = [(1, "short"), (2, "A b"), (3, "naïve ölçü 7"), (4, "twenty three bytes long"), (5, "--"), (6, "x")]
    texts = ["a SHORT one", "shorter", "x short", "(short)", "a\tB", "ab a b", "naïve ölçü 7", "naïve ölçü 78", "ünaïve ölçü 7", "twenty three bytes long.", "twenty three byte long", "-- --", "ax xa", "", None]
    want = {(0, 1), (2, 1), (2, 6), (3, 1), (4, 2), (5, 2), (6, 3), (9, 4)}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = leaks(df, spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and {r.edits for r in got} == {0}
    kept = {r.doc_id for r in decontaminated(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    monkeypatch.setattr(op, "SLICE", 64)  # borders of slices hide no letter
    (index,) = next(op._indexes(spark.createDataFrame(items[:1], ITEMS), Budget(window=4), 1 << 20))
    for pad in range(60, 140):
        assert [bool(f) for f in op.found_in(index, [b"." * pad + b"short" + b"." * 99, b"." * pad + b"ashort" + b"." * 99, b"." * pad + b"shortb" + b"." * 99])] == [True, False, False]
