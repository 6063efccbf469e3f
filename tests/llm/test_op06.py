import random
import re

import pytest
from corpus import DOCS, corpus
from posledger.llm import op06_licenses as op
from posledger.llm.op06_licenses import TEMPLATES, Scanner, license_spans

WORD = re.compile(r"[^\s!-/:-@\[-`{-~]+")


def words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def make(seed=4):
    r = random.Random(seed)
    rows = [list(x) for x in corpus(seed, 60)]
    for i, (name, text) in enumerate(TEMPLATES * 2):
        row = rows[4 * i % 60]
        t = text.upper().replace(" ", "\n * ") if i % 3 == 0 else text
        at = (row[1] or "").find(" ") + 1
        row[1] = (row[1] or "")[:at] + "ñ " + t + " " + (row[1] or "")[at:]
    w = words(TEMPLATES[1][1])
    w[4], w[9] = "other", "changed"
    rows.append([700, "x " + " ".join(w) + " y", None, None, None])
    rows.append([701, " ".join(words(TEMPLATES[2][1])[:9]), None, None, None])
    rows.append([702, "a " * 300_000 + TEMPLATES[9][1] + " b" * 300_000, None, None, None])
    r.shuffle(rows)
    return [tuple(x) for x in rows]


def covered(template, text):
    """Largest number of matched words of any stretch, by plain local alignment."""
    a, b = words(template), words(text)
    if not set(zip(a, a[1:], a[2:])) & set(zip(b, b[1:], b[2:])):
        return 0
    best, prev = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b, 1):
            s, m = prev[j - 1]
            options = [(s + 1, m + 1) if x == y else (s - 1, m), (prev[j][0] - 1, prev[j][1]), (row[j - 1][0] - 1, row[j - 1][1]), (0, 0)]
            row.append(max(options, key=lambda t: t[0]))
        best, prev = max(best, *row), row
    return best[1]


def test_against_plain_alignment(spark):
    rows = make()
    got = license_spans(spark.createDataFrame(rows, DOCS)).collect()
    short = [r for r in rows if r[1] is None or len(r[1]) < 100_000]
    want = {(d, n) for d, t, *_ in short for n, x in TEMPLATES if covered(x, t) >= 0.8 * len(words(x))}
    assert {(r.doc_id, r.license) for r in got if r.doc_id != 702} == want
    assert [(r.license, r.span_start, r.coverage) for r in got if r.doc_id == 702] == [("MIT", 600_000, 1.0)]
    texts = {d: t for d, t, *_ in rows}
    for r in got:
        size = len(words(dict(TEMPLATES)[r.license]))
        inside = words(texts[r.doc_id][r.span_start : r.span_end])
        assert r.n_matched <= len(inside) and abs(r.coverage - r.n_matched / size) < 1e-9


def test_every_place_of_a_repeated_notice():
    text = (TEMPLATES[9][1] + " filler words that go on for a while until the notice comes up again ") * 2
    assert len([1 for k, *_ in Scanner().scan(text.encode()) if TEMPLATES[k][0] == "MIT"]) == 2


def test_empty(spark):
    assert license_spans(spark.createDataFrame([], DOCS)).count() == 0


def places(text, name):
    data = text.encode()
    return [data[s:e].decode() for k, _, s, e in Scanner().scan(data) if TEMPLATES[k][0] == name]


def test_every_place_of_a_chain():
    assert places("(c) 2019 A. All rights reserved. (c) 2020 B. All rights reserved.", "Reserved") == ["All rights reserved"] * 2
    for n in (5, 3_000):
        assert places("Released under the MIT License.\n" * n, "MIT") == ["Released under the MIT License"] * n
    assert places("All rights reserved. " * 70_000, "Reserved") == ["All rights reserved"] * 70_000


def test_no_intact_triple_is_needed():
    for text in ("Released under an MIT License.", "x Released truly under an MIT, new License y", "Released with the MIT License"):
        assert len(places(text, "MIT")) == 1


def test_edited_templates_against_plain_alignment():
    r = random.Random(8)

    def plain(a, b):  # as ``covered``, without its need of a triple
        best, prev = (0, 0), [(0, 0)] * (len(b) + 1)
        for x in a:
            row = [(0, 0)]
            for j, y in enumerate(b, 1):
                s, m = prev[j - 1]
                options = [(s + 1, m + 1) if x == y else (s - 1, m), (prev[j][0] - 1, prev[j][1]), (row[j - 1][0] - 1, row[j - 1][1]), (0, 0)]
                row.append(max(options, key=lambda t: t[0]))
            best, prev = max(best, *row), row
        return best[1]

    n = 0
    for i in range(20 * len(TEMPLATES)):
        k = i % len(TEMPLATES)
        w = words(TEMPLATES[k][1])
        b = list(w)
        for _ in range(r.randint(0, len(w) // 4 + 1)):
            b[r.randrange(len(b))] = r.choice(["new", "new " + b[-1], b[0] + " one", r.choice(w)])
        text = " ".join(["x"] * r.randint(0, 9) + b + ["y"] * r.randint(0, 9))
        if plain(w, words(text)) >= 0.8 * len(w):
            n += 1
            assert k in {x[0] for x in Scanner().scan(text.encode())}, text
    assert n > 50


def test_a_notice_over_the_border_of_a_slice_is_one_row(monkeypatch):
    monkeypatch.setattr(op, "SLICE", 1_000)
    notice = dict(TEMPLATES)["MIT-notice"]
    for pad in range(700, 1_050):
        text = ("ab " * 400)[:pad] + " " + notice + " tail" * 300
        found = [(TEMPLATES[k][0], s, e) for k, _, s, e in Scanner().scan(text.encode())]
        assert found == [("MIT-notice", pad + 1, pad + 1 + len(notice))]
    text = "x" * 5_000 + " " + notice.replace(" ", " " * 90) + " " + "y" * 5_000 + " All rights reserved"
    assert [TEMPLATES[k][0] for k, *_ in Scanner().scan(text.encode())] == ["MIT-notice", "Reserved"]


def long_templates(r, n=3, size=900):
    vocabulary = ["w%d" % k for k in range(300)]
    return [("long%d" % k, " ".join(r.choice(vocabulary) for _ in range(size))) for k in range(n)]


def test_long_templates_are_found_by_their_fingerprints():
    """Planted with edits of a tenth of the words: every place is found, by the banded alignment alone, over its whole length."""
    r = random.Random(3)
    pairs = long_templates(r)
    scanner = Scanner(pairs)
    for k in range(12):
        name, text = pairs[k % 3]
        w = text.split()
        for _ in range(len(w) // 10):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice(([], ["new"], [w[i], "more", "words"]))
        whole = " ".join(["x"] * r.randrange(50) + w + ["y"] * r.randrange(50) + w)
        data = op._Text(whole.encode())
        alone = [(t, m, a + i, a + j) for t, a, b, near in scanner.marked(data) for m, i, j in scanner.taken(scanner.banded(scanner.words[t], data.hash[a:b], scanner.need[t], near), b - a)]
        assert [t for t, *_ in alone] == [k % 3] * 2 and all(m >= 780 and j - i >= len(w) - 20 for _, m, i, j in alone)
        assert len(scanner.scan(whole.encode())) == 2


def test_banded_equals_whole_alignment_where_all_diagonals_are_in():
    import numpy as np

    r, scanner = random.Random(9), Scanner()
    for _ in range(60):
        a, b = (np.array([r.randrange(4) for _ in range(r.randint(1, 12))], np.uint64) for _ in range(2))
        everything = np.arange(-len(a) - 1, len(b) + 1)
        need = r.randint(1, len(a))
        assert (scanner.banded(a, b, need, everything)[0] == scanner.align(a, b, need)[0]).all()


def test_fingerprints_of_a_shared_run_are_shared():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(50):
        run = r.integers(0, 50, op.GRAM + op.WINDOW - 1).astype(np.uint64)
        chosen = []
        for _ in range(2):
            hashes = op.grams(np.concatenate([r.integers(50, 99, r.integers(0, 9)).astype(np.uint64), run, r.integers(50, 99, r.integers(0, 9)).astype(np.uint64)]), op.GRAM)
            chosen.append(set(hashes[op.winnowed(hashes, op.WINDOW)].tolist()))
        assert chosen[0] & chosen[1]


def test_templates_of_a_table(spark, monkeypatch):
    pairs = long_templates(random.Random(1), 2, 60)
    table = spark.createDataFrame([*pairs, (None, "x"), ("y", None), ("", "")], "name string, text string")
    docs = spark.createDataFrame([(1, "a " + pairs[1][1] + " b", None, None, None), (None, pairs[0][1].upper(), None, None, None), (3, None, None, None, None)], DOCS)
    got = sorted(map(tuple, license_spans(docs.withColumnRenamed("lang", "license"), table).collect()), key=str)
    assert [(g[0], g[1], g[3]) for g in got] == [(1, "long1", 1.0), (None, "long0", 1.0)]
    assert license_spans(docs, table.limit(0)).count() == 0
    monkeypatch.setattr(op, "TEMPLATE_BYTES", 100)
    with pytest.raises(ValueError, match="templates of"):
        license_spans(docs, table)
