import hashlib
import re
from collections import defaultdict

from corpus import DOCS, corpus
from posledger.llm.op07_mixture import mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), cap=3):
    """By the rule as it is stated: share by weight, stop at the caps, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        got = {s: cap * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and got[s] > cap * sizes[s]}
        if not over:
            return got
        capped |= over


def check(spark, rows):
    got = mixture(spark.createDataFrame(rows, DOCS)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes) if rows else {}
    out = []
    for s in sizes:
        key = lambda x: (hashlib.md5(f"mix|{'' if x[0] is None else x[0]}|{size(x[1])}".encode()).hexdigest(), size(x[1]))
        before = 0
        for r in sorted((r for r in rows if r[3] == s), key=key):
            n = size(r[1])
            passes, rest = divmod(int(want[s]), sizes[s]) if sizes[s] else (0, 0)
            out.append((r[0], n, sizes[s], passes * n + max(0, min(n, rest - before))))
            before += n
    assert sorted((r.doc_id, r["size"], r.source_size, r.taken) for r in got if r.doc_id is not None) == sorted(x for x in out if x[0] is not None)
    assert len(got) == len(out)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}


def test_against_the_stated_rule(spark):
    check(spark, corpus(6))


def test_caps_and_empty_sources(spark):
    check(spark, [(i, "a b c " * (1 + i % 7), None, "abcdefg"[i % 3] if i < 90 else "g", 0) for i in range(100)] + [(200, None, None, "z", 0), (201, "x", None, None, 1)])


def test_nothing(spark):
    check(spark, [])
    check(spark, [(1, None, None, None, None), (2, "", None, "a", None)])


def test_carried_columns_of_clashing_names(spark):
    rows = [(i, "a b c " * (1 + i % 4), "s%d" % (i % 3), -i, "t%d" % i, 2 * i, i % 2, "k", "b") for i in range(40)]
    names = ["doc_id", "text", "source", "Size", "target", "taken", "source_size", "_mix_key", "_mix_bucket"]
    df = spark.createDataFrame(rows, names)
    carry = ("doc_id", "Size", "target", "taken", "source_size", "_mix_key", "_mix_bucket")
    got = mixture(df, carry=carry)
    assert got.columns == ["doc_id", "carried_Size", "carried_target", "carried_taken", "carried_source_size", "_mix_key", "_mix_bucket", "size", "source_size", "target", "taken"]
    plain = {r.doc_id: tuple(r)[1:] for r in mixture(df.select("doc_id", "text", "source")).collect()}
    for r in got.collect():
        assert tuple(r)[:7] == (r.doc_id, -r.doc_id, "t%d" % r.doc_id, 2 * r.doc_id, r.doc_id % 2, "k", "b") and tuple(r)[7:] == plain[r.doc_id]
