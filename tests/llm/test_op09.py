import hashlib
import math
import re
from collections import defaultdict

from corpus import DOCS, corpus
from posledger.llm.op09_pii import pii_spans, sanitised

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(d):
    return sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text):
            s, d = m.group(0), re.sub("[^0-9]", "", m.group(0))
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end(), d if kind in ("card", "phone") else s.lower()))
    return out


def brute_every(rows, reach=3, least=0.9, sort=True):
    """Revealed terms per row: every pair is scored, and what is glued to a match is passed over."""
    texts, blank = [r[1] or "" for r in rows], "\t\n\v\f\r "
    n, near, n_e, n_te, n_t = len(texts), [], defaultdict(int), defaultdict(int), defaultdict(int)
    for t in texts:
        pairs, ents = set(), set()
        for kind, s, e, v in base(t):
            while s and t[s - 1] not in blank:
                s -= 1
            while e < len(t) and t[e] not in blank:
                e += 1
            ents.add((kind, v))
            pairs |= {((kind, v), w) for w in WORD.findall(t[:s])[-reach:] + WORD.findall(t[e:])[:reach]}
        for counts, keys in ((n_e, ents), (n_te, pairs), (n_t, set(WORD.findall(t)))):
            for x in keys:
                counts[x] += 1
        near.append(pairs)
    reveal = {p for p in n_te if n > n_e[p[0]] and math.log2(n * n_te[p] / (n_t[p[1]] * n_e[p[0]])) / math.log2(n / n_e[p[0]]) >= least}
    out = []
    for r, t, pairs in zip(rows, texts, near):
        terms = {w for e, w in pairs if (e, w) in reveal}
        out.append((r[0], ["term:%d:%d" % m.span() for m in WORD.finditer(t) if m.group(0) in terms]))
    return sorted(out, key=str) if sort else out


def brute(rows):
    """The whole result: the base spans, and the terms of ``brute_every``."""
    out, terms = [], dict(enumerate(brute_every([(k, r[1]) for k, r in enumerate(rows)], sort=False)))
    for k, r in enumerate(rows):
        spans = base(r[1] or "")
        listed = ["%s:%d:%d" % x[:3] for x in spans]
        counts = [sum(x[0] == kind for x in spans) for kind in RAW]
        out.append((r[0], *counts, hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + terms[k][1])))
    return sorted(out, key=str)


def make():
    rows = corpus(10, 60)
    t = [
        "mail a.b@c.d@e.f or x@y.z_w@q.r, not x@y; ñ j%k@l-m.n.o.",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004 12 4111111111111111 1",
        "1.2.3.4.5.6.7.8 999.1.1.1.2.3.4.5 000255.0.0.1 256.1.1.1 10.0.0.1.",
        "+1 (407) 555-7710 x +44.20.7946.0958- +12345678 +1234567890123456 ++1 999 999 9999",
        "x" * 2_000 + "@a.b " + "1" * 2_000 + " " + "1 " * 2_000 + "1." * 4_000 + "1",
        "日本 p@q.r 日本 😀 p@q.r",
        "write to Zeb Quill at zq@corp.example today",
        "our Zeb Quill has zq@corp.example as address\nZeb Quill again",
        "Zeb Quill said: zq@corp.example is mine",
        "the \\E(odd zq2@corp.example is \\E(odd",
        "one \\E(odd zq2@corp.example or",
    ]
    return rows + [(500 + i, x, None, "s", 1) for i, x in enumerate(t + t[6:7])]


def test_spans_against_brute_force(spark):
    rows = make()
    for small in (200_000, 0):
        got = pii_spans(spark.createDataFrame(rows, DOCS), small=small).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    assert any("term" in r[-1] for r in brute(rows))


def test_sanitised(spark):
    rows = make()
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "base")
    got = sanitised(df, remove=2.0)
    assert got.columns == df.columns
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[506] == "write to [TERM] [TERM] [TERM] [EMAIL] [TERM]"
    assert by[60] is None and by[500].startswith("[TERM] [EMAIL]@e.f or [EMAIL][EMAIL], ")
    texts = {r[0]: r[1] for r in rows}
    for x in brute(rows):
        if x[0] is not None and texts[x[0]] is not None and sum(r[0] == x[0] for r in rows) == 1:
            at, out = 0, ""
            for s, e, kind in sorted((int(s), int(e), kind) for kind, s, e in (y.split(":") for y in x[-1].split(",") if y)):
                if s >= at:
                    out, at = out + texts[x[0]][at:s] + f"[{kind.upper()}]", e
            assert by[x[0]] == out + texts[x[0]][at:]
    gone = {r.doc_id: r.text for r in sanitised(df).collect()}
    assert gone[506] == "write to    [EMAIL] "


def test_empty(spark):
    assert pii_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_long_runs_cost_their_length(spark):
    text = "x" * 400_000 + " " + "1" * 400_000 + " " + "1 " * 200_000 + "+" * 100_000 + "1." * 1_000
    (row,) = pii_spans(spark.createDataFrame([(1, text, None, None, None)], DOCS)).collect()
    assert row.n_email == 0 and row.n_card == 0


def test_every_pair_is_scored(spark):
    rows = [r for r in make() if r[1] is None or len(r[1]) < 2_000]
    rows += [(600, "met Anna Meier (anna@x.org), Bonn", None, None, None)]
    rows += [(610 + i, "text %d\ncall Uwe Lang at ul@y.example or write\nmore %d" % (i, i), None, None, None) for i in range(9)]
    df = spark.createDataFrame(rows, DOCS)
    for small in (200_000, 0):
        got = pii_spans(df, small=small).collect()
        assert sorted(((r.doc_id, [x for x in r.spans.split(",") if x.startswith("term:")]) for r in got), key=str) == brute_every(rows)
    spans = {r.doc_id: r.spans for r in got}
    assert "term:4:8,term:9:14,term:29:33" in spans[600]
    assert all("term:12:15,term:16:20" in spans[610 + i] for i in range(9))


def test_the_registered_query_scores_every_pair(spark, tmp_path):
    from posledger.llm import queries

    rows = [(i, "w%d x" % i, None, None, None) for i in range(20)] + [(20, "met Anna Meier (anna@x.org), Bonn", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.spans for r in queries.QUERIES["op9_pii_spans"](spark, str(tmp_path)).where("doc_id = 20").collect()] == ["email:16:26,term:0:3,term:4:8,term:9:14,term:29:33"]


def test_words_of_any_length_stand_near(spark):
    long = ["a" * 90, "b" * 90, "c" * 700, "d" * 5_000]
    rows = [(1, "x " + " ".join(long[:2]) + " one me@x.org two " + " ".join(long[2:]) + " y", None, None, None)]
    rows += [(2, " ".join(long).upper() + " me2@x.org", None, None, None), (3, "(" * 3_000 + "me3@x.org" + ")" * 3_000 + " " + "g" * 9_000 + " e f", None, None, None)]
    rows += [(4, "me4@x.org", None, None, None), (5, "z" * 20_000 + " " + "me5@x.org", None, None, None)]
    rows += [(10 + i, "w%d x" % i, None, None, None) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term:")] for r in pii_spans(df).collect()}
    assert got == dict(brute_every(rows)) and [len(got[k]) for k in (1, 2, 3, 5)] == [6, 3, 3, 1]
    for r in (1, 5):
        got = {x.doc_id: [y for y in x.spans.split(",") if y.startswith("term:")] for x in pii_spans(df, reach=r).collect()}
        assert got == dict(brute_every(rows, reach=r))
