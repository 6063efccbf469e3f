import hashlib
import random
from collections import defaultdict

import pytest

from corpus import DOCS
from posledger.llm.op01_lines import line_digest, without_boilerplate

BLANKS = " \t\n\x0b\f\r"


def make(seed=2, n=80):
    r = random.Random(seed)
    common = ["menu %d of the site" % i for i in range(12)]
    rows = []
    for i in range(n):
        lines = ["body %d %d" % (i, k) for k in range(r.randint(0, 6))]
        for k, c in enumerate(common):
            if r.random() < 0.06 * k:
                lines.insert(r.randint(0, len(lines)), (" " + c + "\t") if r.random() < 0.3 else c)
        if i % 9 == 0:
            lines += ["", "  ", lines[0] if lines else ""]
        rows.append((i, "\n".join(lines), "en", None if i % 11 == 0 else "s%d" % r.randint(0, 11), 7))
    return rows + [rows[3], rows[3], (200, None, None, "s1", None), (201, "", None, "s1", 0), (None, "menu 11 of the site", None, "s2", 1)]


def brute(rows, least):
    sites = defaultdict(set)
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            sites[line.strip(BLANKS)].add(s)
    out = []
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not x.strip(BLANKS) or len(sites[x.strip(BLANKS)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,precision,small", [(5, 12, 200_000), (5, 4, 0), (1, 12, 0)])
def test_against_brute_force(spark, least, precision, small):
    rows = make()
    df = spark.createDataFrame(rows, DOCS)
    got = line_digest(df, "source", least, precision, small).collect()
    want = [(d, n, r, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, r, t in brute(rows, least)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clash = df.withColumnRenamed("lang", "gone")
    kept = without_boilerplate(clash, "source", least, precision, small)
    assert kept.columns == clash.columns and kept.dtypes == clash.dtypes
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((d, t) for d, _, _, t in brute(rows, least)), key=str)


def test_empty(spark):
    assert line_digest(spark.createDataFrame([], DOCS)).count() == 0
