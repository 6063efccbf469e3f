import hashlib
import re
from collections import Counter

from corpus import DOCS, corpus
from posledger.llm.op08_substring import repeated_spans, substring_dedup, substring_digest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    docs = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    for doc_id, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        yield doc_id, w, gone


def expected(rows):
    out = []
    for doc_id, w, gone in brute(rows):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digest_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = substring_digest(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == expected(rows)


def test_texts_and_spans(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "block")
    texts = sorted((tuple(r) for r in substring_dedup(df).collect()), key=str)
    assert texts == sorted(((d, " ".join(x for i, x in enumerate(w) if i not in g)) for d, w, g in brute(rows)), key=str)
    spans = sorted((tuple(r) for r in repeated_spans(df).collect()), key=str)
    want = [(d, i, next(j for j in range(i, len(w) + 1) if j not in g)) for d, w, g in brute(rows) for i in sorted(g) if i - 1 not in g]
    assert spans == sorted(want, key=str)


def test_empty(spark):
    assert substring_digest(spark.createDataFrame([], DOCS)).count() == 0
