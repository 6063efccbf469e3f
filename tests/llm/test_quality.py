import random
import re
import zlib
from collections import Counter

import numpy as np

from corpus import DOCS, corpus
from posledger.llm import op03_rules, op04_classifier
from posledger.llm import statistics as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w, tri = WORD.findall(text), Counter()
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])] += 1
    cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def quality_corpus(n=900, seed=5):
    r = random.Random(seed)
    words = ["w%s" % "".join(r.choice("abcdef") for _ in range(r.randint(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [r.choice(words) for _ in range(r.randint(60, 150))]
        if bad:
            w = [x + "###" for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), None, None, None))
        labels.append((i, int(not bad) if r.random() > 0.03 else int(bad), 0))
    return docs + [(n, None, None, None, None), (n + 1, "", None, None, None), (None, "a b", None, None, None)], labels + [(None, 1, 0), (3, None, 0)]


LABELS = "doc_id long, quality int, toxic int"


def test_counts_against_brute_force(spark):
    rows = corpus(7) + [(900, "a b c a b c\n\na b c\n a b c x \x0b\x0c", None, None, None), (901, "## $ |||\n## $ |||", None, None, None)]
    got = S.with_counts(spark.createDataFrame(rows, DOCS)).collect()
    want = sorted(((r[0], *counts(r[1])) for r in rows), key=str)
    assert sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got), key=str) == want


def test_rules_tell_junk_and_keep_the_rest(spark):
    docs, labels = quality_corpus()
    df = spark.createDataFrame(docs, DOCS)
    got = op03_rules.quality_rules(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    wrong = sum(by[i].kept != (i % 5 != 0) for i in range(900))
    assert wrong < 20
    for d, t, *_ in docs:
        n, _, _, _, rep = counts(t)
        assert by[d].base_failed == (n < 50 or 100 * rep > 50 * n)
    assert not by[900].kept and by[900].base_failed


def test_rules_without_labels(spark):
    docs, _ = quality_corpus(20)
    got = op03_rules.quality_rules(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert op03_rules.quality_rules(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_classifier_on_the_held_out_fold(spark):
    docs, labels = quality_corpus()
    got = op04_classifier.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) > 0.95


def test_classifier_filter_and_degenerate_labels(spark):
    docs, labels = quality_corpus(300)
    df = spark.createDataFrame(docs, DOCS)
    kept = op04_classifier.quality_filter(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns and 200 < kept.count() < 280
    none = op04_classifier.quality_scores(df, spark.createDataFrame([], LABELS)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_labelled_rows_are_bounded_when_ids_repeat(spark):
    docs, labels = quality_corpus(100)
    docs = [(7, "w%d " % i * 60, None, None, None) for i in range(400)] + docs * 3
    sample = S.labelled(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), 30).collect()
    assert len(sample) == 30 and len({r.doc_id for r in sample}) == 30
    every = S.labelled(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(every) == len({i for i, q, _ in labels if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5})


def statistics_of(row):
    """The statistics by name, from a row of counts."""
    per = lambda a, b: a / b if b > 0 else 0.0
    words, chars = row.n_words, row.word_chars
    by_word = {"symbol": row.n_symbols, "repeat": row.n_repeat_words, "distinct": row.n_distinct, "mark": row.n_marks, "point": row.n_points, "dup_line": row.n_dup_lines}
    out = {f"{k}_ratio": per(v, words) for k, v in by_word.items()}
    return out | {"words": float(words), "upper_ratio": per(row.n_upper, chars), "digit_ratio": per(row.n_digits, chars), "word_length": per(chars, words)}


def test_verdicts_against_a_plain_reading_of_the_list(spark):
    docs, labels = quality_corpus()
    docs += docs[:5] + [(950, "x " * 100_000, None, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    rules = op03_rules.learn(S.labelled(df, spark.createDataFrame(labels, LABELS)))
    assert rules
    want = []
    for r in S.with_counts(df).collect():
        s = statistics_of(r)
        first = next((k for k, rule in enumerate(rules, 1) if all(s[n] <= m if at_most else s[n] > m for n, at_most, m in rule)), 0)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        want.append((r.doc_id, failed, first, not failed and not first))
    got = [(r.doc_id, r.base_failed, r.rule, r.kept) for r in op03_rules.judge(df, rules).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_compiled_score_against_the_rules_outcomes(spark):
    docs, labels = quality_corpus()
    docs += docs[:5] + [(950, "x! " * 100_000, None, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    (rules, weights, offset), names = op04_classifier.train(df, spark.createDataFrame(labels, LABELS))
    assert rules
    rows = S.with_counts(df).collect()
    x = np.array([[statistics_of(r)[n] for n in names] for r in rows])
    want = 1 / (1 + np.exp(-(op04_classifier.outcomes(x, rules) @ weights + offset)))
    got = op04_classifier.score(df, ((rules, weights, offset)), names).collect()
    key = lambda p: (str(p[0]), round(p[1], 9))
    a, b = sorted(zip([r.doc_id for r in rows], want), key=key), sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [i for i, _ in a] == [i for i, _ in b] and np.allclose([s for _, s in a], [s for _, s in b], atol=1e-9)
