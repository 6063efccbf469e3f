"""The pipeline on a small fixture, each stage against plain Python on that stage's own input."""

import random
import re

import test_op01
import test_op05
import test_op10
from test_op07 import targets

import corpus_pipeline
from corpus import DOCS
from posledger.llm.op10_decontamination import Budget

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture(tmp_path, spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(500)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(20))) for i in range(5)]
    menu = " ".join(say(6))
    docs, labels = [], []
    for i in range(400):
        w = say(r.randint(60, 120))
        if i % 5 == 0:
            w = [x + "%%%" for x in w]
        if i % 17 == 1:
            w[30:30] = items[i % 5][1].split(" ")
        text = " ".join(w)
        if i % 3 == 0:
            text = menu + "\n" + text
        if i % 20 == 7:
            text = docs[i - 3][1].replace(" ", "\n", 1)
        docs.append((i, text, "en", "s%d" % (i % 8), len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_each_stage_on_its_own_input(spark, tmp_path):
    d, items = fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, columns = [tuple(r) for r in docs.collect()], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        after = [tuple(r) for r in docs.collect()]
        ids = sorted(r[0] for r in after)
        if name != "mixture":
            assert docs.columns == columns
        if name == "quality_classifier":
            assert ids == sorted(r[0] for r in before if r[0] < 400 and "%%%" not in r[1]) or set(ids) - {900, 901} == {r[0] for r in before if r[0] < 400 and "%%%" not in r[1]}
        elif name == "line_dedup":
            want = {x[0]: x[3] for x in test_op01.brute(before, 5)}
            assert {r[0]: r[1] for r in after} == want and len(after) == len(before)
            assert all(r[4] == len(r[1]) for r in after if r[1] is not None)
        elif name == "jaccard_dedup":
            want = test_op05.brute(before)
            assert ids == sorted(i for i, n, c in want if n == 0 or i == c)
        elif name == "decontamination":
            dirty = {i for i, _ in test_op10.brute(before, items, Budget())}
            assert dirty and ids == sorted(r[0] for r in before if r[0] not in dirty)
        else:
            sizes = {}
            for r in before:
                sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
            taken = {}
            for r in docs.collect():
                taken[r.source] = taken.get(r.source, 0) + r.taken
                assert 0 < r.taken <= 3 * r["size"]
            assert {s: int(t) for s, t in targets(sizes).items() if int(t)} == taken
        before = after


def test_run(spark, tmp_path):
    d, _ = fixture(tmp_path, spark)
    assert corpus_pipeline.run(spark, d).count() > 0
