"""Operator 3, quality rules: a decision list learned by sequential covering.

Rules are conjunctions of thresholds on text statistics that tell junk. A rule is grown on two
thirds of the labelled rows, one threshold at a time, by information gain; it is pruned back on the
last third to the length with the best balance of junk and good rows; rows that it covers are
set aside and the next rule starts. The list becomes one ordered ``CASE WHEN``.

Everything runs in Spark expressions. The labelled rows (at most 20,000) are cut into at most
``cuts`` bins per statistic and counted by cell; each step aggregates the cells to one small
histogram, and only that reaches the driver.

Nulls and empty texts have no words and fail the base rule; ids may be null or repeated and each row
has its own result; ties between thresholds go to the first statistic and the least threshold;
without labels the list is empty and only the base rule decides; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import statistics as S

LEAST_WORDS = 50
MOST_REPEAT = 50


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def _gain(junk: int, good: int, was_junk: int, was_good: int) -> float:
    if not junk:
        return 0.0
    return junk * (math.log2(junk / (junk + good)) - math.log2(was_junk / (was_junk + was_good)))


def _condition(literal) -> Column:
    name, at_most, k = literal
    return F.col(f"b_{name}") <= k if at_most else F.col(f"b_{name}") > k


def _all(rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & _condition(literal)
    return out


def _best(cells: DataFrame, names, was_junk: int, was_good: int):
    """The literal of the largest gain over the cells, by one histogram of all statistics."""
    pairs = ", ".join(f"'{n}', b_{n}" for n in names)
    histogram = cells.select("junk", "good", F.expr(f"stack({len(names)}, {pairs}) AS (name, bin)"))
    rows = histogram.groupBy("name", "bin").agg(F.sum("junk").alias("junk"), F.sum("good").alias("good")).collect()
    best = (0.0, None, 0, 0)
    for name in names:
        junk = good = 0
        for _, j, g in sorted((r["bin"], r["junk"], r["good"]) for r in rows if r["name"] == name):
            junk, good = junk + j, good + g
            k = _
            for at_most, a, b in ((True, junk, good), (False, was_junk - junk, was_good - good)):
                if (gain := _gain(a, b, was_junk, was_good)) > best[0] + 1e-9:
                    best = (gain, (name, at_most, k), a, b)
    return best[1:]


def learn(sample: DataFrame, cuts: int = 24, rules: int = 8, literals: int = 3, least_precision: float = 0.8):
    """From rows of ``quality`` and statistics to a list of rules, each a list of (statistic, at most, threshold)."""
    names = [c for c in sample.columns if c not in ("doc_id", "quality")]
    shares = [i / cuts for i in range(1, cuts)]
    sample = sample.persist()
    marks = sample.agg(*[F.percentile_approx(n, shares, 1000).alias(n) for n in names]).first()
    if marks[0] is None:
        sample.unpersist()
        return []
    marks = {n: sorted(set(marks[n])) for n in names}
    bin_of = lambda n: sum((F.when(F.col(n) > m, 1).otherwise(0) for m in marks[n]), F.lit(0))
    cells = sample.select(
        *[bin_of(n).alias(f"b_{n}") for n in names],
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"),
        (1 - F.col("quality")).alias("junk"),
        F.col("quality").alias("good"),
    )
    cells = cells.groupBy("prune", *[f"b_{n}" for n in names]).agg(F.sum("junk").alias("junk"), F.sum("good").alias("good")).coalesce(2).persist()
    found, grow, prune = [], cells.where("NOT prune"), cells.where("prune")
    for _ in range(rules):
        start = grow.agg(F.sum("junk"), F.sum("good")).first()
        junk, good = start[0] or 0, start[1] or 0
        rule, covered = [], grow
        while junk and good and len(rule) < literals:
            literal, a, b = _best(covered, names, junk, good)
            if literal is None:
                break
            rule, junk, good = [*rule, literal], a, b
            covered = covered.where(_condition(literal))
        if not rule:
            break
        sums = [F.sum(F.when(_all(rule[:k]), F.col(c)).otherwise(0)) for k in range(1, len(rule) + 1) for c in ("junk", "good")]
        held = [x or 0 for x in prune.agg(*sums).first()]
        worth = [(j - g) / (j + g) if j + g else -1.0 for j, g in zip(held[0::2], held[1::2])]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        if held[2 * k] < least_precision * (held[2 * k] + held[2 * k + 1]) or not held[2 * k]:
            break
        found.append(rule[: k + 1])
        grow, prune = grow.where(~_all(rule[: k + 1])), prune.where(~_all(rule[: k + 1]))
    cells.unpersist()
    sample.unpersist()
    # bin k holds what is above mark k-1 and at most mark k; the last bin has no upper mark
    return [[(n, at_most, marks[n][k]) for n, at_most, k in rule if k < len(marks[n])] for rule in found]


def fired(rules) -> Column:
    """Number of the first rule that a row meets, from 1; 0 for none."""
    ratios, out = S.ratios(), F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, 1):
        meets = F.lit(True)
        for name, at_most, mark in rule:
            meets = meets & (ratios[name] <= mark if at_most else ratios[name] > mark)
        out = out.when(meets, F.lit(i))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules) -> DataFrame:
    """The counts of every document, whether it fails the base rule, the rule that it meets, and whether it stays."""
    counts = S.with_counts(docs).withColumn("base_failed", base_failed()).withColumn("rule", fired(rules).cast("int"))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, learn(S.labelled(docs, labels)))
