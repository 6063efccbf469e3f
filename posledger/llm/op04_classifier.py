"""Operator 4, quality classifier: a sparse ensemble of rules.

Small regression trees are boosted on text statistics of a bounded sample of labelled rows; every
path from a root is a conjunction of thresholds, a rule. A logistic model with an L1 penalty is fitted on
the rules' outcomes, which leaves a few of them with a weight. These compile to one Spark expression, so
scoring is a plain projection over any number of documents.

Labels come only from documents whose crc32 of the id isn't 0 modulo 5; labels, language, source and id
are no inputs. At most ``statistics.LABELLED_ROWS`` labelled rows are fetched for fitting.

A null text scores as an empty one, and empty texts get a score too; repeated rows get equal scores;
without labelled rows, or with one class only, the score is the share of label 1 (0.5 without any);
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import statistics as S

THRESHOLD = 0.3


def grow_tree(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, cuts: list, leaf: int = 20):
    """A tree as a list of (path, value) over all nodes but the root; a path is a list of (feature, at most, mark)."""
    nodes, values = [], np.zeros(len(x))

    def split(rows, path):
        total = slope[rows].sum() ** 2 / (bend[rows].sum() + 1)
        best = (1e-6, None)
        for f in range(x.shape[1]):
            for mark in cuts[f]:
                left = x[rows, f] <= mark
                n = int(left.sum())
                if min(n, len(rows) - n) >= leaf:
                    a, b = rows[left], rows[~left]
                    gain = sum(slope[r].sum() ** 2 / (bend[r].sum() + 1) for r in (a, b)) - total
                    if gain > best[0]:
                        best = (gain, (f, mark, a, b))
        if best[1] is None or len(path) == depth:
            values[rows] = slope[rows].sum() / (bend[rows].sum() + 1)
            return
        f, mark, a, b = best[1]
        for rows_, at_most in ((a, True), (b, False)):
            nodes.append([*path, (f, at_most, float(mark))])
            split(rows_, [*path, (f, at_most, float(mark))])

    split(np.arange(len(x)), [])
    return nodes, values


def outcomes(x: np.ndarray, rules) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, at_most, mark in rule:
            out[:, k] *= x[:, f] <= mark if at_most else x[:, f] > mark
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400):
    """Weights and offset of the L1-penalised logistic model, by accelerated proximal gradient steps."""
    n, m = z.shape
    step = 4.0 * n / max(1e-9, np.linalg.norm(np.c_[z, np.ones(n)], 2) ** 2)
    w = v = np.zeros(m + 1)
    a = np.c_[z, np.ones(n)]
    t = 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / n
        new = v - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, bins: int = 16):
    """(rules, weights, offset); rules with weight 0 are left out."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return [], [], float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    score, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes, values = grow_tree(x, y - p, p * (1 - p), depth, cuts)
        score = score + rate * values
        rules.update({tuple(sorted(set(node))): None for node in nodes})
    rules = list(rules)
    weights, offset = lasso_logistic(outcomes(x, rules), y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return [rules[k] for k in kept], [float(weights[k]) for k in kept], offset


def compile_score(model, names) -> Column:
    """The model as a column over the statistics of ``statistics.ratios``."""
    rules, weights, offset = model
    ratios, total = S.ratios(), F.lit(offset)
    for rule, weight in zip(rules, weights):
        meets = F.lit(True)
        for f, at_most, mark in rule:
            meets = meets & (ratios[names[f]] <= mark if at_most else ratios[names[f]] > mark)
        total = total + F.when(meets, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame):
    names = list(S.ratios())
    rows = sorted(map(tuple, S.labelled(docs, labels).select("doc_id", "quality", *names).collect()))
    table = np.array([r[1:] for r in rows], float).reshape(-1, 1 + len(names))
    return fit(table[:, 1:], table[:, 0]), names


def score(docs: DataFrame, model, names, keep=("doc_id",)) -> DataFrame:
    return S.with_counts(docs, keep).select(*keep, compile_score(model, names).alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    model, names = train(docs, labels)
    scored = score(docs, model, names)
    return scored.select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold, with all their columns."""
    model, names = train(docs, labels)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text"))
    return S.with_counts(rows, ("_row",)).where(compile_score(model, names) >= threshold).select("_row.*")
