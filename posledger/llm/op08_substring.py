"""Operator 8, substring dedup by seed and extend.

Seeds are winnowed anchors: of the ``anchor`` -word runs that begin in a window, the leftmost with the
least hash. Equal windows choose equal anchors at equal offsets, so every repeat of ``window`` words
shares a seed. Documents meet on their seeds through the block exchange; each occurrence of a seed
that the corpus has twice is then extended both ways, over every window that chose it, and the
windows meet in the same way. Extending classes of equal windows and not pairs of occurrences keeps the
work linear: a passage with n copies is n occurrences and never n*n pairs. Neighbouring repeated
windows join to maximal repeats.

Nulls and empty texts have no words and keep the empty string; a repeated row counts as another
document; ties between equal hashes go to the leftmost; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K

RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"
SPANS = "doc_id long, span_start long, span_end long"
KEPT = "doc_id long, kept string"


class _Windows:
    """The windows of a block by anchor: ``start`` of each window and the index of its anchor."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.words = w = K.Words(B.texts_of(table))
        at, hashes = w.runs(anchor)
        doc = w.doc[at]
        keep, lo, hi = K.anchors(at, doc, hashes, 0, window - anchor, w.first[doc], w.first[doc + 1] - window)
        self.anchors, self.count, self.where = K.compact(hashes[keep])
        self.lo, self.hi, self.window = lo, hi, window

    def windows(self, live: np.ndarray):
        """Starts and hashes of the windows of the live anchors."""
        live = live[self.where]
        start, _ = K.spread(self.lo[live], self.hi[live])
        return start, K.Rolling(self.words.hash, 2)(start, start + self.window)


def _repeats(docs: DataFrame, window: int, anchor: int, finish, schema: str) -> DataFrame:
    plan = B.layout(docs)
    bits = plan.bits
    docs = B.blocked(docs, plan)

    def seeds(table):
        b = _Windows(table, window, anchor)
        return B.send(B.number(table), bits, b.anchors, (b.count > 1).astype(np.uint8))

    def extend(table, answer):
        b = _Windows(table, window, anchor)
        distinct, count, _ = K.compact(b.windows(B.answers(answer, bits, b.anchors))[1])
        return B.send(B.number(table), bits, distinct, (count > 1).astype(np.uint8))

    def mark(table, answer):
        both = answer["stage"].to_numpy()
        b = _Windows(table, window, anchor)
        start, hashes = b.windows(B.answers(answer.filter(pa.array(both == 1)), bits, b.anchors))
        distinct, _, where = K.compact(hashes)
        found = B.answers(answer.filter(pa.array(both == 2)), bits, distinct)
        return finish(table, b.words, K.covered(len(b.words), start[found[where]], window))

    first = B.repeated(docs.groupBy("block").applyInArrow(seeds, B.SENT))
    second = B.repeated(B.meet(docs, first, extend, B.SENT))
    told = first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))
    return B.meet(docs, told, mark, schema)


def _digest(table, words, gone):
    n = table.num_rows
    ids, texts = table["doc_id"].to_pylist(), B.texts_of(table)
    total = np.diff(words.first)
    removed = np.zeros(n, np.int64)
    np.add.at(removed, words.doc[gone], 1)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1] | (words.doc[1:] != words.doc[:-1])
    spans = np.zeros(n, np.int64)
    np.add.at(spans, words.doc[begins], 1)
    kept = [hashlib.sha256(t).hexdigest() for t in _kept(table, words, gone)]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": total, "n_removed": removed, "n_spans": spans, "kept_sha256": pa.array(kept, pa.string())})


def _kept(table, words, gone):
    """The kept words of each document, joined by one space."""
    for k in range(table.num_rows):
        a, b = words.first[k], words.first[k + 1]
        keep = np.flatnonzero(~gone[a:b]) + a
        yield b" ".join([words.data[i:j] for i, j in zip(words.start[keep].tolist(), words.end[keep].tolist())])


def _texts(table, words, gone):
    return pa.table({"doc_id": table["doc_id"].combine_chunks(), "kept": pa.array([t.decode() for t in _kept(table, words, gone)], pa.string())})


def _spans(table, words, gone):
    edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (words.doc[1:] != words.doc[:-1])])[: len(gone)])
    stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | (words.doc[1:] != words.doc[:-1]), [True]])[: len(gone)])
    doc = words.doc[edge]
    return pa.table({"doc_id": table["doc_id"].combine_chunks().take(pa.array(doc)), "span_start": edge - words.first[doc], "span_end": stop + 1 - words.first[doc]})


def substring_digest(docs: DataFrame, window: int = 35, anchor: int = 16) -> DataFrame:
    """A row per document: counts of words, of removed words and of maximal repeats, and a digest of what stays."""
    return _repeats(docs, window, anchor, _digest, RESULT)


def substring_dedup(docs: DataFrame, window: int = 35, anchor: int = 16) -> DataFrame:
    """doc_id and the kept words, joined by one space."""
    return _repeats(docs, window, anchor, _texts, KEPT)


def repeated_spans(docs: DataFrame, window: int = 35, anchor: int = 16) -> DataFrame:
    """Maximal repeats of at least ``window`` words as half-open word ranges."""
    return _repeats(docs, window, anchor, _spans, SPANS)
