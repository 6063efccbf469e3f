"""Operator 2, substring dedup over suffix order, built column by column over many documents at once.

A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere. The suffix
order of whole documents would take as many rounds as the longest document has bytes, each over the
whole collection. The bound on the match makes that unnecessary: only suffixes that may share
``length`` bytes have to be ordered, and only to that depth. So

1. every window of ``length`` bytes names an anchor inside it (winnowing over word starts; every byte
   deep inside a run without separators), and the block exchange finds the anchors that occur twice;
2. the stretch of text that an anchor stands for is looked up as a whole: where it occurs twice, all
   its windows are repeats;
3. what is left is laid out as segments aligned on their anchor. Segments of one anchor form a small
   collection whose Burrows-Wheeler order and common prefixes are built right to left, inserting one
   symbol of every segment each round; all collections of a hash range advance together. A window is a
   repeat where the common prefix with a neighbour in suffix order reaches ``length``. The rounds are
   a constant, 2*length less the anchor's span, whatever the corpus. The sequential files between rounds
   of the published construction are the exchanges' shuffle files here.

Anchors with more than ``hot`` occurrences would gather in one task; their segments are not
ordered but their windows looked up by hash, spread over all ranges. That is exact as well.

Nulls count as empty and keep the empty string; a repeated row is another document; bytes of
multi-byte characters are bytes like others; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS = "doc_id long, span_start long, span_end long"
HOT = 512


class _Shape:
    def __init__(self, length: int):
        self.length, self.gram, self.back = length, max(1, length // 4), min(64, length // 8)
        self.far = length - self.gram  # an anchor stands at back .. far bytes after the start of its windows
        self.starts = self.far - self.back + 1
        self.width = self.starts - 1 + length


class _Segments:
    """Anchors of a block and the window starts [lo, hi] that each stands for."""

    def __init__(self, table: pa.Table, shape: _Shape):
        texts = B.texts_of(table)
        self.shape, self.data = shape, b"".join(texts)
        self.begin = np.cumsum([0, *(len(t) for t in texts)])
        self.raw = raw = np.frombuffer(self.data, np.uint8)
        self.hash = K.Rolling(K.BYTES[raw])
        sep = np.flatnonzero(K.SEPARATOR[raw])
        edge = np.unique(np.concatenate([sep, self.begin - 1, [len(raw) - 1]]))
        long = np.flatnonzero(np.diff(edge) > shape.back)
        pos = sep + 1
        if len(long):
            pos = np.unique(np.concatenate([pos, K.spread(edge[long] + shape.back + 1, edge[long + 1])[0]]))
        doc = np.searchsorted(self.begin, pos, "right") - 1
        doc = np.minimum(doc, len(texts) - 1)
        ok = (pos - self.begin[doc] >= shape.back) & (pos + shape.gram <= self.begin[doc + 1])
        pos, doc = pos[ok], doc[ok]
        grams = self.hash(pos, pos + shape.gram)
        keep, self.lo, self.hi = K.anchors(pos, doc, grams, shape.back, shape.far, self.begin[doc], self.begin[doc + 1] - shape.length)
        self.pos = pos[keep]
        self.anchors, self.count, self.where = K.compact(grams[keep])

    def whole(self, told: np.ndarray):
        """Live stretches as distinct (hash of the stretch) in order, with the index of each live anchor's; hot ones apart."""
        live = np.flatnonzero(told[self.where] > 0)
        lo, hi = self.lo[live], self.hi[live]
        stretch = K.mix(self.hash(lo, hi + self.shape.length) + (self.pos[live] - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct, first, where, count = np.unique(stretch, return_index=True, return_inverse=True, return_counts=True)
        return live, distinct, count, where, live[first]

    def matrix(self, which: np.ndarray):
        """Bytes of the segments aligned on their anchors, and the columns that each has."""
        left = self.pos[which] - self.shape.far
        a, b = self.lo[which] - left, self.hi[which] + self.shape.length - left
        out = np.zeros((len(which), self.shape.width + 4), np.uint8)
        at, row = K.spread(a, b - 1)
        out[row, at] = self.raw[left[row] + at]
        out[:, -4:] = np.stack([a, b], 1).astype("<u2").view(np.uint8)
        return out


def ordered_repeats(group: np.ndarray, symbols: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, starts: int) -> np.ndarray:
    """Column-wise suffix order of aligned segments; which windows [j, j + length) each shares with another of its group.

    ``group`` is sorted. One round inserts column ``j`` of every segment in front of its suffix: a stable
    sort by symbol of the last order gives the new one, and the common prefix of two neighbours is one
    more than the least common prefix between their places in the last order.
    """
    n = len(group)
    found = np.zeros((n, starts), bool)
    if n < 2:
        return found
    small = np.unique(group, return_inverse=True)[1]
    small = small.astype(np.uint16 if small[-1] < 65536 else np.int64)
    order, prefix = np.arange(n), np.zeros(n + 1, np.int32)
    for j in range(int(last.max()) - 1, int(first.min()) - 1, -1):
        there = (j >= first[order]) & (j < last[order])
        symbol = np.where(there, symbols[order, j].astype(np.uint16) + np.uint16(1), np.uint16(0))
        turn = np.argsort(symbol, kind="stable")
        turn = turn[np.argsort(small[order[turn]], kind="stable")]
        a, b = turn[:-1], turn[1:]
        same = np.flatnonzero((symbol[a] == symbol[b]) & (small[order[a]] == small[order[b]]) & there[a] & there[b])
        new = np.zeros(n + 1, np.int32)
        if len(same):
            cut = np.empty(2 * len(same), np.int64)
            cut[0::2], cut[1::2] = a[same] + 1, b[same] + 1
            new[same + 1] = 1 + np.minimum.reduceat(prefix, cut)[0::2]
        order, prefix = order[turn], new
        if j < starts:
            hit = prefix >= length
            found[order[hit[:-1] | hit[1:]], j] = True
    return found


def _repeats(docs: DataFrame, length: int, hot: int, finish, schema: str) -> DataFrame:
    plan, shape = B.layout(docs), _Shape(length)
    bits = plan.bits
    docs = B.blocked(docs, plan)

    def anchors(table):
        s = _Segments(table, shape)
        return B.send(B.number(table), bits, s.anchors, np.minimum(s.count, 65535).astype("<u2").view(np.uint8).reshape(-1, 2))

    def count(table):
        """0: once; 1: more often; 2: more than ``hot`` times."""
        hashes, extra, bounds = B.gathered(table)
        _, where = np.unique(hashes, return_inverse=True)
        n = np.bincount(where, weights=extra.view("<u2"))[where]
        return B.reply(table, (n > 1).astype(np.uint8) + (n > hot), bounds, pack=False)

    def stretches(table, answer):
        s = _Segments(table, shape)
        _, distinct, many, _, _ = s.whole(B.answers(answer, bits, s.anchors, np.uint8))
        return B.send(B.number(table), bits, distinct, (many > 1).astype(np.uint8))

    def whole(table):
        """1: the stretch occurs again; 2: it is to be compared with others of its anchor (one of each kind is)."""
        table = table.sort_by("block")
        hashes, many, bounds = B.gathered(table)
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        group = np.cumsum(new) - 1
        code = np.empty(len(order), np.uint8)
        code[order] = (np.bincount(group, weights=1 + many[order])[group] > 1) + 2 * new
        return B.reply(table, code, bounds, pack=False)

    def left(table, answer, stages):
        """The segments to compare: of anchors in order, those of common anchors apart."""
        s = _Segments(table, shape)
        told = B.answers(stages[1], bits, s.anchors, np.uint8)
        live, distinct, _, where, one = s.whole(told)
        code = B.answers(stages[2], bits, distinct, np.uint8)
        send = one[code >= 2]
        key = s.anchors[s.where[send]]
        order = np.argsort(key, kind="stable")
        send, key, common = send[order], key[order], (told[s.where[send]] == 2)[order]
        start, row = K.spread(s.lo[send[common]], s.hi[send[common]])
        window, many, at = K.compact(s.hash(start, start + length))
        return s, live, code[where], send[~common], key[~common], start, window, many, at

    def split(answer):
        stage = answer["stage"].to_numpy()
        return {k: answer.filter(pa.array(stage == k)) for k in (1, 2, 3, 4)}

    def compare(table, answer):
        s, _, _, send, key, _, window, many, _ = left(table, answer, split(answer))
        rows = B.send(B.number(table), bits, key, s.matrix(send))
        other = B.send(B.number(table), bits, window, (many > 1).astype(np.uint8))
        return pa.concat_tables([rows, other.set_column(0, "p", pa.array(other["p"].to_numpy() + (1 << bits), pa.int32()))])

    def order(table):
        if table["p"][0].as_py() >= 1 << bits:
            return B.twice(table)
        table = table.sort_by("block")
        key, extra, bounds = B.gathered(table)
        extra = extra.reshape(len(key), -1)
        turn = np.argsort(key, kind="stable")
        edge = extra[turn, -4:].copy().view("<u2").astype(np.int64)
        found = np.empty((len(key), shape.starts), bool)
        found[turn] = ordered_repeats(key[turn], extra[turn], edge[:, 0], edge[:, 1], length, shape.starts)
        return B.reply(table, np.packbits(found, axis=1), bounds, pack=False)

    def mark(table, answer):
        stages = split(answer)
        s, live, code, send, key, start, window, _, at = left(table, answer, stages)
        gone = np.zeros(len(s.raw) + 1, np.int32)

        def cover(a, b):
            np.add.at(gone, a, 1)
            np.add.at(gone, b, -1)

        again = live[(code & 1) == 1]
        cover(s.lo[again], s.hi[again] + length)
        packed = B.answers(stages[3], bits, key, np.dtype((np.void, -(-shape.starts // 8)))) if len(key) else np.zeros(0)
        if len(key):
            row, col = np.nonzero(np.unpackbits(packed.view(np.uint8).reshape(len(key), -1), axis=1, count=shape.starts))
            first = s.pos[send[row]] - shape.far + col
            cover(first, first + length)
        if len(window):
            first = start[B.answers(stages[4].set_column(1, "p", pa.array(stages[4]["p"].to_numpy() - (1 << bits), pa.int32())), bits, window)[at]]
            cover(first, first + length)
        return finish(table, s, np.cumsum(gone[:-1]) > 0)

    tell = lambda df, k: df.withColumn("stage", F.lit(k))
    one = tell(docs.groupBy("block").applyInArrow(anchors, B.SENT).groupBy("p").applyInArrow(count, B.ANSWER), 1)
    two = tell(B.meet(docs, one, stretches, B.SENT).groupBy("p").applyInArrow(whole, B.ANSWER), 2)
    three = B.meet(docs, one.unionByName(two), compare, B.SENT).groupBy("p").applyInArrow(order, B.ANSWER)
    three = three.withColumn("stage", F.when(F.col("p") < 1 << bits, 3).otherwise(4))
    return B.meet(docs, one.unionByName(two).unionByName(three), mark, schema)


def _runs(s: _Segments, gone: np.ndarray):
    """Starts and ends of the removed runs; none crosses the border of a document."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[s.begin] = True
    before = np.concatenate([[False], gone[:-1]]) & ~edge[:-1]
    after = np.concatenate([gone[1:], [False]]) & ~edge[1:]
    return np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1


def _digest(table, s, gone):
    start, stop = _runs(s, gone)
    n = table.num_rows
    doc = np.searchsorted(s.begin, start, "right") - 1
    removed, spans, kept = np.zeros(n, np.int64), np.bincount(doc, minlength=n), []
    np.add.at(removed, doc, stop - start)
    data, begin = memoryview(s.data), s.begin.tolist()
    cut = np.searchsorted(start, s.begin).tolist()
    start, stop = start.tolist(), stop.tolist()
    for k in range(n):
        digest, at = hashlib.sha256(), begin[k]
        for i in range(cut[k], cut[k + 1]):
            digest.update(data[at : start[i]])
            at = stop[i]
        digest.update(data[at : begin[k + 1]])
        kept.append(digest.hexdigest())
    return pa.table({"doc_id": table["doc_id"].combine_chunks(), "n_bytes": np.diff(s.begin).astype(np.int64), "n_removed": removed, "n_spans": spans.astype(np.int64), "kept_sha256": pa.array(kept, pa.string())})


def _spans(table, s, gone):
    start, stop = _runs(s, gone)
    doc = np.searchsorted(s.begin, start, "right") - 1
    return pa.table({"doc_id": table["doc_id"].combine_chunks().take(pa.array(doc)), "span_start": start - s.begin[doc], "span_end": stop - s.begin[doc]})


def suffix_digest(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """A row per document: bytes, removed bytes, removed runs and a digest of the bytes that stay."""
    return _repeats(docs, length, hot, _digest, RESULT)


def suffix_repeats(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """The maximal removed runs as half-open byte ranges of each document."""
    return _repeats(docs, length, hot, _spans, SPANS)
