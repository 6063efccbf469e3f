"""Operator 10, benchmark decontamination by the q-gram lemma and banded alignment.

A document holds a leak of a benchmark item if some ``window`` bytes of the item align with it in at most
``edits`` edits (items shorter than a window: the whole item, with edits in proportion). Two such strings share
at least ``window + 1 - q * (edits + 1)`` q-grams whose diagonals (place in the document less place in
the item) lie within ``edits`` of each other. So each q-gram of the document that the benchmark
has is counted in diagonal bands, which overlap by ``edits``; where a window of the item gathers
enough in one band, all windows there are aligned within the band. Items for which ``q`` leaves no q-gram
in common (32 to 35 bytes by default) are searched by shorter ones.

Items under ``least`` bytes are too short to bear edits: they are found where they stand whole and exact, with no
letter or digit on either side; their q-grams are as long as they are, ``q`` at most.

Texts are compared as UTF-8 bytes, A-Z as a-z and every blank as a space. The benchmark is
searched in blocks of at most about ``block_bytes``, each in one pass over all documents, so that
what a task is sent never grows with the benchmark.

Null and empty texts hold nothing; null items and items without a letter or digit are never found; repeated rows
give repeated results; other columns are ignored by ``leaks``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

RESULT = "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, edits long"
BAND = 16
SLICE = 1 << 20
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32
#: Letters and digits of folded text, all bytes of characters beyond ASCII among them.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


@dataclass(frozen=True)
class Budget:
    window: int = 80
    edits: int = 5
    q: int = 12
    least: int = 24

    def of(self, length: int) -> tuple[int, int]:
        """Window length and edits for an item."""
        n = min(self.window, length)
        return n, self.edits * n // self.window if length >= self.least else 0

    def gram(self, length: int) -> int:
        """The longest q, up to ``q``, of which a window within the edits shares at least one."""
        n, e = self.of(length)
        return max(1, min(self.q, n // (e + 1)))

    def shared(self, length: int) -> int:
        n, e = self.of(length)
        return max(1, n + 1 - self.q * (e + 1))


def folded(text: bytes) -> np.ndarray:
    return FOLD[np.frombuffer(text, np.uint8)]


def grams(values: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams: q multiply-adds over the bytes' values."""
    n = len(values) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    v = K.BYTES[values]
    done, span, power = 0, 1, v  # power: hashes of all runs of span values
    for bit in range(q.bit_length()):
        if q >> bit & 1:
            out = out * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) + power[done : done + n] if done else power[:n].copy()
            done += span
        if q >> (bit + 1):
            power = power[:-span] * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) + power[span:]
            span *= 2
    return out


class Index:
    """The q-grams of some benchmark items, and where each occurs."""

    def __init__(self, items: list, budget: Budget):
        self.budget, self.ids, self.short = budget, [i for i, _ in items], all(len(t.encode()) < budget.least for _, t in items)
        self.texts = [folded(t.encode()) for _, t in items]
        self.length = length = np.array([len(t) for t in self.texts], np.int64)
        self.flat, self.begin = np.concatenate(self.texts), np.concatenate([[0], np.cumsum(length)[:-1]])
        hashes = [grams(t, budget.q) for t in self.texts]
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.bits = int(np.clip(np.ceil(np.log2(len(self.hash) + 1)) + 3, 10, 22))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.hash)] = True
        self.window = np.array([budget.of(n)[0] for n in length])
        self.need = np.array([budget.shared(n) for n in length])

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, text: np.ndarray, most: int = 4_000_000):
        """Places in the text and entries of the index with equal q-grams, in runs of at most about ``most``; runs overlap."""
        h = grams(text, self.budget.q)
        at = np.flatnonzero(self.seen[self._slot(h)])
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[k] == h[at]
        at, k = at[ok], k[ok]
        size = self.first[k + 1] - self.first[k]
        total, a = np.cumsum(size), 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            entry, row = K.spread(self.first[k[a:b]], self.first[k[a:b] + 1] - 1)
            yield at[a:b][row], entry
            if b >= len(at):
                return
            a = max(a + 1, int(np.searchsorted(at, at[b] - 2 * self.budget.window)))

    def candidates(self, text: np.ndarray):
        """(item, band, first and last window start) of the regions that share enough q-grams."""
        found = []
        for at, entry in self.hits(text):
            item, place = self.item[entry], self.place[entry]
            diagonal = at - place
            band = diagonal // BAND
            low = diagonal - band * BAND < self.budget.edits
            item, place, band = (np.concatenate([x, y[low]]) for x, y in ((item, item), (place, place), (band, band - 1)))
            order = np.lexsort((place, band, item))
            item, place, band = item[order], place[order], band[order]
            ahead = np.arange(len(item)) + self.need[item] - 1
            ok = np.flatnonzero(ahead < len(item))
            last = ahead[ok]
            ok = ok[(item[last] == item[ok]) & (band[last] == band[ok]) & (place[last] - place[ok] <= self.window[item[ok]] - self.budget.q)]
            last = ahead[ok]
            item, band, hi = item[ok], band[ok], np.minimum(place[ok], self.length[item[ok]] - self.window[item[ok]])
            lo = np.maximum(0, place[last] + self.budget.q - self.window[item])
            # ranges of one band come in order: each adds what the one before it doesn't have
            more = np.flatnonzero((item[1:] == item[:-1]) & (band[1:] == band[:-1])) + 1
            lo[more] = np.maximum(lo[more], hi[more - 1] + 1)
            keep = lo <= hi
            found.append(np.stack([item[keep], band[keep], lo[keep], hi[keep]], 1))
        return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def align(item: np.ndarray, start: np.ndarray, text: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, width: int, edits: int):
    """Least edits of windows ``item[start : start + size]`` against the text, and where each ends (column of the band).

    Column c of a window's band holds the alignments whose byte i meets ``text[place + i + c]``; text
    outside [first, last) matches nothing. Windows are given up once all of their band exceeds ``edits``.
    """
    columns = np.arange(width)
    alive, cost = np.arange(len(start)), np.zeros((len(start), width), np.int32)
    least, end = np.full(len(start), size + 1), np.zeros(len(start), np.int64)
    for i in range(size):
        at = place[alive, None] + i + columns
        differs = (at < first[alive, None]) | (at >= last[alive, None])
        differs |= text[np.clip(at, 0, len(text) - 1)] != item[start[alive] + i][:, None]
        step = cost + differs
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - columns, axis=1) + columns
        if i % 8 == 7:
            keep = cost.min(1) <= edits
            alive, cost = alive[keep], cost[keep]
            if not len(alive):
                return least, end
    best = cost.argmin(1)
    least[alive], end[alive] = cost[np.arange(len(alive)), best], best
    return least, end


def exact(index: Index, text: np.ndarray, before: bool, after: bool) -> dict:
    """Of an index of short items, those that stand in the text with no letter or digit beside them.

    ``before`` and ``after`` tell whether the text is cut there, which hides what stands beside.
    """
    out: dict = {}
    for at, entry in index.hits(text):
        start, item = at[index.place[entry] == 0], index.item[entry[index.place[entry] == 0]]
        n = index.length[item]
        ok = start + n <= len(text)
        for k in range(int(n.max(initial=0))):
            ok &= (k >= n) | (text[np.minimum(start + k, len(text) - 1)] == index.flat[np.minimum(index.begin[item] + k, len(index.flat) - 1)])
        start, item, n = start[ok], item[ok], n[ok]
        left = np.where(start > 0, ALNUM[text[np.maximum(start - 1, 0)]], before)
        right = np.where(start + n < len(text), ALNUM[text[np.minimum(start + n, len(text) - 1)]], after)
        for k, s, m in zip(item[~left & ~right].tolist(), start[~left & ~right].tolist(), n[~left & ~right].tolist()):
            had = out.get(k, (s, s + m))
            out[k] = (min(had[0], s), max(had[1], s + m), 0, m, 0)
    return out


def search(index: Index, texts: list, cut: list | None = None) -> list:
    """Of each text: per item (first and last byte in the text, in the item, least edits) over all aligned windows.

    ``cut`` tells of each text whether more of a document stands before and after it.
    """
    out, budget, rows = [{} for _ in texts], index.budget, []
    if index.short:
        return [exact(index, folded(t), *c) for t, c in zip(texts, cut or [(False, False)] * len(texts))]
    values = [folded(t) for t in texts]
    for d, value in enumerate(values):
        found = index.candidates(value)
        if len(found):
            rows.append(np.concatenate([np.full((len(found), 1), d), found], 1))
    if not rows:
        return out
    text, begin = np.concatenate(values), np.cumsum([0, *(len(v) for v in values)])
    rows = np.concatenate(rows)
    start, row = K.spread(rows[:, 3], rows[:, 4])
    doc, item, band = rows[row, 0], rows[row, 1], rows[row, 2]
    for size in np.unique(index.window[item]).tolist():
        own = np.flatnonzero(index.window[item] == size)
        d, k, s, edits = doc[own], item[own], start[own], budget.edits * size // budget.window
        low, width = band[own] * BAND - budget.edits, BAND + 3 * budget.edits + 1
        place = begin[d] + s + low
        cost, end = align(index.flat, index.begin[k] + s, text, place, begin[d], begin[d + 1], size, width, edits)
        good = np.flatnonzero(cost <= edits)
        # the same windows read backwards end where they start
        total, letters = len(text), len(index.flat)
        back = total - place[good] - size - width + 1
        _, stop = align(index.flat[::-1], letters - index.begin[k[good]] - s[good] - size, text[::-1], back, total - begin[d[good] + 1], total - begin[d[good]], size, width, edits)
        ends = np.minimum(place[good] + size + end[good], begin[d[good] + 1]) - begin[d[good]]
        begins = np.maximum(total - (back + size + stop), begin[d[good]]) - begin[d[good]]
        for x, a, b in zip(good.tolist(), begins.tolist(), ends.tolist()):
            one = (a, b, int(s[x]), int(s[x]) + size, int(cost[x]))
            had = out[d[x]].get(int(k[x]), one)
            out[d[x]][int(k[x])] = (min(had[0], a), max(had[1], b), min(had[2], one[2]), max(had[3], one[3]), min(had[4], one[4]))
    return out


def found_in(index: Index, texts: list) -> list:
    """``search`` over texts of any length, in overlapping slices, many short texts at a time."""
    overlap, out, part, size = 4 * index.budget.window, [{} for _ in texts], [], 0

    def flush():
        cut = [(a > 0, a + len(piece) < len(texts[d])) for d, a, piece in part]
        for (d, a), found in zip([p[:2] for p in part], search(index, [p[2] for p in part], cut)):
            for k, (s, e, i, j, c) in found.items():
                h = out[d].get(k, (s + a, e + a, i, j, c))
                out[d][k] = (min(h[0], s + a), max(h[1], e + a), min(h[2], i), max(h[3], j), min(h[4], c))
        part.clear()

    for d, text in enumerate(texts):
        for a in range(0, max(1, len(text) - overlap), SLICE):
            part.append((d, a, text[a : a + SLICE + overlap]))
            size += len(part[-1][2])
            if size >= SLICE:
                flush()
                size = 0
    flush()
    return out


def _found(indexes: list, batch: pa.RecordBatch) -> list:
    """Of each text of the batch: (item, what was found of it)."""
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
    out = [[] for _ in texts]
    for index in indexes:
        for rows, found in zip(out, found_in(index, texts)):
            rows += [(index.ids[k], v) for k, v in sorted(found.items())]
    return out


def _scan(indexes: list):
    names = ["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "edits"]

    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(doc_id, item, *v) for doc_id, found in zip(ids, _found(indexes, batch)) for item, v in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(7)], names=names)

    return scan


def _without(indexes: list):
    def scan(batches):
        for batch in batches:
            yield batch.filter(pa.array([not found for found in _found(indexes, batch)], pa.bool_()))

    return scan


def _indexes(benchmark: DataFrame, budget: Budget, block_bytes: int):
    """The benchmark in blocks of about ``block_bytes``: of each an index per length of q-gram."""
    items = benchmark.where((F.octet_length("text") >= budget.least) | F.col("text").rlike(r"[\p{L}\p{N}]")).select("item_id", "text")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for part in range(blocks):
        own = sorted(((r.item_id, r.text) for r in items.where(F.col("part") == part).collect()), key=str)
        by_gram: dict = {}
        for item in own:
            n = len(item[1].encode())
            by_gram.setdefault((n >= budget.least, budget.gram(n)), []).append(item)
        yield [Index(some, replace(budget, q=q)) for (_, q), some in sorted(by_gram.items(), reverse=True)]


def leaks(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), block_bytes: int = 1 << 20) -> DataFrame:
    """A row per document and item that it holds: spans in bytes over all aligned windows, and the least edits of a window."""
    docs, out = docs.select("doc_id", "text"), docs.sparkSession.createDataFrame([], RESULT)
    for indexes in _indexes(benchmark, budget, block_bytes):
        out = out.unionByName(docs.mapInArrow(_scan(indexes), RESULT))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), block_bytes: int = 1 << 20) -> DataFrame:
    """The documents that hold no leak, with all their columns."""
    for indexes in _indexes(benchmark, budget, block_bytes):
        docs = docs.mapInArrow(_without(indexes), docs.schema)
    return docs
