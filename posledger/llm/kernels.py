"""Vectorised text kernels: hashes of words, word runs and byte runs over a whole block of documents.

A block is a few megabytes of text held by one task. Hashes of runs are two polynomials over random
31-bit values modulo the prime 2**31 - 1, at two random points, finished by a bit mixer: equal strings
always get equal hashes, and two different runs of n letters equal ones with a probability of at most
(n / 2**31)**2, about 2**-62 for strings of no special form.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SEED = 20240229


def _byte_values() -> np.ndarray:
    """256 odd random 64-bit values, the same in every process."""
    return mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95) + U(_SEED)) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTES = _byte_values()
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
PRIME = U((1 << 31) - 1)
#: Two points at which the polynomials are taken, per kind of run (letters, words, words of windows).
POINTS = ((1_215_752_192, 987_654_321), (1_431_655_765, 1_735_928_559), (1_640_531_527, 2_027_808_487))
_powers: dict[int, np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime in place, not quite reduced: any 64-bit x becomes one under 2**34, one under 2**34 one under 2**31 + 8."""
    high = x >> U(31)
    x &= PRIME
    x += high
    return x


def _canonical(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.minimum(x, x - PRIME)  # below the prime the difference wraps to a larger number


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime; kept per process and grown on demand, doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U) if have is None else have.astype(U)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, _canonical(have * U(pow(base, len(have), int(PRIME))))])
        have = _powers[base] = have.astype(np.uint32)
    return have[:n]


class Rolling:
    """Hashes of any run [i, j) of a sequence of 64-bit values; computed in pieces that fit a core's cache."""

    PIECE = 1 << 14

    def __init__(self, values: np.ndarray, salt: int = 0):
        n = len(values)
        self.sums = [np.zeros(n + 1, np.uint32) for _ in POINTS[salt]]
        self.back = [powers(pow(point, -1, int(PRIME)), n + 1) for point in POINTS[salt]]
        forth, carry = [powers(point, n) for point in POINTS[salt]], [U(0), U(0)]
        for a in range(0, n, self.PIECE):
            piece = values[a : a + self.PIECE]
            for k, half in enumerate((piece & PRIME, piece >> U(33))):
                half *= forth[k][a : a + len(piece)]
                half = np.cumsum(_folded(half), out=half)
                half += carry[k]
                half = self.sums[k][a + 1 : a + 1 + len(piece)] = _folded(_folded(half))
                carry[k] = half[-1]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), U)
        for a in range(0, len(i), self.PIECE):
            here, there, made = i[a : a + self.PIECE], j[a : a + self.PIECE], out[a : a + self.PIECE]
            made[:] = 0
            for sums, back in zip(self.sums, self.back):
                x = sums[there].astype(U)
                x += U(3) * PRIME
                x -= sums[here]
                x = _folded(x)
                x *= back[here]
                made <<= U(31)
                made |= _canonical(x)
            made[:] = mix(made)
        return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a list of byte strings.

    ``start`` and ``end`` are offsets into ``data``, ``doc`` the index of the document, ``first`` the
    index of each document's first word (with one entry past the end), ``hash`` a hash per word.
    """

    def __init__(self, texts: list, lower: bool = False, separator: np.ndarray = SEPARATOR):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(texts) + 1]
        sep = separator[raw]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if len(raw) and not sep[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = Rolling((LOWER if lower else BYTES)[raw])(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that start a run of ``size`` words of one document, and its hashes."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, Rolling(self.hash, 1)(at, at + size)


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document as (document index, hash), sorted by both.

    A document of fewer words has its whole sequence as its one shingle; without words it has none.
    """
    at, hashes = words.runs(size)
    docs = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = Rolling(words.hash, 1)(words.first[short], words.first[short + 1])
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, mix(whole + U(0x51ED270B) * count[short].astype(U))])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def anchors(pos: np.ndarray, doc: np.ndarray, hashes: np.ndarray, lo: int, hi: int, first: np.ndarray, last: np.ndarray):
    """Winnowing: the anchor of each window is the leftmost least hash among its candidates.

    Candidates are given in order of ``doc`` and ``pos``. A window starting at ``s`` looks at the
    candidates with ``s + lo <= pos <= s + hi``; windows start from ``first`` to ``last`` (per
    candidate: the bounds of its document). Returns the candidates that are an anchor and, for
    each, the first and last window start that it stands for. Equal windows have equal anchors.
    """
    n = len(pos)
    left = np.maximum(pos - hi, first)
    right = np.minimum(pos - lo, last)
    live = np.flatnonzero(left <= right)
    t = 1
    while len(live):  # nearest candidate to the left that is as small: windows that hold it are its own
        live = live[live >= t]
        back = live - t
        near = (doc[back] == doc[live]) & (pos[back] - lo >= left[live])
        live, back = live[near], back[near]
        hit = hashes[back] <= hashes[live]
        left[live[hit]] = pos[back[hit]] - lo + 1
        live = live[~hit]
        t += 1
    live = np.flatnonzero(left <= right)
    t = 1
    while len(live):
        live = live[live < n - t]
        fore = live + t
        near = (doc[fore] == doc[live]) & (pos[fore] - hi <= right[live])
        live, fore = live[near], fore[near]
        hit = hashes[fore] < hashes[live]
        right[live[hit]] = pos[fore[hit]] - hi - 1
        live = live[~hit]
        t += 1
    keep = np.flatnonzero(left <= right)
    return keep, left[keep], right[keep]


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi], with the index of the range of each."""
    size = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), size)
    return lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size), which


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n positions lie in [s, s + length) for any of the given starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


def compact(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, how often each occurs, and where each row is among them."""
    distinct, where, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return distinct, count, where
