"""Operator 6, license scans.

Every template is known by winnowed fingerprints: the least hash of each window of ``WINDOW`` runs of ``GRAM`` words, and
for a template too short for one window each run of two words. An inverted index takes a fingerprint to the templates and places
that have it. The fingerprints of a text, winnowed alike, pick candidates: the template and the diagonals (place in the text less
place in the template) of what is shared. Around these diagonals, ``band`` words to each side, template and text are aligned (local alignment: a
match counts 1, a gap or a differing word -1). The best stretches with ``need`` words matched (``coverage`` of the template's n
words) are taken, none overlapping another.

A notice that is so short or so edited that it keeps no fingerprint is found in another, exact way: a stretch
that aligns with a positive score and ``need`` words matched is at most 2n - 1 words long, so some window of 2n - 1 words holds
``need`` words of the template, none counted more often than the template has it. What such windows hold beside the stretches
found already is aligned over its whole length (up to ``band`` words put in at a place) until no stretch reaches the coverage.

Words are runs of letters, digits and other characters between blanks and ASCII punctuation, with A-Z
as a-z, so layout and punctuation do not matter. Templates are a parameter: pairs of a name and a text, or a table of
``name`` and ``text``, whose size is checked first (``TEMPLATE_BYTES``; more is an error); they go to the tasks with the code.

Null and empty texts hold nothing; repeated rows give repeated results; long texts are read into words slice by
slice, cut at a blank, and searched as a whole, so that no border is seen; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

# Names and short notices of common public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Reserved", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

RESULT = "doc_id long, license string, n_matched long, coverage double, span_start long, span_end long"
SLICE = 1 << 20
#: Words of a fingerprint, fingerprints of a window, and the most bytes of all templates.
GRAM, WINDOW, TEMPLATE_BYTES = 3, 4, 64 << 20
PUNCTUATED = K.SEPARATOR.copy()
PUNCTUATED[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; their order counts."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash, the last of equal ones, of each window of hashes; all are one window if they are fewer."""
    if not len(hashes) or window == 1:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, min(window, len(hashes)))
    size = views.shape[1]
    return np.unique(np.arange(len(views)) + size - 1 - np.argmin(views[:, ::-1], axis=1))


class Scanner:
    def __init__(self, templates=TEMPLATES, coverage: float = 0.8, band: int = 8):
        self.names, self.band = [n for n, _ in templates], band
        w = K.Words([t.encode() for _, t in templates], True, PUNCTUATED)
        self.words = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        self.need = [max(1, math.ceil(coverage * len(x))) for x in self.words]
        self.longest = max((len(x) for x in self.words), default=0)
        self.hash = np.unique(w.hash)
        kinds = [(GRAM, WINDOW) if len(x) >= GRAM + WINDOW - 1 else (min(2, len(x)), 1) for x in self.words]
        #: Per kind of fingerprint the inverted index: hashes in order, and the template and place of each.
        self.index = {}
        for kind in sorted({k for k in kinds if k[0]}):
            found = [(g[at], np.full(len(at), t), at) for t, (x, k) in enumerate(zip(self.words, kinds)) if k == kind for g in [grams(x, kind[0])] for at in [winnowed(g, kind[1])]]
            h, t, at = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            self.index[kind] = h[order], t[order], at[order]
        # how often a template has each of the words
        self.room = [np.bincount(np.searchsorted(self.hash, x), minlength=len(self.hash)) for x in self.words]

    def hits(self, words: K.Words):
        """Arrays of document, template, and place in words and in the template of each fingerprint that they share."""
        out = []
        for (size, window), (index, template, place) in self.index.items():
            g = grams(words.hash, size)
            inside = words.doc[: len(g)] == words.doc[size - 1 :] if len(g) else np.zeros(0, bool)
            g[~inside] = np.iinfo(np.uint64).max  # a run over two documents is the least of no window that has another
            at = winnowed(g, window)
            at = at[inside[at]]
            low, high = np.searchsorted(index, g[at]), np.searchsorted(index, g[at], "right")
            has, n = low < high, high - low
            at, low, n = at[has], low[has], n[has]
            k = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            pos = np.repeat(at, n)
            out.append((words.doc[pos], template[k], pos, place[k]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4

    def marked(self, words: K.Words):
        """Rows (template, first word of the region, word past its end, diagonals) of one text where fingerprints are shared."""
        _, template, pos, place = self.hits(words)
        order = np.lexsort((pos, template))
        template, pos, place = template[order], pos[order], place[order]
        size = 2 * np.array([len(x) for x in self.words], np.int64)[template] + 2 * self.band
        edge = np.flatnonzero((template[1:] != template[:-1]) | (pos[1:] - pos[:-1] > size[1:])) + 1 if len(pos) else []
        for part in np.split(np.arange(len(pos)), edge) if len(pos) else []:
            t, diagonal = int(template[part[0]]), pos[part] - place[part]
            a = max(0, int(diagonal.min()) - self.band)
            b = min(len(words), int(diagonal.max()) + len(self.words[t]) + self.band)
            near = np.unique(np.add.outer(np.unique(diagonal) - a, np.arange(-self.band, self.band + 1)))
            yield t, a, b, near

    def banded(self, template: np.ndarray, text: np.ndarray, need: int, diagonals: np.ndarray):
        """As ``align``, over the cells of some diagonals only: what is held is a row of them."""
        n, size = len(text), len(diagonals)
        beside = np.flatnonzero(diagonals[1:] == diagonals[:-1] + 1)  # diagonals whose next one is there too
        score, match, start = np.zeros(size, np.int64), np.zeros(size, np.int64), np.clip(diagonals, 0, n)
        best = np.zeros((3, n + 1), np.int64)
        for i, word in enumerate(template):
            end = i + 1 + diagonals
            inside = (end >= 1) & (end <= n)
            same = inside & (text[np.clip(end - 1, 0, n - 1)] == word)
            s, m, o = score + np.where(same, 1, -1), match + same, start.copy()
            up = score[beside + 1] - 1 > s[beside]  # a word of the template that the text lacks
            k = beside[up]
            s[k], m[k], o[k] = score[k + 1] - 1, match[k + 1], start[k + 1]
            for _ in range(self.band):  # words of the text that the template lacks
                k = beside[s[beside] - 1 > s[beside + 1]]
                if not len(k):
                    break
                s[k + 1], m[k + 1], o[k + 1] = s[k] - 1, m[k], o[k]
            none = ~inside | (s < 0) | (s == 0) & (m == 0)
            s[none], m[none], o[none] = 0, 0, np.clip(end[none], 0, n)
            k = np.flatnonzero(inside & (m >= need))
            k = k[s[k] > best[0, end[k]]]
            best[:, end[k]] = s[k], m[k], o[k]
            score, match, start = s, m, o
        return best

    def candidates(self, words: K.Words):
        """Rows (document, template, first word of the region, word past its end) where windows hold enough words."""
        if not len(self.hash) or not len(words):
            return []
        k = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        at = np.flatnonzero(self.hash[k] == words.hash)
        order = at[np.argsort(k[at].astype(np.int32), kind="stable")]
        word, begin = k[order], words.first[words.doc[order]]
        out = []
        for t, (need, room) in enumerate(zip(self.need, self.room)):
            own = np.flatnonzero(room[word])
            if len(own) < need:
                continue
            # a word counts for the window starts back to its last occurrence but ``room``
            pos, w, size = order[own], word[own], 2 * len(self.words[t]) - 1
            back = np.arange(len(own)) - room[w]
            before = np.where((back >= 0) & (w[np.maximum(back, 0)] == w), pos[np.maximum(back, 0)], -1)
            low = np.maximum(np.maximum(pos - size, before) + 1, begin[own])
            held = np.cumsum(np.bincount(low, minlength=len(words) + 1) - np.bincount(pos + 1, minlength=len(words) + 1))
            start = np.flatnonzero(held >= need)
            if not len(start):
                continue
            doc = words.doc[start]
            edge = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > size)) + 1, [len(start)]])
            out += [(int(doc[a]), t, int(start[a]), int(min(start[b - 1] + size, words.first[doc[a] + 1]))) for a, b in zip(edge, edge[1:])]
        return out

    def align(self, template: np.ndarray, text: np.ndarray, need: int):
        """Local alignment: per end in the text the best score with ``need`` words matched (0: none), the words matched and the start."""
        n = len(text)
        score, match, start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.arange(n + 1)
        best = np.zeros((3, n + 1), np.int64)
        for word in template:
            same = text == word
            new = score[:-1] + np.where(same, 1, -1)
            s, m, o = np.concatenate([[0], new]), np.concatenate([[0], match[:-1] + same]), np.concatenate([[0], start[:-1]])
            up = score - 1
            s, m, o = np.where(up > s, up, s), np.where(up > s, match, m), np.where(up > s, start, o)
            for _ in range(self.band):  # words of the text that the template lacks
                left = s[:-1] - 1 > s[1:]
                if not left.any():
                    break
                s[1:], m[1:], o[1:] = np.where(left, s[:-1] - 1, s[1:]), np.where(left, m[:-1], m[1:]), np.where(left, o[:-1], o[1:])
            none = (s < 0) | (s == 0) & (m == 0)
            s[none], m[none], o[none] = 0, 0, np.arange(n + 1)[none]
            better = (m >= need) & (s > best[0])
            best[:, better] = s[better], m[better], o[better]
            score, match, start = s, m, o
        return best

    @staticmethod
    def taken(best: np.ndarray, size: int):
        """The best stretches (words matched, first word, word past the end), none overlapping another."""
        score, match, start = best
        ends, used = np.flatnonzero(score), np.zeros(size, bool)
        for e in ends[np.argsort(-score[ends], kind="stable")]:
            if not used[start[e] : e].any():
                used[start[e] : e] = True
                yield int(match[e]), int(start[e]), int(e)

    def stretches(self, t: int, text: np.ndarray, rest: list):
        """Stretches that reach the coverage within the pieces ``rest`` of a text, none overlapping another."""
        while rest:
            a, b = rest.pop()
            if b - a < self.need[t]:
                continue
            found = [(m, a + i, a + j) for m, i, j in self.taken(self.align(self.words[t], text[a:b], self.need[t]), b - a)]
            yield from found
            if found:
                rest += _between(a, b, sorted(x[1:] for x in found))

    def scan(self, text: bytes, fingerprints: bool = True) -> list:
        """(template, words matched, first and last byte) of every place of a template that is covered enough, by place."""
        words = _Text(text)
        found = {t: [] for t in range(len(self.words))}
        for t, a, b, near in self.marked(words) if fingerprints else ():
            last = max((x[2] for x in found[t][-1:]), default=0)  # of the region before, whose end may lie in this one
            own = [(m, a + i, a + j) for m, i, j in self.taken(self.banded(self.words[t], words.hash[a:b], self.need[t], near), b - a)]
            found[t] += sorted((x for x in own if x[1] >= last), key=lambda x: x[1])
        begins = {t: np.array([x[1] for x in f], np.int64) for t, f in found.items()}
        more = []
        for _, t, a, b in self.candidates(words):
            own = found[t][max(0, int(np.searchsorted(begins[t], a, "right")) - 1) : int(np.searchsorted(begins[t], b))]
            more += [(t, *x) for x in self.stretches(t, words.hash, _between(a, b, [x[1:] for x in own if x[2] > a]))]
        places = [(t, *x) for t, f in found.items() for x in f] + more
        return sorted((t, m, int(words.start[i]), int(words.end[j - 1])) for t, m, i, j in places)


def _between(a: int, b: int, found: list) -> list:
    """The pieces of a stretch of words that lie between others, which are in order."""
    ends = [a, *[x for pair in found for x in pair], b]
    return [(x, y) for x, y in zip(ends[0::2], ends[1::2]) if x < y]


class _Text:
    """The words of one text as ``K.Words`` has them, made of slices that end where a word does."""

    def __init__(self, text: bytes):
        raw, parts, a = np.frombuffer(text, np.uint8), [], 0
        while a < len(text):
            b, size = a + SLICE, 4096
            while b < len(text):  # the next blank or punctuation; a word of any length stays whole
                stop = np.flatnonzero(PUNCTUATED[raw[b : b + size]])
                if len(stop):
                    b += int(stop[0])
                    break
                b, size = b + size, 2 * size
            w = K.Words([text[a:b]], True, PUNCTUATED)
            parts.append((w.hash, w.start + a, w.end + a))
            a = b
        self.hash, self.start, self.end = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.doc, self.first = np.zeros(len(self.hash), np.int64), np.array([0, len(self.hash)])

    def __len__(self) -> int:
        return len(self.hash)


def _scan(scanner: Scanner):
    def scan(batches):
        for batch in batches:
            rows, raw = [], [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            ids = batch.column("doc_id").to_pylist()
            for a, b in _slices(raw):  # the words of many short texts at once tell which have a candidate
                words = K.Words(raw[a:b], True, PUNCTUATED)
                for d in sorted({int(x) for x in scanner.hits(words)[0]} | {c[0] for c in scanner.candidates(words)}):
                    text = raw[a + d]
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    for k, m, s, e in scanner.scan(text):
                        rows.append((ids[a + d], scanner.names[k], m, m / len(scanner.words[k]), int(chars[s]), int(chars[e])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(6)], names=["doc_id", "license", "n_matched", "coverage", "span_start", "span_end"])

    return scan


def _slices(raw: list):
    a = size = 0
    for b, text in enumerate(raw):
        if size and size + len(text) > SLICE:
            yield a, b
            a, size = b, 0
        size += len(text)
    if a < len(raw):
        yield a, len(raw)


def template_rows(templates: DataFrame) -> list:
    """The pairs of a table of ``name`` and ``text``, in the order of their names; rows without either are none."""
    rows = templates.select("name", "text").where("name IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes, over {TEMPLATE_BYTES}")
    return sorted((r.name, r.text) for r in rows.collect())


def license_spans(docs: DataFrame, templates=TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """A row per license found: words matched, their share of the template, and the span in characters, end exclusive."""
    pairs = template_rows(templates) if isinstance(templates, DataFrame) else templates
    return docs.select("doc_id", "text").mapInArrow(_scan(Scanner(pairs, coverage=coverage)), RESULT)
