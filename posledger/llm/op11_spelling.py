"""Spelling variants: each frequent word's near words, at one inserted, deleted or replaced code point, and its more common form.

Letters are hashed to a few symbols. An edit of a word is an edit of its reduced word or leaves that as it is, so near words have
reduced words at most one edit apart. Of each distinct reduced word the full neighbourhood is generated, as hashes that are
computed from the hash of the word and the edit, and joined with the reduced vocabulary; what meets is verified on the words
themselves. A hash that meets by chance is one more candidate and changes no result.

There are so many symbols that a reduced string of seven has about one word: the neighbourhoods grow with the vocabulary and
the candidates with it, not with its square. Rows are words and no occurrences: counts are combined before the shuffle.

Runs of letters are taken from whole texts (null: none); documents count as often as they stand in the table, and a null
id is read as an empty one. Words of equal count are ordered by their code points. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U, mix
from .shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Neighbours that a task makes at once.
AT_ONCE = 1 << 20


def noisy(run: Column, doc_id: Column, every: int | None) -> Column:
    """A run of letters, without one of its letters where ``every`` divides the hash of document and run."""
    if not every:
        return run
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, every: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns word and n: the runs of letters, A-Z lower-cased, of ``least_length`` code points and ``least`` occurrences or more."""
    runs = docs.select(F.col(doc_id).alias("_id"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least_length).select(noisy(F.col("run"), F.col("_id"), every).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def symbols_for(words: int) -> int:
    """So many symbols that there are about as many strings of seven as words."""
    return max(2, int(np.ceil(words ** (1 / 7))))


def _key(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + U((length * 0xD6E8FEB86659FD93) % 2**64)).view(np.int64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(n, U(BASE))]), dtype=U)


def _values(symbols: int) -> np.ndarray:
    return mix(np.arange(1, symbols + 1, dtype=U) * U(0xA0761D6478BD642F))


def reduced(words: DataFrame, symbols: int) -> DataFrame:
    """The words with ``short``, their reduced word as a string, and ``key``, its hash."""
    values = _values(symbols)

    def each(batches):
        for batch in batches:
            short, keys = [], []
            for word in batch.column("word").to_pylist():
                points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(U)
                s = (mix(points + U(77)) % U(symbols)).astype(np.int64)
                total = (values[s] * _powers(len(s))[: len(s)]).sum(dtype=U)
                keys.append(_key(np.array([total]), len(s))[0])
                short.append("".join(map(chr, (s + 48).tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(short, pa.string()), pa.array(keys, pa.int64())], names=[*batch.schema.names, "short", "key"])

    return words.mapInArrow(each, "word string, n long, short string, key long")


def neighbours(s: np.ndarray, symbols: int):
    """The keys of all distinct strings within one edit of the rows of ``s`` (equal lengths), each with its row, in pieces."""
    m, n = s.shape
    values, power = _values(symbols), _powers(n + 1)
    v = values[s]
    head = np.concatenate([np.zeros((m, 1), U), np.cumsum(v * power[:n], axis=1, dtype=U)], axis=1)
    whole = head[:, -1]
    yield _key(whole, n), np.arange(m)
    before = np.concatenate([np.full((m, 1), -1), s], axis=1)  # a run of equal symbols loses, or gets, one at its start only
    step = max(1, AT_ONCE // (m * symbols))
    for a in range(0, n + 1, step):
        at = np.arange(a, min(a + step, n + 1))
        c, place = np.arange(symbols)[None, None], power[at][None, :, None]
        tail = (whole[:, None] - head[:, at])[:, :, None] * U(BASE)
        put = head[:, at][:, :, None] + values[None, None] * place + tail
        row, i, k = np.nonzero(np.broadcast_to(c != before[:, at][:, :, None], put.shape))
        yield _key(put[row, i, k], n + 1), row
        at = at[at < n]
        if len(at):
            other = whole[:, None, None] + (values[None, None] - v[:, at][:, :, None]) * power[at][None, :, None]
            row, i, k = np.nonzero(np.broadcast_to(c != s[:, at][:, :, None], other.shape))
            yield _key(other[row, i, k], n), row
            cut = head[:, at] + (whole[:, None] - head[:, at + 1]) * U(INVERSE)
            row, i = np.nonzero(s[:, at] != before[:, at])
            yield _key(cut[row, i], n - 1), row


def neighbourhoods(shorts: DataFrame, symbols: int) -> DataFrame:
    """Columns near and key: for the key of each reduced word the keys of its neighbourhood, itself included."""

    def each(batches):
        for batch in batches:
            words, keys = batch.column("short").to_pylist(), batch.column("key").to_numpy()
            sizes = np.array([len(w) for w in words])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                m = max(1, AT_ONCE // (2 * symbols * int(size + 1)))
                for a in range(0, len(own), m):
                    some = own[a : a + m]
                    s = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), -1).astype(np.int64) - 48
                    for near, row in neighbours(s, symbols):
                        yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(keys[some[row]])], names=["near", "key"])

    return shorts.mapInArrow(each, "near long, key long")


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """Columns word, n, other, other_n: every ordered pair of words (of distinct rows word, n) that are one edit apart."""
    symbols = symbols or symbols_for(words.count())
    words = saved(reduced(words, symbols))
    near = neighbourhoods(words.select("short", "key").distinct(), symbols)
    others = words.select(F.col("key").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = near.join(others, "near").drop("near").join(words.select("key", "word", "n"), "key")
    pairs = pairs.where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    return pairs.select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """Columns word and root from word and form: the end of each word's chain of forms, in steps that double."""
    forms = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = saved(forms.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        forms = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return forms


def spelling_variants(words: DataFrame, times: int = 5, symbols: int | None = None) -> DataFrame:
    """Per word its form, the near word of the largest n if that is ``times`` its own or more, and the root that forms lead to."""
    words = saved(words)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("other"))).alias("best")
    near = saved(near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("own"), best))
    formed = near.where(-F.col("best.m") >= times * F.col("own")).select("word", F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))
    ends = roots(formed)
    df = words.join(near.select("word", "n_near"), "word", "left").join(formed, "word", "left").join(ends, "word", "left")
    return df.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
run AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY doc_id, w),
hex AS (SELECT doc_id, w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM run),
hashed AS MATERIALIZED (SELECT w, n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(length(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM hex, crc),
word AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS short FROM word, unnest(range(length(word))) AS u(i)),
pair AS (SELECT a.word, b.word AS other, a.n, b.n AS other_n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, a.n, b.n FROM cut a JOIN word b ON a.short = b.word UNION SELECT b.word, a.word, b.n, a.n FROM cut a JOIN word b ON a.short = b.word),
near AS MATERIALIZED (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n, max(n) AS n FROM pair GROUP BY word),
formed AS MATERIALIZED (SELECT word, other AS form, other_n AS form_n FROM near WHERE other_n >= 5 * n),
chain AS (SELECT word, form AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root),
ends AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM formed))
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM word LEFT JOIN (SELECT word, n_near FROM near) USING (word) LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)"""
