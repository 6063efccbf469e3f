"""Block exchange: how often does each hash of a corpus occur, answered to the blocks that asked.

Documents are dealt into blocks of a few megabytes by a hash of their own. A block sends each of
its distinct hashes once, packed by hash range, and is told about all of them by a packed answer
in the same order. So a hash that half the corpus holds costs a row per block and not one per
occurrence, and no range gathers more than its share. Blocks and ranges are ordinary Spark groups:
everything is one plan over one shuffle of the texts (Spark reuses that exchange), and a lost
executor's part is computed again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
MOST_BLOCK_BYTES = 64 << 20
SENT = "p int, block long, hashes binary, extra binary"
ANSWER = "block long, p int, answer binary"


@dataclass(frozen=True)
class Layout:
    """Number of blocks and log2 of the number of hash ranges, from the size of the corpus."""

    blocks: int
    bits: int


def layout(docs: DataFrame, text: str = "text", per_range: int = 8 << 20) -> Layout:
    """One pass over the lengths. Blocks grow from 1 to 64 MB with the corpus; ranges see ``per_range`` bytes of text each."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    size = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, total // 20_000))
    return Layout(max(1, -(-total // size)), int(min(20, max(7, np.ceil(np.log2(max(1, total / per_range)))))))


def blocked(docs: DataFrame, plan: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns block, doc_id and text (null: empty); repeated rows stay repeated."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.substring(F.col(text), 1, 64), F.octet_length(text)), F.lit(plan.blocks)).alias("block"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def texts_of(table: pa.Table) -> list:
    """The texts of a block as byte slices of Arrow's buffer, without copies."""
    out = []
    for chunk in table["text"].chunks:
        wide = pa.types.is_large_string(chunk.type)
        off = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        data = memoryview(chunk.buffers()[2] or b"")
        out += [data[a:b] for a, b in zip(off, off[1:])]
    return out


def send(block: int, bits: int, hashes: np.ndarray, extra: np.ndarray | None = None) -> pa.Table:
    """Rows of SENT for distinct, sorted hashes; ``extra`` holds bytes for each (a 2-D uint8 array or 1-D array)."""
    top = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.searchsorted(top, np.arange((1 << bits) + 1))
    has = np.flatnonzero(cut[1:] > cut[:-1])
    extra = np.zeros((len(hashes), 0), np.uint8) if extra is None else extra
    return pa.table(
        {
            "p": pa.array(has, pa.int32()),
            "block": pa.array(np.full(len(has), block), pa.int64()),
            "hashes": pa.array([hashes[cut[p] : cut[p + 1]].tobytes() for p in has], pa.binary()),
            "extra": pa.array([extra[cut[p] : cut[p + 1]].tobytes() for p in has], pa.binary()),
        }
    )


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one range: all hashes, all extra bytes, and the bounds of each row."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]]
    bounds = np.cumsum([0, *(len(x) for x in parts)])
    return np.concatenate(parts), np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["extra"]]), bounds


def reply(table: pa.Table, values: np.ndarray, bounds: np.ndarray, pack: bool = True) -> pa.Table:
    """Rows of ANSWER: a bit (or the values' bytes) for each hash that a row sent."""
    cut = [values[a:b] for a, b in zip(bounds, bounds[1:])]
    return pa.table(
        {
            "block": table["block"].combine_chunks() if table.num_rows else pa.array([], pa.int64()),
            "p": table["p"].combine_chunks() if table.num_rows else pa.array([], pa.int32()),
            "answer": pa.array([np.packbits(x).tobytes() if pack else x.tobytes() for x in cut], pa.binary()),
        }
    )


def answers(table: pa.Table, bits: int, hashes: np.ndarray, dtype: np.dtype | None = None) -> np.ndarray:
    """The answers to ``hashes`` (as they were sent): booleans, or values of ``dtype``."""
    out = np.zeros(len(hashes), bool if dtype is None else dtype)
    cut = np.searchsorted((hashes >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    for p, got in zip(table["p"].to_pylist(), table["answer"]):
        n = cut[p + 1] - cut[p]
        raw = np.frombuffer(got.as_buffer(), np.uint8)
        out[cut[p] : cut[p + 1]] = np.unpackbits(raw, count=n).astype(bool) if dtype is None else raw.view(dtype)
    return out


def twice(table: pa.Table) -> pa.Table:
    """Which hashes occur more than once in the corpus; ``extra`` is 1 where the block itself has several."""
    hashes, many, bounds = gathered(table)
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    count = np.bincount(group, weights=1 + many[order], minlength=1)
    found = np.empty(len(h), bool)
    found[order] = count[group] > 1
    return reply(table, found, bounds)


def repeated(sent: DataFrame) -> DataFrame:
    """Rows of SENT with a count flag in ``extra``, to rows of ANSWER."""
    return sent.groupBy("p").applyInArrow(twice, ANSWER)


def meet(docs: DataFrame, answer: DataFrame, function, schema: str) -> DataFrame:
    """Each block of documents with the answers it got."""
    return docs.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(function, schema)


def number(table: pa.Table) -> int:
    return table["block"][0].as_py()
