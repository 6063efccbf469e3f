"""SentencePiece encoding and decoding by a table of distinct chunks.

A model whose pieces hold the whitespace marker only in front can't merge over a marker that follows another character.
So a text falls into *chunks*, a run of markers and what follows it, that are segmented one by one: each distinct chunk of
the corpus is segmented and decoded once, by the library, and a text's ids are those of its chunks in order of position.

Each task packs what it reads into blocks, a row each; a block sends each of its distinct chunks once, packed by hash range; a
range segments what it gets and answers each block in its own order. A chunk that every text holds costs a row per block, equal
rows lie where they were read, and texts move once, compressed.

Null and empty texts have no ids but the end id, if asked for. Rows are kept one by one, repeated and null ids included; columns other than
id and text are not read. Input is a table or a saved one: a lost task must read its rows in the same order again.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import meet, texts_of
from .kernels import spread

MARK = "▁"
SPACE = 32
SENT = "p int, block long, chunks binary, n int, sizes binary"
ANSWER = "block long, p int, counts binary, ids binary, sizes binary, surfaces binary"
#: Bytes of text of a block, and of all blocks for each range; a text that is larger is a block of its own.
BLOCK_BYTES, RANGE_BYTES = 16 << 20, 16 << 20


@lru_cache(maxsize=2)
def processor(model: bytes):
    """The library's processor of a model file, one per process; a model that chunks can't be taken from is refused."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_proto=model)
    crossing = [made.id_to_piece(i) for i in range(len(made)) if MARK in made.id_to_piece(i).lstrip(MARK)]
    probe = "Á  ﬁ\t  x "
    if crossing or made.normalize(probe) != (MARK + probe.replace(" ", MARK)):
        raise ValueError("the model has pieces over a whitespace marker, or changes texts before it segments them")
    return made


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def segmented(model: bytes, chunks: list[bytes]) -> tuple[list[list[int]], list[bytes]]:
    """The ids of chunks and what the library decodes them to behind other text."""
    sp = processor(model)
    # the library puts a marker in front, which is the chunk's own; a lone marker is read behind a letter
    ids = sp.encode([c[1:] for c in chunks], num_threads=1)
    head = sp.encode("x")
    lone = sp.encode("x ")[len(head) :]
    ids = [lone if len(c) == 1 else got for c, got in zip(chunks, ids)]
    return ids, [s[1:].encode() for s in sp.decode([head + got for got in ids], num_threads=1)]


class Chunks:
    """The chunks of a block's texts: ``place`` says for each which of the distinct ones it is, ``first`` where a text's begin.

    Distinct chunks are in order of their hash range, then of their bytes, whatever order the texts came in.
    """

    def __init__(self, texts: list, bits: int):
        marked = [b" " + bytes(t).replace(MARK.encode(), b" ") if len(t) else b"" for t in texts]
        data = b"".join(marked)
        begin = np.cumsum([0, *(len(t) for t in marked)])
        space = np.frombuffer(data, np.uint8) == SPACE
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[begin[:-1][begin[:-1] < begin[1:]]] = True
        at = np.flatnonzero(opens)
        self.first = np.searchsorted(at, begin)
        coded = _slices(data, np.append(at, len(data))).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        found = coded.dictionary.take(pa.array(order)).to_pylist()
        part = np.array([xxhash.xxh3_64_intdigest(c) >> (64 - bits) for c in found], np.int64)
        by_part = np.argsort(part, kind="stable")
        where = np.empty(len(found), np.int64)
        where[order[by_part]] = np.arange(len(found))
        self.distinct, self.part = [found[i] for i in by_part], part[by_part]
        self.place = where[coded.indices.to_numpy()]


def _slices(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _runs(part: np.ndarray):
    """The distinct values of a sorted array, with the bounds of each."""
    cut = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
    return zip(part[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(part)])


def _sizes(items) -> np.ndarray:
    return np.fromiter((len(x) for x in items), np.int64, len(items))


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes that hold the largest; ``_unpacked`` knows how many there are."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _pack(size: int):
    def each(batches):
        """Blocks of about ``size`` bytes in the order in which rows are read."""
        part, count, held, room = TaskContext.get().partitionId(), 0, [], size
        for batch in batches:
            rows = pa.table({"doc_id": batch.column("doc_id"), "text": pc.fill_null(batch.column("text"), "")})
            ends = np.cumsum(pc.binary_length(rows["text"]).to_numpy().astype(np.int64) + 16)
            a = 0
            while a < len(ends):
                done = int(ends[a - 1]) if a else 0
                b = max(a + (not held), int(np.searchsorted(ends, done + room, "right")))
                held += [rows.slice(a, b - a)] if b > a else []
                room -= int(ends[b - 1]) - done if b > a else 0
                if b < len(ends):
                    yield _block(part, count, held)
                    count, held, room = count + 1, [], size
                a = b
        if held:
            yield _block(part, count, held)

    return each


def _block(part: int, count: int, held: list[pa.Table]) -> pa.RecordBatch:
    table, sink = pa.concat_tables(held).combine_chunks(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return pa.RecordBatch.from_arrays([pa.array([part << 32 | count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])


def _unpacked_block(table: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(table["packed"][0].as_buffer()).read_all()


def _send(bits: int):
    def each(table: pa.Table) -> pa.Table:
        chunks = Chunks(texts_of(_unpacked_block(table)), bits)
        rows = [(p, chunks.distinct[a:b]) for p, a, b in _runs(chunks.part)]
        return pa.table(
            {
                "p": pa.array([p for p, _ in rows], pa.int32()),
                "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int64()),
                "chunks": pa.array([zstandard.compress(b"".join(c)) for _, c in rows], pa.binary()),
                "n": pa.array([len(c) for _, c in rows], pa.int32()),
                "sizes": pa.array([_packed(_sizes(c)) for _, c in rows], pa.binary()),
            }
        )

    return each


def _answer(model: bytes):
    def each(table: pa.Table) -> pa.Table:
        """Segment every distinct chunk of a range once and answer each row in its own order.

        In ``sizes`` 0 says that the chunk's surface is the chunk itself, another number is one more than its length.
        """
        sizes = [_unpacked(x.as_py(), n) for x, n in zip(table["sizes"], table["n"].to_pylist())]
        ends = np.cumsum(np.concatenate([[0], *sizes]).astype(np.int64))
        coded = _slices(b"".join(zstandard.decompress(x.as_py()) for x in table["chunks"]), ends).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        ids, surfaces = segmented(model, chunks)
        counts, flat = _sizes(ids), np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids)))
        cut = np.concatenate([[0], np.cumsum(counts)])
        other = [b"" if s == c else s for s, c in zip(surfaces, chunks)]
        width = np.array([0 if s == c else len(s) + 1 for s, c in zip(surfaces, chunks)], np.int64)
        rows, place, a = [], coded.indices.to_numpy(), 0
        for n in map(len, sizes):
            own = place[a : a + n]
            at, _ = spread(cut[own], cut[own + 1] - 1)
            rows.append((_packed(counts[own]), zstandard.compress(_packed(flat[at])), _packed(width[own]), b"".join([other[i] for i in own[width[own] > 0].tolist()])))
            a += n
        named = {name: pa.array([r[k] for r in rows], pa.binary()) for k, name in enumerate(("counts", "ids", "sizes", "surfaces"))}
        return pa.table({"block": table["block"], "p": table["p"], **named})

    return each


def _cut(data: bytes, sizes: np.ndarray, unit: int = 1) -> list[bytes]:
    ends = (np.cumsum(sizes) * unit).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _meet(bits: int, make):
    def each(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        """The texts of a block with the ids and surfaces of their chunks, put together by position."""
        table = _unpacked_block(table)
        chunks = Chunks(texts_of(table), bits)
        answer = answer.sort_by("p")
        held = [b - a for _, a, b in _runs(chunks.part)]
        got = {n: [x.as_py() for x in answer[n]] for n in ("counts", "ids", "sizes", "surfaces")}
        told = [_unpacked(x, n) for x, n in zip(got["counts"], held)]
        none = np.zeros(0, np.int64)
        ids = np.concatenate([none, *(_unpacked(zstandard.decompress(x), int(c.sum())) for x, c in zip(got["ids"], told))]).astype(np.int32)
        width = np.concatenate([none, *(_unpacked(x, n) for x, n in zip(got["sizes"], held))])
        counts = np.concatenate([none, *told])
        other = _cut(b"".join(got["surfaces"]), np.maximum(width - 1, 0))
        surfaces = [s if w else c for c, s, w in zip(chunks.distinct, other, width.tolist())]
        return make(table["doc_id"], chunks, _cut(ids.tobytes(), counts, 4), counts, surfaces)

    return each


def _texts(chunks: Chunks, parts: list[bytes], between: bytes = b""):
    """Per text the parts of its chunks, joined."""
    first = chunks.first.tolist()
    for a, b in zip(first, first[1:]):
        yield between.join([parts[i] for i in chunks.place[a:b].tolist()])


def _rows(end: bytes):
    def make(doc_id, chunks: Chunks, ids: list[bytes], counts: np.ndarray, surfaces: list[bytes]) -> pa.Table:
        whole = [np.frombuffer(x + end, np.int32) for x in _texts(chunks, ids)]
        decoded = [s[1:].decode(errors="replace") for s in _texts(chunks, surfaces)]
        return pa.table({"doc_id": doc_id, "ids": pa.array(whole, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())})

    return make


def _digests(end: list[int]):
    from hashlib import sha256

    tail = [b"%d" % i for i in end]

    def make(doc_id, chunks: Chunks, ids: list[bytes], counts: np.ndarray, surfaces: list[bytes]) -> pa.Table:
        words = [" ".join(map(str, np.frombuffer(x, np.int32).tolist())).encode() for x in ids]
        joined = (b" ".join([x, *tail] if x else tail) for x in _texts(chunks, words, b" "))
        total = np.concatenate([[0], np.cumsum(counts[chunks.place])])
        return pa.table(
            {
                "doc_id": doc_id,
                "n_tokens": pa.array(np.diff(total[chunks.first]) + len(end), pa.int64()),
                "ids_sha256": pa.array([sha256(x).hexdigest() for x in joined], pa.string()),
                "decoded_sha256": pa.array([sha256(s[1:]).hexdigest() for s in _texts(chunks, surfaces)], pa.string()),
            }
        )

    return make


def _through_table(docs: DataFrame, model: bytes, make, schema: str, doc_id: str, text: str) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    bits = int(min(20, max(6, np.ceil(np.log2(max(1, total / RANGE_BYTES))))))
    kind = docs.schema[doc_id].dataType.simpleString()
    blocks = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pack(BLOCK_BYTES), "block long, packed binary")
    sent = blocks.groupBy("block").applyInArrow(_send(bits), SENT)
    answer = sent.groupBy("p").applyInArrow(_answer(model), ANSWER)
    return meet(blocks, answer, _meet(bits, make), f"doc_id {kind}, {schema}")


def _end(model: bytes, end: bool) -> list[int]:
    return [processor(model).eos_id()] if end else []


def encoded(docs: DataFrame, model: bytes, end: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its ``doc_id``, ``ids`` as the library encodes the whole text, and ``decoded``, what the library makes of the ids."""
    tail = np.array(_end(model, end), np.int32).tobytes()
    return _through_table(docs, model, _rows(tail), "ids array<int>, decoded string", doc_id, text)


def encoding_digest(docs: DataFrame, model: bytes, end: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encoded``, but counts and digests in place of ids and texts: n_tokens, ids_sha256, decoded_sha256."""
    return _through_table(docs, model, _digests(_end(model, end)), "n_tokens long, ids_sha256 string, decoded_sha256 string", doc_id, text)


def decoded(rows: DataFrame, model: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of any column of ids, theirs from elsewhere included; null ids have no text, and ids out of range fail."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != into)

    def each(batches):
        for batch in batches:
            texts = [None if x is None else processor(model).decode(x) for x in batch.column(ids).to_pylist()]
            kept = [n for n in batch.schema.names if n != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return rows.mapInArrow(each, f"{kinds}, `{into}` string")
