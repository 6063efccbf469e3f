"""Encoding by distinct chunks against the library over whole texts."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posledger.llm import op13_pieces as op

from corpus import DOCS, corpus

MODEL = op.read_model(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", None, " ", "  ", "a", "a ", " a", "a  b", "▁", "a▁b ▁ c", "\n \n", "\x00 �", "\U0001f600 日本  x", "  \t z", " " * 40, ("long word " * 5000).strip(), "x" * 50_000, "1234 56 789", "</s> <s> <unk>", "<0x41> é́"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def whole(text):
    sp = op.processor(MODEL)
    ids = sp.encode(text or "", add_eos=True)
    return ids, sp.decode(ids)


def test_digest_and_rows_equal_the_library(spark):
    rows = corpus() + [(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "same row", None, None, None)] * 50
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted((-1 if r[0] is None else r[0], len(ids), sha(" ".join(map(str, ids))), sha(back)) for r in rows for ids, back in [whole(r[1])])
    got = op.encoding_digest(docs, MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    listed = op.encoded(docs, MODEL)
    assert sorted((-1 if r.doc_id is None else r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids))), sha(r.decoded)) for r in listed.collect()) == want
    again = op.decoded(listed.withColumn("extra", F.lit(1)).withColumnRenamed("decoded", "own"), MODEL)
    assert again.where("decoded <> own").count() == 0 and again.columns == ["doc_id", "ids", "own", "extra", "decoded"]


def test_other_columns_types_and_empty_tables(spark):
    docs = spark.createDataFrame([("k", 1, "a b", "p")], "key string, block int, body string, ids string")
    assert [(r.doc_id, r.ids) for r in op.encoded(docs, MODEL, end=False, doc_id="key", text="body").collect()] == [("k", op.processor(MODEL).encode("a b"))]
    assert op.encoding_digest(docs.limit(0), MODEL, doc_id="key", text="body").count() == 0


def test_equal_rows_lie_in_many_blocks_and_long_texts_in_their_own(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 1 << 16)
    rows = [(None, "w " * 1000)] * 300 + [(1, "long text " * 20_000), (2, ""), (3, None)] + [(4, "x")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = docs.mapInArrow(op._pack(op.BLOCK_BYTES), "block long, packed binary").collect()
    assert len(packed) >= 10 == len({r.block for r in packed}) - len(packed) + 10
    got = op.encoding_digest(docs, MODEL)
    assert got.count() == len(rows) and got.where("doc_id IS NULL").distinct().count() == 1
    assert got.where("doc_id = 1").first().n_tokens == len(whole(rows[300][1])[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ▁ab\né日"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_chunks_join_to_what_the_library_gives(texts):
    chunks = op.Chunks([memoryview(t.encode()) for t in texts], 4)
    ids, surfaces = op.segmented(MODEL, chunks.distinct)
    for k, t in enumerate(texts):
        own = chunks.place[chunks.first[k] : chunks.first[k + 1]].tolist()
        got = [i for c in own for i in ids[c]]
        assert got == op.processor(MODEL).encode(t)
        assert b"".join(surfaces[c] for c in own)[1:].decode() == op.processor(MODEL).decode(got)


def test_models_that_chunks_do_not_fit_are_refused():
    with pytest.raises(Exception):
        op.processor(b"no model")
