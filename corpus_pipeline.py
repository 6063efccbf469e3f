"""Corpus pipeline: from raw documents to a mixture, each stage over all that the one before kept."""

from __future__ import annotations

from posledger.llm.op01_lines import without_boilerplate
from posledger.llm.op04_classifier import quality_filter
from posledger.llm.op05_jaccard import keep_one
from posledger.llm.op07_mixture import mixture
from posledger.llm.op10_decontamination import decontaminated
from posledger.llm.shared import saved


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark, docs, sf_dir):
    """Documents that the rule ensemble scores under its threshold go."""
    return quality_filter(docs, _table(spark, sf_dir, "labels"))


def dedup_lines(spark, docs, sf_dir):
    """Lines that stand on many sites go; no document does."""
    return without_boilerplate(docs)


def dedup_documents(spark, docs, sf_dir):
    """Of each group of near duplicates the document of the least id stays."""
    return keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item, or a window of one, go."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """What the mixture takes: documents with the number of words taken, repeats counted; those with none go."""
    carry = ("doc_id", "text", "lang", "source", "n_chars")
    return mixture(docs, carry=carry).where("taken > 0")


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("jaccard_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixture", mix),
]

#: Stages with a learned model, sketches, approximate matching have no SQL; tests/llm/test_pipeline.py checks each against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over ``documents``; what is between stages is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs) if k + 1 < len(STAGES) else docs
    return docs
