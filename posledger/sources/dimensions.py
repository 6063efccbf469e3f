"""Fetched side tables: token labels and oracle prices as they land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABEL = 64


def clean_label(raw: Column, most: int = MOST_LABEL) -> Column:
    """Control characters out, trimmed, cut to length; nothing left is null."""
    text = F.trim(F.regexp_replace(raw, r"[\x00-\x1F\x7F-\x9F]", ""))
    return F.nullif(F.left(text, F.lit(most)), F.lit(""))


def bytes32_label(raw: Column, most: int = MOST_LABEL) -> Column:
    """A label that came as a 0x-prefixed 32-byte word, padded with zeros."""
    text = F.decode(F.unhex(F.substring(raw, 3, 64)), "UTF-8")
    return F.when(raw.rlike("^0x[0-9a-fA-F]{64}$"), clean_label(text, most))


def clean_decimals(raw: Column) -> Column:
    return F.when(raw.between(0, 255), raw.cast("int"))


def labels(raw: DataFrame) -> DataFrame:
    """Label rows from landed answers; a null label means asked and none."""
    symbol = F.coalesce(bytes32_label(F.col("symbol")), clean_label(F.col("symbol")))
    return raw.select("chain_id", F.lower("token").alias("token"), symbol.alias("symbol"), clean_label(F.col("name")).alias("name"), clean_decimals(F.col("decimals")).alias("token_decimals"), "fetched_at")


def price_rows(batches: DataFrame) -> DataFrame:
    """Oracle batches (reserve_ids, answers) zipped by position; ``accepted`` is false where an answer is not positive.

    A batch whose answers are not as many as its ids is not zipped at all: one row without an id, not accepted.
    """
    fits = F.size("reserve_ids") == F.size("answers")
    pairs = F.zip_with("reserve_ids", "answers", lambda i, a: F.struct(i.alias("reserve_id"), a.alias("price")))
    none = F.array(F.struct(F.lit(None).cast("long").alias("reserve_id"), F.lit(None).cast("decimal(38,0)").alias("price")))
    each = batches.select("chain_id", F.lower("spoke").alias("spoke"), "priced_at", F.explode(F.when(fits, pairs).otherwise(none)).alias("x"))
    return each.select("chain_id", "spoke", "x.reserve_id", "x.price", "priced_at", F.coalesce(F.col("x.price") > 0, F.lit(False)).alias("accepted"))
