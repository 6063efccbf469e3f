"""Reconciliation of folds and values with snapshots of the chain, with no tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wideint import DEC, VALUE_LIMBS, joined, limbs
from .folds import ASSET, POSITION

ADDITIVE = ("liquidity", "added_shares", "drawn_shares", "premium_shares", "swept", "premium_offset_ray", "deficit_ray")
LATEST = ("drawn_index", "drawn_rate", "realized_fees", "liquidity_fee", "index_timestamp")
GETTERS = ("supplied", "drawn_debt", "premium_debt")


def _long(df: DataFrame, keys: tuple, fields: tuple, name: str) -> DataFrame:
    """Keys, field and value (as text) per row."""
    text = df.select(*keys, *[F.col(x).cast("string").alias(x) for x in fields])
    return text.unpivot(list(keys), list(fields), "field", name)


def difference(a, b):
    """a - b of digit strings of up to 156 digits; null where either is."""
    none = F.lit(0).cast(DEC)
    parts = [(F.coalesce(x, none) - F.coalesce(y, none)).cast(DEC) for x, y in zip(limbs(a, VALUE_LIMBS), limbs(b, VALUE_LIMBS))]
    return F.when(a.isNotNull() & b.isNotNull(), joined(*parts))


def reconcile_hub(fold: DataFrame, after: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Status of each asset and field: match, mismatch, skipped (the fold has no value) or untouched.

    With ``before``, additive fields are compared with the change between the snapshots, and an asset that the
    fold lacks was not touched; without it they are absolute, and a missing asset is a mismatch.
    Fields that the snapshot does not have are not compared; values have up to 156 digits.
    """
    fields = tuple(x for x in (*ADDITIVE, *LATEST) if x in after.columns)
    ours, theirs = _long(fold, ASSET, fields, "ours"), _long(after, ASSET, fields, "theirs")
    df = theirs.join(ours.withColumn("_has", F.lit(True)), [*ASSET, "field"], "full")
    want = F.col("theirs")
    if before is not None:
        df = df.join(_long(before, ASSET, fields, "_was"), [*ASSET, "field"], "left")
        change = difference(F.col("theirs"), F.coalesce("_was", F.lit("0")))
        want = F.when(F.col("field").isin(*ADDITIVE), change).otherwise(F.col("theirs"))
    missing = F.lit("mismatch" if before is None else "untouched")
    status = F.when(F.col("_has").isNull(), missing).when(F.col("ours").isNull(), "skipped").when(F.col("ours") == want, "match").otherwise("mismatch")
    return df.select(*ASSET, "field", "ours", want.alias("theirs"), status.alias("status"))


def reconcile_positions(valued: DataFrame, getters: DataFrame) -> DataFrame:
    """Three fields of every valued position against getters of the same instant; positions without a value are ``unvalued``."""
    flat = valued.select(*POSITION, *[F.col(f"value.{x}").alias(x) for x in GETTERS])
    df = _long(flat, POSITION, GETTERS, "ours").join(_long(getters, POSITION, GETTERS, "theirs"), [*POSITION, "field"], "left")
    status = F.when(F.col("ours").isNull(), "unvalued").when(F.col("ours") == F.col("theirs"), "match").otherwise("mismatch")
    return df.withColumn("status", status)


def summary(reconciled: DataFrame) -> DataFrame:
    """Counts by field and status."""
    return reconciled.groupBy("field", "status").agg(F.count("*").alias("n"))


def drift(reconciled: DataFrame, keys: tuple = ASSET) -> DataFrame:
    """Mismatches by field: how many, the largest difference, and the row that has it."""
    gap = F.regexp_replace(difference(F.coalesce("ours", F.lit("0")), F.coalesce("theirs", F.lit("0"))), "^-", "")
    bad = reconciled.where("status = 'mismatch'").withColumn("gap", gap)
    size = F.struct(F.length("gap").alias("n"), F.col("gap"), *keys)
    worst = bad.groupBy("field").agg(F.count("*").alias("n"), F.max(size).alias("_most"))
    return worst.select("field", "n", F.col("_most.gap").alias("largest_gap"), *[F.col(f"_most.{k}").alias(k) for k in keys])


def drawn_by_hash(seed: int, keys: tuple):
    """An order that is the same in every run and has nothing to do with the values: the digest of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def triage(rows: DataFrame, strata: dict, k: int, seed: int = 1, keys: tuple = POSITION) -> DataFrame:
    """Up to ``k`` rows of each stratum to compare with the chain first: touched lately, largest, near health 1, any at random.

    ``strata`` maps a name to a condition and an order, largest first; without an order rows are drawn by hash, without a condition from
    all. A row may stand in several strata. Each stratum keeps ``k`` rows per partition while it reads, so nothing is sorted as a whole;
    ties of an order are drawn by hash. Rows whose condition or order is null are not in the stratum.
    """
    draw, out = drawn_by_hash(seed, keys), None
    for name, (condition, order) in strata.items():
        some = rows if condition is None else rows.where(condition)
        some = some if order is None else some.where(order.isNotNull())
        taken = some.orderBy(*([] if order is None else [order.desc()]), draw, *keys).limit(k).withColumn("stratum", F.lit(name))
        out = taken if out is None else out.unionByName(taken)
    return out
