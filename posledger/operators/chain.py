"""Block headers: finality, contiguity, forks, retention and replay plans, as table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import replace_range

DEPTH = 128


def safe_head(head: int, depth: int = DEPTH) -> int:
    return max(-1, head - depth)


def settled(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Whether each block is at or under the finality boundary of its chain."""
    heads = df.groupBy("chain_id").agg(F.greatest(F.lit(-1), F.max("block_number") - depth).alias("safe_head"))
    return df.join(F.broadcast(heads), "chain_id").withColumn("settled", F.col("block_number") <= F.col("safe_head"))


def contiguity_breaks(headers: DataFrame) -> DataFrame:
    """Headers whose predecessor is missing or has another hash; the first of a chain has none to compare.

    A join on the number less one, so that no chain's headers have to stand in one task.
    """
    parent = headers.select("chain_id", (F.col("block_number") + 1).alias("block_number"), F.col("hash").alias("_hash"))
    first = headers.groupBy("chain_id").agg(F.min("block_number").alias("_first"))
    df = headers.join(parent, ["chain_id", "block_number"], "left").join(F.broadcast(first), "chain_id").where("block_number > _first")
    kind = F.when(F.col("_hash").isNull(), "gap").when(F.col("_hash") != F.col("parent_hash"), "parent")
    return df.select("chain_id", "block_number", kind.alias("problem")).where("problem IS NOT NULL")


def fork_point(processed: DataFrame, canonical: DataFrame, safe: int = -1) -> DataFrame:
    """Per chain: continuous, reorg with the range to retract, or unrecoverable. Headers at or under ``safe`` are settled."""
    own = processed.where(F.col("block_number") > safe)
    other = canonical.select("chain_id", "block_number", F.col("hash").alias("_hash"))
    same = F.col("hash") == F.col("_hash")
    both = own.join(other, ["chain_id", "block_number"], "left").groupBy("chain_id").agg(
        F.max(F.when(same, F.col("block_number"))).alias("ancestor"), F.max("block_number").alias("last"),
        F.max(F.when(F.col("_hash").isNotNull() & ~same, F.col("block_number"))).alias("_differs"),
    )
    forked = F.coalesce(F.col("_differs") > F.coalesce("ancestor", F.lit(-1)), F.lit(False))
    verdict = F.when(~forked, "continuous").when(F.col("ancestor").isNull(), "unrecoverable").otherwise("reorg")
    moved = F.col("verdict") == "reorg"
    return both.withColumn("verdict", verdict).select(
        "chain_id", "verdict", "ancestor", F.when(moved, F.col("ancestor") + 1).alias("retract_from"), F.when(moved, F.col("last")).alias("retract_to")
    )


def retain(headers: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The window of depth + 1 headers under each chain's head."""
    heads = headers.groupBy("chain_id").agg(F.max("block_number").alias("_head"))
    return headers.join(F.broadcast(heads), "chain_id").where(F.col("block_number") >= F.col("_head") - depth).drop("_head")


def truncate_above(headers: DataFrame, block: int) -> DataFrame:
    return headers.where(F.col("block_number") <= block)


def replay_plan(spark, lo: int, hi: int, width: int, safe: int) -> DataFrame:
    """The ranges that a replay would dispatch; one beyond the safe head is refused."""
    if lo > hi or width < 1:
        raise ValueError("empty range")
    if hi > safe:
        raise ValueError(f"block {hi} is above the safe head {safe}")
    starts = spark.range(lo, hi + 1, width).withColumnRenamed("id", "range_from")
    return starts.withColumn("range_to", F.least(F.col("range_from") + width - 1, F.lit(hi).cast("long")))


def replay(ledger: DataFrame, events: DataFrame, chain: int, lo: int, hi: int, version: int, safe: int) -> tuple[DataFrame, int]:
    """The ledger with a settled range dispatched again from its events, and the block to resume from. No cursor moves."""
    if lo > hi:
        raise ValueError("empty range")
    if hi > safe:
        raise ValueError(f"block {hi} is above the safe head {safe}")
    return replace_range(ledger, events, chain, lo, hi, version), hi + 1
