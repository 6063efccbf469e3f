"""The append-only signed ledger: +1 rows are live, a -1 row with the same key and version retracts one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("chain_id", "block_number", "log_index")


def append(events: DataFrame, version: int | Column) -> DataFrame:
    """One version for the batch; nothing to append is no rows."""
    v = version if isinstance(version, Column) else F.lit(version)
    return events.withColumn("version", v.cast("long")).withColumn("sign", F.lit(1))


def current(ledger: DataFrame, extra_keys: tuple = ()) -> DataFrame:
    """Signed collapse: live rows by key and version, whatever order rows arrived in; an unpaired -1 disappears."""
    keys = [*KEYS, "version", *extra_keys]
    rest = [c for c in ledger.columns if c not in keys and c != "sign"]
    live = ledger.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in rest], F.sum("sign").alias("_live"))
    return live.where("_live > 0").select(*[c for c in ledger.columns if c != "sign"])


def in_range(chain: int, lo: int, hi: int) -> Column:
    return (F.col("chain_id") == chain) & F.col("block_number").between(lo, hi)


def retract_range(ledger: DataFrame, chain: int, lo: int, hi: int) -> DataFrame:
    """The rows to append that retract what is live in a block range: all columns, the original version, sign -1."""
    return current(ledger.where(in_range(chain, lo, hi))).withColumn("sign", F.lit(-1)).select(*ledger.columns)


def replace_range(ledger: DataFrame, events: DataFrame, chain: int, lo: int, hi: int, version: int) -> DataFrame:
    """Dispatch a range again: retract, then append, always in this order."""
    new = append(events.where(in_range(chain, lo, hi)), version)
    return ledger.unionByName(retract_range(ledger, chain, lo, hi)).unionByName(new)


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the dataset, partitioned by a million blocks so that a range scan prunes."""
    rows.withColumn("block_part", F.expr("block_number div 1000000")).write.mode(mode).partitionBy("block_part").parquet(path)
