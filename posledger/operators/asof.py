"""State at many instants in one plan: sums and last values of a signed history as they stood at each instant asked for.

History and questions are one table, cut into buckets of time. Within a bucket a window runs over the rows of a key; what
earlier buckets left is added up over the buckets' totals, a row each. So a key with a third of the history is spread over its
buckets, and no pair of a question and a row of history is ever made. A retraction has the time of its row and cancels at any instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wideint import DEC, LIMBS, joined_columns
from . import folds


def state_at(asks: DataFrame, history: DataFrame, keys: tuple, at: str, sums: tuple = (), latest: tuple = (), order: tuple = (), bucket: int = 3600) -> DataFrame:
    """``asks`` with, for its key, the sums and last values of the rows of ``history`` at or before its ``at``.

    Rows of equal ``at`` follow one another by ``order``; a question comes after them. A last value passes over nulls. Sums are
    null where there is nothing before, columns of ``asks`` keep their names, and repeated questions have an answer each.
    """
    own = [c for c in asks.columns if c not in (*keys, at)]
    ask = asks.select(*keys, F.col(at).cast("long").alias("_t"), F.struct(*[F.col(c) for c in own], F.lit(1).alias("_one")).alias("_ask"), F.lit(True).alias("_asked"))
    past = history.select(*keys, F.col(at).cast("long").alias("_t"), *order, *sums, *latest)
    both = ask.unionByName(past, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / bucket)).withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    turn = F.struct(F.col("_t"), *[F.col(c) for c in order]) if order else F.col("_t")
    ends = both.where("NOT _asked").groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums], *[_last(c, turn).alias(f"_l_{c}") for c in latest])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    grid = both.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    carried = grid.select(*keys, "_b", *[F.sum(f"_s_{c}").over(before).alias(f"_s_{c}") for c in sums], *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_l_{c}") for c in latest])
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_asked", *order).rowsBetween(Window.unboundedPreceding, 0)
    run = [F.sum(c).over(inside).alias(f"_r_{c}") for c in sums] + [F.last(c, ignorenulls=True).over(inside).alias(f"_v_{c}") for c in latest]
    df = both.select(*keys, "_b", "_t", "_asked", "_ask", *run).where("_asked").join(carried, [*keys, "_b"])

    def total(c: str) -> Column:
        a, b = F.col(f"_r_{c}"), F.col(f"_s_{c}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b).alias(c)

    found = [total(c) for c in sums] + [F.coalesce(f"_v_{c}", f"_l_{c}").alias(c) for c in latest]
    return df.select(*keys, F.col("_t").alias(at), *[F.col(f"_ask.{c}").alias(c) for c in own], *found)


def _last(column: str, turn: Column) -> Column:
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), turn))


def _spread(deltas: DataFrame, names: tuple) -> DataFrame:
    """The limbs of a row's scale as a column each, so that a running sum keeps scales apart."""
    parts = [F.when(F.col("scale") == k, F.col(n)).cast(DEC).alias(f"{n}_{k}") for n in names for k in range(LIMBS)]
    return deltas.select(*[c for c in deltas.columns if c not in (*names, "scale")], *parts)


def _limbed(names: tuple) -> tuple:
    return tuple(f"{n}_{k}" for n in names for k in range(LIMBS))


def assets_at(asks: DataFrame, ledger: DataFrame, at: str = "at", bucket: int = 3600) -> DataFrame:
    """Pool state of each asked asset (``folds.ASSET`` and ``at``, unix seconds) as the ledger had it at that second."""
    carry, sums = ("block_timestamp",), (*_limbed(folds.ASSET_SUMS), "events")
    deltas = _spread(folds.hub_deltas(ledger, carry), folds.ASSET_SUMS).withColumnRenamed("block_timestamp", at)
    state = folds.hub_state(ledger, carry).withColumnRenamed("block_timestamp", at)
    df = state_at(asks, deltas.unionByName(state, allowMissingColumns=True), folds.ASSET, at, sums, folds.STATE, folds.ORDER, bucket)
    wide = [joined_columns(*[f"{n}_{k}" for k in range(LIMBS)]).alias(n) for n in folds.ASSET_SUMS]
    return df.select(*asks.columns, *wide, *folds.STATE, F.coalesce("events", F.lit(0)).alias("events"))


def positions_at(asks: DataFrame, ledger: DataFrame, at: str = "at", bucket: int = 3600) -> DataFrame:
    """Sums and flag of each asked position (``folds.POSITION`` and ``at``) as the ledger had it at that second."""
    sums = (*_limbed(folds.SUMS), "events")
    deltas = _spread(folds.position_deltas(ledger, ("block_timestamp",)), folds.SUMS).withColumnRenamed("block_timestamp", at)
    times = ledger.where("event_name = 'SetUsingAsCollateral' AND sign > 0").select("chain_id", *folds.ORDER, "version", F.col("block_timestamp").alias(at)).distinct()
    flags = folds.position_flags(ledger).join(times, ["chain_id", *folds.ORDER, "version"]).drop("version")
    df = state_at(asks, deltas.unionByName(flags, allowMissingColumns=True), folds.POSITION, at, sums, ("flag",), folds.ORDER, bucket)
    wide = [joined_columns(*[f"{n}_{k}" for k in range(LIMBS)]).alias(n) for n in folds.SUMS]
    return df.select(*asks.columns, *wide, F.coalesce("flag", F.lit(False)).alias("using_as_collateral"), F.coalesce("events", F.lit(0)).alias("events"))
