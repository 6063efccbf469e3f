"""Valuation of positions at one instant, in exact integer arithmetic of any width.

Pool index and totals are computed once per asset and joined; per position there are only a few
products left, of Python integers in one Arrow function. A row that can't be valued is null and tells why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wideint as w

BROADCAST_ROWS = 500_000
MOST = 10**38


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A dimension that was computed once and counted: a broadcast hint where it is small; otherwise the join shuffles."""
    df = df.persist()
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _over(a: int, d: int) -> int:
    """a / d toward zero, as the protocol's own arithmetic has it where a pool is in the red."""
    return a // d if a >= 0 else -(-a // d)


def _up(x: int) -> int:
    return _over(x + w.RAY - 1, w.RAY)


def _owed(drawn: int, premium: int, offset: int, index: int, deficit: int = 0) -> tuple[int, int]:
    """What is owed in all, and its premium."""
    ray = premium * index - offset
    if ray < 0:
        raise w.Unvalued("negative premium")
    return drawn * index + ray + deficit, ray


def _asset(liquidity, swept, drawn, premium, offset, deficit, fees, fee, index, rate, stamp, at):
    if index is None:
        raise w.Unvalued("no checkpoint")
    now = index
    if at != stamp and (drawn or premium):
        if at < stamp:
            raise w.Unvalued("instant before the checkpoint")
        now = _up(index * (w.RAY + rate * (at - stamp) // w.YEAR_SECONDS))
    after, before = (_up(_owed(drawn, premium, offset, i, deficit)[0]) for i in (now, index))
    unrealized = _over((after - before) * fee, w.BPS) if now != index and fee else 0
    made = now, unrealized, liquidity + swept + after - fees - unrealized
    if max(map(abs, made)) >= MOST:
        raise w.Unvalued("over 38 digits")
    return made


def _position(supplied, drawn, premium, offset, index, total, added):
    if index is None or total is None:
        raise w.Unvalued("no checkpoint")
    if supplied < 0 or drawn < 0 or added + w.VIRTUAL <= 0:
        raise w.Unvalued("negative balance")
    ray = _owed(0, premium, offset, index)[1]
    amounts = supplied * (total + w.VIRTUAL) // (added + w.VIRTUAL), _up(drawn * index), _up(ray)
    if max(amounts[0], amounts[1] + amounts[2]) >= MOST:
        raise w.Unvalued("over 38 digits")
    return *amounts, amounts[1] + amounts[2], ray


def _supplied(shares, total, added):
    return (None if shares is None or total is None else shares * (total + w.VIRTUAL) // (added + w.VIRTUAL),)


def asset_at(hub_assets: DataFrame, at: int | Column) -> DataFrame:
    """Each asset with its index, unrealised fees and total assets at an instant, or its row's; null without a checkpoint, with the reason."""
    at = at if isinstance(at, Column) else F.lit(at)
    inputs = ("liquidity", "swept", "drawn_shares", "premium_shares", "premium_offset_ray", "deficit_ray", "realized_fees")
    made = w.integers(_asset, ("index_at", "unrealized_fees", "total_added_assets"))(
        *inputs, F.coalesce("liquidity_fee", F.lit(0)), "drawn_index", "drawn_rate", "index_timestamp", at
    )
    df = hub_assets.withColumn("_made", made).withColumn("at", at.cast("long"))
    numbers = [F.col(f"_made.{n}").cast(w.DEC).alias(n) for n in ("index_at", "unrealized_fees", "total_added_assets")]
    return df.select(*[c for c in hub_assets.columns if c != "at"], *numbers, F.col("_made.reason").alias("unvalued"), "at")


def supplied_assets(shares: Column) -> Column:
    """Base units that shares of a pool are worth, as digits."""
    return w.integers(_supplied, ("x",))(shares, "total_added_assets", "pool_added_shares")["x"]


AMOUNTS = ("supplied", "drawn_debt", "premium_debt", "total_debt")


def value_positions(positions: DataFrame, reserves: DataFrame, assets_at: DataFrame) -> DataFrame:
    """Positions with their asset and value, null where the reserve or its checkpoint is unknown.

    Amounts have up to 38 digits; ``premium_ray`` is a digit string of any width. A position without a value, a
    negative balance for one, is listed with the reason in ``unvalued``; ``value.at`` is the instant.
    """
    pool = assets_at.select(
        "chain_id", "hub", "asset_id", "underlying", "decimals", "index_at", "total_added_assets", F.col("added_shares").alias("pool_added_shares"), F.col("unvalued").alias("_why"), "at"
    )
    joined = positions.join(sized(reserves), ["chain_id", "spoke", "reserve_id"], "left").join(sized(pool), ["chain_id", "hub", "asset_id"], "left")
    made = w.integers(_position, (*AMOUNTS, "premium_ray"))(
        "supplied_shares", "drawn_shares", "premium_shares", "premium_offset_ray", "index_at", "total_added_assets", "pool_added_shares"
    )
    joined = joined.withColumn("_made", made)
    value = F.struct(*[F.col(f"_made.{n}").cast(w.DEC).alias(n) for n in AMOUNTS], F.col("index_at").alias("drawn_index"), F.col("_made.premium_ray").alias("premium_ray"), "at")
    reason = F.when(F.col("underlying").isNull() & F.col("index_at").isNull() & F.col("_why").isNull(), "unknown reserve").otherwise(F.coalesce("_why", "_made.reason"))
    asset = F.when(F.col("underlying").isNotNull(), F.struct("hub", "asset_id", "underlying", "decimals"))
    joined = joined.withColumn("asset", asset).withColumn("value", F.when(F.col("_made.reason").isNull(), value))
    return joined.withColumn("unvalued", F.when(F.col("_made.reason").isNotNull(), reason)).select(*positions.columns, "asset", "value", "unvalued")
