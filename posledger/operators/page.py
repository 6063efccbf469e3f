"""Serving: keyset pages, labels, prices, scaled amounts and freshness stamps."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wideint as w
from .folds import hub_assets_current, open_positions, positions_current, reserves_current
from .valuation import asset_at, sized, value_positions

# The service's bounds.
DEFAULT_LIMIT, MOST_LIMIT = 50, 200
EARLIEST, LATEST = 1_774_277_159, 4_102_444_800
STALE_SYNC, STALE_PRICE = 60, 300
ADDRESS = re.compile("^0x[0-9a-fA-F]{40}$")


def _address(value: str | None) -> str | None:
    if value is not None and not ADDRESS.match(value):
        raise ValueError(f"not an address: {value}")
    return value and value.lower()


def instant(as_of: int | None = None) -> int:
    """The one instant of a page: now, or one asked for, within bounds."""
    if as_of is None:
        return int(time.time())
    if not EARLIEST <= as_of <= LATEST:
        raise ValueError(f"as_of must be {EARLIEST}..{LATEST}")
    return as_of


def views(spoke_ledger: DataFrame, hub_ledger: DataFrame, as_of: int | None = None, until: bool = False) -> dict:
    """What a page is made from, at one instant; with ``until`` from the ledger as it stood then, without later blocks."""
    at = instant(as_of)
    if until:
        spoke_ledger, hub_ledger = (x.where(F.col("block_timestamp") <= at) for x in (spoke_ledger, hub_ledger))
    return {"positions": positions_current(spoke_ledger), "reserves": reserves_current(spoke_ledger), "assets_at": asset_at(hub_assets_current(hub_ledger), at)}


def page_rows(positions: DataFrame, chain: int, user: str, spoke: str | None = None, limit: int = DEFAULT_LIMIT, after: tuple | None = None) -> DataFrame:
    """``limit + 1`` open positions of a wallet after a key, in numeric order; the extra row tells that there is a next page."""
    if not 1 <= limit <= MOST_LIMIT:
        raise ValueError(f"limit must be 1..{MOST_LIMIT}")
    own = open_positions(positions).where((F.col("chain_id") == chain) & (F.col("user") == _address(user)))
    if spoke is not None:
        own = own.where(F.col("spoke") == _address(spoke))
    if after is not None:
        own = own.where(F.struct("spoke", "reserve_id") > F.struct(F.lit(_address(after[0])).alias("spoke"), F.lit(int(after[1])).cast("long").alias("reserve_id")))
    return own.orderBy("spoke", "reserve_id").limit(limit + 1)


def first_of(rows: DataFrame, limit: int) -> DataFrame:
    """The page itself, and on each row the key to resume from (null on the last page)."""
    order = Window.orderBy("spoke", "reserve_id")
    numbered = rows.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    key = F.struct(F.col("spoke"), F.col("reserve_id"))
    last = F.max(F.when(F.col("_n") == limit, key)).over(Window.partitionBy())
    return numbered.withColumn("next_key", F.when(F.col("_all") > limit, last)).where(F.col("_n") <= limit).drop("_n", "_all")


def latest_snapshot(rows: DataFrame, keys: list, at: str = "fetched_at") -> DataFrame:
    """Last write wins per key over appended snapshots; of equal times the row that is largest by its columns in order of their names."""
    ties = [F.col(c).desc_nulls_last() for c in sorted(rows.columns) if c not in (*keys, at)]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc(), *ties))
    return rows.withColumn("_n", turn).where("_n = 1").drop("_n")


def valid_prices(rows: DataFrame) -> DataFrame:
    """A price that is not above zero, or a malformed Spoke, is refused and leaves the older one."""
    return rows.where((F.col("price") > 0) & F.col("spoke").rlike("^0x[0-9a-f]{40}$"))


def label_gap(listed: DataFrame, labels: DataFrame, force: bool = False) -> DataFrame:
    """Listed tokens never asked about; a known token without a label is no gap. Forced: all."""
    if force:
        return listed
    known = labels.select("chain_id", F.col("token").alias("underlying"))
    return listed.join(known, ["chain_id", "underlying"], "left_anti")


def decimals_audit(hub_assets: DataFrame, labels: DataFrame) -> DataFrame:
    """Assets whose pool has other decimals than the token itself reports."""
    token = labels.select("chain_id", F.col("token").alias("underlying"), "token_decimals")
    return hub_assets.join(token, ["chain_id", "underlying"]).where("token_decimals <> decimals")


def enrich(valued: DataFrame, labels: DataFrame, prices: DataFrame, as_of: int | None = None) -> DataFrame:
    """Labels and dollar values as exact decimal strings; with an explicit instant, the one ``views`` was given, there are no prices at all."""
    names = labels.select("chain_id", F.col("token").alias("_token"), "symbol", "name")
    df = valued.withColumn("_token", F.col("asset.underlying")).join(sized(names), ["chain_id", "_token"], "left").drop("_token")
    rates = prices.select("chain_id", "spoke", "reserve_id", F.col("price").alias("_price"), "priced_at")
    df = df.join(sized(rates), ["chain_id", "spoke", "reserve_id"], "left")
    used = F.col("asset").isNotNull() & F.col("value").isNotNull() & F.lit(as_of is None)
    price, n = F.when(used, F.col("_price")), F.col("asset.decimals")

    def usd(amount: Column) -> Column:
        return F.when(price.isNotNull(), w.to_decimal(w.value_wide(amount, n, price), F.lit(w.VALUE_DIGITS)))

    def scaled(amount: Column) -> Column:
        return F.when(F.col("asset").isNotNull(), w.to_decimal(amount, n))

    value = F.col("value")
    return df.select(
        *[c for c in valued.columns if c not in ("asset", "value")], "symbol", "name", F.col("asset.underlying").alias("underlying"),
        scaled(value["supplied"]).alias("supplied"), scaled(value["total_debt"]).alias("debt"), w.to_decimal(value["premium_ray"], F.lit(w.RAY_DIGITS)).alias("premium"),
        w.to_decimal(price, F.lit(w.ORACLE_DIGITS)).alias("price_usd"), usd(value["supplied"]).alias("supplied_usd"), usd(value["total_debt"]).alias("debt_usd"),
        F.when(price.isNotNull(), F.col("priced_at")).alias("priced_at"),
    )


def pricing_stamp(enriched: DataFrame, as_of: int, stale: int = STALE_PRICE) -> DataFrame:
    """Age of the oldest price that a page used; null if it used none."""
    age = F.max(F.lit(as_of).cast("long") - F.col("priced_at"))
    return enriched.agg(age.alias("oldest_age")).withColumn("stale", F.col("oldest_age") > stale)


def sync_stamp(cursor: DataFrame, chain: int, as_of: int, stale: int = STALE_SYNC) -> DataFrame:
    """Freshness of a chain; a chain that is not indexed is an error and no empty page."""
    own = cursor.where(F.col("chain_id") == chain)
    if own.isEmpty():
        raise ValueError(f"chain {chain} is not indexed")
    age = F.lit(as_of).cast("long") - F.col("updated_at")
    return own.select("chain_id", "last_block", "last_hash", age.alias("age"), (age > stale).alias("stale"))


def positions_page(views: dict, chain: int, user: str, spoke: str | None = None, limit: int = DEFAULT_LIMIT, after: tuple | None = None) -> DataFrame:
    """One wallet's page: positions, registry and assets at one instant are in ``views``; the limit comes before the joins."""
    rows = first_of(page_rows(views["positions"], chain, user, spoke, limit, after), limit)
    return value_positions(rows, views["reserves"], views["assets_at"]).orderBy("spoke", "reserve_id")


def value_all(views: dict) -> DataFrame:
    """Every open position valued, in one plan."""
    return value_positions(open_positions(views["positions"]), views["reserves"], views["assets_at"])


def listing(spoke_ledger: DataFrame, hub_ledger: DataFrame, labels: DataFrame, prices: DataFrame, as_of: int | None = None) -> DataFrame:
    """Every open position, valued and labelled, now and with prices, or at an explicit instant and without: one argument decides both."""
    return enrich(value_all(views(spoke_ledger, hub_ledger, as_of)), labels, prices, as_of)
