"""Risk views over valued positions: totals, health, liquidations, prices as of an instant."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as f
from ..functions import wideint as w
from .asof import state_at
from .folds import ORDER
from .ledger import current


WALLET = ("chain_id", "user", "spoke")


def spoke_totals(priced: DataFrame) -> DataFrame:
    """Supplied, debt and net worth per wallet and Spoke, as digits; risk never adds up across Spokes."""
    supplied, debt = (w.limbs(F.col(c).cast("string"), w.VALUE_LIMBS) for c in ("supplied_value", "debt_value"))
    net = [F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)) for a, b in zip(supplied, debt)]
    df = priced.groupBy(*WALLET).agg(*w.sums_wide({"s": supplied, "d": debt, "n": net}))
    return df.select(*WALLET, *[w.joined_sums(n, w.VALUE_LIMBS).alias(c) for n, c in (("s", "supplied_value"), ("d", "debt_value"), ("n", "net_worth"))])


def position_type(collateral: Column, factor_bps: Column) -> Column:
    """borrow if anything is drawn, collateral if it is used as such with a factor, else supply."""
    return F.when(~F.startswith("drawn_shares", F.lit("-")) & (F.col("drawn_shares") != "0"), "borrow").when(collateral & (factor_bps > 0), "collateral").otherwise("supply")


def health_factor(priced: DataFrame) -> DataFrame:
    """floor(sum(factor_bps * collateral) * 1e14 / debt) with 18 decimals, over exact values of any width; null without debt (no bound)."""
    counted = [F.when(F.col("using_as_collateral"), v * F.col("factor_bps").cast("int")).otherwise(0) for v in w.limbs(F.col("supplied_value").cast("string"), w.VALUE_LIMBS)]
    df = priced.groupBy(*WALLET).agg(*w.sums_wide({"w": counted, "d": w.limbs(F.col("debt_value").cast("string"), w.VALUE_LIMBS)}))
    df = df.select(*WALLET, w.joined_sums("w", w.VALUE_LIMBS).alias("weighted"), w.joined_sums("d", w.VALUE_LIMBS).alias("debt_value"))
    debt = F.when(F.col("debt_value") != "0", F.col("debt_value"))
    return df.withColumn("health_factor", w.mul_div_wide("weighted", F.lit(str(10**14)), debt))


health_factor_wide = health_factor


def headroom(health: Column) -> Column:
    """1 - 1 / HF in 18 decimals, floored."""
    return (w.num(10**18) - w.div_up(w.num(10**36), health)).cast(w.DEC)


def liquidation_groups(ledger: DataFrame) -> DataFrame:
    """Liquidation legs of one wallet in one transaction."""
    rows = ledger.where("event_name = 'LiquidationCall'").select("chain_id", "tx_hash", F.lower(F.get_json_object("body", "$.user")).alias("user"), "sign")
    return rows.groupBy("chain_id", "tx_hash", "user").agg(F.sum("sign").alias("calls")).where("calls > 0")


def derived_price(feed: Column, ratio: Column, cap: Column) -> Column:
    """min(feed * ratio / 1e18, cap)."""
    return F.least(w.mul_div_down(feed, ratio, w.num(10**18)), w.num(cap))


def price_as_of(wanted: DataFrame, steps: DataFrame, bucket: int = 3600) -> DataFrame:
    """The last step at or before each wanted instant, per asset.

    Steps are carried into the time buckets: a wanted row looks at its own bucket and, where that has no earlier step, at the
    last one of an earlier bucket, found by a running maximum over bucket ends. No pair of rows is made but the matching.
    """
    from pyspark.sql import Window

    both = wanted.select("asset_id", F.col("at").alias("t"), F.lit(1).alias("ask"), F.lit(None).cast(w.DEC).alias("p"), *[c for c in wanted.columns if c not in ("asset_id", "at")])
    both = both.unionByName(steps.select("asset_id", F.col("from_time").alias("t"), F.lit(0).alias("ask"), F.col("price").cast(w.DEC).alias("p")), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.col("t") / bucket))
    ends = both.where("ask = 0").groupBy("asset_id", "_b").agg(F.max_by("p", "t").alias("_end"))
    grid = both.select("asset_id", "_b").distinct().join(ends, ["asset_id", "_b"], "left")
    past = Window.partitionBy("asset_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.withColumn("_before", F.last("_end", ignorenulls=True).over(past)).drop("_end")
    inside = Window.partitionBy("asset_id", "_b").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    df = both.withColumn("_own", F.last("p", ignorenulls=True).over(inside)).join(carried, ["asset_id", "_b"])
    rest = [c for c in wanted.columns if c not in ("asset_id", "at")]
    return df.where("ask = 1").select("asset_id", F.col("t").alias("at"), *rest, F.coalesce("_own", "_before").alias("price"))


def deviation(df: DataFrame, oracle: str, market: str) -> DataFrame:
    """|oracle - market| in basis points of the market price, floored."""
    return df.withColumn("deviation_bps", w.div_down(w.mul(F.abs(F.col(oracle) - F.col(market)), w.num(w.BPS)), w.num(F.col(market))))


def largest_positions(positions: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` largest by a column of digits."""
    digits, less = F.regexp_replace(F.col(column), "^-", ""), F.startswith(column, F.lit("-"))
    size = F.when(less, -F.length(digits)).otherwise(F.length(digits))
    below = F.when(less, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    return positions.orderBy(size.desc(), below.desc(), "user", "spoke", "reserve_id").limit(n)


PLACE = 10**10


def config_events(ledger: DataFrame) -> DataFrame:
    """Live risk configurations: (chain_id, spoke, reserve_id, config_key, factor_bps) with their place in the chain."""
    rows = f.parsed(ledger.where("event_name IN ('AddDynamicReserveConfig', 'UpdateDynamicReserveConfig')"), "reserveId", "dynamicConfigKey", "config.collateralFactor")
    rows = rows.select(
        "chain_id", F.lower("address").alias("spoke"), f.whole("reserveId").alias("reserve_id"), f.whole("dynamicConfigKey").alias("config_key"),
        f.small("config.collateralFactor", 10_000).cast("int").alias("factor_bps"), "event_name", *ORDER, "version", "sign",
    )
    return current(rows, ("spoke", "reserve_id", "config_key")).withColumn("place", F.col("block_number") * PLACE + F.col("log_index"))


def pins(ledger: DataFrame) -> DataFrame:
    """Where in the chain each position was pinned last: at a refresh of its own or of all of its wallet, else at its first event.

    A refresh of all is joined with the wallet's positions; both sides are one row per wallet and Spoke, or per position, before they meet.
    """
    read = f.parsed(ledger.where("event_name IN ('RefreshAllUserDynamicConfig', 'RefreshSingleUserDynamicConfig', 'Supply', 'Borrow', 'SetUsingAsCollateral')"), "user", "reserveId")
    rows = current(read.select("chain_id", f.address("user").alias("user"), F.lower("address").alias("spoke"), f.text("reserveId").cast("long").alias("reserve_id"), "event_name", *ORDER, "version", "sign"))
    rows = rows.withColumn("place", F.col("block_number") * PLACE + F.col("log_index"))
    whole = rows.where("event_name = 'RefreshAllUserDynamicConfig'").groupBy("chain_id", "user", "spoke").agg(F.max("place").alias("_all"))
    one = F.max(F.when(F.col("event_name") == "RefreshSingleUserDynamicConfig", F.col("place"))).alias("_one")
    first = F.min(F.when(F.col("event_name").isin("Supply", "Borrow", "SetUsingAsCollateral"), F.col("place"))).alias("_first")
    own = rows.where("event_name <> 'RefreshAllUserDynamicConfig'").groupBy(*WALLET, "reserve_id").agg(one, first)
    met = own.join(whole, list(WALLET), "left")
    later = F.greatest("_one", F.when(F.col("_all") >= F.coalesce("_first", F.col("_all")), F.col("_all")))
    return met.select(*WALLET, "reserve_id", F.coalesce(later, F.col("_first")).alias("place"))


def pinned_factors(ledger: DataFrame, bucket: int = 1000 * PLACE) -> DataFrame:
    """Per position the configuration it is pinned to and that key's factor as it is now.

    The key is the last that its reserve got before the pin, found as of it; a key that is updated keeps its number, so what
    is pinned to it follows, and later keys leave it alone. Without a configuration before the pin both are null.
    """
    configs = config_events(ledger)
    added = configs.where("event_name = 'AddDynamicReserveConfig'").select("chain_id", "spoke", "reserve_id", "place", "config_key")
    at = state_at(pins(ledger), added, ("chain_id", "spoke", "reserve_id"), "place", latest=("config_key",), bucket=bucket)
    now = configs.groupBy("chain_id", "spoke", "reserve_id", "config_key").agg(F.max_by("factor_bps", "place").alias("factor_bps"))
    return at.drop("place").join(now, ["chain_id", "spoke", "reserve_id", "config_key"], "left").select(*WALLET, "reserve_id", "config_key", "factor_bps")


#: A century; a wallet that interest alone doesn't end in this time has no time to liquidation.
HORIZON = 100 * w.YEAR_SECONDS


def _first_second(weighted: int, debts: list) -> int | None:
    """The first second at which 10,000 times the debts' value exceeds the weighted collateral; value never falls with time."""

    def under(seconds: int) -> bool:
        total = 0
        for drawn, premium, index, rate, decimals, price in debts:
            grown = -(-index * (w.RAY + rate * seconds // w.YEAR_SECONDS) // w.RAY) if seconds else index
            owed = -(-drawn * grown // w.RAY) + premium
            total += owed * price * 10 ** (18 - decimals) if decimals <= 18 else owed * price // 10 ** (decimals - 18)
        return total * w.BPS > weighted

    if not under(HORIZON):
        return None
    low, high = -1, HORIZON  # not under at low, under at high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if under(middle) else (middle, high)
    return high


DEBT = ("drawn_shares", "premium_debt", "index", "rate", "decimals", "price")


def time_to_liquidation(debts: DataFrame, weighted: DataFrame) -> DataFrame:
    """Per wallet the first second from now, prices and premium standing still, at which its health is under one.

    ``debts`` has a row per debt with ``DEBT`` (index as it is now, rate per year, both in ray), ``weighted`` the sum of factor times
    collateral value of each wallet (``health_factor``'s ``weighted``). Zero: it is under one now. Null: not within ``HORIZON``, or
    something is not known. A wallet's debts are gathered; there are at most as many as its Spoke has reserves.
    """
    listed = debts.groupBy(*WALLET).agg(F.collect_list(F.struct(*[F.col(c).cast("string").alias(c) for c in DEBT])).alias("debts"))

    @F.pandas_udf("long")
    def search(weight: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for have, many in zip(weight, rows):
            owed = [[row[c] for c in DEBT] for row in many]
            known = have is not None and all(x is not None for row in owed for x in row)
            out.append(_first_second(int(have), [[int(x) for x in row] for row in owed]) if known else None)
        return pd.Series(out, dtype="Int64")

    df = listed.join(weighted.select(*WALLET, F.col("weighted").cast("string").alias("weighted")), list(WALLET), "left")
    return df.select(*WALLET, search(F.coalesce("weighted", F.lit("0")), "debts").alias("seconds"))
