"""Landed contract logs: scan, timestamps, and decoding of ABI words.

The words that an event's fields need are cut out by column expressions; those that are numbers become
decimal text in one Arrow function, since 256 bits are more than Spark's exact types hold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import wideint as w
from . import files

RAW_LOG = "chain_id int, address string, topics array<string>, data string, block_number long, block_timestamp long, block_hash string, tx_hash string, tx_index int, log_index int"

# The decoded events, their fields in order as (path in the body, type), and how many are indexed.
U, I, A, B = "uint", "int", "address", "bool"
PREMIUM = [("premiumDelta.sharesDelta", I), ("premiumDelta.offsetRayDelta", I), ("premiumDelta.restoredPremiumRay", U)]
SPOKE_EVENTS = {
    "Supply": (3, [("reserveId", U), ("caller", A), ("user", A), ("suppliedShares", U), ("suppliedAmount", U)]),
    "Withdraw": (3, [("reserveId", U), ("caller", A), ("user", A), ("withdrawnShares", U), ("withdrawnAmount", U)]),
    "Borrow": (3, [("reserveId", U), ("caller", A), ("user", A), ("drawnShares", U), ("drawnAmount", U)]),
    "Repay": (3, [("reserveId", U), ("caller", A), ("user", A), ("drawnShares", U), ("totalAmountRepaid", U), *PREMIUM]),
    "ReportDeficit": (2, [("reserveId", U), ("user", A), ("drawnShares", U), *PREMIUM]),
    "SetUsingAsCollateral": (3, [("reserveId", U), ("caller", A), ("user", A), ("usingAsCollateral", B)]),
    "AddReserve": (3, [("reserveId", U), ("assetId", U), ("hub", A)]),
    "LiquidationCall": (3, [
        ("collateralReserveId", U), ("debtReserveId", U), ("user", A), ("liquidator", A), ("receiveShares", B), ("debtAmountRestored", U), ("drawnSharesLiquidated", U), *PREMIUM,
        ("collateralAmountRemoved", U), ("collateralSharesLiquidated", U), ("collateralSharesToLiquidator", U),
    ]),
}
HUB_EVENTS = {
    "Add": (2, [("assetId", U), ("spoke", A), ("shares", U), ("amount", U)]),
    "Remove": (2, [("assetId", U), ("spoke", A), ("shares", U), ("amount", U)]),
    "Draw": (2, [("assetId", U), ("spoke", A), ("drawnShares", U), ("drawnAmount", U)]),
    "Restore": (2, [("assetId", U), ("spoke", A), ("drawnShares", U), *PREMIUM, ("drawnAmount", U), ("premiumAmount", U)]),
    "ReportDeficit": (2, [("assetId", U), ("spoke", A), ("drawnShares", U), *PREMIUM, ("deficitAmountRay", U)]),
    "EliminateDeficit": (3, [("assetId", U), ("callerSpoke", A), ("coveredSpoke", A), ("shares", U), ("deficitAmountRay", U)]),
    "MintFeeShares": (2, [("assetId", U), ("feeReceiver", A), ("shares", U), ("assets", U)]),
    "Sweep": (2, [("assetId", U), ("reinvestmentController", A), ("amount", U)]),
    "Reclaim": (2, [("assetId", U), ("reinvestmentController", A), ("amount", U)]),
    "RefreshPremium": (2, [("assetId", U), ("spoke", A), *PREMIUM]),
    "UpdateAsset": (1, [("assetId", U), ("drawnIndex", U), ("drawnRate", U), ("accruedFees", U)]),
    "UpdateAssetConfig": (1, [("assetId", U), ("config.feeReceiver", A), ("config.liquidityFee", U), ("config.irStrategy", A), ("config.reinvestmentController", A)]),
    "AddAsset": (2, [("assetId", U), ("underlying", A), ("decimals", U)]),
}


#: Blocks of one folder of landed logs.
SPAN = 1_000_000
LANDED = f"{RAW_LOG}, topic0 string"


def land_logs(logs: DataFrame, path: str, span: int = SPAN) -> None:
    """Add logs to a landed table: folders of chain and ``span`` blocks, files in the order of address, event and block.

    Addresses are written in lower case, and the first topic as a column of its own (null for an anonymous log), so that a scan's
    conditions on both are ones on columns and reach the files' statistics. The span is written down with the table; another
    one is refused. A range of blocks with many logs is dealt over several files. What lands twice is there twice.
    """
    spark = logs.sparkSession
    told = files.pointer(spark, f"{path}/_span")
    if told is None:
        files.publish(spark, f"{path}/_span", {"span": span})
    elif told["span"] != span:
        raise ValueError(f"the table has a span of {told['span']} blocks")
    rows = logs.withColumn("address", F.lower("address")).withColumn("topic0", F.lower(F.get("topics", F.lit(0))))
    kept = [c.split()[0] for c in LANDED.split(", ")]
    rows = rows.select(*kept, F.col("chain_id").alias("chain"), F.floor(F.col("block_number") / span).cast("long").alias("blocks")).hint("rebalance", "chain", "blocks")
    rows.sortWithinPartitions("chain", "blocks", "address", "topic0", "block_number").write.mode("append").partitionBy("chain", "blocks").parquet(path)


def raw_logs(spark, path: str, chain: int, addresses: list, topic0: list, lo: int, hi: int) -> DataFrame:
    """Logs of a chain, of some addresses in any case, with any of the first topics (all if none is given), in an inclusive block range.

    Only folders of the range are listed in the plan; addresses, topics and blocks are filters of the files. No address gives
    no log, and a table that nothing was landed in has none.
    """
    told = files.pointer(spark, f"{path}/_span")
    columns = [c.split()[0] for c in RAW_LOG.split(", ")]
    if told is None or not [x for x in files.names(spark, path) if x.startswith("chain=")]:
        return spark.createDataFrame([], RAW_LOG)
    span = told["span"]
    logs = spark.read.schema(f"{LANDED}, chain int, blocks long").parquet(path)
    logs = logs.where((F.col("chain") == chain) & F.col("blocks").between(lo // span, hi // span))
    logs = logs.where(F.col("block_number").between(lo, hi) & F.col("address").isin([a.lower() for a in addresses]))
    return (logs.where(F.col("topic0").isin([t.lower() for t in topic0])) if topic0 else logs).select(*columns)


def fill_timestamps(logs: DataFrame, headers: DataFrame) -> DataFrame:
    """A log without a time takes its block's; one that cannot be resolved is an error."""
    times = headers.select("chain_id", "block_number", F.col("block_timestamp").alias("_time"))
    df = logs.join(times, ["chain_id", "block_number"], "left")
    time = F.coalesce("block_timestamp", "_time", F.raise_error(F.lit("no timestamp for a log's block")).cast("long"))
    return df.withColumn("block_timestamp", time).drop("_time").select(*logs.columns)


def _words() -> Column:
    """All words of a log, topics after the first and then data, as 64 lower-case digits; null where it is none."""
    topics = F.transform(F.expr("slice(topics, 2, greatest(0, size(topics) - 1))"), lambda t: F.lower(F.substring(t, 3, 64)))
    n = F.greatest(F.lit(0), ((F.length("data") - 2) / 64).cast("int"))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    data = F.transform(places, lambda k: F.lower(F.substr(F.col("data"), k * 64 - 61, F.lit(64))))
    return F.transform(F.concat(topics, data), lambda w: F.when(w.rlike("^[0-9a-f]{64}$"), w))


@F.pandas_udf(ArrayType(StringType()))
def _numbers(words: pd.Series, kinds: pd.Series) -> pd.Series:
    """The decimal text of each word whose kind is u (unsigned) or i (two's complement); null for the others."""

    def text(word, kind):
        if word is None or kind not in "ui":
            return None
        x = int(word, 16)
        return str(x - (1 << 256) if kind == "i" and x >> 255 else x)

    return pd.Series([[text(w, k) for w, k in zip(row, code.ljust(len(row)))] for row, code in zip(words, kinds)], dtype=object)


def _body(spec: tuple) -> Column:
    indexed, fields = spec
    tree: dict = {}
    for k, (path, kind) in enumerate(fields):
        # the words of the topics come first, so a log with too few topics has its data words out of place
        word, number = F.get("_words", F.lit(k)), F.get("_numbers", F.lit(k))
        has = (F.size("topics") == indexed + 1) & word.isNotNull()
        value = {U: number, I: number, A: F.concat(F.lit("0x"), F.substring(word, 25, 40)), B: word != "0" * 64}[kind]
        *outer, name = path.split(".")
        place = tree.setdefault(outer[0], {}) if outer else tree
        place[name] = F.when(has, value).otherwise(F.raise_error(F.lit(f"malformed {path}")).cast("boolean" if kind == B else "string"))
    made = [(F.struct(*[c.alias(n) for n, c in v.items()]) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()]
    return F.to_json(F.struct(*made))


def decode_logs(logs: DataFrame, topic0: dict, contract: str | tuple, events: dict = SPOKE_EVENTS) -> DataFrame:
    """Logs of one contract, or of several that have the same events, to ledger events in one pass; ``topic0`` has the signature hash of each event.

    A log of another address, an anonymous or unknown one, and a malformed word are errors.
    """
    ours = [c.lower() for c in ((contract,) if isinstance(contract, str) else contract)]
    known = {event: spec for event, spec in events.items() if event in topic0}

    def named(first: Column) -> Column:
        found = F.when(F.lit(False), F.lit(""))
        for event in known:
            found = found.when(first == topic0[event].lower(), F.lit(event))
        return found.otherwise(F.raise_error(F.lit("anonymous or unknown log")).cast("string"))

    # a filter on the event is pushed below these columns: the topic is bound, so that it is not made again for each event it is compared with
    name = w.bound(F.lower(F.get("topics", F.lit(0))), named)
    name = F.when(~F.lower("address").isin(ours), F.raise_error(F.lit("log of another contract")).cast("string")).otherwise(name)
    body, code = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for event, spec in known.items():
        kinds = "".join({U: "u", I: "i"}.get(kind, " ") for _, kind in spec[1])
        body, code = body.when(F.col("_name") == event, _body(spec)), code.when(F.col("_name") == event, F.lit(kinds))
    topics = [F.get("topics", F.lit(k)).alias(f"topic{k}") for k in (1, 2, 3)]
    words = logs.withColumn("_name", name).withColumn("_words", _words()).withColumn("_kinds", code.otherwise(F.lit("")))
    return words.withColumn("_numbers", _numbers("_words", "_kinds")).select(
        "chain_id", F.lower("address").alias("address"), "block_number", "log_index", "block_hash", "block_timestamp", "tx_hash", "tx_index",
        F.col("_name").alias("event_name"), *topics, body.alias("body"), "data",
    )


def event_set(logs: DataFrame, topic0: dict) -> DataFrame:
    """Only the logs of the given events: others would be counted twice."""
    return logs.where(F.lower(F.get("topics", F.lit(0))).isin([t.lower() for t in topic0.values()]))
