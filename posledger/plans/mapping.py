"""Ledgers, headers and side tables derived from the driver's tables, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T0 = 1_785_000_000
CHAIN = 1
HUB = "0x" + "c" * 40
SPOKES = ("0x" + "9" * 40, "0x" + "a" * 40)
#: A block range that is retracted and dispatched again in the reorganisation queries.
LO, HI = 300, 500
HUB_EVENTS = ("Add", "Remove", "Draw", "Restore", "ReportDeficit", "EliminateDeficit", "MintFeeShares", "Sweep", "Reclaim", "RefreshPremium", "UpdateAsset", "UpdateAssetConfig", "AddAsset")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(number: str) -> str:
    return f"concat('0x', lpad(lower(hex({number})), 40, '0'))"


def spoke_base(spark, sf_dir: str) -> DataFrame:
    """The numbers behind the Spoke events: a row per event."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.selectExpr(
        "event_id", "event_type", "event_id div 10 AS block_number", "cast(event_id % 10 AS int) AS log_index", "unix_timestamp(ts) AS block_timestamp", "k", "user_id",
        f"{address('user_id')} AS user", f"if(user_id % 2 = 0, '{SPOKES[0]}', '{SPOKES[1]}') AS spoke", "k % 14 AS reserve_id", "cast(round(value * 100) AS bigint) AS s",
    )


def _event(df: DataFrame, name, body, address) -> DataFrame:
    return df.select(
        F.lit(CHAIN).alias("chain_id"), address.alias("address"), "block_number", "log_index", "block_timestamp",
        F.concat(F.lit("0xt"), F.col("block_number").cast("string")).alias("tx_hash"), name.alias("event_name"), body.alias("body"),
    )


def _json(**fields) -> str:
    parts = [f"'{k}', {v if k in ('usingAsCollateral', 'receiveShares', 'premiumDelta', 'config', 'decimals') else f'cast({v} AS string)'}" for k, v in fields.items()]
    return f"to_json(named_struct({', '.join(parts)}))"


def _premium(shares: str, offset: str) -> str:
    return f"named_struct('sharesDelta', cast({shares} AS string), 'offsetRayDelta', cast({offset} AS string))"


def spoke_events(spark, sf_dir: str) -> DataFrame:
    """view: Supply, click: Withdraw, purchase: Borrow, error: Repay, signup: SetUsingAsCollateral."""
    key = {"reserveId": "reserve_id", "caller": "user", "user": "user"}
    body = F.expr(
        "CASE event_type"
        f" WHEN 'view' THEN {_json(**key, suppliedShares='s', suppliedAmount='s + 7')}"
        f" WHEN 'click' THEN {_json(**key, withdrawnShares='s div 4', withdrawnAmount='s div 5')}"
        f" WHEN 'purchase' THEN {_json(**key, drawnShares='s div 2', drawnAmount='s div 2 + 1')}"
        f" WHEN 'error' THEN {_json(**key, drawnShares='s div 8', totalAmountRepaid='s div 8 + 3', premiumDelta=_premium('s div 16', '-s'))}"
        f" ELSE {_json(**key, usingAsCollateral='event_id % 2 = 1')} END"
    )
    name = F.expr("CASE event_type WHEN 'view' THEN 'Supply' WHEN 'click' THEN 'Withdraw' WHEN 'purchase' THEN 'Borrow' WHEN 'error' THEN 'Repay' ELSE 'SetUsingAsCollateral' END")
    return _event(spoke_base(spark, sf_dir), name, body, F.col("spoke"))


def liquidations(spark, sf_dir: str) -> DataFrame:
    """Every purchase as a liquidation of its wallet by the next one."""
    body = _json(
        collateralReserveId="reserve_id", debtReserveId="(k + event_id) % 14", user="user", liquidator=address("user_id + 1"), receiveShares="event_id % 2 = 0",
        debtAmountRestored="s div 2 + 1", drawnSharesLiquidated="s div 2", premiumDelta=_premium("s div 10", "-(s div 5)"),
        collateralAmountRemoved="s + 1", collateralSharesLiquidated="s", collateralSharesToLiquidator="s div 3",
    )
    return _event(spoke_base(spark, sf_dir).where("event_type = 'purchase'"), F.lit("LiquidationCall"), F.expr(body), F.col("spoke"))


def reserves(spark, sf_dir: str) -> DataFrame:
    """AddReserve for each signup: reserve to asset, the later one of a reserve winning."""
    body = _json(reserveId="reserve_id", assetId="(reserve_id + event_id % 3) % 17", hub=f"'{HUB}'")
    return _event(spoke_base(spark, sf_dir).where("event_type = 'signup'"), F.lit("AddReserve"), F.expr(body), F.col("spoke"))


def hub_base(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderkey div 10 AS block_number", "cast(o_orderkey % 10 AS int) AS log_index", f"{T0} + o_orderkey div 10 AS block_timestamp",
        "o_custkey % 17 AS asset_id", "o_orderkey % 13 AS kind", "cast(round(o_totalprice * 100) AS bigint) AS v",
    )


def hub_events(spark, sf_dir: str) -> DataFrame:
    """An order is one of the 13 pool events, by its key; inflows exceed outflows so that balances stay positive."""
    index = "cast(cast(1000000000000000000000000000 AS decimal(38,0)) + cast(id AS decimal(38,0)) * 100000000000000000000 AS string)"
    bodies = [
        _json(assetId="asset_id", shares="v * 9", amount="v * 10"), _json(assetId="asset_id", shares="v", amount="v"),
        _json(assetId="asset_id", drawnShares="v", drawnAmount="v + 2"),
        _json(assetId="asset_id", drawnShares="v div 4", premiumDelta=_premium("v div 50", "concat('-', v, '00000')"), drawnAmount="v div 4", premiumAmount="v div 100"),
        _json(assetId="asset_id", drawnShares="v div 8", premiumDelta=_premium("v div 60", "concat('-', v, '000')"), deficitAmountRay="concat(v, '000000000000000000')"),
        _json(assetId="asset_id", shares="v div 9", deficitAmountRay="concat(v, '00000000000000000')"),
        _json(assetId="asset_id", shares="v div 20"), _json(assetId="asset_id", amount="v div 3"), _json(assetId="asset_id", amount="v div 6"),
        _json(assetId="asset_id", premiumDelta=_premium("v div 70", "concat('-', v, '00')")),
        _json(assetId="asset_id", drawnIndex=index, drawnRate="concat(id % 90 + 10, '000000000000000000000000')", accruedFees="v div 1000"),
        _json(assetId="asset_id", config="named_struct('liquidityFee', id % 3000)"),
        _json(assetId="asset_id", underlying=address("asset_id + 1"), decimals="6 + asset_id % 13"),
    ]
    body = "CASE kind " + " ".join(f"WHEN {k} THEN {b}" for k, b in enumerate(bodies)) + " END"
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(HUB_EVENTS)) + " END"
    return _event(hub_base(spark, sf_dir), F.expr(name), F.expr(body), F.lit(HUB))


def headers(spark, sf_dir: str, branch: str = "a", fork: int | None = None) -> DataFrame:
    """A header per order key; above ``fork`` the hashes are another branch's."""
    tag = "o_orderkey" if fork is None else f"o_orderkey, if(o_orderkey > {fork}, '{branch}', 'a')"
    own = f"md5(concat({tag if fork is not None else 'o_orderkey, ' + repr('a')}))"
    above = f"md5(concat(o_orderkey - 1, {repr('a') if fork is None else f'if(o_orderkey - 1 > {fork}, {branch!r}, {chr(39)}a{chr(39)})'}))"
    return table(spark, sf_dir, "orders").selectExpr(f"{CHAIN} AS chain_id", "o_orderkey AS block_number", f"{own} AS hash", f"{above} AS parent_hash", f"{T0} + o_orderkey AS block_timestamp")


def label_rows(spark, sf_dir: str) -> DataFrame:
    """Labels per asset, a snapshot per part; some assets were never asked about, some have none."""
    p = table(spark, sf_dir, "part").where("p_partkey % 17 NOT IN (3, 11)")
    return p.selectExpr(
        f"{CHAIN} AS chain_id", f"{address('p_partkey % 17 + 1')} AS token", "if(p_partkey % 17 = 5, null, p_brand) AS symbol", "p_name AS name",
        "if(p_partkey % 17 = 6, null, cast(6 + (p_partkey % 17 + if(p_partkey % 17 IN (2, 9), 1, 0)) % 13 AS int)) AS token_decimals", "p_partkey AS fetched_at",
    )


def price_snapshots(spark, sf_dir: str) -> DataFrame:
    """Prices per Spoke and reserve with 8 decimals, a snapshot per part; some are refused, reserve 13 has none."""
    p = table(spark, sf_dir, "part").where("p_partkey % 14 <> 13")
    refused = "cast(round(p_retailprice * 100) AS bigint) % 7 = 3"
    return p.selectExpr(
        f"{CHAIN} AS chain_id", f"if(p_partkey % 28 < 14, '{SPOKES[0]}', '{SPOKES[1]}') AS spoke", "p_partkey % 14 AS reserve_id",
        f"cast(if({refused}, 0, round(p_retailprice * 100) * 1000000) AS decimal(38,0)) AS price", f"{T0} + p_partkey AS priced_at",
    )


def sql_address(number: str) -> str:
    return f"('0x' || lpad(lower(hex({number})), 40, '0'))"


SP = f"""sp AS (SELECT event_id, event_type, event_id // 10 AS b, event_id % 10 AS l, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  {sql_address('user_id')} AS usr, CASE WHEN user_id % 2 = 0 THEN '{SPOKES[0]}' ELSE '{SPOKES[1]}' END AS spoke,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 14 AS r, CAST(round(value * 100) AS BIGINT) AS s FROM events),
spd AS (SELECT *, CASE event_type WHEN 'view' THEN s WHEN 'click' THEN -(s // 4) ELSE 0 END AS sup, CASE event_type WHEN 'purchase' THEN s // 2 WHEN 'error' THEN -(s // 8) ELSE 0 END AS dr,
  CASE event_type WHEN 'error' THEN s // 16 ELSE 0 END AS pr, CASE event_type WHEN 'error' THEN -s ELSE 0 END AS po, CASE event_type WHEN 'view' THEN s + 7 WHEN 'click' THEN -(s // 5) ELSE 0 END AS ns,
  CASE event_type WHEN 'purchase' THEN s // 2 + 1 WHEN 'error' THEN -(s // 8 + 3) ELSE 0 END AS nb, CASE event_type WHEN 'signup' THEN event_id % 2 = 1 END AS flag,
  CASE event_type WHEN 'signup' THEN 0 ELSE 1 END AS ev FROM sp)"""

HB = f"""hb AS (SELECT o_orderkey AS id, o_orderkey // 10 AS b, o_custkey % 17 AS a, o_orderkey % 13 AS kind, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS HUGEINT) AS v FROM orders),
hs AS (SELECT a, CAST(sum(CASE kind WHEN 0 THEN v * 10 WHEN 1 THEN -v WHEN 2 THEN -(v + 2) WHEN 3 THEN v // 4 + v // 100 WHEN 7 THEN -(v // 3) WHEN 8 THEN v // 6 ELSE 0 END) AS HUGEINT) AS liq,
  CAST(sum(CASE kind WHEN 0 THEN v * 9 WHEN 1 THEN -v WHEN 5 THEN -(v // 9) WHEN 6 THEN v // 20 ELSE 0 END) AS HUGEINT) AS added,
  CAST(sum(CASE kind WHEN 2 THEN v WHEN 3 THEN -(v // 4) WHEN 4 THEN -(v // 8) ELSE 0 END) AS HUGEINT) AS dr,
  CAST(sum(CASE kind WHEN 3 THEN v // 50 WHEN 4 THEN v // 60 WHEN 9 THEN v // 70 ELSE 0 END) AS HUGEINT) AS pr,
  CAST(sum(CASE kind WHEN 3 THEN -v * 100000 WHEN 4 THEN -v * 1000 WHEN 9 THEN -v * 100 ELSE 0 END) AS HUGEINT) AS po,
  CAST(sum(CASE kind WHEN 4 THEN v * 1000000000000000000 WHEN 5 THEN -v * 100000000000000000 ELSE 0 END) AS HUGEINT) AS de,
  CAST(sum(CASE kind WHEN 7 THEN v // 3 WHEN 8 THEN -(v // 6) ELSE 0 END) AS HUGEINT) AS sw, count(*) FILTER (WHERE kind < 10) AS ev,
  arg_max(CASE WHEN kind = 10 THEN 1000000000000000000000000000::HUGEINT + id::HUGEINT * 100000000000000000000::HUGEINT END, id) AS ix,
  arg_max(CASE WHEN kind = 10 THEN (id % 90 + 10)::HUGEINT * 1000000000000000000000000::HUGEINT END, id) AS rate,
  arg_max(CASE WHEN kind = 10 THEN v // 1000 END, id) AS fees, arg_max(CASE WHEN kind = 10 THEN {T0} + b END, id) AS ts,
  arg_max(CASE WHEN kind = 11 THEN CAST(id % 3000 AS INTEGER) END, id) AS fee, arg_max(CASE WHEN kind = 12 THEN {sql_address('a + 1')} END, id) AS und,
  arg_max(CASE WHEN kind = 12 THEN CAST(6 + a % 13 AS INTEGER) END, id) AS decs FROM hb GROUP BY a)"""
