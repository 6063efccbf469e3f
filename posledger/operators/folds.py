"""Projections of events to deltas, and the folds of deltas to positions and pool state.

Additive columns are sums of signed deltas over the raw ledger, so a retraction cancels by itself.
Latest-wins columns come from live rows only, ordered by chain order and never by version. Both
halves are unioned and folded by one aggregation, which keeps the key filters of a reader reaching both scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as f
from ..functions.wideint import DEC, LIMB, LIMBS, bound, joined_columns, limb
from .ledger import current

POSITION = ("chain_id", "user", "spoke", "reserve_id")
SUMS = ("supplied_shares", "drawn_shares", "premium_shares", "net_supplied", "net_borrowed", "premium_offset_ray")
ASSET = ("chain_id", "hub", "asset_id")
ASSET_SUMS = ("liquidity", "added_shares", "drawn_shares", "premium_shares", "swept", "premium_offset_ray", "deficit_ray")
STATE = ("drawn_index", "drawn_rate", "realized_fees", "index_timestamp", "liquidity_fee", "underlying", "decimals")
ORDER = ("block_number", "log_index")


def _leg(names: tuple, key: dict, events: int = 1, **delta) -> Column:
    """A delta in digits; what an event does not touch is null, which a sum passes over."""
    parts = [c.alias(k) for k, c in key.items()]
    parts += [delta.get(n, F.lit(None)).cast("string").alias(n) for n in names]
    return F.struct(*parts, F.lit(events).alias("events"))


def _by_event(cases: dict) -> Column:
    """The legs of an event: only the branch of its own name is evaluated, so strict fields of others do not fail."""
    out = None
    for name, legs in cases.items():
        made = F.array(*legs) if isinstance(legs, list) else legs
        out = F.when(F.col("event_name") == name, made) if out is None else out.when(F.col("event_name") == name, made)
    return out


def _signed(df: DataFrame, keys: tuple, names: tuple) -> DataFrame:
    """Deltas by the sign of their row, by limbs of 26 digits.

    A row has the limbs of one ``scale``. What has no longer amount is one row, at scale 0; longer ones are a row per scale.
    """
    long = " OR ".join(f"length({n}) > {LIMB}" for n in names)
    each = df.withColumn("scale", F.expr(f"explode(if({long}, array({', '.join(map(str, range(LIMBS)))}), array(0)))"))
    parts = [f"{limb(n, negative='sign < 0')} AS {n}" for n in names]
    return each.selectExpr(*keys, "scale", *parts, "CAST(if(scale = 0, sign * events, 0) AS long) AS events")


def _sums(names: tuple) -> list[Column]:
    """All scales in one aggregation, as a stream needs it: every row carries a sum per scale and column on."""
    return [F.expr(f"sum(if(scale = {k}, {n}, NULL)) AS {n}_{k}") for n in names for k in range(LIMBS)]


def _sums_of_scale(names: tuple) -> list[Column]:
    """Sums of rows that are grouped by ``scale`` too, a third as many for a row to carry on."""
    return [F.sum(n).alias(n) for n in names]


def _by_scale(names: tuple) -> list[Column]:
    """The sums of the scales, a row each, side by side."""
    return [F.expr(f"max(if(scale = {k}, {n}, NULL)) AS {n}_{k}") for n in names for k in range(LIMBS)]


def _joined(names: tuple) -> list[Column]:
    return [joined_columns(*[f"{n}_{k}" for k in range(LIMBS)]).alias(n) for n in names]


def additive(rows: DataFrame, keys: tuple, names: tuple) -> DataFrame:
    """The additive fold: sums of columns by the sign of their row, and the signed number of rows, combined before the shuffle."""
    return rows.groupBy(*keys).agg(*[F.sum(F.col(n) * F.col("sign")).alias(n) for n in names], F.sum("sign").alias("events"))


PREMIUM = ("premiumDelta.sharesDelta", "premiumDelta.offsetRayDelta")
POSITION_FIELDS = (
    "user", "reserveId", "suppliedShares", "suppliedAmount", "withdrawnShares", "withdrawnAmount", "drawnShares", "drawnAmount", "totalAmountRepaid", *PREMIUM, "liquidator", "collateralReserveId",
    "debtReserveId", "receiveShares", "collateralSharesLiquidated", "collateralAmountRemoved", "drawnSharesLiquidated", "debtAmountRestored", "collateralSharesToLiquidator",
)
ASSET_FIELDS = ("assetId", "shares", "amount", "drawnShares", "drawnAmount", "premiumAmount", *PREMIUM, "deficitAmountRay")


def position_deltas(ledger: DataFrame, carry: tuple = ()) -> DataFrame:
    """A row per touched position, event leg and scale; a liquidation has two or three legs. ``carry`` names columns of the ledger to keep."""

    def leg(user="user", reserve="reserveId", **delta):
        return _leg(SUMS, {"user": f.address(user), "reserve_id": f.whole(reserve)}, **delta)

    plus, less = f.unsigned, lambda path: f.minus(f.unsigned(path))
    premium = {"premium_shares": f.integer("premiumDelta.sharesDelta"), "premium_offset_ray": f.integer("premiumDelta.offsetRayDelta")}
    collateral = leg(reserve="collateralReserveId", supplied_shares=less("collateralSharesLiquidated"), net_supplied=less("collateralAmountRemoved"))
    debt = leg(reserve="debtReserveId", drawn_shares=less("drawnSharesLiquidated"), net_borrowed=less("debtAmountRestored"), **premium)
    liquidator = leg("liquidator", "collateralReserveId", supplied_shares=plus("collateralSharesToLiquidator"))
    cases = {
        "Supply": [leg(supplied_shares=plus("suppliedShares"), net_supplied=plus("suppliedAmount"))],
        "Withdraw": [leg(supplied_shares=less("withdrawnShares"), net_supplied=less("withdrawnAmount"))],
        "Borrow": [leg(drawn_shares=plus("drawnShares"), net_borrowed=plus("drawnAmount"))],
        "Repay": [leg(drawn_shares=less("drawnShares"), net_borrowed=less("totalAmountRepaid"), **premium)],
        "ReportDeficit": [leg(drawn_shares=less("drawnShares"), **premium)],
        "LiquidationCall": F.when(f.boolean("receiveShares"), F.array(collateral, debt, liquidator)).otherwise(F.array(collateral, debt)),
    }
    each = f.parsed(ledger.where(F.col("event_name").isin(*cases)), *POSITION_FIELDS).select("chain_id", F.lower("address").alias("spoke"), "sign", *carry, F.explode(_by_event(cases)).alias("leg"))
    return _signed(each.select("chain_id", "spoke", "sign", *carry, "leg.*"), (*POSITION, *carry), SUMS)


#: What the body of an event has to have, by the kind of its fields.
REQUIRED = {
    "Supply": {f.ID: ("reserveId",), f.UNSIGNED: ("suppliedShares", "suppliedAmount"), f.ANY: ("user",)},
    "Withdraw": {f.ID: ("reserveId",), f.UNSIGNED: ("withdrawnShares", "withdrawnAmount"), f.ANY: ("user",)},
    "Borrow": {f.ID: ("reserveId",), f.UNSIGNED: ("drawnShares", "drawnAmount"), f.ANY: ("user",)},
    "Repay": {f.ID: ("reserveId",), f.UNSIGNED: ("drawnShares", "totalAmountRepaid"), f.INTEGER: PREMIUM, f.ANY: ("user",)},
    "ReportDeficit": {f.ID: ("reserveId",), f.UNSIGNED: ("drawnShares",), f.INTEGER: PREMIUM, f.ANY: ("user",)},
    "LiquidationCall": {
        f.ID: ("collateralReserveId", "debtReserveId"), f.INTEGER: PREMIUM, f.BOOLEAN: ("receiveShares",), f.ANY: ("user",),
        f.UNSIGNED: ("collateralSharesLiquidated", "collateralAmountRemoved", "drawnSharesLiquidated", "debtAmountRestored"),
    },
    "SetUsingAsCollateral": {f.ID: ("reserveId",), f.BOOLEAN: ("usingAsCollateral",), f.ANY: ("user",)},
}


def _faults(body: Column) -> Column:
    """The first field of an event's parsed body that can't be folded; null for a sound body and for events that are not folded."""

    def text(path):
        outer, _, inner = path.partition(".")
        return body[outer][inner] if inner else body[outer]

    out = None
    for event, kinds in REQUIRED.items():
        bad = [F.when(~F.coalesce(text(x).rlike(pattern), F.lit(False)), F.lit(x)) for pattern, paths in kinds.items() for x in paths]
        if event == "LiquidationCall":  # two more where the liquidator takes shares
            more = [F.when(~F.coalesce(text(x).rlike(pattern), F.lit(False)), F.lit(x)) for x, pattern in (("liquidator", f.ANY), ("collateralSharesToLiquidator", f.UNSIGNED))]
            bad.append(F.when(text("receiveShares") == "true", F.coalesce(*more)))
        case = F.coalesce(*bad)
        out = F.when(F.col("event_name") == event, case) if out is None else out.when(F.col("event_name") == event, case)
    return out


def _faulty(ledger: DataFrame) -> DataFrame:
    """The body is parsed inside the fault, once: a filter on the fault is pushed below any column of it, and would parse it for each field."""
    return ledger.withColumn("fault", bound(f.structure(*POSITION_FIELDS, "usingAsCollateral"), _faults))


def poison(ledger: DataFrame) -> DataFrame:
    """The rows of a Spoke's ledger that would stop a fold, with ``fault``, the field that is missing, malformed or beyond 256 bits."""
    return _faulty(ledger).where("fault IS NOT NULL")


def sound(ledger: DataFrame) -> DataFrame:
    """The other rows. A retraction has its row's body, so both are on the same side."""
    return _faulty(ledger).where("fault IS NULL").drop("fault")


def flag_rows(ledger: DataFrame) -> DataFrame:
    """Collateral flags at event grain, signed."""
    return f.parsed(ledger.where("event_name = 'SetUsingAsCollateral'"), "user", "reserveId", "usingAsCollateral").select(
        "chain_id", f.address("user").alias("user"), F.lower("address").alias("spoke"), f.whole("reserveId").alias("reserve_id"),
        f.boolean("usingAsCollateral").alias("flag"), *ORDER, "version", "sign",
    )


def position_flags(ledger: DataFrame) -> DataFrame:
    """Live collateral flags at event grain."""
    return current(flag_rows(ledger), ("user", "spoke", "reserve_id"))


def touching(ledger: DataFrame, user: str) -> DataFrame:
    """The rows of a ledger that name a wallet somewhere in their body, before any body is parsed."""
    return ledger.where(F.contains(F.lower("body"), F.lit(user.lower())))


def _latest(column: str) -> Column:
    """The value of the last row in chain order that has one: max_by alone would return the null of a later row."""
    place = "cast(block_number AS decimal(19,0)) * 10000000000 + log_index"  # one number, so that a hash aggregation can hold it
    return F.expr(f"max_by({column}, {place}) FILTER (WHERE {column} IS NOT NULL)")


def fold_positions(deltas: DataFrame, flags: DataFrame) -> DataFrame:
    """Positions from deltas and live flags, by one aggregation over both; then a position's scales, mostly one, become one row."""
    both = deltas.unionByName(flags.drop("version").withColumn("scale", F.lit(0)), allowMissingColumns=True)
    parts = both.groupBy(*POSITION, "scale").agg(*_sums_of_scale(SUMS), _latest("flag").alias("flag"), F.sum("events").alias("events"))
    folded = parts.groupBy(*POSITION).agg(*_by_scale(SUMS), F.coalesce(F.max("flag"), F.lit(False)).alias("using_as_collateral"), F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("events"))
    return folded.select(*POSITION, *_joined(SUMS), "using_as_collateral", "events")


def positions_current(ledger: DataFrame) -> DataFrame:
    """Positions: six sums as digits, exact for amounts of up to 256 bits, the collateral flag and the signed number of events."""
    return fold_positions(position_deltas(ledger), position_flags(ledger))


def position_rows(ledger: DataFrame) -> DataFrame:
    """What a ledger adds to a stored table of typed deltas: deltas, and flags at event grain, both signed."""
    flags = flag_rows(ledger).withColumnRenamed("sign", "flag_sign")
    return position_deltas(ledger).unionByName(flags, allowMissingColumns=True)


#: The columns of stored deltas.
STORED = (
    "chain_id int, user string, spoke string, reserve_id long, scale int, " + ", ".join(f"{n} decimal(38,0)" for n in SUMS) + ", events long, flag boolean, block_number long, log_index int, version long, flag_sign int"
)


def store_positions(rows: DataFrame, path: str, mode: str = "append", files: int | None = None) -> None:
    """Write typed deltas in ranges of wallets, sorted, so that a reader of one wallet reads its pages only."""
    key = ["user", "spoke", "reserve_id"]
    dealt = rows.repartitionByRange(*([files] if files else []), *key)
    dealt.sortWithinPartitions(*key).write.mode(mode).parquet(path)


def stored_positions(rows: DataFrame) -> DataFrame:
    """The positions of stored deltas; filters on the key reach the scan of both halves."""
    flags = rows.where("flag IS NOT NULL").select(*POSITION, "flag", *ORDER, "version", F.col("flag_sign").alias("sign"))
    deltas = rows.where("flag IS NULL").drop("flag", *ORDER, "version", "flag_sign")
    return fold_positions(deltas, current(flags, ("user", "spoke", "reserve_id")))


def open_positions(positions: DataFrame) -> DataFrame:
    """Unequal to zero and not only above it: a negative fold must stay visible."""
    return positions.where("supplied_shares <> '0' OR drawn_shares <> '0'")


def hub_deltas(ledger: DataFrame, carry: tuple = ()) -> DataFrame:
    def leg(**delta):
        return _leg(ASSET_SUMS, {"asset_id": f.whole("assetId")}, **delta)

    plus, less = f.unsigned, lambda path: f.minus(f.unsigned(path))
    premium = {"premium_shares": f.integer("premiumDelta.sharesDelta"), "premium_offset_ray": f.integer("premiumDelta.offsetRayDelta")}
    cases = {
        "Add": [leg(liquidity=plus("amount"), added_shares=plus("shares"))],
        "Remove": [leg(liquidity=less("amount"), added_shares=less("shares"))],
        "Draw": [leg(liquidity=less("drawnAmount"), drawn_shares=plus("drawnShares"))],
        "Restore": [leg(liquidity=plus("drawnAmount"), drawn_shares=less("drawnShares"), **premium), leg(events=0, liquidity=plus("premiumAmount"))],
        "ReportDeficit": [leg(drawn_shares=less("drawnShares"), deficit_ray=plus("deficitAmountRay"), **premium)],
        "EliminateDeficit": [leg(added_shares=less("shares"), deficit_ray=less("deficitAmountRay"))],
        "MintFeeShares": [leg(added_shares=plus("shares"))],
        "Sweep": [leg(liquidity=less("amount"), swept=plus("amount"))],
        "Reclaim": [leg(liquidity=plus("amount"), swept=less("amount"))],
        "RefreshPremium": [leg(**premium)],
    }
    each = f.parsed(ledger.where(F.col("event_name").isin(*cases)), *ASSET_FIELDS).select("chain_id", F.lower("address").alias("hub"), "sign", *carry, F.explode(_by_event(cases)).alias("leg"))
    return _signed(each.select("chain_id", "hub", "sign", *carry, "leg.*"), (*ASSET, *carry), ASSET_SUMS)


def _plain(digits: Column) -> Column:
    """Digits as they are written: without zeros in front."""
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def hub_state(ledger: DataFrame, carry: tuple = ()) -> DataFrame:
    """Live latest-wins rows of the pool, three independent groups of columns; ``carry`` names columns of the ledger to keep."""
    name = F.col("event_name")
    only = lambda event, c, kind: F.when(name == event, c.cast(kind))
    read = ("assetId", "drawnIndex", "drawnRate", "accruedFees", "config.liquidityFee", "underlying", "decimals")
    rows = f.parsed(ledger.where(name.isin("UpdateAsset", "UpdateAssetConfig", "AddAsset")), *read).select(
        "chain_id", F.lower("address").alias("hub"), f.whole("assetId").alias("asset_id"),
        only("UpdateAsset", _plain(f.unsigned("drawnIndex")), "string").alias("drawn_index"), only("UpdateAsset", _plain(f.unsigned("drawnRate")), "string").alias("drawn_rate"),
        only("UpdateAsset", _plain(f.unsigned("accruedFees")), "string").alias("realized_fees"), only("UpdateAsset", F.col("block_timestamp"), "long").alias("index_timestamp"),
        only("UpdateAssetConfig", f.small("config.liquidityFee", 65_535), "int").alias("liquidity_fee"),
        only("AddAsset", f.address("underlying"), "string").alias("underlying"), only("AddAsset", f.small("decimals", 255), "int").alias("decimals"),
        *carry, *ORDER, "version", "sign",
    )
    return current(rows, ("hub", "asset_id"))


def hub_assets_current(ledger: DataFrame) -> DataFrame:
    """Pool state per asset: sums, and each latest-wins column by its own last row.

    The halves are folded apart, since text can't be held by the hash aggregation of the many delta rows, and meet as one row each.
    """
    sums = hub_deltas(ledger).groupBy(*ASSET, "scale").agg(*_sums_of_scale(ASSET_SUMS), F.sum("events").alias("events"))
    state = hub_state(ledger).groupBy(*ASSET).agg(*[_latest(c).alias(c) for c in STATE])
    both = sums.unionByName(state, allowMissingColumns=True)
    folded = both.groupBy(*ASSET).agg(*_by_scale(ASSET_SUMS), F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("events"), *[F.max(c).alias(c) for c in STATE])
    return folded.select(*ASSET, *_joined(ASSET_SUMS), *STATE, "events")


def hub_assets(view: DataFrame, chain: int, hub: str, asset_id: int | None = None) -> DataFrame:
    """All assets of a pool in numeric order, or one; assets that net to zero are listed too."""
    own = view.where((F.col("chain_id") == chain) & (F.col("hub") == hub.lower()))
    return (own if asset_id is None else own.where(F.col("asset_id") == asset_id)).orderBy("asset_id")


def reserves_current(ledger: DataFrame) -> DataFrame:
    """The reserve registry: the last live AddReserve of each reserve."""
    rows = f.parsed(ledger.where("event_name = 'AddReserve'"), "reserveId", "assetId", "hub").select(
        "chain_id", F.lower("address").alias("spoke"), f.whole("reserveId").alias("reserve_id"),
        f.whole("assetId").alias("asset_id"), f.address("hub").alias("hub"), *ORDER, "version", "sign",
    )
    live = current(rows, ("spoke", "reserve_id"))
    last = F.max_by(F.struct("asset_id", "hub"), F.struct(*ORDER)).alias("last")
    return live.groupBy("chain_id", "spoke", "reserve_id").agg(last).select("chain_id", "spoke", "reserve_id", "last.asset_id", "last.hub")


def reserve_ids(view: DataFrame, chain: int, spoke: str) -> DataFrame:
    return view.where((F.col("chain_id") == chain) & (F.col("spoke") == spoke.lower())).select("reserve_id").orderBy("reserve_id")


def listed_tokens(ledger: DataFrame) -> DataFrame:
    """Distinct underlying tokens of AddAsset rows at event grain; retracted listings stay, odd bodies are skipped."""
    rows = f.parsed(ledger.where("event_name = 'AddAsset'"), "underlying").select("chain_id", F.lower(f.text("underlying")).alias("underlying"))
    return rows.where("underlying RLIKE '^0x[0-9a-f]{40}$'").distinct()


def listing_counts(ledger: DataFrame) -> DataFrame:
    """How often each token was listed: a small table, added up over batches, of which the keys are what counts."""
    rows = f.parsed(ledger.where("event_name = 'AddAsset'"), "underlying").select("chain_id", F.lower(f.text("underlying")).alias("underlying"))
    return rows.where("underlying RLIKE '^0x[0-9a-f]{40}$'").groupBy("chain_id", "underlying").agg(F.count("*").alias("n"))
