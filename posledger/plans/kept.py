"""Queries over tables that a stream keeps: rebuilt beside it, held in buckets, flags in state; and amounts of 256 bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds, maintained, totals, valuation
from ..operators import ledger as lg
from ..sources import shared
from ..streaming import flags, ingest
from . import mapping as m
from . import pools, positions

SHOWN = ("user", "spoke", "reserve_id")
#: Zeros between the copies of a number that a wide amount is made of.
PAD = 34


def _land(spark, events: DataFrame, at: str, lo: int, hi: int, turn: int, last: int) -> None:
    """The blocks from ``lo`` to ``hi`` land in ranges of 250."""
    rows = spark.range(lo, hi + 1, 250).selectExpr(f"{m.CHAIN} AS chain_id", "id AS range_from", f"least(id + 249, {hi}L) AS range_to", f"{turn}L AS dispatch", f"{last}L AS head", "false AS rewind")
    ingest.land(ingest.dispatches(events.where(F.col("block_number").between(lo, hi)), rows), f"{at}/source")


def _run(spark, at: str, **more) -> None:
    """What has landed since the last run is one batch, of however many files."""
    ingest.start_ingest(spark, f"{at}/source", f"{at}/ledger", f"{at}/checkpoint", f"{at}/progress", None, deltas=f"{at}/deltas", **more).awaitTermination()


def _shown(p: DataFrame) -> DataFrame:
    return p.select(*SHOWN, "supplied_shares", "premium_offset_ray", "using_as_collateral", "events")


def rebuild_then_stream(spark, sf_dir):
    """Deltas of two thirds of the blocks, rebuilt from the ledger, then two more batches, one of blocks that the base holds."""
    at, events = shared.table_path(spark, "rebuilt"), m.spoke_events(spark, sf_dir)
    last = events.agg(F.max("block_number")).first()[0]
    third = last // 3
    for turn, (lo, hi) in enumerate(((0, third), (third + 1, 2 * third), (2 * third + 1, last), (third // 2, third + third // 2)), 1):
        _land(spark, events, at, lo, hi, turn, last)
        _run(spark, at)
        if turn == 2:
            ingest.rebuild(spark, f"{at}/ledger", f"{at}/deltas")
    return _shown(ingest.positions(spark, f"{at}/deltas"))


def kept_view(spark, sf_dir) -> str:
    """A view kept over four batches: halves of the blocks, a part of them again, and one range emptied."""
    at, events = shared.table_path(spark, "kept"), m.spoke_events(spark, sf_dir)
    last = events.agg(F.max("block_number")).first()[0]
    batches = ((events, 0, last // 2), (events, last // 2 + 1, last), (events, last // 3, 2 * (last // 3)), (events.where("false"), m.LO, m.HI))
    for turn, (some, lo, hi) in enumerate(batches, 1):
        _land(spark, some, at, lo, hi, turn, last)
        _run(spark, at, view=f"{at}/view")
    return f"{at}/view"


def positions_kept(spark, sf_dir):
    """All positions of the kept view; those of which nothing is left are rows of zeros."""
    return _shown(folds.stored_positions(maintained.view(spark, kept_view(spark, sf_dir)))).where("events > 0 OR using_as_collateral")


def page_of(spark, view: str) -> DataFrame:
    """A wallet's page out of its bucket."""
    return positions._shown_page(folds.stored_positions(maintained.view(spark, view, m.CHAIN, positions.WALLET)), None)


def positions_page_kept(spark, sf_dir):
    return page_of(spark, kept_view(spark, sf_dir))


def collateral_flags_kept(spark, sf_dir):
    """Flags in keyed state over three batches: all, the retraction of the last blocks, and half of these again."""
    at, events = shared.table_path(spark, "flags"), m.spoke_events(spark, sf_dir).where("event_name = 'SetUsingAsCollateral'")
    first = lg.append(events, 1)
    for rows in (first, lg.retract_range(first, m.CHAIN, m.HI, 10**9), lg.append(events.where(f"block_number >= {m.HI} AND block_number % 2 = 0"), 2)):
        rows.write.mode("append").parquet(f"{at}/ledger")
        flags.keep_flags(spark, spark.readStream.schema(first.schema).parquet(f"{at}/ledger"), f"{at}/flags", f"{at}/checkpoint").awaitTermination()
    return flags.kept_flags(spark, f"{at}/flags").select(*SHOWN, "using_as_collateral")


def _wide(path: str) -> str:
    """A number n as n, n and n again with zeros between: 78 digits at most, and their sum is the sum three times."""
    n = f"get_json_object(body, '$.{path}')"
    return f"concat({n}, lpad({n}, {PAD}, '0'), lpad({n}, {PAD}, '0'))"


def wide_events(spark, sf_dir) -> DataFrame:
    """Supplies and withdrawals of amounts of up to 78 digits."""
    events = m.spoke_events(spark, sf_dir).where("event_name IN ('Supply', 'Withdraw')")
    bodies = [
        f"WHEN event_name = '{e}' THEN to_json(named_struct('reserveId', get_json_object(body, '$.reserveId'), 'user', get_json_object(body, '$.user'), '{s}', {_wide(s)}, '{a}', {_wide(a)}))"
        for e, s, a in (("Supply", "suppliedShares", "suppliedAmount"), ("Withdraw", "withdrawnShares", "withdrawnAmount"))
    ]
    return events.withColumn("body", F.expr("CASE " + " ".join(bodies) + " END"))


def position_fold_wide(spark, sf_dir):
    p = folds.positions_current(lg.append(wide_events(spark, sf_dir), 1))
    return p.select(*SHOWN, "supplied_shares", "net_supplied", "drawn_shares", "events")


def _spoilt(spark, sf_dir) -> DataFrame:
    """The Spoke's ledger, in which some amounts are missing, no numbers, or have more than 78 digits."""
    k = "block_number % 50"
    spoilt = f"CASE WHEN {k} = 7 THEN regexp_replace(body, '\"(suppliedShares|drawnShares|withdrawnShares)\":\"[0-9]+\",?', '') WHEN {k} = 8 THEN regexp_replace(body, 'Shares\":\"', 'Shares\":\"x') WHEN {k} = 9 THEN regexp_replace(body, 'Shares\":\"', 'Shares\":\"1{'0' * 78}') ELSE body END"
    return lg.append(m.spoke_events(spark, sf_dir).withColumn("body", F.expr(spoilt)), 1)


def poison_rows(spark, sf_dir):
    """How many rows can't be folded, by their fault."""
    return folds.poison(_spoilt(spark, sf_dir)).groupBy("event_name", "fault").agg(F.count("*").alias("n"))


def position_fold_sound(spark, sf_dir):
    """The fold of the rows that can be."""
    return _shown(folds.positions_current(folds.sound(_spoilt(spark, sf_dir))))


def quotes(spark, sf_dir, at: int) -> DataFrame:
    """The quote of each reserve: its pool at an instant, and its last price."""
    pool = valuation.asset_at(pools._pool(spark, sf_dir), at).withColumn("pool_added_shares", F.col("added_shares"))
    known = pools._views(spark, sf_dir)["reserves"].join(pool, ["chain_id", "hub", "asset_id"])
    priced = known.join(pools._prices(spark, sf_dir).select(*totals.RESERVE, "price"), [*totals.RESERVE], "left")
    return priced.select(*totals.RESERVE, *totals.QUOTE)


def spoke_totals_kept(spark, sf_dir):
    """Totals over three steps: positions of half of the blocks, by quotes a day early of which half are dear; all quotes as they are; the positions that the other blocks change."""
    path, events = shared.table_path(spark, "totals"), m.spoke_events(spark, sf_dir)
    middle = events.agg(F.max("block_number")).first()[0] // 2
    early = folds.positions_current(lg.append(events.where(F.col("block_number") <= middle), 1))
    changed = events.where(F.col("block_number") > middle).select("chain_id", F.lower(F.get_json_object("body", "$.user")).alias("user"), F.col("address").alias("spoke"), F.get_json_object("body", "$.reserveId").cast("long").alias("reserve_id"))
    late = folds.positions_current(lg.append(events, 1)).join(changed.distinct(), [*totals.POSITION], "left_semi")
    dear = quotes(spark, sf_dir, pools.AT - 86_400).withColumn("price", F.when(F.col("reserve_id") % 2 == 0, F.col("price") * 3).otherwise(F.col("price")))
    for step, (rows, told) in enumerate(((early, dear), (None, quotes(spark, sf_dir, pools.AT)), (late, None))):
        totals.apply(spark, path, step, rows, told)
    return totals.view(spark, path).select("user", "spoke", "supplied_value", "debt_value", "net_worth")


QUERIES = {x.__name__: x for x in (spoke_totals_kept, rebuild_then_stream, positions_kept, positions_page_kept, collateral_flags_kept, position_fold_wide, poison_rows, position_fold_sound)}


def _fold(where: str = "true", having: str = "true") -> str:
    return (
        f"WITH {m.SP} SELECT usr AS user, spoke, r AS reserve_id, CAST(sum(sup) AS VARCHAR) AS supplied_shares, CAST(sum(po) AS VARCHAR) AS premium_offset_ray, "
        f"coalesce(arg_max(flag, event_id), false) AS using_as_collateral, CAST(sum(ev) AS BIGINT) AS events FROM spd WHERE {where} GROUP BY usr, spoke, r HAVING {having}"
    )


def _three(c: str) -> str:
    digits = f"CAST(abs({c}) AS VARCHAR)"
    return f"CASE WHEN {c} = 0 THEN '0' ELSE CASE WHEN {c} < 0 THEN '-' ELSE '' END || {digits} || lpad({digits}, {PAD}, '0') || lpad({digits}, {PAD}, '0') END"


_KEPT = f"b NOT BETWEEN {m.LO} AND {m.HI}"
_PAGE = f"""WITH {m.SP}, p AS (SELECT spoke, r, sum(sup) AS x FROM spd WHERE usr = '{positions.WALLET}' AND {_KEPT} GROUP BY spoke, r HAVING sum(sup) <> 0 OR sum(dr) <> 0),
n AS (SELECT *, row_number() OVER (ORDER BY spoke, r) AS i, count(*) OVER () AS c FROM p)
SELECT spoke, r AS reserve_id, CAST(x AS VARCHAR) AS supplied_shares, CASE WHEN c > 5 THEN max(CASE WHEN i = 5 THEN spoke END) OVER () END AS next_spoke,
 CASE WHEN c > 5 THEN max(CASE WHEN i = 5 THEN r END) OVER () END AS next_reserve_id FROM n WHERE i <= 5"""

ORACLES = {
    "spoke_totals_kept": pools.ORACLES["spoke_totals"],
    "rebuild_then_stream": _fold(),
    "positions_kept": _fold(_KEPT, "sum(ev) > 0 OR coalesce(arg_max(flag, event_id), false)"),
    "positions_page_kept": _PAGE,
    "collateral_flags_kept": f"""WITH {m.SP} SELECT usr AS user, spoke, r AS reserve_id, coalesce(arg_max(flag, event_id) FILTER (WHERE b < {m.HI} OR b % 2 = 0), false) AS using_as_collateral
 FROM spd WHERE event_type = 'signup' GROUP BY ALL""",
    "position_fold_wide": f"""WITH {m.SP}, p AS (SELECT usr, spoke, r, CAST(sum(sup) AS HUGEINT) AS x, CAST(sum(ns) AS HUGEINT) AS y, count(*) AS n FROM spd WHERE event_type IN ('view', 'click') GROUP BY usr, spoke, r)
SELECT usr AS user, spoke, r AS reserve_id, {_three('x')} AS supplied_shares, {_three('y')} AS net_supplied, '0' AS drawn_shares, n AS events FROM p""",
    "poison_rows": f"""WITH {m.SP} SELECT CASE event_type WHEN 'view' THEN 'Supply' WHEN 'click' THEN 'Withdraw' WHEN 'purchase' THEN 'Borrow' ELSE 'Repay' END AS event_name,
 CASE event_type WHEN 'view' THEN 'suppliedShares' WHEN 'click' THEN 'withdrawnShares' ELSE 'drawnShares' END AS fault, count(*) AS n FROM sp WHERE event_type <> 'signup' AND b % 50 IN (7, 8, 9) GROUP BY ALL""",
    "position_fold_sound": _fold("event_type = 'signup' OR b % 50 NOT IN (7, 8, 9)"),
}
