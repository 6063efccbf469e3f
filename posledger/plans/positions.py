"""Queries over the Spoke ledger: collapse, folds, flags, registry, liquidations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds as f
from ..operators import ledger as lg
from ..operators import page, risk
from . import mapping as m
from ..sources import shared

WALLET = "0x" + "0" * 39 + "1"
WIDE = ("supplied_shares", "drawn_shares", "premium_shares", "premium_offset_ray", "net_supplied", "net_borrowed")


def shown(positions: DataFrame) -> DataFrame:
    """Positions as they are published: every amount is a decimal string."""
    return positions.select("chain_id", "user", "spoke", "reserve_id", *[F.col(c).cast("string").alias(c) for c in WIDE], "using_as_collateral", "events")


def _retracted_doubled(spark, sf_dir):
    """Version 1, retracted between two blocks, where version 2 has each Supply, Withdraw, Borrow and Repay twice over."""
    first = lg.append(m.spoke_events(spark, sf_dir), 1)
    again = m.spoke_events(spark, sf_dir)
    copies = again.withColumn("log_index", F.col("log_index") + 10).unionByName(again).where("event_name <> 'SetUsingAsCollateral'")
    return lg.replace_range(first, copies.unionByName(again.where("event_name = 'SetUsingAsCollateral'")), m.CHAIN, m.LO, m.HI, 2)


def position_fold(spark, sf_dir):
    return shown(f.open_positions(f.positions_current(_retracted_doubled(spark, sf_dir))))


def position_fold_plain(spark, sf_dir):
    return shown(f.positions_current(lg.append(m.spoke_events(spark, sf_dir), 1)))


def position_fold_retracted(spark, sf_dir):
    ledger = lg.append(m.spoke_events(spark, sf_dir), 1)
    return shown(f.positions_current(ledger.unionByName(lg.retract_range(ledger, m.CHAIN, m.LO, m.HI))))


def position_fold_redispatch(spark, sf_dir):
    events = m.spoke_events(spark, sf_dir)
    return shown(f.positions_current(lg.replace_range(lg.append(events, 1), events, m.CHAIN, m.LO, m.HI, 5000)))


def position_fold_appended_twice(spark, sf_dir):
    events = m.spoke_events(spark, sf_dir)
    ledger = lg.append(events, 1).unionByName(lg.append(events.where(lg.in_range(m.CHAIN, m.LO, m.HI)), 2))
    return shown(f.positions_current(ledger))


def ledger_current(spark, sf_dir):
    live = lg.current(_retracted_doubled(spark, sf_dir))
    return live.groupBy("event_name", "version").agg(F.count("*").alias("n"), F.sum("block_number").alias("blocks"))


def ledger_unpaired_retraction(spark, sf_dir):
    """A -1 without its +1 subtracts from the sums and is hidden by the collapse."""
    events = m.spoke_events(spark, sf_dir).where("event_name = 'Supply'")
    lone = lg.append(events.where("block_number < 100"), 7).withColumn("sign", F.lit(-1))
    ledger = lg.append(events.where("block_number >= 100"), 1).unionByName(lone)
    sums = f.positions_current(ledger).agg(F.sum(F.col("supplied_shares").cast("decimal(38,0)")).cast("string").alias("supplied"), F.sum("events").alias("events"))
    return sums.crossJoin(lg.current(ledger).agg(F.count("*").alias("live")))


def collateral_flag_latest(spark, sf_dir):
    """Flags after the last blocks are retracted: each falls back to the one before."""
    events = m.spoke_events(spark, sf_dir).where("event_name = 'SetUsingAsCollateral'")
    ledger = lg.append(events, 1)
    ledger = ledger.unionByName(lg.retract_range(ledger, m.CHAIN, m.HI, 10**9))
    return f.positions_current(ledger).select("user", "spoke", "reserve_id", "using_as_collateral")


def liquidation_legs(spark, sf_dir):
    return shown(f.positions_current(lg.append(m.liquidations(spark, sf_dir), 1)))


def liquidation_groups(spark, sf_dir):
    return risk.liquidation_groups(lg.append(m.liquidations(spark, sf_dir), 1))


def registry_latest(spark, sf_dir):
    ledger = lg.append(m.reserves(spark, sf_dir), 1)
    return f.reserves_current(ledger.unionByName(lg.retract_range(ledger, m.CHAIN, m.LO, m.HI)))


def reserve_ids(spark, sf_dir):
    return f.reserve_ids(f.reserves_current(lg.append(m.reserves(spark, sf_dir), 1)), m.CHAIN, m.SPOKES[0])


def largest_positions(spark, sf_dir):
    return shown(risk.largest_positions(f.positions_current(lg.append(m.spoke_events(spark, sf_dir), 1)), "supplied_shares", 100))


def _page(spark, sf_dir, after):
    positions = f.positions_current(f.touching(lg.append(m.spoke_events(spark, sf_dir), 1), WALLET))
    return _shown_page(positions, after)


def _shown_page(positions, after):
    rows = page.first_of(page.page_rows(positions, m.CHAIN, WALLET, None, 5, after), 5)
    return rows.select("spoke", "reserve_id", F.col("supplied_shares").cast("string").alias("supplied_shares"), F.col("next_key.spoke").alias("next_spoke"), F.col("next_key.reserve_id").alias("next_reserve_id"))


def positions_page(spark, sf_dir):
    return _page(spark, sf_dir, None)


def positions_page_stored(spark, sf_dir):
    """The page from a stored table of typed deltas, half of which came in a second batch."""
    at, ledger = shared.table_path(spark, "deltas"), lg.append(m.spoke_events(spark, sf_dir), 1)
    for part in (ledger.where("block_number % 2 = 0"), ledger.where("block_number % 2 = 1")):
        f.store_positions(f.position_rows(part), at, files=4)
    return _shown_page(f.stored_positions(spark.read.parquet(at)), None)


def positions_page_next(spark, sf_dir):
    return _page(spark, sf_dir, (m.SPOKES[1], "6"))


def additive_fold_lineitem(spark, sf_dir):
    """The scale case of the additive fold: quantities and prices in cents by part, returned lines retracted."""
    rows = m.table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "if(l_returnflag = 'R', -1, 1) AS sign", "cast(round(l_extendedprice * 100) AS bigint) AS cents", "cast(l_quantity AS bigint) AS quantity")
    return f.additive(rows, ("l_partkey",), ("cents", "quantity"))


def deficit_legs(spark, sf_dir):
    """Repayments reported as deficits: shares and premium go, nothing is paid back."""
    events = m.spoke_events(spark, sf_dir).where("event_name = 'Repay'").withColumn("event_name", F.lit("ReportDeficit"))
    return shown(f.positions_current(lg.append(events, 1)))


def position_types(spark, sf_dir):
    """Open positions by type; each third reserve has no collateral factor."""
    p = f.open_positions(f.positions_current(lg.append(m.spoke_events(spark, sf_dir), 1)))
    factor = F.when(F.col("reserve_id") % 3 == 0, 0).otherwise(7500)
    kind = risk.position_type(F.col("using_as_collateral"), factor)
    return p.groupBy("reserve_id", kind.alias("type")).agg(F.count("*").alias("n"))


QUERIES = {
    x.__name__: x
    for x in (
        position_fold, position_fold_plain, position_fold_retracted, position_fold_redispatch, position_fold_appended_twice, ledger_current, ledger_unpaired_retraction,
        collateral_flag_latest, liquidation_legs, liquidation_groups, registry_latest, reserve_ids, largest_positions, positions_page, positions_page_stored, positions_page_next, additive_fold_lineitem, deficit_legs, position_types,
    )
}


def _fold(weight: str = "1", flagged: str = "true", where: str = "true", having: str = "true", tail: str = "") -> str:
    """The plain fold in SQL: each event counts ``weight`` times; flags only of events that are ``flagged``."""
    w = f"({weight})"
    sums = ", ".join(f"CAST(sum({w} * {c}) AS VARCHAR) AS {n}" for c, n in zip(("sup", "dr", "pr", "po", "ns", "nb"), WIDE))
    return (
        f"WITH {m.SP} SELECT {m.CHAIN} AS chain_id, usr AS user, spoke, r AS reserve_id, {sums}, coalesce(arg_max(CASE WHEN {flagged} THEN flag END, event_id), false) AS using_as_collateral, "
        f"CAST(sum({w} * ev) AS BIGINT) AS events FROM spd WHERE {where} GROUP BY usr, spoke, r HAVING {having} {tail}"
    )


_TWICE = f"CASE WHEN b BETWEEN {m.LO} AND {m.HI} THEN 2 ELSE 1 END"
_OUT = f"b NOT BETWEEN {m.LO} AND {m.HI}"
_PAGE = f"""WITH {m.SP}, p AS (SELECT spoke, r, sum(sup) AS x FROM spd WHERE usr = '0x{"0" * 39}1' GROUP BY spoke, r HAVING sum(sup) <> 0 OR sum(dr) <> 0),
n AS (SELECT *, row_number() OVER (ORDER BY spoke, r) AS i, count(*) OVER () AS c FROM p WHERE {{after}})
SELECT spoke, r AS reserve_id, CAST(x AS VARCHAR) AS supplied_shares, CASE WHEN c > 5 THEN max(CASE WHEN i = 5 THEN spoke END) OVER () END AS next_spoke,
 CASE WHEN c > 5 THEN max(CASE WHEN i = 5 THEN r END) OVER () END AS next_reserve_id FROM n WHERE i <= 5"""
_LEGS = f"""WITH {m.SP}, q AS (SELECT * FROM sp WHERE event_type = 'purchase'),
legs AS (SELECT usr, spoke, r, -s AS sup, 0 AS dr, 0 AS pr, 0 AS po, -(s + 1) AS ns, 0 AS nb FROM q
 UNION ALL SELECT usr, spoke, (k + event_id) % 14, 0, -(s // 2), s // 10, -(s // 5), 0, -(s // 2 + 1) FROM q
 UNION ALL SELECT {m.sql_address('user_id + 1')}, spoke, r, s // 3, 0, 0, 0, 0, 0 FROM q WHERE event_id % 2 = 0)
SELECT 1 AS chain_id, usr AS user, spoke, r AS reserve_id, {", ".join(f"CAST(sum({c}) AS VARCHAR) AS {n}" for c, n in zip(("sup", "dr", "pr", "po", "ns", "nb"), WIDE))}, false AS using_as_collateral,
 count(*) AS events FROM legs GROUP BY usr, spoke, r"""

_DEFICIT = f"""WITH {m.SP} SELECT 1 AS chain_id, usr AS user, spoke, r AS reserve_id, '0' AS supplied_shares, CAST(sum(-(s // 8)) AS VARCHAR) AS drawn_shares, CAST(sum(s // 16) AS VARCHAR) AS premium_shares,
 CAST(sum(-s) AS VARCHAR) AS premium_offset_ray, '0' AS net_supplied, '0' AS net_borrowed, false AS using_as_collateral, count(*) AS events FROM sp WHERE event_type = 'error' GROUP BY usr, spoke, r"""
_TYPES = f"""WITH {m.SP}, p AS (SELECT r, sum(sup) AS x, sum(dr) AS y, coalesce(arg_max(flag, event_id), false) AS flag FROM spd GROUP BY usr, spoke, r)
SELECT r AS reserve_id, CASE WHEN y > 0 THEN 'borrow' WHEN flag AND r % 3 <> 0 THEN 'collateral' ELSE 'supply' END AS type, count(*) AS n FROM p WHERE x <> 0 OR y <> 0 GROUP BY ALL"""

ORACLES = {
    "deficit_legs": _DEFICIT,
    "position_types": _TYPES,
    "position_fold": _fold(_TWICE, having=f"sum({_TWICE} * sup) <> 0 OR sum({_TWICE} * dr) <> 0"),
    "position_fold_plain": _fold(),
    # what is wholly retracted stays as a row of zeros, since sums run over raw rows; positions with flags only do not
    "position_fold_retracted": _fold(f"CASE WHEN {_OUT} THEN 1 ELSE 0 END", _OUT, having=f"count(*) FILTER (WHERE ev = 1 OR {_OUT}) > 0"),
    "position_fold_redispatch": _fold(),
    "position_fold_appended_twice": _fold(_TWICE),
    "ledger_current": f"""WITH {m.SP}, n AS (SELECT CASE event_type WHEN 'view' THEN 'Supply' WHEN 'click' THEN 'Withdraw' WHEN 'purchase' THEN 'Borrow' WHEN 'error' THEN 'Repay' ELSE 'SetUsingAsCollateral' END AS event_name,
 b, CASE WHEN {_OUT} THEN 1 ELSE 2 END AS version, CASE WHEN {_OUT} OR event_type = 'signup' THEN 1 ELSE 2 END AS w FROM sp)
SELECT event_name, CAST(version AS BIGINT) AS version, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * b) AS BIGINT) AS blocks FROM n GROUP BY event_name, version""",
    "ledger_unpaired_retraction": f"""WITH {m.SP} SELECT CAST(sum(CASE WHEN b < 100 THEN -s ELSE s END) AS VARCHAR) AS supplied, CAST(sum(CASE WHEN b < 100 THEN -1 ELSE 1 END) AS BIGINT) AS events,
 count(*) FILTER (WHERE b >= 100) AS live FROM sp WHERE event_type = 'view'""",
    "collateral_flag_latest": f"WITH {m.SP} SELECT usr AS user, spoke, r AS reserve_id, arg_max(flag, event_id) AS using_as_collateral FROM spd WHERE event_type = 'signup' AND b < {m.HI} GROUP BY ALL",
    "liquidation_legs": _LEGS,
    "liquidation_groups": f"WITH {m.SP} SELECT 1 AS chain_id, '0xt' || b AS tx_hash, usr AS user, count(*) AS calls FROM sp WHERE event_type = 'purchase' GROUP BY ALL",
    "registry_latest": f"WITH {m.SP} SELECT 1 AS chain_id, spoke, r AS reserve_id, arg_max((r + event_id % 3) % 17, event_id) AS asset_id, '{m.HUB}' AS hub FROM sp WHERE event_type = 'signup' AND {_OUT} GROUP BY spoke, r",
    "reserve_ids": f"WITH {m.SP} SELECT DISTINCT r AS reserve_id FROM sp WHERE event_type = 'signup' AND spoke = '{m.SPOKES[0]}'",
    "largest_positions": _fold(tail="ORDER BY sum(sup) DESC, usr, spoke, r LIMIT 100"),
    "positions_page": _PAGE.format(after="true"),
    "positions_page_stored": _PAGE.format(after="true"),
    "positions_page_next": _PAGE.format(after=f"(spoke, r) > ('{m.SPOKES[1]}', 6)"),
    "additive_fold_lineitem": """SELECT l_partkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
 CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS events FROM lineitem GROUP BY l_partkey""",
}
