"""Queries over time: pool state at many instants, pinned risk parameters, time to liquidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, reconcile, risk
from ..operators import ledger as lg
from . import mapping as m


def assets_at_instants(spark, sf_dir):
    """For every order the state of its asset one second before it: as many instants as orders, in one plan."""
    asks = m.hub_base(spark, sf_dir).selectExpr(f"{m.CHAIN} AS chain_id", f"'{m.HUB}' AS hub", "asset_id", "block_timestamp - 1 AS at", "id AS o_orderkey")
    df = asof.assets_at(asks, lg.append(m.hub_events(spark, sf_dir), 1), bucket=200)
    return df.select("o_orderkey", "asset_id", "liquidity", "added_shares", "drawn_shares", "premium_offset_ray", "drawn_index", "realized_fees", "underlying", "events")


def _risk_events(spark, sf_dir):
    """Supplies; of the purchases each seventh is a new configuration, of the clicks each fifth refreshes a wallet, of the errors each third a position."""
    b, key = m.spoke_base(spark, sf_dir), {"reserveId": "reserve_id", "user": "user"}
    kind = "CASE event_type WHEN 'purchase' THEN 'AddDynamicReserveConfig' WHEN 'click' THEN 'RefreshAllUserDynamicConfig' ELSE 'RefreshSingleUserDynamicConfig' END"
    body = (
        f"CASE event_type WHEN 'purchase' THEN {m._json(reserveId='reserve_id', dynamicConfigKey='event_id', config='named_struct(' + repr('collateralFactor') + ', event_id % 9000)')}"
        f" WHEN 'click' THEN {m._json(user='user')} ELSE {m._json(**key)} END"
    )
    own = b.where("event_type = 'purchase' AND event_id % 7 = 0 OR event_type = 'click' AND event_id % 5 = 0 OR event_type = 'error' AND event_id % 3 = 0")
    return m.spoke_events(spark, sf_dir).where("event_name = 'Supply'").unionByName(m._event(own, F.expr(kind), F.expr(body), F.col("spoke")))


def pinned_factors(spark, sf_dir):
    return risk.pinned_factors(lg.append(_risk_events(spark, sf_dir), 1), 100 * risk.PLACE).select("user", "spoke", "reserve_id", "config_key", "factor_bps")


def time_to_liquidation(spark, sf_dir):
    """Customers as wallets, their orders as debts at 1 to 10 % a year, collateral of 95 to 124 % of them."""
    o = m.table(spark, sf_dir, "orders").selectExpr(f"{m.CHAIN} AS chain_id", "cast(o_custkey AS string) AS user", f"'{m.SPOKES[0]}' AS spoke", "o_orderkey", "o_custkey", "cast(round(o_totalprice * 100) AS decimal(38,0)) AS v")
    debts = o.select("chain_id", "user", "spoke", F.col("v").alias("drawn_shares"), F.lit(0).alias("premium_debt"), F.lit("1" + "0" * 27).alias("index"),
                     F.concat((F.col("o_orderkey") % 90 + 10).cast("string"), F.lit("0" * 24)).alias("rate"), F.lit(18).alias("decimals"), F.lit(10**8).alias("price"))
    weighted = o.groupBy("chain_id", "user", "spoke").agg((F.sum("v") * (F.first("o_custkey") % 30 + 95)).cast("decimal(38,0)").alias("v"))
    weighted = weighted.select("chain_id", "user", "spoke", F.concat(F.col("v").cast("string"), F.lit("0" * 10)).alias("weighted"))
    return risk.time_to_liquidation(debts, weighted).select("user", "seconds")


def drift_samples(spark, sf_dir):
    """Of all wallets and reserves, 20 that the last blocks touched, 20 of the most events and 20 at random."""
    b = m.spoke_base(spark, sf_dir)
    last = b.agg(F.max("block_number")).first()[0]
    rows = b.groupBy("user", "spoke", "reserve_id").agg(F.max("block_number").alias("touched"), F.count("*").alias("n"))
    strata = {"touched": (F.col("touched") > last - 20, None), "largest": (None, F.col("n")), "random": (None, None)}
    return reconcile.triage(rows, strata, 20, 7, ("user", "spoke", "reserve_id"))


QUERIES = {x.__name__: x for x in (assets_at_instants, pinned_factors, time_to_liquidation, drift_samples)}

def _searched() -> str:
    """The same search, a step a common table expression."""
    owed = "(v * (1000000000000000000000000000::HUGEINT + rate * mid // 31536000) + 999999999999999999999999999::HUGEINT) // 1000000000000000000000000000::HUGEINT"
    parts = ["d AS MATERIALIZED (SELECT o_custkey AS ck, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS HUGEINT) AS v, (o_orderkey % 90 + 10)::HUGEINT * 1000000000000000000000000::HUGEINT AS rate FROM orders)",
             f"s0 AS (SELECT DISTINCT ck, CAST(-1 AS BIGINT) AS lo, CAST({risk.HORIZON} AS BIGINT) AS hi FROM d)"]
    for n in range(33):
        parts.append(
            f"s{n + 1} AS MATERIALIZED (SELECT ck, CASE WHEN hi - lo <= 1 OR u THEN lo ELSE mid END AS lo, CASE WHEN hi - lo > 1 AND u THEN mid ELSE hi END AS hi FROM "
            f"(SELECT ck, lo, hi, mid, sum({owed}) * 100 > sum(v) * (95 + ck % 30) AS u FROM (SELECT *, (lo + hi) // 2 AS mid FROM s{n}) JOIN d USING (ck) GROUP BY ck, lo, hi, mid))"
        )
    return f"WITH {', '.join(parts)} SELECT CAST(ck AS VARCHAR) AS user, hi AS seconds FROM s33"


ORACLES = {
    "assets_at_instants": f"""WITH {m.HB}, e AS (SELECT *, CASE kind WHEN 0 THEN v * 10 WHEN 1 THEN -v WHEN 2 THEN -(v + 2) WHEN 3 THEN v // 4 + v // 100 WHEN 7 THEN -(v // 3) WHEN 8 THEN v // 6 ELSE 0 END AS liq,
 CASE kind WHEN 0 THEN v * 9 WHEN 1 THEN -v WHEN 5 THEN -(v // 9) WHEN 6 THEN v // 20 ELSE 0 END AS added, CASE kind WHEN 2 THEN v WHEN 3 THEN -(v // 4) WHEN 4 THEN -(v // 8) ELSE 0 END AS dr,
 CASE kind WHEN 3 THEN -v * 100000 WHEN 4 THEN -v * 1000 WHEN 9 THEN -v * 100 ELSE 0 END AS po, CASE WHEN kind = 10 THEN 1000000000000000000000000000::HUGEINT + id::HUGEINT * 100000000000000000000::HUGEINT END AS ix FROM hb)
SELECT id AS o_orderkey, a AS asset_id, CAST(coalesce(sum(liq) OVER w, 0) AS VARCHAR) AS liquidity, CAST(coalesce(sum(added) OVER w, 0) AS VARCHAR) AS added_shares, CAST(coalesce(sum(dr) OVER w, 0) AS VARCHAR) AS drawn_shares,
 CAST(coalesce(sum(po) OVER w, 0) AS VARCHAR) AS premium_offset_ray, CAST(arg_max(ix, id) OVER w AS VARCHAR) AS drawn_index, CAST(arg_max(CASE WHEN kind = 10 THEN v // 1000 END, id) OVER w AS VARCHAR) AS realized_fees,
 arg_max(CASE WHEN kind = 12 THEN {m.sql_address('a + 1')} END, id) OVER w AS underlying, CAST(coalesce(sum(CASE WHEN kind < 10 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS events
 FROM e WINDOW w AS (PARTITION BY a ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "pinned_factors": f"""WITH {m.SP}, own AS (SELECT usr, spoke, r, min(CASE WHEN event_type = 'view' THEN event_id END) AS first, max(CASE WHEN event_type = 'error' THEN event_id END) AS one FROM sp
  WHERE event_type = 'view' OR event_type = 'error' AND event_id % 3 = 0 GROUP BY ALL),
every AS (SELECT usr, spoke, max(event_id) AS al FROM sp WHERE event_type = 'click' AND event_id % 5 = 0 GROUP BY ALL),
pin AS (SELECT own.usr, own.spoke, r, coalesce(greatest(one, CASE WHEN al >= coalesce(first, al) THEN al END), first) AS place FROM own LEFT JOIN every ON own.usr = every.usr AND own.spoke = every.spoke),
c AS (SELECT spoke, r, event_id AS k FROM sp WHERE event_type = 'purchase' AND event_id % 7 = 0)
SELECT usr AS user, pin.spoke, pin.r AS reserve_id, k AS config_key, CAST(k % 9000 AS INTEGER) AS factor_bps FROM pin ASOF LEFT JOIN c ON pin.spoke = c.spoke AND pin.r = c.r AND pin.place >= c.k""",
    "time_to_liquidation": _searched(),
    "drift_samples": f"""WITH {m.SP}, p AS (SELECT usr AS user, spoke, r AS reserve_id, max(b) AS touched, count(*) AS n, md5('7:' || usr || ':' || spoke || ':' || r) AS h FROM sp GROUP BY usr, spoke, r)
SELECT * EXCLUDE (h) FROM ((SELECT *, 'touched' AS stratum FROM p WHERE touched > (SELECT max(b) - 20 FROM sp) ORDER BY h LIMIT 20)
 UNION ALL (SELECT *, 'largest' FROM p ORDER BY n DESC, h LIMIT 20) UNION ALL (SELECT *, 'random' FROM p ORDER BY h LIMIT 20))""",
}
