"""Queries over the pool ledger: folds, valuation, enriched listings and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wideint as w
from ..operators import folds as f
from ..operators import ledger as lg
from ..operators import page, risk, valuation
from ..sources import dimensions
from . import mapping as m

#: The instant of valuation: after every checkpoint of the derived ledgers.
AT = m.T0 + 40_000_000
TEXT = ("liquidity", "added_shares", "drawn_shares", "premium_shares", "premium_offset_ray", "deficit_ray", "swept")


def _pool(spark, sf_dir) -> DataFrame:
    return f.hub_assets_current(lg.append(m.hub_events(spark, sf_dir), 1))


def _text(df: DataFrame, names) -> list:
    return [F.col(c).cast("string").alias(c) for c in names]


def hub_additive_fold(spark, sf_dir):
    return _pool(spark, sf_dir).select("asset_id", *_text(None, TEXT), "events")


def hub_latest_wins(spark, sf_dir):
    return _pool(spark, sf_dir).select("asset_id", *_text(None, ("drawn_index", "drawn_rate", "realized_fees")), "index_timestamp", "liquidity_fee", "underlying", "decimals")


def hub_assets_current(spark, sf_dir):
    view = f.hub_assets(_pool(spark, sf_dir), m.CHAIN, m.HUB)
    return view.select("chain_id", "hub", "asset_id", *_text(None, (*TEXT, "drawn_index")), "underlying")


def listed_tokens(spark, sf_dir):
    return f.listed_tokens(lg.append(m.hub_events(spark, sf_dir), 1))


def drawn_index_at(spark, sf_dir):
    return valuation.asset_at(_pool(spark, sf_dir), AT).select("asset_id", F.col("index_at").cast("string").alias("index_at"))


def total_added_assets(spark, sf_dir):
    return valuation.asset_at(_pool(spark, sf_dir), AT).select("asset_id", *_text(None, ("unrealized_fees", "total_added_assets")))


def supplied_amount(spark, sf_dir):
    """What a million shares of each asset are worth in its base units."""
    df = valuation.asset_at(_pool(spark, sf_dir), AT).withColumn("pool_added_shares", F.col("added_shares"))
    return df.select("asset_id", valuation.supplied_assets(w.num(10**6)).cast("string").alias("supplied"))


def _views(spark, sf_dir) -> dict:
    events = m.spoke_events(spark, sf_dir)
    return {
        "positions": f.positions_current(lg.append(events, 1)),
        "reserves": f.reserves_current(lg.append(m.reserves(spark, sf_dir), 1)).where("reserve_id <> 12"),
        "assets_at": valuation.asset_at(_pool(spark, sf_dir), AT),
    }


def _valued(spark, sf_dir) -> DataFrame:
    return page.value_all(_views(spark, sf_dir))


VALUE = ("supplied", "drawn_debt", "premium_debt", "total_debt", "premium_ray")


def valued_positions(spark, sf_dir):
    v = _valued(spark, sf_dir)
    return v.select("user", "spoke", "reserve_id", F.col("asset.asset_id").alias("asset_id"), F.col("asset.decimals").alias("decimals"), *[F.col(f"value.{c}").cast("string").alias(c) for c in VALUE])


def _labels(spark, sf_dir) -> DataFrame:
    return page.latest_snapshot(m.label_rows(spark, sf_dir), ["chain_id", "token"])


def _prices(spark, sf_dir) -> DataFrame:
    return page.latest_snapshot(page.valid_prices(m.price_snapshots(spark, sf_dir)), ["chain_id", "spoke", "reserve_id"], "priced_at")


def _enriched(spark, sf_dir, as_of=None) -> DataFrame:
    return page.enrich(_valued(spark, sf_dir), _labels(spark, sf_dir), _prices(spark, sf_dir), as_of)


def enriched_positions(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return e.select("user", "spoke", "reserve_id", "symbol", "name", "underlying", "supplied", "debt", "premium", "price_usd", "supplied_usd", "debt_usd")


def unpriced_nulls(spark, sf_dir):
    """An explicit past instant serves labels and amounts, and no prices at all."""
    e = _enriched(spark, sf_dir, AT)
    return e.groupBy("reserve_id").agg(F.count("*").alias("n"), F.count("supplied").alias("scaled"), F.count("price_usd").alias("priced"), F.count("supplied_usd").alias("in_usd"))


def pricing_staleness(spark, sf_dir):
    return page.pricing_stamp(_enriched(spark, sf_dir), m.T0 + 400)


def latest_prices(spark, sf_dir):
    return _prices(spark, sf_dir).select("spoke", "reserve_id", F.col("price").cast("string").alias("price"), "priced_at")


def label_gap(spark, sf_dir):
    return page.label_gap(f.listed_tokens(lg.append(m.hub_events(spark, sf_dir), 1)), _labels(spark, sf_dir))


def decimals_audit(spark, sf_dir):
    return page.decimals_audit(_pool(spark, sf_dir), _labels(spark, sf_dir)).select("asset_id", "underlying", "decimals", "token_decimals")


def scaled_amounts(spark, sf_dir):
    """Order totals in cents as amounts of 0 to 20 decimals, every third one negative."""
    o = m.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(round(o_totalprice * 100) AS bigint) * if(o_orderkey % 3 = 0, -1, 1) AS v", "cast(o_orderkey % 21 AS int) AS d")
    return o.select("o_orderkey", w.to_decimal(F.col("v"), F.col("d")).alias("amount"))


def clean_labels(spark, sf_dir):
    raw = m.table(spark, sf_dir, "part").selectExpr(
        "1 AS chain_id", "upper(concat('0x', lpad(lower(hex(p_partkey)), 40, '0'))) AS token",
        "case p_partkey % 4 when 0 then concat('  ', p_brand, '\t', char(7)) when 1 then '\n ' when 2 then concat('0x', rpad(hex(encode(p_brand, 'UTF-8')), 64, '0')) else p_brand end AS symbol",
        "repeat(p_name, 5) AS name", "p_partkey % 300 - 10 AS decimals", "p_partkey AS fetched_at",
    )
    return dimensions.labels(raw).select("token", "symbol", "name", "token_decimals")


def oracle_batches(spark, sf_dir):
    """A batch of answers per order of lines; each fifth has an answer missing, quantities under five are no price."""
    lines = m.table(spark, sf_dir, "lineitem").where("l_linenumber IS NOT NULL").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_suppkey").alias("i"), F.col("l_quantity").alias("q")))).alias("x"))
    batches = lines.selectExpr(
        "1 AS chain_id", f"'{m.SPOKES[0].upper()}' AS spoke", "l_orderkey AS priced_at", "transform(x, y -> y.i) AS reserve_ids",
        "transform(if(l_orderkey % 5 = 0, slice(x, 2, size(x)), x), y -> cast(if(y.q < 5, 0, y.q) AS decimal(38,0))) AS answers",
    )
    rows = dimensions.price_rows(batches)
    return rows.groupBy("priced_at").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("long")).alias("accepted"), F.sum("price").cast("string").alias("total"))


def _priced(spark, sf_dir) -> DataFrame:
    v = _valued(spark, sf_dir).join(_prices(spark, sf_dir), ["chain_id", "spoke", "reserve_id"]).where("value IS NOT NULL")
    n = F.col("asset.decimals")
    value = lambda x: w.value_wide(F.col(f"value.{x}"), n, F.col("price"))
    return v.select("chain_id", "user", "spoke", "reserve_id", "using_as_collateral", value("supplied").alias("supplied_value"), value("total_debt").alias("debt_value"), (F.lit(5000) + F.col("reserve_id") * 100).alias("factor_bps"))


def spoke_totals(spark, sf_dir):
    return risk.spoke_totals(_priced(spark, sf_dir)).select("user", "spoke", *_text(None, ("supplied_value", "debt_value", "net_worth")))


def health_factor(spark, sf_dir):
    """Health by the folded collateral flag over exact values."""
    return risk.health_factor(_priced(spark, sf_dir)).select("user", "spoke", "health_factor")


def valued_positions_wide(spark, sf_dir):
    """Positions 1e18 times as large, as tokens of 18 decimals have them: products of over 50 digits, and their value in dollars."""
    views, zeros = _views(spark, sf_dir), "0" * 18
    more = [F.when(F.col(c) == "0", "0").otherwise(F.concat(c, F.lit(zeros))).alias(c) for c in ("supplied_shares", "drawn_shares", "premium_shares", "premium_offset_ray")]
    large = views["positions"].select("chain_id", "user", "spoke", "reserve_id", *more)
    v = page.value_all({**views, "positions": large}).join(valuation.sized(_prices(spark, sf_dir)), ["chain_id", "spoke", "reserve_id"], "left")
    worth = w.value_wide(F.col("value.supplied"), F.col("asset.decimals"), F.col("price")).alias("supplied_value")
    return v.select("user", "spoke", "reserve_id", *[F.col(f"value.{c}").cast("string").alias(c) for c in VALUE], worth, (F.col("unvalued") == "negative balance").alias("negative"))


def price_asof(spark, sf_dir):
    """The price in force at each order of an asset: the last order of that asset by an 'F' order before it or with it."""
    o = m.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 17 AS asset_id", "o_orderkey AS t", "o_orderstatus", "cast(round(o_totalprice * 100) AS decimal(38,0)) AS price")
    steps = o.where("o_orderstatus = 'F'").selectExpr("asset_id", "t AS from_time", "price")
    out = risk.price_as_of(o.selectExpr("asset_id", "t AS at", "o_orderkey"), steps, 500)
    return out.select("o_orderkey", "asset_id", F.col("price").cast("string").alias("price"))


#: An instant in the middle of the derived pool ledger.
THEN = m.T0 + 50


def total_added_assets_then(spark, sf_dir):
    """The pool as it stood at an earlier instant: the ledger up to it, valued at it."""
    past = lg.append(m.hub_events(spark, sf_dir), 1).where(F.col("block_timestamp") <= THEN)
    return valuation.asset_at(f.hub_assets_current(past), THEN).select("asset_id", F.col("index_at").cast("string").alias("index_at"), *_text(None, ("unrealized_fees", "total_added_assets")))


def listing_counts(spark, sf_dir):
    return f.listing_counts(lg.append(m.hub_events(spark, sf_dir), 1))


def _quotes(spark, sf_dir) -> DataFrame:
    return m.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(round(o_totalprice * 100) AS decimal(38,0)) AS v", "cast(o_custkey + 1 AS decimal(38,0)) AS c")


def headroom(spark, sf_dir):
    """Of each order's health factor (its cents, 16 decimals up) what the collateral may lose."""
    return _quotes(spark, sf_dir).select("o_orderkey", risk.headroom((F.col("v") * w.num(10**16)).cast(w.DEC)).cast("string").alias("headroom"))


def derived_prices(spark, sf_dir):
    """A feed times a ratio around one, up to a cap."""
    q = _quotes(spark, sf_dir)
    ratio = (w.num(10**18) + F.col("c") * w.num(10**13)).cast(w.DEC)
    return q.select("o_orderkey", risk.derived_price(F.col("v"), ratio, w.num(20_000_000)).cast("string").alias("price"))


def price_deviation(spark, sf_dir):
    q = _quotes(spark, sf_dir).withColumn("market", (F.col("v") + F.col("c") * 100 - 5000).cast(w.DEC)).where("market > 0")
    return risk.deviation(q, "v", "market").select("o_orderkey", F.col("deviation_bps").cast("string").alias("deviation_bps"))


QUERIES = {
    x.__name__: x
    for x in (
        hub_additive_fold, hub_latest_wins, hub_assets_current, listed_tokens, drawn_index_at, total_added_assets, supplied_amount, valued_positions, enriched_positions, unpriced_nulls,
        pricing_staleness, latest_prices, label_gap, decimals_audit, scaled_amounts, clean_labels, oracle_batches, spoke_totals, health_factor, valued_positions_wide, price_asof, total_added_assets_then, listing_counts, headroom, derived_prices, price_deviation,
    )
}

_RAY = "1000000000000000000000000000::HUGEINT"


def _up(x: str) -> str:
    return f"(({x}) + {_RAY} - 1) // {_RAY}"


#: Index and totals in SQL, over the fold of the pool (``hs``). Every index is a multiple of 1e20, which keeps its products in range.
_AT = f"""{m.HB},
ix AS (SELECT *, CASE WHEN ix IS NULL THEN NULL WHEN {AT} = ts OR (dr = 0 AND pr = 0) THEN ix
  ELSE ((ix // 100000000000000000000::HUGEINT) * ({_RAY} + (rate * ({AT} - ts)::HUGEINT) // 31536000) + 9999999) // 10000000 END AS ixa FROM hs),
ow AS (SELECT *, {_up('dr * ixa + pr * ixa - po + de')} AS aft, {_up('dr * ix + pr * ix - po + de')} AS bef FROM ix),
un AS (SELECT *, CASE WHEN ixa = ix OR coalesce(fee, 0) = 0 THEN 0::HUGEINT ELSE ((aft - bef) * fee) // 10000 END AS unr FROM ow),
pool AS (SELECT *, liq + sw + aft - fees - unr AS total FROM un)"""
_VAL = f"""{_AT}, {m.SP},
pos AS (SELECT usr, spoke, r, CAST(sum(sup) AS HUGEINT) AS sup, CAST(sum(dr) AS HUGEINT) AS dr, CAST(sum(pr) AS HUGEINT) AS pr, CAST(sum(po) AS HUGEINT) AS po FROM spd GROUP BY usr, spoke, r HAVING sum(sup) <> 0 OR sum(dr) <> 0),
reg AS (SELECT spoke, r, arg_max((r + event_id % 3) % 17, event_id) AS a FROM sp WHERE event_type = 'signup' AND r <> 12 GROUP BY spoke, r),
j AS (SELECT pos.*, pool.a, pool.und, pool.decs, pool.ixa, pool.total, pool.added, pool.ixa IS NOT NULL AND pos.sup >= 0 AND pos.dr >= 0 AS good FROM pos LEFT JOIN reg USING (spoke, r) LEFT JOIN pool ON pool.a = reg.a),
val AS (SELECT *, CASE WHEN good THEN (sup * (total + 1000000)) // (added + 1000000) END AS supplied, CASE WHEN good THEN {_up('dr * ixa')} END AS drawn_debt,
  CASE WHEN good THEN {_up('pr * ixa - po')} END AS premium_debt, CASE WHEN good THEN pr * ixa - po END AS premium_ray FROM j)"""


def _decimal(x: str, d: str) -> str:
    """to_decimal of a value that is not negative, in SQL."""
    padded = f"lpad(CAST({x} AS VARCHAR), CAST(greatest(length(CAST({x} AS VARCHAR)), {d} + 1) AS INTEGER), '0')"
    whole, part = f"left({padded}, CAST(length({padded}) - {d} AS INTEGER))", f"rtrim(right({padded}, CAST({d} AS INTEGER)), '0')"
    return f"CASE WHEN {d} = 0 THEN CAST({x} AS VARCHAR) WHEN {part} = '' THEN {whole} ELSE {whole} || '.' || {part} END"


_POOL_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {n}" for c, n in zip(("liq", "added", "dr", "pr", "po", "de", "sw"), TEXT))
_LAB = f"""lab AS (SELECT {m.sql_address('p_partkey % 17 + 1')} AS token, arg_max(p_partkey, p_partkey) AS k FROM part WHERE p_partkey % 17 NOT IN (3, 11) GROUP BY 1),
labels_ AS (SELECT token, CASE WHEN k % 17 = 5 THEN NULL ELSE p_brand END AS symbol, p_name AS name, CASE WHEN k % 17 = 6 THEN NULL ELSE CAST(6 + (k % 17 + CASE WHEN k % 17 IN (2, 9) THEN 1 ELSE 0 END) % 13 AS INTEGER) END AS token_decimals
  FROM lab JOIN part ON p_partkey = k)"""
_PRICE = f"""pr0 AS (SELECT CASE WHEN p_partkey % 28 < 14 THEN '{m.SPOKES[0]}' ELSE '{m.SPOKES[1]}' END AS spoke, p_partkey % 14 AS r, CAST(round(p_retailprice * 100) AS HUGEINT) * 1000000 AS price, p_partkey AS k
  FROM part WHERE p_partkey % 14 <> 13 AND CAST(round(p_retailprice * 100) AS BIGINT) % 7 <> 3),
prices_ AS (SELECT spoke, r, arg_max(price, k) AS price, {m.T0} + max(k) AS priced_at FROM pr0 GROUP BY spoke, r)"""

ORACLES = {
    "hub_additive_fold": f"WITH {m.HB} SELECT a AS asset_id, {_POOL_TEXT}, ev AS events FROM hs",
    "hub_latest_wins": f"WITH {m.HB} SELECT a AS asset_id, CAST(ix AS VARCHAR) AS drawn_index, CAST(rate AS VARCHAR) AS drawn_rate, CAST(fees AS VARCHAR) AS realized_fees, ts AS index_timestamp, fee AS liquidity_fee, und AS underlying, decs AS decimals FROM hs",
    "hub_assets_current": f"WITH {m.HB} SELECT 1 AS chain_id, '{m.HUB}' AS hub, a AS asset_id, {_POOL_TEXT}, CAST(ix AS VARCHAR) AS drawn_index, und AS underlying FROM hs",
    "listed_tokens": f"WITH {m.HB} SELECT DISTINCT 1 AS chain_id, {m.sql_address('a + 1')} AS underlying FROM hb WHERE kind = 12",
    "latest_prices": f"WITH {_PRICE} SELECT spoke, r AS reserve_id, CAST(price AS VARCHAR) AS price, priced_at FROM prices_",
    "label_gap": f"WITH {m.HB}, {_LAB} SELECT DISTINCT 1 AS chain_id, {m.sql_address('a + 1')} AS underlying FROM hb WHERE kind = 12 AND {m.sql_address('a + 1')} NOT IN (SELECT token FROM labels_)",
    "decimals_audit": f"WITH {m.HB}, {_LAB} SELECT a AS asset_id, und AS underlying, decs AS decimals, token_decimals FROM hs JOIN labels_ ON token = und WHERE token_decimals <> decs",
    "scaled_amounts": "WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v, CAST(o_orderkey % 21 AS INTEGER) AS d FROM orders) "
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || {_decimal('v', 'd')} AS amount FROM o",
    "clean_labels": f"""SELECT {m.sql_address('p_partkey')} AS token, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_brand END AS symbol, left(trim(repeat(p_name, 5)), 64) AS name,
 CASE WHEN p_partkey % 300 - 10 BETWEEN 0 AND 255 THEN CAST(p_partkey % 300 - 10 AS INTEGER) END AS token_decimals FROM part""",
    "oracle_batches": """SELECT l_orderkey AS priced_at, CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE count(*) END AS n, CAST(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE count(*) FILTER (WHERE l_quantity >= 5) END AS BIGINT) AS accepted,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(sum(CASE WHEN l_quantity < 5 THEN 0 ELSE l_quantity END) AS BIGINT) AS VARCHAR) END AS total FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY l_orderkey""",
    "drawn_index_at": f"WITH {_AT} SELECT a AS asset_id, CAST(ixa AS VARCHAR) AS index_at FROM pool",
    "total_added_assets": f"WITH {_AT} SELECT a AS asset_id, CAST(unr AS VARCHAR) AS unrealized_fees, CAST(total AS VARCHAR) AS total_added_assets FROM pool",
    "supplied_amount": f"WITH {_AT} SELECT a AS asset_id, CAST((1000000 * (total + 1000000)) // (added + 1000000) AS VARCHAR) AS supplied FROM pool",
    "valued_positions": f"WITH {_VAL} SELECT usr AS user, spoke, r AS reserve_id, a AS asset_id, decs AS decimals, CAST(supplied AS VARCHAR) AS supplied, CAST(drawn_debt AS VARCHAR) AS drawn_debt, CAST(premium_debt AS VARCHAR) AS premium_debt, CAST(drawn_debt + premium_debt AS VARCHAR) AS total_debt, CAST(premium_ray AS VARCHAR) AS premium_ray FROM val",
    "enriched_positions": f"""WITH {_VAL}, {_LAB}, {_PRICE}, e AS (SELECT val.*, symbol, name, CASE WHEN good AND und IS NOT NULL THEN price END AS p, drawn_debt + premium_debt AS debt,
 CAST('1' || repeat('0', 18 - decs) AS HUGEINT) AS up FROM val LEFT JOIN labels_ ON token = und LEFT JOIN prices_ pp ON pp.spoke = val.spoke AND pp.r = val.r)
SELECT usr AS user, spoke, r AS reserve_id, symbol, name, und AS underlying, {_decimal('supplied', 'decs')} AS supplied, {_decimal('debt', 'decs')} AS debt, {_decimal('premium_ray', '27')} AS premium,
 {_decimal('p', '8')} AS price_usd, {_decimal('(supplied * p * up)', '26')} AS supplied_usd, {_decimal('(debt * p * up)', '26')} AS debt_usd FROM e""",
    "unpriced_nulls": f"WITH {_VAL} SELECT r AS reserve_id, count(*) AS n, count(supplied) AS scaled, CAST(0 AS BIGINT) AS priced, CAST(0 AS BIGINT) AS in_usd FROM val GROUP BY r",
    "pricing_staleness": f"WITH {_VAL}, {_PRICE} SELECT max({m.T0} + 400 - priced_at) AS oldest_age, max({m.T0} + 400 - priced_at) > 300 AS stale FROM val JOIN prices_ pp ON pp.spoke = val.spoke AND pp.r = val.r WHERE good AND und IS NOT NULL",
    "spoke_totals": f"""WITH {_VAL}, {_PRICE}, e AS (SELECT usr, val.spoke, supplied * price * CAST('1' || repeat('0', 18 - decs) AS HUGEINT) AS sv, (drawn_debt + premium_debt) * price * CAST('1' || repeat('0', 18 - decs) AS HUGEINT) AS dv
 FROM val JOIN prices_ pp ON pp.spoke = val.spoke AND pp.r = val.r WHERE good)
SELECT usr AS user, spoke, CAST(sum(sv) AS VARCHAR) AS supplied_value, CAST(sum(dv) AS VARCHAR) AS debt_value, CAST(sum(sv) - sum(dv) AS VARCHAR) AS net_worth FROM e GROUP BY usr, spoke""",
    "price_asof": """WITH o AS (SELECT o_orderkey, o_custkey % 17 AS asset_id, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders)
SELECT o_orderkey, asset_id, CAST(last_value(CASE WHEN o_orderstatus = 'F' THEN price END IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY o_orderkey) AS VARCHAR) AS price FROM o""",
}

#: The quotient by long division in two steps of seven digits, which keeps its products in range.
_HEALTH = f"""WITH {_VAL}, {_PRICE}, fl AS (SELECT usr, spoke, r, coalesce(arg_max(flag, event_id), false) AS flag FROM spd GROUP BY usr, spoke, r),
e AS (SELECT val.usr, val.spoke, CASE WHEN flag THEN supplied * price * CAST('1' || repeat('0', 18 - decs) AS HUGEINT) * (5000 + val.r * 100) ELSE 0::HUGEINT END AS sv,
 (drawn_debt + premium_debt) * price * CAST('1' || repeat('0', 18 - decs) AS HUGEINT) AS dv
 FROM val JOIN prices_ pp ON pp.spoke = val.spoke AND pp.r = val.r JOIN fl ON fl.usr = val.usr AND fl.spoke = val.spoke AND fl.r = val.r WHERE good),
t AS (SELECT usr, spoke, CAST(sum(sv) AS HUGEINT) AS n, CAST(sum(dv) AS HUGEINT) AS d FROM e GROUP BY usr, spoke),
q AS (SELECT *, CASE WHEN d > 0 THEN n // d END AS q0, CASE WHEN d > 0 THEN (n % d) * 10000000 END AS r0 FROM t)
SELECT usr AS user, spoke, CAST(q0 * 100000000000000 + (r0 // d) * 10000000 + ((r0 % d) * 10000000) // d AS VARCHAR) AS health_factor FROM q"""

_E18 = "1000000000000000000::HUGEINT"
_WIDE = f"""WITH {_VAL}, {_PRICE}, x AS (SELECT j.*, sup * (total + 1000000) AS n, added + 1000000 AS d, pr * ixa - po AS ray, price FROM j LEFT JOIN prices_ pp ON pp.spoke = j.spoke AND pp.r = j.r),
y AS (SELECT *, CASE WHEN good THEN (n // d) * {_E18} + ((n % d) * {_E18}) // d END AS s, CASE WHEN good THEN (dr * ixa + 999999999) // 1000000000 END AS dd, CASE WHEN good THEN (ray + 999999999) // 1000000000 END AS pd FROM x)
SELECT usr AS user, spoke, r AS reserve_id, CAST(s AS VARCHAR) AS supplied, CAST(dd AS VARCHAR) AS drawn_debt, CAST(pd AS VARCHAR) AS premium_debt, CAST(dd + pd AS VARCHAR) AS total_debt,
 CASE WHEN NOT good THEN NULL WHEN ray = 0 THEN '0' ELSE ray || '000000000000000000' END AS premium_ray,
 CASE WHEN s * price = 0 THEN '0' ELSE (s * price) || repeat('0', 18 - decs) END AS supplied_value, CASE WHEN NOT good THEN ixa IS NOT NULL END AS negative FROM y"""
_Q = "WITH q AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS HUGEINT) AS v, CAST(o_custkey + 1 AS HUGEINT) AS c FROM orders)"
_THEN = _AT.replace(str(AT), str(THEN)).replace("FROM orders)", f"FROM orders WHERE {m.T0} + o_orderkey // 10 <= {THEN})")
ORACLES |= {
    "total_added_assets_then": f"WITH {_THEN} SELECT a AS asset_id, CAST(ixa AS VARCHAR) AS index_at, CASE WHEN ix IS NOT NULL THEN CAST(unr AS VARCHAR) END AS unrealized_fees, CAST(total AS VARCHAR) AS total_added_assets FROM pool",
    "listing_counts": f"WITH {m.HB} SELECT 1 AS chain_id, {m.sql_address('a + 1')} AS underlying, count(*) AS n FROM hb WHERE kind = 12 GROUP BY a",
    "headroom": f"{_Q} SELECT o_orderkey, CAST(1000000000000000000::HUGEINT - (1000000000000000000000000000000000000::HUGEINT + v * 10000000000000000 - 1) // (v * 10000000000000000) AS VARCHAR) AS headroom FROM q",
    "derived_prices": f"{_Q} SELECT o_orderkey, CAST(least((v * (1000000000000000000::HUGEINT + c * 10000000000000)) // 1000000000000000000, 20000000::HUGEINT) AS VARCHAR) AS price FROM q",
    "price_deviation": f"{_Q} SELECT o_orderkey, CAST((abs(c * 100 - 5000) * 10000) // (v + c * 100 - 5000) AS VARCHAR) AS deviation_bps FROM q WHERE v + c * 100 - 5000 > 0",
}
ORACLES |= {"health_factor": _HEALTH, "valued_positions_wide": _WIDE}

#: Second names of queries that once had a form over part of the rows.
WHOLE = ("latest_prices", "enriched_positions", "pricing_staleness", "spoke_totals", "label_gap", "decimals_audit", "health_factor")
QUERIES |= {f"{n}_whole": QUERIES[n] for n in WHOLE}
ORACLES |= {f"{n}_whole": ORACLES[n] for n in WHOLE}
