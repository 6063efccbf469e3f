"""Queries over logs, headers, replay, streaming and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chain, folds, reconcile
from ..operators import ledger as lg
from ..sources import logs
from . import mapping as m
from ..sources import shared
from ..streaming import ingest
from . import pools

TOPIC = {name: "0x" + f"{k + 1:064x}" for k, name in enumerate(logs.SPOKE_EVENTS)}
HUB_TOPIC = {name: "0x" + f"{k + 101:064x}" for k, name in enumerate(logs.HUB_EVENTS)}
FORK = 700
#: Blocks of a folder of landed logs here.
LANDED = 100


def _word(x: str) -> str:
    return f"lpad(lower(hex({x})), 64, '0')"


def _negative(x: str) -> str:
    """The two's complement word of -x for 0 <= x < 2**62."""
    return f"if(x0 = 0, {_word('0L')}, concat(repeat('f', 48), lpad(lower(hex(-({x}))), 16, '0')))".replace("x0", x)


def _log(df: DataFrame, contract: str, cases: dict, names: dict, *more: str) -> DataFrame:
    """Rows as contract logs; ``cases`` has per value of ``kind`` the event, its topics and its data words."""
    pick = lambda of: "CASE kind " + " ".join(f"WHEN {k} THEN {of(*v)}" for k, v in cases.items()) + " END"
    topics = pick(lambda name, topics, data: f"array('{names[name]}', " + ", ".join(f"concat('0x', {t})" for t in topics) + ")")
    data = pick(lambda name, topics, data: f"concat('0x', {', '.join(data)})" if data else "'0x'")
    return df.selectExpr(
        f"{m.CHAIN} AS chain_id", f"upper({contract}) AS address", f"{topics} AS topics", f"{data} AS data", "block_number",
        "if(log_index % 3 = 0, null, block_timestamp) AS block_timestamp", "'0x0' AS block_hash", "'0x1' AS tx_hash", "0 AS tx_index", "log_index", *more,
    )


def raw_spoke_logs(spark, sf_dir) -> DataFrame:
    """Every Spoke event as a contract log."""
    key = [_word("reserve_id"), _word("user_id"), _word("user_id")]
    cases = {
        "'view'": ("Supply", key, [_word("s"), _word("s + 7")]), "'click'": ("Withdraw", key, [_word("s div 4"), _word("s div 5")]),
        "'purchase'": ("Borrow", key, [_word("s div 2"), _word("s div 2 + 1")]),
        "'error'": ("Repay", key, [_word("s div 8"), _word("s div 8 + 3"), _word("s div 16"), _negative("s"), _word("s")]),
        "'signup'": ("SetUsingAsCollateral", key, [_word("event_id % 2")]),
    }
    return _log(m.spoke_base(spark, sf_dir).withColumn("kind", F.col("event_type")), "spoke", cases, TOPIC, "spoke")


def raw_hub_logs(spark, sf_dir) -> DataFrame:
    """Every pool event as a contract log: all 13 kinds, with words beyond 64 bits."""
    a, spoke, zeros = _word("asset_id"), _word("id % 5"), lambda x, n: f"lpad(concat(lower(hex({x})), repeat('0', {n})), 64, '0')"
    premium = [_word("v div 50"), _negative("v"), _word("v div 9")]
    two = [a, spoke]
    events = [
        (two, [_word("v * 9"), _word("v * 10")]), (two, [_word("v"), _word("v")]), (two, [_word("v"), _word("v + 2")]), (two, [_word("v div 4"), *premium, _word("v div 4"), _word("v div 100")]),
        (two, [_word("v div 8"), *premium, zeros("v", 20)]), ([a, spoke, spoke], [_word("v div 9"), zeros("v", 20)]), (two, [_word("v div 20"), _word("v")]), (two, [_word("v div 3")]),
        (two, [_word("v div 6")]), (two, premium), ([a], [zeros("v", 8), zeros("v", 6), _word("v div 1000")]), ([a], [_word("1"), _word("id % 3000"), _word("2"), _word("3")]), ([a, _word("asset_id + 1")], [_word("6 + asset_id % 13")]),
    ]
    cases = {k: (name, *event) for k, (name, event) in enumerate(zip(m.HUB_EVENTS, events))}
    return _log(m.hub_base(spark, sf_dir), f"'{m.HUB}'", cases, HUB_TOPIC)


def _times(spark, sf_dir) -> DataFrame:
    return m.spoke_base(spark, sf_dir).groupBy(F.lit(m.CHAIN).alias("chain_id"), "block_number").agg(F.min("block_timestamp").alias("block_timestamp"))


def _filled(spark, sf_dir) -> DataFrame:
    return logs.fill_timestamps(raw_spoke_logs(spark, sf_dir), _times(spark, sf_dir))


def _decoded(spark, sf_dir) -> DataFrame:
    filled = logs.event_set(_filled(spark, sf_dir), TOPIC)
    return logs.decode_logs(filled, TOPIC, m.SPOKES)


def log_scan(spark, sf_dir):
    """Supplies and borrows of one Spoke in a third of the blocks, out of the landed logs of both Spokes and the pool; the address is given in upper case."""
    at, raw = shared.table_path(spark, "logs"), raw_spoke_logs(spark, sf_dir).drop("spoke")
    logs.land_logs(raw.unionByName(raw_hub_logs(spark, sf_dir)), at, LANDED)
    lo, hi = _scanned(raw.agg(F.max("block_number")).first()[0])
    found = logs.raw_logs(spark, at, m.CHAIN, [m.SPOKES[0].upper()], [TOPIC["Supply"].upper(), TOPIC["Borrow"]], lo, hi)
    return found.select("block_number", "log_index", "address", F.get("topics", F.lit(0)).alias("topic0"), "data")


def _scanned(last: int) -> tuple:
    return last // 3, 2 * (last // 3)


def timestamp_fill(spark, sf_dir):
    return _filled(spark, sf_dir).select("block_number", "log_index", "block_timestamp")


def _field(path):
    return F.get_json_object("body", f"$.{path}")


def decode_logs(spark, sf_dir):
    """All logs of both Spokes."""
    return _decoded(spark, sf_dir).select(
        "block_number", "log_index", "address", "event_name", _field("user").alias("user"), _field("reserveId").alias("reserve"),
        F.coalesce(*[_field(x) for x in ("suppliedShares", "withdrawnShares", "drawnShares")]).alias("shares"),
        F.coalesce(*[_field(x) for x in ("suppliedAmount", "withdrawnAmount", "drawnAmount", "totalAmountRepaid")]).alias("amount"),
        _field("premiumDelta.offsetRayDelta").alias("offset_ray"), _field("usingAsCollateral").alias("flag"),
    )


def decode_hub_logs(spark, sf_dir):
    """All logs of the pool, 13 kinds; amounts by kind and asset, the wide ones as text."""
    times = m.hub_base(spark, sf_dir).groupBy(F.lit(m.CHAIN).alias("chain_id"), "block_number").agg(F.min("block_timestamp").alias("block_timestamp"))
    e = logs.decode_logs(logs.fill_timestamps(raw_hub_logs(spark, sf_dir), times), HUB_TOPIC, m.HUB, logs.HUB_EVENTS)
    amount = F.coalesce(*[_field(x) for x in ("amount", "drawnAmount", "assets", "premiumDelta.offsetRayDelta", "shares", "accruedFees", "config.liquidityFee", "decimals")])
    return e.select("block_number", "log_index", "event_name", _field("assetId").alias("asset"), amount.alias("amount"), _field("deficitAmountRay").alias("deficit"), _field("drawnIndex").alias("index"), _field("underlying").alias("underlying"))


def decoded_fold(spark, sf_dir):
    """From logs to positions: decode, append, fold."""
    p = folds.positions_current(lg.append(_decoded(spark, sf_dir), 1))
    return p.select("user", "spoke", "reserve_id", F.col("supplied_shares").cast("string").alias("supplied_shares"), F.col("premium_offset_ray"), "using_as_collateral", "events")


def header_contiguity(spark, sf_dir):
    """Every 997th header is missing and every 1009th has a foreign parent."""
    h = m.headers(spark, sf_dir).where("block_number % 997 <> 5").withColumn("parent_hash", F.when(F.col("block_number") % 1009 == 7, "x").otherwise(F.col("parent_hash")))
    return chain.contiguity_breaks(h)


def fork_point(spark, sf_dir):
    own, other = m.headers(spark, sf_dir), m.headers(spark, sf_dir, "b", FORK)
    lost = m.headers(spark, sf_dir, "c", -1).withColumn("chain_id", F.lit(3))
    own = own.unionByName(own.withColumn("chain_id", F.lit(2))).unionByName(own.withColumn("chain_id", F.lit(3)))
    return chain.fork_point(own, other.unionByName(m.headers(spark, sf_dir).withColumn("chain_id", F.lit(2))).unionByName(lost))


def settled_split(spark, sf_dir):
    return chain.settled(m.headers(spark, sf_dir)).groupBy("settled").agg(F.count("*").alias("n"), F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))


def header_window(spark, sf_dir):
    return chain.retain(m.headers(spark, sf_dir)).select("block_number", "hash")


def replay_plan(spark, sf_dir):
    """Ranges of 64 blocks over all settled blocks, with the rows that each would dispatch."""
    e = m.spoke_base(spark, sf_dir).select("block_number")
    head = e.agg(F.max("block_number")).first()[0]
    safe = chain.safe_head(head, 16)
    plan = chain.replay_plan(spark, 0, safe, 64, safe)
    rows = e.groupBy((F.col("block_number") - F.col("block_number") % 64).alias("range_from")).agg(F.sum((F.col("block_number") <= safe).cast("long")).alias("n"))
    return plan.join(rows, "range_from", "left").select("range_from", "range_to", F.coalesce("n", F.lit(0)).alias("n"))


def _landed(spark, sf_dir, at: str) -> None:
    """Ranges of 500 blocks land in files: all but each third; then the rest, with each tenth block's range twice and one emptied
    and filled again, all in the same files as ranges far from them."""
    events = m.spoke_events(spark, sf_dir)
    last = events.agg(F.max("block_number")).first()[0]
    ranges = spark.range(0, last + 1, 500).selectExpr(
        f"{m.CHAIN} AS chain_id", "id AS range_from", f"least(id + 499, {last}L) AS range_to", "id div 500 AS n", f"{last}L + 12 AS head", "false AS rewind"
    )
    shown = ["chain_id", "range_from", "range_to", "dispatch", "head", "rewind"]
    first = ranges.where("n % 3 <> 1").withColumn("dispatch", F.lit(1).cast("long"))
    second = ranges.where("n % 3 = 1 OR n % 10 = 0").withColumn("dispatch", F.lit(2).cast("long"))
    emptied = ranges.where("n % 10 = 5").withColumn("dispatch", F.lit(3).cast("long"))
    filled = ranges.where("n % 10 = 5").withColumn("dispatch", F.lit(4).cast("long"))
    gone = ranges.where("n = 2").withColumn("dispatch", F.lit(5).cast("long")).withColumn("rewind", F.lit(True))
    land = lambda rows, some: ingest.land(ingest.dispatches(some, rows.select(*shown)).coalesce(2), f"{at}/source")
    land(first, events)
    land(second.unionByName(filled).unionByName(second.where("n % 10 = 0")), events)
    land(emptied.unionByName(gone), events.where("false"))


def stream_ranges(spark, sf_dir):
    """Ranges that land with gaps, twice in one batch, emptied, and emptied and filled again: the ledger's fold."""
    at = shared.table_path(spark, "stream")
    _landed(spark, sf_dir, at)
    ingest.start_ingest(spark, f"{at}/source", f"{at}/ledger", f"{at}/checkpoint", f"{at}/progress", 100).awaitTermination()
    p = folds.positions_current(ingest.ledger(spark, f"{at}/ledger"))
    return p.select("user", "spoke", "reserve_id", F.col("supplied_shares").cast("string").alias("supplied_shares"), "premium_offset_ray", "using_as_collateral", "events").where("events > 0 OR using_as_collateral")


def stream_fold_equals_batch(spark, sf_dir):
    """The typed deltas kept by micro-batches over landed ranges, the last third of the blocks landing twice, folded."""
    at, events = shared.table_path(spark, "stream"), m.spoke_events(spark, sf_dir)
    blocks = events.agg(F.max("block_number")).first()[0] + 1
    for turn, k in enumerate((0, 1, 2, 2)):
        lo, hi = -(-k * blocks // 3), -(-(k + 1) * blocks // 3) - 1
        ranges = spark.range(lo, hi + 1, 250).selectExpr(f"{m.CHAIN} AS chain_id", "id AS range_from", f"least(id + 249, {hi}L) AS range_to", f"{turn}L AS dispatch", f"{blocks}L AS head", "false AS rewind")
        ingest.land(ingest.dispatches(events.where(F.col("block_number").between(lo, hi)), ranges), f"{at}/source")
        ingest.start_ingest(spark, f"{at}/source", f"{at}/ledger", f"{at}/checkpoint", f"{at}/progress", None, deltas=f"{at}/deltas").awaitTermination()
    p = ingest.positions(spark, f"{at}/deltas")
    return p.select("user", "spoke", "reserve_id", F.col("supplied_shares").cast("string").alias("supplied_shares"), "using_as_collateral", "events")


def _hub(spark, sf_dir, until: int | None = None) -> DataFrame:
    events = m.hub_events(spark, sf_dir)
    return folds.hub_assets_current(lg.append(events if until is None else events.where(F.col("block_number") <= until), 1))


def _perturbed(view: DataFrame) -> DataFrame:
    """A snapshot in which asset 4's liquidity and asset 9's rate are off by one, and asset 16 is missing from the fold's side."""
    off = lambda c, a: (F.col(c).cast("decimal(38,0)") + F.when(F.col("asset_id") == a, 1).otherwise(0)).cast("decimal(38,0)")
    return view.withColumn("liquidity", off("liquidity", 4)).withColumn("drawn_rate", off("drawn_rate", 9))


def reconcile_hub_delta(spark, sf_dir):
    """The fold of the blocks after 300 against the change between two snapshots."""
    late = folds.hub_assets_current(lg.append(m.hub_events(spark, sf_dir).where("block_number > 300"), 1)).where("asset_id <> 16")
    r = reconcile.reconcile_hub(late, _perturbed(_hub(spark, sf_dir)), _hub(spark, sf_dir, 300))
    return r.select("asset_id", "field", "status")


def reconcile_hub_absolute(spark, sf_dir):
    r = reconcile.reconcile_hub(_hub(spark, sf_dir).where("asset_id <> 16"), _perturbed(_hub(spark, sf_dir)))
    return r.select("asset_id", "field", "status")


def drift_by_field(spark, sf_dir):
    """Which fields drift, how far at most and where."""
    r = reconcile.reconcile_hub(_hub(spark, sf_dir).where("asset_id <> 16"), _perturbed(_hub(spark, sf_dir)).where("asset_id <> 16"))
    return reconcile.drift(r).select("field", "n", "largest_gap", "asset_id")


def reconcile_positions(spark, sf_dir):
    """Valued positions against getters that are off by one unit in each wallet's reserve 7."""
    v = pools._valued(spark, sf_dir)
    off = F.when(F.col("reserve_id") == 7, 1).otherwise(0)
    getters = v.select(*folds.POSITION, (F.col("value.supplied") + off).cast("decimal(38,0)").alias("supplied"), F.col("value.drawn_debt").alias("drawn_debt"), F.col("value.premium_debt").alias("premium_debt"))
    return reconcile.summary(reconcile.reconcile_positions(v, getters))


QUERIES = {
    x.__name__: x
    for x in (
        log_scan, timestamp_fill, decode_logs, decode_hub_logs, decoded_fold, header_contiguity, fork_point, settled_split, header_window, replay_plan, stream_fold_equals_batch, stream_ranges,
        reconcile_hub_delta, reconcile_hub_absolute, drift_by_field, reconcile_positions,
    )
}

_FIELDS = "('liquidity', 1), ('added_shares', 1), ('drawn_shares', 1), ('premium_shares', 1), ('swept', 1), ('drawn_index', 0), ('drawn_rate', 0), ('realized_fees', 0), ('premium_offset_ray', 1), ('deficit_ray', 1), ('liquidity_fee', 0), ('index_timestamp', 0)"
_STATUS = "CASE WHEN a = 16 THEN '{missing}' WHEN field = 'liquidity' AND a = 4 OR field = 'drawn_rate' AND a = 9 THEN 'mismatch' ELSE 'match' END"

ORACLES = {
    "log_scan": f"""WITH {m.SP}, e AS (SELECT max(b) AS last FROM sp)
SELECT b AS block_number, CAST(l AS INTEGER) AS log_index, '{m.SPOKES[0]}' AS address, CASE event_type WHEN 'view' THEN '{TOPIC["Supply"]}' ELSE '{TOPIC["Borrow"]}' END AS topic0,
 '0x' || lpad(lower(to_hex(CASE event_type WHEN 'view' THEN s ELSE s // 2 END)), 64, '0') || lpad(lower(to_hex(CASE event_type WHEN 'view' THEN s + 7 ELSE s // 2 + 1 END)), 64, '0') AS data
 FROM sp, e WHERE spoke = '{m.SPOKES[0]}' AND event_type IN ('view', 'purchase') AND b BETWEEN last // 3 AND 2 * (last // 3)""",
    "timestamp_fill": f"WITH {m.SP}, h AS (SELECT b, min(t) AS t FROM sp GROUP BY b) SELECT b AS block_number, CAST(l AS INTEGER) AS log_index, CASE WHEN l % 3 = 0 THEN h.t ELSE sp.t END AS block_timestamp FROM sp JOIN h USING (b)",
    "decode_logs": f"""WITH {m.SP} SELECT b AS block_number, CAST(l AS INTEGER) AS log_index, spoke AS address,
 CASE event_type WHEN 'view' THEN 'Supply' WHEN 'click' THEN 'Withdraw' WHEN 'purchase' THEN 'Borrow' WHEN 'error' THEN 'Repay' ELSE 'SetUsingAsCollateral' END AS event_name, usr AS user, CAST(r AS VARCHAR) AS reserve,
 CAST(CASE event_type WHEN 'view' THEN s WHEN 'click' THEN s // 4 WHEN 'purchase' THEN s // 2 WHEN 'error' THEN s // 8 END AS VARCHAR) AS shares,
 CAST(CASE event_type WHEN 'view' THEN s + 7 WHEN 'click' THEN s // 5 WHEN 'purchase' THEN s // 2 + 1 WHEN 'error' THEN s // 8 + 3 END AS VARCHAR) AS amount,
 CASE event_type WHEN 'error' THEN CAST(-s AS VARCHAR) END AS offset_ray, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END END AS flag FROM sp""",
    "decode_hub_logs": f"""WITH {m.HB}
SELECT b AS block_number, CAST(id % 10 AS INTEGER) AS log_index, list_extract(['{"', '".join(m.HUB_EVENTS)}'], CAST(kind + 1 AS INTEGER)) AS event_name, CAST(a AS VARCHAR) AS asset,
 CAST(CASE kind WHEN 0 THEN v * 10 WHEN 1 THEN v WHEN 2 THEN v + 2 WHEN 3 THEN v // 4 WHEN 4 THEN -v WHEN 5 THEN v // 9 WHEN 6 THEN v WHEN 7 THEN v // 3 WHEN 8 THEN v // 6 WHEN 9 THEN -v WHEN 10 THEN v // 1000 WHEN 11 THEN id % 3000 ELSE 6 + a % 13 END AS VARCHAR) AS amount,
 CASE WHEN kind IN (4, 5) THEN CAST(v * 1208925819614629174706176::HUGEINT AS VARCHAR) END AS deficit, CASE WHEN kind = 10 THEN CAST(v * 4294967296 AS VARCHAR) END AS "index",
 CASE WHEN kind = 12 THEN {m.sql_address('a + 1')} END AS underlying FROM hb""",
    "decoded_fold": f"WITH {m.SP} SELECT usr AS user, spoke, r AS reserve_id, CAST(sum(sup) AS VARCHAR) AS supplied_shares, CAST(sum(po) AS VARCHAR) AS premium_offset_ray, coalesce(arg_max(flag, event_id), false) AS using_as_collateral, CAST(sum(ev) AS BIGINT) AS events FROM spd GROUP BY usr, spoke, r",
    "header_contiguity": """WITH h AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 997 <> 5)
SELECT 1 AS chain_id, k AS block_number, CASE WHEN (k - 1) % 997 = 5 THEN 'gap' ELSE 'parent' END AS problem FROM h WHERE k > 0 AND ((k - 1) % 997 = 5 OR k % 1009 = 7)""",
    "fork_point": f"""SELECT 1 AS chain_id, 'reorg' AS verdict, CAST({FORK} AS BIGINT) AS ancestor, CAST({FORK + 1} AS BIGINT) AS retract_from, max(o_orderkey) AS retract_to FROM orders
UNION ALL SELECT 2, 'continuous', max(o_orderkey), NULL, NULL FROM orders UNION ALL SELECT 3, 'unrecoverable', NULL, NULL, NULL""",
    "settled_split": "SELECT o_orderkey <= (SELECT max(o_orderkey) - 128 FROM orders) AS settled, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1",
    "header_window": "SELECT o_orderkey AS block_number, md5(o_orderkey || 'a') AS hash FROM orders WHERE o_orderkey >= (SELECT max(o_orderkey) - 128 FROM orders)",
    "replay_plan": """WITH s AS (SELECT max(event_id // 10) - 16 AS safe FROM events)
SELECT event_id // 10 - (event_id // 10) % 64 AS range_from, least(event_id // 10 - (event_id // 10) % 64 + 63, safe) AS range_to, count(*) AS n FROM events, s WHERE event_id // 10 <= safe GROUP BY 1, 2""",
    "stream_fold_equals_batch": f"WITH {m.SP} SELECT usr AS user, spoke, r AS reserve_id, CAST(sum(sup) AS VARCHAR) AS supplied_shares, coalesce(arg_max(flag, event_id), false) AS using_as_collateral, CAST(sum(ev) AS BIGINT) AS events FROM spd GROUP BY usr, spoke, r",
    "stream_ranges": f"""WITH {m.SP} SELECT usr AS user, spoke, r AS reserve_id, CAST(sum(sup) AS VARCHAR) AS supplied_shares, CAST(sum(po) AS VARCHAR) AS premium_offset_ray,
 coalesce(arg_max(flag, event_id), false) AS using_as_collateral, CAST(sum(ev) AS BIGINT) AS events FROM spd WHERE b // 500 <> 2 GROUP BY usr, spoke, r HAVING sum(ev) > 0 OR coalesce(arg_max(flag, event_id), false)""",
    "reconcile_hub_absolute": f"WITH {m.HB} SELECT a AS asset_id, field, {_STATUS.format(missing='mismatch')} AS status FROM hs, (VALUES {_FIELDS}) AS f(field, additive)",
    "reconcile_hub_delta": f"WITH {m.HB} SELECT a AS asset_id, field, {_STATUS.format(missing='untouched')} AS status FROM hs, (VALUES {_FIELDS}) AS f(field, additive)",
    "drift_by_field": "SELECT 'liquidity' AS field, CAST(1 AS BIGINT) AS n, '1' AS largest_gap, CAST(4 AS BIGINT) AS asset_id WHERE (SELECT count(*) FROM orders WHERE o_custkey % 17 = 4) > 0 UNION ALL SELECT 'drawn_rate', 1, '1', 9 WHERE (SELECT count(*) FROM orders WHERE o_custkey % 17 = 9 AND o_orderkey % 13 = 10) > 0",
    "reconcile_positions": f"""WITH {pools._VAL} SELECT field, CASE WHEN NOT good THEN 'unvalued' WHEN field = 'supplied' AND r = 7 THEN 'mismatch' ELSE 'match' END AS status, count(*) AS n
 FROM val, (VALUES ('supplied'), ('drawn_debt'), ('premium_debt')) AS f(field) GROUP BY ALL""",
}
