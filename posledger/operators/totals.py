"""Totals of wallets per Spoke that are kept: a change of a price or an index reaches only what it changes.

The view holds every position with its last value, and the quote of its reserve (index, pool totals, decimals, price), in
buckets of *reserves*: the way from a changed quote to the positions it values. Totals are held in buckets of *wallets*. A step takes
changed positions and changed quotes, values these positions and those of these reserves again, and adds to the wallets' totals
what their values gained or lost. Buckets without a change are neither read nor written.

Files of a step go to folders of its own, and one pointer, replaced whole, says for each bucket which folder is its own: a step
that failed isn't there, one that the view has already is not applied again. Only numbers of buckets reach the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wideint as w
from ..sources import files
from . import valuation
from .risk import WALLET

BUCKETS = 64
RESERVE = ("chain_id", "spoke", "reserve_id")
POSITION = ("chain_id", "user", "spoke", "reserve_id")
SHARES = ("supplied_shares", "drawn_shares", "premium_shares", "premium_offset_ray")
QUOTE = ("index_at", "total_added_assets", "pool_added_shares", "decimals", "price")
VALUES = ("supplied_value", "debt_value")
TYPES = {"chain_id": "int", "reserve_id": "long", "changed": "boolean", "valued": "long"}
NEW, OLD = VALUES, tuple(f"was_{c}" for c in VALUES)


def _ddl(*names: str) -> str:
    return ", ".join(f"{n} {TYPES.get(n, 'string')}" for n in names)


KINDS = {
    "positions": (RESERVE, _ddl(*POSITION, *SHARES, *NEW, *OLD, "changed")),
    "quotes": (RESERVE, _ddl(*RESERVE, *QUOTE)),
    "totals": (WALLET, _ddl(*WALLET, *VALUES, "valued")),
}


def _worth(supplied, drawn, premium, offset, index, total, added, decimals, price):
    if price is None or decimals is None or not (supplied or drawn):
        return None, None
    got, _, _, owed, _ = valuation._position(supplied, drawn, premium, offset, index, total, added)
    return w._value(got, decimals, price)[0], w._value(owed, decimals, price)[0]


def _bucket(key: tuple, buckets: int) -> Column:
    return (F.crc32(F.concat_ws(":", *[F.col(c).cast("string") for c in key]).cast("binary")) % buckets).cast("int")


def _typed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; two different rows of one key are an error, equal ones are one."""
    key = POSITION if "user" in names else RESERVE
    rows = df.select(*[F.col(c).cast(TYPES.get(c, "string")).alias(c) for c in names]).distinct()
    one = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.any_value(F.struct(*names)).alias("_row"))
    return one.select(F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("two states of one key in a step")).cast(one.schema["_row"].dataType)).alias("_row")).select("_row.*")


def _paths(path: str, state: dict, kind: str, of: set) -> list[str]:
    return [f"{path}/{kind}/{folder}/bucket={k}" for k, folder in state[kind].items() if int(k) in of]


def _read(spark: SparkSession, path: str, state: dict, kind: str, of: set | None = None) -> DataFrame:
    paths = _paths(path, state, kind, set(range(state["buckets"])) if of is None else of)
    return spark.read.schema(KINDS[kind][1]).parquet(*paths) if paths else spark.createDataFrame([], KINDS[kind][1])


def _write(rows: DataFrame, path: str, kind: str, buckets: int, folder: str) -> dict:
    """Write the buckets of a step; which of them have rows."""
    dealt = rows.withColumn("bucket", _bucket(KINDS[kind][0], buckets)).hint("rebalance", "bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{kind}/{folder}")
    return {x.split("=")[1]: folder for x in files.names(rows.sparkSession, f"{path}/{kind}/{folder}") if x.startswith("bucket=")}


def _touched(key: tuple, buckets: int, *rows: DataFrame) -> set:
    found = [df.select(_bucket(key, buckets).alias("b")).distinct() for df in rows]
    return {r[0] for df in found for r in df.collect()}


def _valued(old: DataFrame, positions: DataFrame, quotes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The positions of the touched buckets, of which those with a new state or a fresh quote are valued anew."""
    state = F.struct(*SHARES)
    both = old.select(*POSITION, F.lit(0).alias("_at"), state.alias("_s"), F.struct(*NEW).alias("_v"))
    both = both.unionByName(positions.select(*POSITION, F.lit(1).alias("_at"), state.alias("_s")), allowMissingColumns=True)
    one = both.groupBy(*POSITION).agg(F.max_by("_s", "_at").alias("_s"), F.max("_at").alias("_moved"), F.min_by("_v", "_at").alias("_v"))
    marked = quotes.join(fresh.select(*RESERVE, F.lit(True).alias("_fresh")), [*RESERVE], "left")
    rows = one.join(valuation.sized(marked), [*RESERVE], "left").withColumn("changed", (F.col("_moved") == 1) | F.coalesce("_fresh", F.lit(False)))
    price = F.when(F.col("changed"), F.col("price"))
    made = w.integers(_worth, NEW)(*[F.col(f"_s.{c}") for c in SHARES], *QUOTE[:-1], price)
    rows = rows.withColumn("_made", made)
    new = [F.when(F.col("changed"), F.col(f"_made.{c}")).otherwise(F.col(f"_v.{c}")).alias(c) for c in NEW]
    return rows.select(*POSITION, "_s.*", *new, *[F.col(f"_v.{c}").alias(o) for c, o in zip(NEW, OLD)], "changed")


def _summed(rows: DataFrame) -> DataFrame:
    """Wallets with their sums; the values in ``OLD`` are taken off. Those of which nothing is valued any more go."""
    parts = {}
    for name, new, was in zip("sd", NEW, OLD):
        more, less = (w.limbs(F.col(c), w.VALUE_LIMBS) for c in (new, was))
        parts[name] = [F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)) for a, b in zip(more, less)]
    df = rows.groupBy(*WALLET).agg(*w.sums_wide(parts), F.sum("valued").alias("valued"))
    return df.select(*WALLET, *[w.joined_sums(n, w.VALUE_LIMBS).alias(c) for n, c in zip("sd", VALUES)], "valued").where("valued <> 0")


def apply(spark: SparkSession, path: str, step: int, positions: DataFrame | None = None, quotes: DataFrame | None = None, buckets: int = BUCKETS) -> dict:
    """Apply a step's changed positions (``POSITION`` and ``SHARES``) and quotes (``RESERVE`` and ``QUOTE``); one caller at a time.

    Other columns are ignored. A position that is closed has shares of zero; one whose reserve has no quote, or a quote that can't
    value it, has no value until that changes. A step up to the view's last is not applied again. Returns how many positions were
    valued, and the buckets that were written.
    """
    state = files.pointer(spark, f"{path}/_totals") or {"step": None, "buckets": buckets, "positions": {}, "quotes": {}, "totals": {}}
    if state["step"] is not None and step <= state["step"]:
        return {"valued": 0, "reserve_buckets": [], "wallet_buckets": []}
    n, folder = state["buckets"], f"{step}-{uuid.uuid4().hex}"
    nothing = lambda *names: spark.createDataFrame([], _ddl(*names))
    positions = nothing(*POSITION, *SHARES) if positions is None else _typed(positions, *POSITION, *SHARES)
    fresh = nothing(*RESERVE, *QUOTE) if quotes is None else _typed(quotes, *RESERVE, *QUOTE)
    positions, fresh = positions.persist(), fresh.persist()
    try:
        of = _touched(RESERVE, n, positions, fresh)
        if not of:
            files.publish(spark, f"{path}/_totals", {**state, "step": step})
            return {"valued": 0, "reserve_buckets": [], "wallet_buckets": []}
        kept = _read(spark, path, state, "quotes", of).join(fresh, [*RESERVE], "left_anti").unionByName(fresh)
        own = {"quotes": _write(kept, path, "quotes", n, folder)}
        now = _read(spark, path, {**state, "quotes": {**state["quotes"], **own["quotes"]}}, "quotes", of)
        own["positions"] = _write(_valued(_read(spark, path, state, "positions", of), positions, now, fresh), path, "positions", n, folder)
    finally:
        positions.unpersist()
        fresh.unpersist()
    done = _read(spark, path, {**state, **own}, "positions", of).where("changed")
    delta = done.withColumn("valued", (F.col(NEW[0]).isNotNull().cast("long") - F.col(OLD[0]).isNotNull().cast("long")))
    delta = delta.select(*WALLET, *NEW, *OLD, "valued")
    wallets = _touched(WALLET, n, delta)
    old = _read(spark, path, state, "totals", wallets)
    own["totals"] = _write(_summed(delta.unionByName(old, allowMissingColumns=True)), path, "totals", n, folder)
    # a touched bucket of which nothing is left has no folder
    rest = {k: v for k, v in state["totals"].items() if int(k) not in wallets}
    merged = {kind: {**(rest if kind == "totals" else state[kind]), **own[kind]} for kind in KINDS}
    count = done.count()
    files.publish(spark, f"{path}/_totals", {"step": step, "buckets": n, **merged})
    return {"valued": count, "reserve_buckets": sorted(of), "wallet_buckets": sorted(wallets)}


def view(spark: SparkSession, path: str, chain: int | None = None, user: str | None = None, spoke: str | None = None) -> DataFrame:
    """Supplied, debt and net worth per wallet and Spoke, as digits; of one wallet at one Spoke out of its bucket."""
    state = files.pointer(spark, f"{path}/_totals")
    if state is None:
        rows = spark.createDataFrame([], KINDS["totals"][1])
    elif user is None:
        rows = _read(spark, path, state, "totals")
    else:
        key = spark.range(1).select(F.lit(chain).alias("chain_id"), F.lit(user.lower()).alias("user"), F.lit(spoke.lower()).alias("spoke"))
        rows = _read(spark, path, state, "totals", _touched(WALLET, state["buckets"], key))
        rows = rows.where((F.col("chain_id") == chain) & (F.col("user") == user.lower()) & (F.col("spoke") == spoke.lower()))
    supplied, debt = (w.limbs(F.col(c), w.VALUE_LIMBS) for c in VALUES)
    net = w.joined(*[F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)) for a, b in zip(supplied, debt)])
    return rows.select(*WALLET, *VALUES, net.alias("net_worth"))
