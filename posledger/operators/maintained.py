"""Positions that are kept and not recomputed: a view in buckets of wallets, of which a batch rewrites the touched ones.

A bucket holds, for each of its positions, one row of sums and the live rows of its flag, in the form of the stored deltas, so
that it is folded like these. A batch's deltas are added to the buckets of their wallets only; the new files of these go to a
folder of the batch and one pointer, replaced whole, says for each bucket which folder is its own. What failed before the
pointer moved is not there; a batch that the pointer has already is not applied again; a batch that was missed is applied with the next.

A wallet's page reads one bucket, whatever the history. The pointer has an entry per bucket and is a few bytes for each.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import folds, generations

BUCKETS = 64


def bucket_of(chain: int, user: str, buckets: int) -> int:
    return zlib.crc32(f"{chain}:{user.lower()}".encode()) % buckets


def _bucket(buckets: int) -> Column:
    return (F.crc32(F.concat(F.col("chain_id").cast("string"), F.lit(":"), F.col("user")).cast("binary")) % buckets).cast("int")


def compacted(rows: DataFrame) -> DataFrame:
    """Stored deltas with one row of sums per position and scale, and of flags those that are not retracted, or retracted and not there."""
    flag = ("flag", *folds.ORDER, "version", "flag_sign")
    sums = [*folds.SUMS, "events"]
    deltas = rows.where("flag IS NULL").groupBy(*folds.POSITION, "scale").agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums])
    one = rows.where("flag IS NOT NULL").groupBy(*folds.POSITION, *folds.ORDER, "version")
    flags = one.agg(F.any_value("flag").alias("flag"), F.sum("flag_sign").cast(rows.schema["flag_sign"].dataType).alias("flag_sign")).where("flag_sign <> 0")
    return deltas.unionByName(flags, allowMissingColumns=True)


def _write(rows: DataFrame, buckets: int, folder: str) -> None:
    dealt = compacted(rows).withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", *folds.POSITION[1:]).write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _states(spark: SparkSession, path: str) -> tuple:
    """What the view holds, and the base that was rebuilt last; None where there is none."""
    return tuple(files.pointer(spark, f"{path}/{name}") for name in ("_view", "_rebuilt"))


def _paths(path: str, state: dict, of=None) -> list[str]:
    return [f"{path}/data/{folder}/bucket={k}" for k, folder in state["folders"].items() if of is None or int(k) in of]


def _read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def maintain(spark: SparkSession, deltas: str, path: str, upto: int, buckets: int = BUCKETS) -> list[int]:
    """Apply the batches of ``deltas`` that the view hasn't, up to one; returns the buckets it rewrote. One caller at a time.

    Only the numbers of the touched buckets reach the driver, at most ``buckets``.
    """
    state, rebuilt = _states(spark, path)
    state = state or {"buckets": buckets, "applied": generations.NONE, "generation": None, "folders": {}}
    if rebuilt and rebuilt["generation"] != state["generation"]:
        state = rebuilt
    elif state["applied"] >= upto:
        return []
    schema = folds.STORED
    new = generations.between(spark, deltas, schema, state["applied"], upto)
    touched = sorted(r[0] for r in new.select(_bucket(state["buckets"]).alias("b")).distinct().collect())
    folders = dict(state["folders"])
    if touched:
        old = _read(spark, _paths(path, state, set(touched)), schema)
        folder = f"{upto}-{uuid.uuid4().hex}"
        _write(old.unionByName(new), state["buckets"], f"{path}/data/{folder}")
        folders |= {str(k): folder for k in touched}
    files.publish(spark, f"{path}/_view", {**state, "applied": upto, "folders": folders})
    return touched


def rebuild(rows: DataFrame, path: str, upto: int, buckets: int = BUCKETS) -> None:
    """All buckets anew from the deltas of the ledger up to a batch, beside the running view; the next batch goes on from there."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    _write(rows, buckets, f"{path}/data/{name}")
    own = {x.split("=")[1]: name for x in files.names(spark, f"{path}/data/{name}") if x.startswith("bucket=")}
    files.publish(spark, f"{path}/_rebuilt", {"buckets": buckets, "applied": upto, "generation": name, "folders": own})


def view(spark: SparkSession, path: str, chain: int | None = None, user: str | None = None) -> DataFrame:
    """The view's rows, or those of one wallet's bucket; ``folds.stored_positions`` makes positions of them."""
    states = [s for s in _states(spark, path) if s]
    if not states:
        return spark.createDataFrame([], folds.STORED)
    state = max(states, key=lambda s: s["applied"])
    of = None if user is None else {bucket_of(chain, user, state["buckets"])}
    rows = _read(spark, _paths(path, state, of), folds.STORED)
    return rows if user is None else rows.where((F.col("chain_id") == chain) & (F.col("user") == user.lower()))


def expire(spark: SparkSession, path: str) -> None:
    """Remove folders of which no bucket is current any more; plans made earlier fail from then on."""
    used = {f for state in _states(spark, path) if state for f in state["folders"].values()}
    for name in files.names(spark, f"{path}/data"):
        if name not in used:
            files.remove(spark, f"{path}/data/{name}")
