"""Tables written to the folder that a cluster shares, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a local session gets one of its own, and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT_KEYS, SALTS = 1000, 64


def spread_join(df: DataFrame, other: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``df`` joined with ``other``, which has a row per key; keys that many rows of ``df`` have are dealt over many tasks.

    A key is hot with over a thousandth of all rows, so there are at most a thousand, which are broadcast; their rows go to
    one of ``SALTS`` parts by a hash of ``by``, and their row of ``other`` to each. ``df`` is read twice: it is to be a saved table.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    least = max(100, df.count() // HOT_KEYS)
    hot = F.broadcast(saved(counts.where(F.col("_n") > least).select(key, F.lit(SALTS).alias("_salts"))))
    left = df.join(hot, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull() & F.col(key).isNotNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))).drop("_salts")
    right = other.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


SMALL_EDGES = 2_000_000


def _forest(batches):
    """Roots of the edges of one partition: labels sink to the least over edges and along labels until they rest."""
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    ends = np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["node", "root"])


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """Connected components of edges (a, b) of longs, as (node, root) for each node that isn't its root.

    Up to ``small`` edges, counted first, are one task's (32 MB). Beyond, two star contractions
    alternate: every node points its larger neighbours, then its smaller ones, at its least neighbour,
    until the edges are stars and stay the same. Minima are combined before the shuffle, and the joins back
    are plain equi-joins that Spark splits where a star is large.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
    last = mark(edges)
    if last[0] <= small:
        return edges.coalesce(1).mapInArrow(_forest, "node long, root long")
    while last[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("x"), F.col("m").alias("y"))
        small = small.unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        edges = saved(small.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct())
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
