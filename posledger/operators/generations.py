"""Derived tables that can be rebuilt while a stream keeps adding to them.

A table is a base, made from the ledger up to a batch, and the batches after it. The stream writes each batch to a folder of
its own and then moves the pointer ``_head`` to it; a rebuild writes a new base beside the old one and then moves the pointer
``_base``, which names the base and the batch it goes up to. Each pointer has one writer and is replaced whole. A reader takes
both once: the base, and of the batches those after it, up to the head. So a rebuild and a stream never wait for one another,
whatever was written and not published is not there, and a plan that was made goes on reading the generation it was made of.

A batch that runs again writes its folder again; a base that holds the batch already hides it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources import files

NONE = -(2**62)


def head(spark: SparkSession, path: str) -> int | None:
    """The last whole batch."""
    told = files.pointer(spark, f"{path}/_head")
    return told and told["batch"]


def write_batch(rows: DataFrame, path: str, batch: int, write) -> None:
    """Write a batch's rows by ``write(rows, folder)``; they count after ``publish_batch``."""
    write(rows, f"{path}/batches/batch_id={batch}")


def publish_batch(spark: SparkSession, path: str, batch: int) -> None:
    last = head(spark, path)
    if last is None or last < batch:
        files.publish(spark, f"{path}/_head", {"batch": batch})


def rebuild(rows: DataFrame, path: str, upto: int, write) -> str:
    """A new base from ``rows``, which are those of the ledger up to batch ``upto``; it counts from the moment it is published."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    write(rows, f"{path}/base/{name}")
    files.publish(spark, f"{path}/_base", {"generation": name, "upto": upto})
    return name


def base(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """The rows of one base alone."""
    return spark.read.schema(schema).parquet(f"{path}/base/{name}")


def between(spark: SparkSession, path: str, schema: str, after: int, upto: int) -> DataFrame:
    """The rows of the batches after one and up to another; their folders are found by name. Batches that were removed are an error."""
    gone = files.pointer(spark, f"{path}/_expired")
    if gone and after < gone["upto"]:
        raise ValueError(f"batches up to {gone['upto']} are in the base only; rebuild what has those up to {after}")
    wanted = [x for x in files.names(spark, f"{path}/batches") if after < int(x.split("=")[1]) <= upto]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/batches/{x}" for x in wanted])


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as it is published now."""
    last, own = head(spark, path), files.pointer(spark, f"{path}/_base")
    last = NONE if last is None else last
    if own is None:
        return between(spark, path, schema, NONE, last)
    rows = base(spark, path, schema, own["generation"])
    return rows if last <= own["upto"] else rows.unionByName(between(spark, path, schema, own["upto"], last))


def expire(spark: SparkSession, path: str) -> None:
    """Remove what no reader will be given any more: other bases, and the batches that the base holds.

    Plans made before the last rebuild fail from then on; leave time for them.
    """
    own = files.pointer(spark, f"{path}/_base")
    if own is None:
        return
    files.publish(spark, f"{path}/_expired", {"upto": own["upto"]})
    for name in files.names(spark, f"{path}/base"):
        if name != own["generation"]:
            files.remove(spark, f"{path}/base/{name}")
    for name in files.names(spark, f"{path}/batches"):
        if int(name.split("=")[1]) <= own["upto"]:
            files.remove(spark, f"{path}/batches/{name}")
