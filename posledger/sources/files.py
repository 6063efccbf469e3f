"""Small files of a table's folder on any file system that Spark reads: pointers that are replaced whole, names, removal."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a pointer: written beside it and renamed over it, so that a reader finds the old one or the new one."""
    beside, fs = _at(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    place = fs.makeQualified(_at(spark, path)[0])
    hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), place, over)


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What a pointer says, None where there is none yet."""
    place, fs = _at(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    place, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _at(spark, path)
    fs.delete(place, True)
