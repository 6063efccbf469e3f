"""Continuous ingest of dispatched block ranges: each one replaces its range in the signed ledger.

What lands is one row per dispatched range, with its events; a range without events empties it. In a micro-batch the last
dispatch of a block counts. Exactly the landed ranges are retracted, no block between them, and retraction reads only the
ledger's partitions of these blocks. A batch's rows go to a partition of their own, overwritten when the batch
runs again, so a replay after a failure changes nothing; it never reads its own rows. The checkpoint of the query is the resume point.

A reorganisation is a range too: empty (or with the new branch's events) and marked ``rewind``, which sets the cursor back
to the block before it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import folds, generations, maintained
from ..operators.chain import truncate_above
from ..operators.ledger import KEYS, append, current
from ..operators.page import label_gap

EVENT = (
    "chain_id int, address string, block_number long, log_index int, block_hash string, block_timestamp long, tx_hash string, "
    "tx_index int, event_name string, topic1 string, topic2 string, topic3 string, body string, data string"
)
NESTED = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in EVENT.split(", ") if not c.startswith("chain_id"))
RANGE = f"chain_id int, range_from long, range_to long, dispatch long, head long, rewind boolean, events array<struct<{NESTED}>>"
LEDGER = EVENT + ", version long, sign int"
STORED = LEDGER + ", batch_id long, block_part long"
PROGRESS = "batch_id long, chain_id int, block_from long, block_to long, dispatch long, appended long, rewind boolean, cursor long, head long, lag long, depth long, seconds double"
#: Ranges are matched with blocks by pieces of so many blocks.
PIECE = 1024


def ledger(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The ledger's rows, or those of its batches up to one."""
    rows = spark.read.schema(STORED).parquet(path)
    return (rows if upto is None else rows.where(F.col("batch_id") <= upto)).drop("batch_id", "block_part")


def land(ranges: DataFrame, source: str, fmt: str = "json") -> None:
    """Append dispatched ranges (rows of RANGE) to the folder that the stream watches."""
    ranges.write.mode("append").format(fmt).save(source)


def dispatches(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of RANGE from ranges (chain_id, range_from, range_to, dispatch, head, rewind) and the events of their blocks."""
    names = [c.split()[0] for c in EVENT.split(", ") if not c.startswith("chain_id")]
    kinds = dict(c.split() for c in EVENT.split(", "))
    fields = [(F.col(n) if n in events.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names]
    placed = events.select("chain_id", _piece(F.col("block_number")), F.struct(*fields).alias("e"))
    hit = _pieces(ranges.dropDuplicates(["chain_id", "range_from", "range_to", "dispatch"])).join(placed, ["chain_id", "piece"]).where("e.block_number BETWEEN range_from AND range_to")
    got = hit.groupBy("chain_id", "range_from", "range_to", "dispatch").agg(F.collect_list("e").alias("events"))
    all_rows = ranges.join(got, ["chain_id", "range_from", "range_to", "dispatch"], "left")
    return all_rows.select("chain_id", "range_from", "range_to", "dispatch", "head", "rewind", F.coalesce("events", F.array().cast(f"array<struct<{NESTED}>>")).alias("events"))


def _piece(block: Column) -> Column:
    return F.floor(block / PIECE).alias("piece")


def _pieces(ranges: DataFrame) -> DataFrame:
    """Each range once for every piece of blocks that it touches."""
    steps = F.sequence(F.floor(F.col("range_from") / PIECE), F.floor(F.col("range_to") / PIECE))
    return ranges.withColumn("piece", F.explode(steps))


def _dispatched(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranges of a batch and the events that count: those of the last dispatch of their block.

    A range that landed twice under one number is one, and so is an event; of different ranges with one number the later one counts.
    """
    batch = batch.dropDuplicates(["chain_id", "range_from", "range_to", "dispatch"])
    order = F.struct("dispatch", "range_from", "range_to")
    ranges = batch.select("chain_id", "range_from", "range_to", order.alias("turn"))
    each = batch.select("chain_id", "range_from", "range_to", order.alias("turn"), F.explode("events").alias("e"))
    outside = ~F.col("e.block_number").between(F.col("range_from"), F.col("range_to"))
    each = each.select("chain_id", "turn", "e.*", F.when(outside, F.raise_error(F.lit("event outside its range"))).cast("int").alias("_in"))
    each = each.where("_in IS NULL").drop("_in").withColumn("piece", _piece(F.col("block_number")))
    later = _pieces(ranges).select("chain_id", "piece", "range_from", "range_to", F.col("turn").alias("other"))
    beaten = (each.chain_id == later.chain_id) & (each.piece == later.piece) & each.block_number.between(later.range_from, later.range_to) & (later.other > each.turn)
    kept = each.join(later, beaten, "left_anti")
    return batch.drop("events"), kept.select(*[c.split()[0] for c in EVENT.split(", ")]).dropDuplicates(list(KEYS))


def retractions(past: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows that retract what is live in any of the ranges; blocks between them stay."""
    wanted = _pieces(ranges.select("chain_id", "range_from", "range_to")).withColumnRenamed("chain_id", "_chain")
    own = past.withColumn("piece", _piece(F.col("block_number")))
    within = (own.chain_id == wanted._chain) & (own.piece == wanted.piece) & own.block_number.between(wanted.range_from, wanted.range_to)
    return current(own.join(wanted, within, "left_semi").drop("piece")).withColumn("sign", F.lit(-1))


def dispatch(batch: DataFrame, batch_id: int, path: str, progress: str, deltas: str | None = None, listings: str | None = None, labels: DataFrame | None = None, view: str | None = None, poison: str | None = None) -> None:
    """Replace the batch's ranges; with ``deltas`` keep the typed position deltas too, with ``listings`` the counts of listed tokens.

    Deltas are a table of generations (``operators.generations``), published when the batch is whole; with ``view`` the positions
    of ``operators.maintained`` are kept from them; with ``poison`` rows that can't be folded go there, each with its fault, and
    stop no other, where without it they stop the batch. With ``labels`` the listed tokens that were never asked about are added to
    ``listings``/gaps. Only the numbers of the millions of blocks that a batch touches reach the driver.
    """
    spark, began = batch.sparkSession, time.monotonic()
    batch = batch.persist()
    ranges, events = _dispatched(batch)
    spans = F.explode(F.sequence(F.expr("range_from div 1000000"), F.expr("range_to div 1000000")))
    parts = [r[0] for r in ranges.select(spans.alias("p")).distinct().collect()]
    past = spark.read.schema(STORED).parquet(path).where((F.col("batch_id") != batch_id) & F.col("block_part").isin(parts)).drop("batch_id", "block_part")
    rows = append(events, batch_id)
    rows = rows.unionByName(retractions(past.select(*rows.columns), ranges))
    rows = rows.withColumn("block_part", F.expr("block_number div 1000000"))
    rows.write.mode("overwrite").partitionBy("block_part").parquet(f"{path}/batch_id={batch_id}")
    own = spark.read.schema(LEDGER).parquet(f"{path}/batch_id={batch_id}")
    if deltas:
        if poison:
            folds.poison(own).write.mode("overwrite").parquet(f"{poison}/batch_id={batch_id}")
        generations.write_batch(folds.position_rows(folds.sound(own) if poison else own), deltas, batch_id, store)
    if listings:
        folds.listing_counts(own).write.mode("overwrite").parquet(f"{listings}/counts/batch_id={batch_id}")
        if labels is not None:
            label_gap(folds.listed_tokens(own.where("sign = 1")), labels).write.mode("overwrite").parquet(f"{listings}/gaps/batch_id={batch_id}")
    _told(ranges, events, batch_id, progress, began).write.mode("overwrite").parquet(f"{progress}/batch_id={batch_id}")
    if deltas:
        generations.publish_batch(spark, deltas, batch_id)
        if view:
            maintained.maintain(spark, deltas, view, batch_id)
    batch.unpersist()


def store(rows: DataFrame, folder: str) -> None:
    folds.store_positions(rows, folder, "overwrite")


def positions(spark: SparkSession, deltas: str) -> DataFrame:
    """The positions of the stored deltas as they are published."""
    return folds.stored_positions(generations.read(spark, deltas, folds.STORED))


def rebuild(spark: SparkSession, path: str, deltas: str, view: str | None = None, sound_only: bool = False) -> int | None:
    """Make the stored deltas, and the view, again from the ledger; a stream may run meanwhile and goes on from there.

    ``sound_only`` leaves out what a stream with a ``poison`` table leaves out.

    The ledger is read up to the last batch that is whole, which is returned; later batches stand beside the new base.
    """
    upto = generations.head(spark, deltas)
    if upto is not None:
        rows = ledger(spark, path, upto)
        rows = folds.position_rows(folds.sound(rows) if sound_only else rows)
        name = generations.rebuild(rows, deltas, upto, store)
        if view:
            maintained.rebuild(generations.base(spark, deltas, folds.STORED, name), view, upto)
    return upto


def _told(ranges: DataFrame, events: DataFrame, batch_id: int, progress: str, began: float) -> DataFrame:
    """A row per range: what it appended, and its chain's cursor, highest head and lag after the batch.

    ``depth`` is how many blocks behind the cursor of the batch before a rewind set it, ``seconds`` what the batch took until here.
    """
    counted = _pieces(ranges).join(events.select("chain_id", "block_number", _piece(F.col("block_number"))), ["chain_id", "piece"])
    counted = counted.where("block_number BETWEEN range_from AND range_to").groupBy("chain_id", "range_from", "range_to", "dispatch").agg(F.count("*").alias("appended"))
    before = ranges.sparkSession.read.schema(PROGRESS).parquet(progress).where(F.col("batch_id") != batch_id).groupBy("chain_id")
    before = before.agg(F.max("head").alias("known"), F.max_by("cursor", "batch_id").alias("_was"))
    last = F.max_by(F.when(F.col("rewind"), F.col("range_from") - 1).otherwise(F.col("range_to")), F.struct("dispatch", "range_from", "range_to"))
    state = ranges.groupBy("chain_id").agg(last.alias("cursor"), F.max("head").alias("told"))
    state = state.join(before, "chain_id", "left").select("chain_id", "cursor", F.greatest("told", "known").alias("head"), "_was")
    back = F.when(F.col("rewind"), F.greatest(F.lit(0), F.col("_was") - F.col("range_from") + 1))
    df = ranges.drop("head").join(counted, ["chain_id", "range_from", "range_to", "dispatch"], "left").join(state, "chain_id")
    return df.select(
        F.lit(batch_id).cast("long").alias("batch_id"), "chain_id", F.col("range_from").alias("block_from"), F.col("range_to").alias("block_to"), "dispatch",
        F.coalesce("appended", F.lit(0)).cast("long").alias("appended"), F.coalesce("rewind", F.lit(False)).alias("rewind"), "cursor", "head",
        F.greatest(F.lit(0), F.coalesce("head", "cursor") - F.col("cursor")).cast("long").alias("lag"),
        back.cast("long").alias("depth"), F.lit(time.monotonic() - began).alias("seconds"),
    )


def cursors(progress: DataFrame) -> DataFrame:
    """Per chain the cursor, head and lag after the last batch."""
    last = F.max_by(F.struct("cursor", "head", "lag"), "batch_id").alias("s")
    return progress.groupBy("chain_id").agg(last).select("chain_id", "s.*")


def throughput(progress: DataFrame) -> DataFrame:
    """Per batch the rows it appended, the seconds it took, rows a second and the deepest reorganisation, null without one."""
    each = progress.where("batch_id >= 0").groupBy("batch_id").agg(F.sum("appended").alias("appended"), F.max("seconds").alias("seconds"), F.max("depth").alias("depth"))
    return each.withColumn("rows_per_second", F.col("appended") / F.col("seconds"))


def rewind(headers: DataFrame, ancestor: int) -> DataFrame:
    """The headers that stay after a reorganisation; the range above is landed empty and marked ``rewind``."""
    return truncate_above(headers, ancestor)


def start(spark: SparkSession, path: str, progress: str) -> None:
    """Empty tables, so that the first batch has something to read."""
    empty = lambda schema: spark.createDataFrame([], ", ".join(c for c in schema.split(", ") if not c.startswith("batch_id")))
    empty(LEDGER).withColumn("block_part", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("block_part").parquet(f"{path}/batch_id=-1")
    empty(PROGRESS).write.mode("overwrite").parquet(f"{progress}/batch_id=-1")


def start_ingest(spark: SparkSession, source: str, path: str, checkpoint: str, progress: str, files_per_batch: int | None = 16, fmt: str = "json", **more) -> StreamingQuery:
    """Ingest landed ranges, all that are there now; run again for later ones. ``more`` goes to ``dispatch``.

    Without ``files_per_batch`` all that is there is one batch.
    """
    start(spark, path, progress)
    reader = spark.readStream.schema(RANGE).format(fmt)
    stream = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).load(source)
    write = stream.writeStream.foreachBatch(lambda df, n: dispatch(df, n, path, progress, **more))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def continuous_sums(events: DataFrame) -> DataFrame:
    """The additive fold as a streaming aggregation, for output in update mode; no watermark, so no late row is dropped.

    Flags are latest-wins over live rows, which update mode can't hold; they come from the stored deltas.
    """
    df = folds.position_deltas(events).groupBy(*folds.POSITION).agg(*folds._sums(folds.SUMS), F.sum("events").alias("events"))
    return df.select(*folds.POSITION, *folds._joined(folds.SUMS), "events")
