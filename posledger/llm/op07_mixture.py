"""Operator 7, mixing sources to target weights.

Every document gets a hash-random key. A source's documents in order of their keys are cut at the
source's budget: whole passes over the source first, then the documents that the rest reaches, the
last one in part. The order is never sorted as a whole: keys are uniform, so equal ranges of the
key space are even buckets; a prefix sum over the buckets' totals gives each bucket its offset, and
within a bucket a window finishes the sum. A source with a third of all rows is spread over
all buckets.

Targets: sources in order of code points (null last) weigh ``weights`` in turn and share the total
size; none exceeds ``cap`` times its own size, and what it leaves is shared by weight among the others.

Nulls: a null text has size 0, null sources are one source, null ids are allowed. Repeated rows are
documents of their own; rows with equal id and size tie and are interchangeable. An empty table gives an
empty result. Columns of the input that are carried keep their names, but those called as a column of the result
(``size``, ``source_size``, ``target``, ``taken``, in any case) are returned as ``carried_`` and their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS = 64
MADE = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """From one row per source (``_mix_source``, ``source_size``) to its target.

    The sources whose cap is least in proportion to their weight fill first: with sources in that
    order, the level of the first one that stays under its cap is the level of all after it.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(Window.orderBy("_mix_source")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap)
    ranked = ranked.withColumn("_total", F.sum("source_size").over(everything))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_mix_source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after))
    ranked = ranked.withColumn("_at", F.row_number().over(fill)).withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    first = ranked.withColumn("_first", F.min(F.when(F.col("_open"), F.col("_at"))).over(everything))
    first = first.withColumn("_lambda", F.min(F.when(F.col("_at") == F.col("_first"), F.col("_level"))).over(everything))
    target = F.when(F.col("_at") < F.col("_first"), F.col("_cap").cast("double")).otherwise(F.col("_lambda") * F.col("_w"))
    return first.select("_mix_source", "source_size", target.alias("target"))


def mixture(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: str = "mix", carry: tuple = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every document with its size, its source's size and target, and the words taken of it."""
    size = n_words(F.col("text"))
    rows = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("_mix_row"),
        size.alias("size"),
        # never null, ordered as the source is, with the null source last
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("_mix_source"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), size.cast("string"))).alias("_mix_key"),
    )
    n = max(LEAST_BUCKETS, -(-docs.count() // ROWS_PER_BUCKET))
    place = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_mix_bucket", F.shiftright(place * n, 32)).repartition("_mix_source", "_mix_bucket")
    buckets = rows.groupBy("_mix_source", "_mix_bucket").agg(F.sum("size").alias("_mix_sum"))
    targets = source_targets(buckets.groupBy("_mix_source").agg(F.sum("_mix_sum").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("_mix_offset", F.coalesce(F.sum("_mix_sum").over(earlier), F.lit(0))).drop("_mix_sum")
    offsets = offsets.join(targets, "_mix_source")
    ahead = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["_mix_source", "_mix_bucket"])
    placed = placed.withColumn("_mix_before", F.col("_mix_offset") + F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size") - F.col("_mix_before")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    carried = [F.col("_mix_row")[c].alias(f"carried_{c}" if c.lower() in MADE else c) for c in carry]
    return placed.select(*carried, "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5, 2, 1], CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)) AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER f1, 0) AS DOUBLE)) / CAST(sum(w) OVER f2 AS DOUBLE) AS level, row_number() OVER f AS "at" FROM w
  WINDOW f AS (ORDER BY cap / w, source NULLS LAST),
    f1 AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f2 AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT *, min(CASE WHEN level * w <= cap THEN "at" END) OVER () AS opens FROM l),
t AS (SELECT source, source_size, CASE WHEN "at" < opens THEN CAST(cap AS DOUBLE) ELSE w * min(CASE WHEN "at" = opens THEN level END) OVER () END AS target FROM o),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix|', coalesce(CAST(d.doc_id AS VARCHAR), ''), '|', CAST(d.size AS VARCHAR))), d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(budget % source_size - ahead, size)) END AS BIGINT) AS taken
FROM b"""
