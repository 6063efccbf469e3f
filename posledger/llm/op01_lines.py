"""Operator 1, line dedup by the spread of a line over sites.

A line (without the blanks around it) that stands on ``least_sites`` different sites is boilerplate,
and goes from every document. How many sites a line has is estimated by HyperLogLog sketches, one per
line hash, merged by the aggregation; where the estimate is within its error of the threshold,
sites are counted exactly. Only lines with at least that many rows and two sites are sketched: no
other can pass. A line that a third of all rows hold is combined before each shuffle.

Documents meet their boilerplate by a hash of their text, on which alone it depends, and one of 1,024 parts by
their other columns, so that the copies of one text do not meet in one task. Sets of line
hashes are broadcast only up to ``small`` rows, counted first; beyond, the same join is a shuffled one.

Null texts have no lines and stay null; blank lines always stay; the null site is a site; repeated rows
have equal results; an empty table gives an empty result; all columns of the input are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .statistics import BLANKS

LEAST_SITES = 5
PRECISION = 12
SMALL = 200_000
COPIES = 1024


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _checked(df: DataFrame, small: int) -> DataFrame:
    """Broadcast where there are at most ``small`` rows."""
    return F.broadcast(df) if df.count() <= small else df


def boilerplate(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES, precision: int = PRECISION, small: int = SMALL) -> DataFrame:
    """Hashes ``line`` of the lines that stand on ``least_sites`` sites or more."""
    lines = docs.select(F.xxhash64(F.col(site)).alias("site"), F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    lines = lines.select("site", bare(F.col("line")).alias("line")).where("line <> ''").select("site", F.xxhash64("line").alias("line"))
    can = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    if least_sites > 1:
        can = can.where((F.col("n") >= least_sites) & (F.col("lo") != F.col("hi")))
    can = _checked(saved(can.select("line")), small)
    spread = lines.join(can, "line").groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(precision))).alias("sites"))
    spread = saved(spread)
    error = 4 * 1.04 / 2 ** (precision / 2) * least_sites + 1
    near = spread.where(F.abs(F.col("sites") - least_sites) <= error).select("line")
    exact = lines.join(_checked(saved(near), small), "line").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").count()
    return spread.where(F.col("sites") - least_sites > error).select("line").unionByName(exact.where(F.col("count") >= least_sites).select("line"))


def _marked(docs: DataFrame, site: str, least_sites: int, precision: int, small: int) -> DataFrame:
    """The input as ``_row``, with its lines and the hashes of those that go."""
    gone = _checked(saved(boilerplate(docs, site, least_sites, precision, small)), small)
    others = [F.col(c) for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind]
    part = F.pmod(F.xxhash64(*others), F.lit(COPIES))
    key = [F.xxhash64("text").alias("k1"), F.hash("text", F.lit(7)).alias("k2"), part.alias("part")]
    lines = docs.select(*key, F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    hits = lines.select("k1", "k2", "part", F.xxhash64(bare(F.col("line"))).alias("line")).join(gone, "line").groupBy("k1", "k2", "part").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), *key)
    return rows.join(hits, ["k1", "k2", "part"], "left").select("_row", "gone", F.split("_row.text", "\n", -1).alias("lines"))


def _stays(gone: Column):
    return lambda line: (bare(line) == "") | ~F.array_contains(gone, F.xxhash64(bare(line)))


def without_boilerplate(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES, precision: int = PRECISION, small: int = SMALL) -> DataFrame:
    """The documents without their boilerplate lines; ``n_chars`` follows the text where there is such a column."""
    rows = _marked(docs, site, least_sites, precision, small)
    text = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(F.array_join(F.filter("lines", _stays(F.col("gone"))), "\n"))
    rows = rows.select("_row", text.alias("kept"))
    made = {"text": F.col("kept"), "n_chars": F.when(F.col("kept").isNull(), F.col("_row.n_chars")).otherwise(F.length("kept")) if "n_chars" in docs.columns else None}
    types = dict(docs.dtypes)
    return rows.select(*[(made[c].cast(types[c]) if c in made else F.col("_row")[c]).alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES, precision: int = PRECISION, small: int = SMALL) -> DataFrame:
    """A row per document: lines, removed lines, and a digest of the text that stays."""
    rows = _marked(docs.select("doc_id", "text", site), site, least_sites, precision, small)
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", _stays(F.col("gone"))))
    rows = rows.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "gone", kept.alias("kept"), F.size(F.coalesce("lines", F.array())).alias("n"))
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("kept", "\n"))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.size(F.coalesce("kept", F.array()))).cast("long").alias("n_removed"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
bare AS (SELECT *, trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS b FROM line),
gone AS (SELECT b FROM bare WHERE b <> '' GROUP BY b HAVING count(DISTINCT coalesce(source, chr(1))) >= 5),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE g.b IS NOT NULL) AS r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.b IS NULL), '') AS text
  FROM bare LEFT JOIN gone g USING (b) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)"""
