"""Centroid clustering in integers, with a filter on PCA-rotated coordinates.

A vector becomes integers floor(256 * x). It is stored once with its leading coordinates on the principal axes and the norm
of the rest. For a centroid in the same form, the projected squared distance plus the squared difference of the two residual
norms is at most the squared distance. So the centroid of the least bound is measured first, exactly, and only those whose
bound doesn't exceed that distance are measured too. Floats only ever leave a centroid out with a margin beyond their
error; distances, sums and means are integers, so the result is that of the plain algorithm to the bit.

A round is one pass over the stored vectors: tasks add up the vectors of each cluster per batch, Spark adds these up, and
the new centroids (``k`` times the width, whatever the table's size) go with the next round.

Kept are vectors of exactly ``width`` components, none null, NaN or infinite. Repeated rows count each, a null id is an id
(its hash is null and comes last among the seeds), and with fewer vectors than ``k`` each is a centroid. Components of
2**19 or more in size can't have a distance in 64 bits: they are an error. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

SCALE = 256
MOST = 1 << 27
#: Leading axes that are stored; the bound is right with any number of them.
AXES = 12
#: The bounds' margin, relative to the squared norms: far above what 64-bit floats lose in sums of so few products.
MARGIN = 1e-9


def integers(vectors: DataFrame, width: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns vec_id and v, the integers of the kept vectors."""
    v = F.col(vector)
    sound = (F.size(v) == width) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    scaled = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-2.0 * MOST)), F.lit(2.0 * MOST))).cast("int"))
    kept = vectors.where(v.isNotNull() & sound).select(F.col(vec_id).alias("vec_id"), scaled.alias("v"))
    wide = F.exists("v", lambda x: (x >= MOST) | (x < -MOST))
    return kept.select("vec_id", F.when(wide, F.raise_error(F.lit("a component is too large for a distance in 64 bits")).cast("array<int>")).otherwise(F.col("v")).alias("v"))


def seeds(kept: DataFrame, k: int, salt: int = 2) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order; ``k`` rows reach the driver."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "vec_id", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def principal_axes(kept: DataFrame, width: int, axes: int = AXES) -> np.ndarray:
    """The leading eigenvectors of the covariance of all vectors, as columns; sums per task are added up by Spark."""

    def moments(batches):
        both, n = np.zeros((width + 1, width + 1)), 0
        for batch in batches:
            x = _matrix(batch.column("v"), width, float)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            both, n = both + x.T @ x, n + len(x)
        if n:
            i, j = np.triu_indices(width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both[i, j])], names=["i", "j", "s"])

    rows = kept.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    both = np.zeros((width + 1, width + 1))
    for i, j, s in rows:
        both[i, j] = both[j, i] = s
    n, mean = max(1.0, both[-1, -1]), both[-1, :-1] / max(1.0, both[-1, -1])
    return np.linalg.eigh(both[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1][:, : min(axes, width)]


def _form(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading coordinates, residual norm and squared norm of integer vectors."""
    lead, square = x @ axes, (x * x).sum(axis=1)
    return lead, np.sqrt(np.maximum(square - (lead * lead).sum(axis=1), 0)), square


def rotated(kept: DataFrame, axes: np.ndarray, width: int) -> DataFrame:
    """The kept vectors with ``lead``, ``rest`` and ``square``, as one stored table that every round reads."""

    def each(batches):
        for batch in batches:
            lead, rest, square = _form(_matrix(batch.column("v"), width, float), axes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1) * axes.shape[1], pa.int32()), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists, pa.array(rest), pa.array(square)], names=["vec_id", "v", "lead", "rest", "square"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return saved(kept.mapInArrow(each, f"vec_id {kind}, v array<int>, lead array<double>, rest double, square double"))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, square: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), its exact squared distance, and how many pairs were measured."""
    c_lead, c_rest, c_square = _form(centroids.astype(float), axes)
    low = (lead * lead).sum(axis=1)[:, None] + (c_lead * c_lead).sum(axis=1)[None] - 2 * lead @ c_lead.T + (rest[:, None] - c_rest[None]) ** 2
    low -= MARGIN * (square[:, None] + c_square[None] + 1)
    first = low.argmin(axis=1)
    gap = x - centroids[first]
    most = (gap * gap).sum(axis=1)
    maybe = low <= most[:, None]
    maybe[np.arange(len(x)), first] = False
    row, cluster = np.nonzero(maybe)  # by vector, and by number within one
    best, distance = first.copy(), most
    step = max(1, (1 << 20) // x.shape[1])
    for a in range(0, len(row), step):
        r, c = row[a : a + step], cluster[a : a + step]
        gap = x[r] - centroids[c]
        found = (gap * gap).sum(axis=1)
        order = np.lexsort((c, found, r))
        one = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
        r, c, found = r[one], c[one], found[one]
        better = (found < distance[r]) | ((found == distance[r]) & (c < best[r]))
        best[r[better]], distance[r[better]] = c[better], found[better]
    return best, distance, len(row) + len(x)


def _assigned(batch, centroids: np.ndarray, axes: np.ndarray):
    x = _matrix(batch.column("v"), centroids.shape[1])
    lead = _matrix(batch.column("lead"), axes.shape[1], float)
    rest, square = batch.column("rest").to_numpy(), batch.column("square").to_numpy()
    return x, *nearest(x, lead, rest, square, centroids, axes)


def round_sums(stored: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Per cluster its number of vectors, their exact componentwise sums and the number of pairs measured."""
    k, width = centroids.shape

    def each(batches):
        for batch in batches:
            x, best, _, measured = _assigned(batch, centroids, axes)
            order = np.argsort(best, kind="stable")
            has = np.flatnonzero(np.bincount(best, minlength=k))
            cut = np.searchsorted(best[order], has)
            if len(has):
                sums = np.add.reduceat(x[order], cut, axis=0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * width, pa.int32()), pa.array(sums.ravel()))
                pairs = np.where(np.arange(len(has)) == 0, measured, 0)
                yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(np.bincount(best, minlength=k)[has]), pa.array(pairs), lists], names=["cluster", "n", "measured", "sums"])

    partial = stored.select("v", "lead", "rest", "square").mapInArrow(each, "cluster int, n long, measured long, sums array<long>")
    summed = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"_{i}") for i in range(width)]
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), F.array(*summed).alias("sums"))


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, vec_id: str = "vec_id", vector: str = "embedding", axes: int = AXES) -> tuple[DataFrame, np.ndarray]:
    """Per kept vector its cluster and squared distance after ``rounds`` rounds, and the final centroids."""
    kept = saved(integers(vectors, width, vec_id, vector))
    centroids = seeds(kept, k)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, width), np.int64)
    turned = principal_axes(kept, width, axes)
    stored = rotated(kept, turned, width)
    for _ in range(rounds):
        for cluster, n, _, sums in round_sums(stored, centroids, turned).collect():
            centroids[cluster] = [int(s) // n for s in sums]

    def each(batches):
        for batch in batches:
            _, best, distance, _ = _assigned(batch, centroids, turned)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return stored.mapInArrow(each, f"vec_id {kind}, cluster int, distance long"), centroids


def cluster_digest(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64) -> DataFrame:
    """Per kept vector vec_id, cluster, distance, the inertia of its cluster and of all, and the digest of its final centroid."""
    rows, centroids = clusters(vectors, k, rounds, width)
    rows = saved(rows)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    each = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows
    own = {r.cluster: int(r.own) for r in each}
    told = [(i, own.get(i, 0), sum(own.values()), sha) for i, sha in names]
    table = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The plain algorithm as SQL: every distance in every round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
x AS MATERIALIZED (SELECT r, i, v[i] AS x FROM kept, unnest(range(1, {width + 1})) AS u(i)),
c0 AS MATERIALIZED (SELECT s.c, i, s.v[i] AS x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, vec_id, v) - 1 AS c, v FROM kept ORDER BY c LIMIT {k}) s, unnest(range(1, {width + 1})) AS u(i))"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""d{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM
  (SELECT r, c, sum((x.x - c{n}.x) * (x.x - c{n}.x)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(new.x, c{n}.x) AS x FROM c{n} LEFT JOIN
  (SELECT m.c AS c, i, {mean} AS x FROM d{n} JOIN x USING (r) GROUP BY m.c, i) new USING (c, i))""")
    return f"""WITH {", ".join(parts)},
name AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256 FROM d{rounds} JOIN kept USING (r) JOIN name ON name.c = m.c"""


ORACLE = oracle()
