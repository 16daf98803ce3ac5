"""k-means with exact integer arithmetic; nearest centroids by a progressive search over Walsh-Hadamard coefficients.

Vectors and centroids are transformed by the integer Walsh-Hadamard matrix, which multiplies squared distances by the
number of components. Squared coefficient differences are added up from coarse coefficients (few sign changes) to fine ones.
Each sum is a lower bound of the whole: a centroid whose sum is larger than the whole distance to some other one is strictly
worse and dropped; those that are left after all coefficients have exact distances. Nothing is rounded, so ties are real.

Vectors are transformed and written once; a round reads them, and each task hands on one sum per centroid and component.
The driver sees these sums added up, a bounded table of centroids x components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, finite, floors, lists, matrix, saved, small_batches, widened

_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def sequency(size: int) -> np.ndarray:
    """Coefficients of the natural order, sorted by the sign changes of their rows: coarse to fine."""
    return np.argsort((np.diff(walsh(np.eye(size, dtype=np.int64)), axis=0) != 0).sum(0), kind="stable")


def walsh(x: np.ndarray) -> np.ndarray:
    """Each row times the Walsh-Hadamard matrix in natural order, by butterflies; the row length is a power of two."""
    rows, size = x.shape
    half = 1
    while half < size:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(rows, size)


def restored(t: np.ndarray) -> np.ndarray:
    """The rows whose coefficients, coarse to fine, are ``t``; of Python integers."""
    natural = np.empty(t.shape, dtype=object)
    natural[:, sequency(t.shape[1])] = t
    return walsh(natural) // t.shape[1]


def nearest(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of coefficients ``t`` the first of the nearest centroids ``c``, the squared distance of the coefficients, and how
    many coefficient differences were computed."""
    size = t.shape[1]
    t, c = widened(size, t, c)
    end = min(4, size)
    partial = ((t[:, None, :end] - c[:, :end]) ** 2).sum(2)
    alive, worst = np.ones(partial.shape, dtype=bool), 2**62 if partial.dtype != object else 1 << 200
    limit, work = None, partial.size * end
    while end < size:
        guess = partial.argmin(1)
        whole = ((t - c[guess]) ** 2).sum(1)
        work += t.size
        limit = whole if limit is None else np.minimum(limit, whole)
        alive &= (partial <= limit[:, None]).astype(bool)
        partial = np.where(alive, partial, worst)
        at, end = end, end * 2
        row, column = np.nonzero(alive)
        partial[row, column] += ((t[row, at:end] - c[column, at:end]) ** 2).sum(1)
        work += len(row) * (end - at)
    near = partial.argmin(1)
    return near, partial[np.arange(len(t)), near], work


def _assignments(spark: SparkSession, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = spark.sparkContext.broadcast(centroids)  # as many rows as there are centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = shared.value.shape[1]
        c = walsh(shared.value)[:, sequency(size)]
        for batch in batches:
            if batch.num_rows:
                near, distance, _ = nearest(matrix(batch.column(1)), c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(near, pa.int32()), pa.array((distance // size).tolist(), pa.int64())],
                    names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _moved(spark: SparkSession, vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the vectors nearest to each centroid; one that has none stays."""
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, size = shared.value.shape
        c = walsh(shared.value)[:, sequency(size)]
        sums, sizes = np.zeros((count, size), dtype=object), np.zeros(count, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                t = matrix(batch.column(1))
                near = nearest(t, c)[0]
                order = np.argsort(near, kind="stable")
                some, first = np.unique(near[order], return_index=True)
                sums[some] += np.add.reduceat(t[order].astype(object) if np.abs(t).max() > 2**50 else t[order], first, axis=0)
                sizes += np.bincount(near, minlength=count)
        for j in np.flatnonzero(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size + 1, j), pa.int32()), pa.array(np.arange(-1, size), pa.int32()),
                 pa.array([str(int(v)) for v in (sizes[j], *sums[j])])], names=["cluster", "place", "total"])

    added = vectors.mapInArrow(run, "cluster int, place int, total string").groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # centroids x (components + 1) rows
    size, out = centroids.shape[1], centroids.copy()
    totals = {(r.cluster, r.place): int(r.total) for r in added}
    for j in {cluster for cluster, _ in totals}:
        out[j] = restored(np.array([[totals[j, i] for i in range(size)]], dtype=object))[0] // totals[j, -1]
    return out


def clusters(rows: DataFrame, size: int = 64, count: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with ``size`` components (a power of
    two), none of them null or non-finite.

    Components become floor(scale * x). Centroids start as the ``count`` vectors with the smallest SHA-256 of seed and
    vec_id, in that order; rows that repeat an id in order of their coefficients, null ids last. Fewer vectors give fewer centroids. Every
    row counts, repeated ones too. Ties go to the smaller centroid; a mean is rounded down. A component of 2**55 / scale or
    more, or a distance beyond a long, is an ArithmeticError or OverflowError. Extra columns are ignored; an empty table
    gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    v = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == size) & finite(F.col("v")))

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sequency(size)
        for batch in batches:
            if batch.num_rows:
                t = walsh(floors(matrix(batch.column(1)), scale))[:, order]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(t)], names=["vec_id", "t"])

    scratch = Scratch(spark, "centroids")
    vectors = scratch.saved(kept.mapInArrow(transformed, "vec_id long, t array<long>"))
    name = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = vectors.orderBy(name.asc_nulls_last(), "t").limit(count).select("t").collect()
    if not start:
        return spark.createDataFrame([], _RESULT)
    centroids = restored(np.array([r.t for r in start], dtype=object)).astype(np.int64)
    for _ in range(rounds):
        centroids = _moved(spark, vectors, centroids)
    done = saved(_assignments(spark, vectors, centroids), "clusters")
    scratch.remove()
    inertia = {r.cluster: int(r.total) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(j, inertia[j], sum(inertia.values()), digests[j]) for j in sorted(inertia)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(*[part.split()[0] for part in _RESULT.split(", ")])


def oracle(size: int = 64, count: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2:") -> str:
    """DuckDB SQL for the rows of ``clusters`` over table embeddings."""
    nearest = """
  SELECT vec_id, cluster, distance FROM (
    SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
    FROM components v JOIN {c} c ON v.place = c.place GROUP BY v.vec_id, c.cluster)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1"""
    steps = []
    for r in range(rounds):
        steps.append(f"""
a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')}),
m{r} AS (SELECT a.cluster, v.place, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN components v USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.place, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM c{r} c LEFT JOIN m{r} m USING (cluster, place)),""")
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size}),
components AS MATERIALIZED (
  SELECT vec_id, generate_subscripts(embedding, 1) AS place, floor({scale} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
start AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1 AS cluster FROM kept
  QUALIFY cluster < {count}),
c0 AS MATERIALIZED (SELECT cluster, place, x FROM start JOIN components USING (vec_id)),{''.join(steps)}
last AS MATERIALIZED ({nearest.format(c=f'c{rounds}')}),
digests AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM last JOIN digests USING (cluster)
"""
