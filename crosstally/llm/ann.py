"""Nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Largest inner product becomes smallest distance once every vector gets a further coordinate that brings its norm to the
largest one. Lists come from k-means on a bounded sample; every vector is put into a list. A query visits its nearest lists.
Within a list, vectors are rotated at random and read in blocks of columns: a partial squared distance times
(dimensions / columns read) estimates the whole, and a candidate is given up once a hypothesis test says that it is
farther than the list's k-th best so far. Survivors are scored exactly on the original vectors.

Large lists are cut into chunks of vectors and blocks of queries, so a task's memory is bounded whatever the
lists' sizes; each gives its k best, and these are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Rows the k-means is fitted on at most (those whose ids hash lowest), and the most lists.
SAMPLE, MAX_LISTS = 20_000, 2048
#: Queries whose true neighbours tell how many lists to visit.
TUNED = 64
#: Most vectors, and most queries, of one task's group.
CHUNK, BLOCK = 20_000, 5_000
COLUMNS = 16
#: Width of the test in standard errors of the estimate: larger keeps more candidates.
WIDTH = 2.4


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of rows with an id and a vector that is not null, empty or zero and has finite numbers
    only. Rows that repeat an id count once, with the smallest vector."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def _matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column, a row each; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lists(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of ``count`` lists by k-means with a fixed start."""
    random = np.random.default_rng(3)
    centres = sample[random.choice(len(sample), count, replace=False)].copy()
    for _ in range(12):
        near = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None],
                           sample[random.choice(len(sample), count)])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1) - 2 * x @ centres.T


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings their norms to ``top``."""
    return np.column_stack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))])


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(5).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, rotated: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that the adaptive scan doesn't give up; both sides are rotated.

    The first rows give each query its limit, the ``k``-th best so far. A pair goes on to the next block of columns while
    its partial distance could still end below the limit; once few pairs are left only these are computed.
    """
    n, size = rotated.shape
    first = min(n, max(k, 64))
    lead = (queries**2).sum(1)[:, None] + (rotated[:first] ** 2).sum(1) - 2 * queries @ rotated[:first].T
    limit = np.partition(lead, k - 1, axis=1)[:, k - 1] if first >= k else np.full(len(queries), np.inf)
    start = tuple(x.ravel() for x in np.indices((len(queries), first)))
    if n == first:
        return start
    rest, partial, alive = rotated[first:], None, None
    for at in range(0, size, COLUMNS):
        end = min(size, at + COLUMNS)
        q, x = queries[:, at:end], rest[:, at:end]
        if alive is None:
            step = (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T
            partial = step if partial is None else partial + step
            bound = limit[:, None]
        else:
            partial = partial + ((q[alive[0]] - x[alive[1]]) ** 2).sum(1)
            bound = limit[alive[0]]
        if end < size:
            stays = partial * (size / end) <= bound * (1 + WIDTH / math.sqrt(end)) ** 2
        else:
            stays = partial <= bound * (1 + 1e-9) + 1e-9
        if alive is not None:
            alive, partial = (alive[0][stays], alive[1][stays]), partial[stays]
        elif end == size or stays.mean() < 0.2:
            alive, partial = np.nonzero(stays), partial[stays]
        else:
            partial = np.where(stays, partial, np.inf)
    return np.concatenate([start[0], alive[0]]), np.concatenate([start[1], alive[1] + first])


def probes_for(listed: DataFrame, centres: np.ndarray, queries: list[tuple[int, np.ndarray]], k: int, target: float) -> int:
    """How many lists to visit so that these queries' true ``k`` nearest lie in them to the share ``target``.

    The true neighbours of a few queries are found by one pass over all vectors (list, vec_id, v): a task keeps their
    best ``k`` so far.
    """
    spark = listed.sparkSession
    shared = spark.sparkContext.broadcast((np.array([i for i, _ in queries]), np.array([v for _, v in queries])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        kept = [(np.zeros(0), np.zeros(0, np.int32))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, own, scores = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)) @ q.T
            for j, query in enumerate(ids):
                s = np.concatenate([kept[j][0], np.where(own == query, -np.inf, scores[:, j])])
                l = np.concatenate([kept[j][1], lists])
                top = np.argpartition(-s, min(k, len(s) - 1))[:k]
                kept[j] = s[top], l[top]
        for j, (s, l) in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), j), pa.int32()), pa.array(l, pa.int32()), pa.array(s)],
                                             names=["q", "list", "score"])

    found = listed.select("list", "vec_id", "v").mapInArrow(best, "q int, list int, score double").where(F.col("score") > -float("inf"))
    turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    wanted = found.withColumn("turn", turn).where(F.col("turn") <= k).select("q", "list").collect()  # k rows a query
    order = np.argsort(_distances(np.column_stack([[v for _, v in queries], np.zeros(len(queries))]), centres), axis=1, kind="stable")
    places = np.argsort(order, axis=1)
    return 1 + int(np.quantile([places[r.q, r.list] for r in wanted], target, method="higher")) if wanted else 1


def nearest(rows: DataFrame, every: int = 20, k: int = 20, target: float = 0.96, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found to each vector whose id is divisible by ``every``.

    All other vectors are candidates; score is the inner product in double precision, ties go to the smaller vec_id.
    Lists are visited nearest first, as many as hold the share ``target`` of the true neighbours of ``TUNED`` queries
    (or ``probes``), and until they hold ``k`` candidates. Vectors have the length that most have; see ``usable`` for
    rows that take no part. Extra columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    vectors = saved(usable(rows), "vectors")
    common = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size("v") == common.d)
    top = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] ** 0.5
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    lifted = _lifted(np.array([r.v for r in sample]), top)
    centres = _lists(lifted, max(1, min(MAX_LISTS, len(sample), int(common["count"] ** 0.5 / 2))))
    known = spark.sparkContext.broadcast((centres, top))  # at most MAX_LISTS centres

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, top = known.value
        for batch in batches:
            if batch.num_rows:
                near = _nearest(_lifted(_matrix(batch.column(1)), top), centres)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *batch.columns], names=["list", "vec_id", "v"])

    listed = saved(vectors.mapInArrow(assign, "list int, vec_id long, v array<double>"), "lists")
    sizes = np.zeros(len(centres), dtype=np.int64)
    for r in listed.groupBy("list").count().collect():  # a row a list
        sizes[r.list] = r["count"]
    if probes is None:
        some = vectors.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNED).collect()
        probes = probes_for(listed, centres, [(r.vec_id, np.array(r.v)) for r in some], k, target) if some else 1
    cuts = np.maximum(1, -(-sizes // CHUNK))
    per_list = spark.sparkContext.broadcast((sizes, cuts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (centres, top), (sizes, cuts) = known.value, per_list.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            order = np.argsort(_distances(np.column_stack([q, np.zeros(len(q))]), centres), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1) - sizes[order]  # before the list is visited
            visit = (np.arange(order.shape[1])[None] < probes) | (held < k + 1)
            of, at = np.nonzero(visit)
            lists = order[of, at]
            again = cuts[lists]
            chunk = np.concatenate([np.arange(c) for c in again]) if len(again) else again
            of, lists = np.repeat(of, again), np.repeat(lists, again)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int32()), pa.array(chunk, pa.int32()), batch.column(0).take(pa.array(of)),
                 batch.column(1).take(pa.array(of))], names=["list", "chunk", "query_id", "q"])

    asked = saved(vectors.where(F.col("vec_id") % every == 0).mapInArrow(probe, "list int, chunk int, query_id long, q array<double>"),
                  "probes")
    blocks = asked.groupBy("list", "chunk").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cuts)], "list int, cuts int")
    left = (
        listed.join(cut, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))
        .join(blocks, ["list", "chunk"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("list", "chunk", "block", "vec_id", "v")
    )
    right = asked.join(blocks, ["list", "chunk"]).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("list", "chunk", "block", "query_id", "q")

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        _, top = known.value
        vectors = vectors.sort_values("vec_id", kind="stable")
        ids, x, q = vectors["vec_id"].to_numpy(), np.stack(vectors["v"]), np.stack(queries["q"])
        turn = rotation(x.shape[1] + 1)
        rotated, asked = _lifted(x, top) @ turn, np.column_stack([q, np.zeros(len(q))]) @ turn
        names, out = queries["query_id"].to_numpy(), []
        for at in range(0, len(q), 128):
            of, near = scan(asked[at : at + 128], rotated, k + 1)
            of = of + at
            other = ids[near] != names[of]
            of, near = of[other], near[other]
            scores = np.concatenate([(x[near[i : i + 65536]] * q[of[i : i + 65536]]).sum(1) for i in range(0, len(near), 65536)] or [[]])
            order = np.lexsort((ids[near], -scores, of))
            of, near, scores = of[order], near[order], scores[order]
            best = np.arange(len(of)) - np.searchsorted(of, of) < k
            out.append((names[of[best]], ids[near[best]], scores[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    found = left.groupBy("list", "chunk", "block").cogroup(right.groupBy("list", "chunk", "block")).applyInPandas(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
