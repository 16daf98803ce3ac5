import hashlib
import math

import duckdb
import numpy as np
import pytest

from crosstally.llm import centroids


def brute(rows, size, count, rounds, scale=256, seed="2:"):
    """Plain k-means in Python integers over (vec_id, vector) with ids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest()))
    c = [list(x) for _, x in order[:count]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        of = [near(x) for _, x in kept]
        for j in set(of):
            own = [x for (_, x), a in zip(kept, of) if a == j]
            c[j] = [sum(col) // len(own) for col in zip(*own)]
    last = [(i, near(x), x) for i, x in kept]
    out = [(i, j, far(x, c[j])) for i, j, x in last]
    total = {j: sum(d for _, k, d in out if k == j) for _, j, _ in out}
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, total[j], sum(total.values()), name[j]) for i, j, d in out), key=str)


def result(frame, **more):
    return sorted(map(tuple, centroids.clusters(frame, **more).collect()), key=str)


def test_transform_multiplies_distances_and_goes_from_coarse_to_fine():
    rng = np.random.default_rng(1)
    x = rng.integers(-900, 900, (50, 64))
    t = centroids.walsh(x)
    assert (((t[:1] - t) ** 2).sum(1) == 64 * ((x[:1] - x) ** 2).sum(1)).all()
    order = centroids.sequency(64)
    signs = centroids.walsh(np.eye(64, dtype=np.int64))[:, order]
    assert ((np.diff(signs, axis=0) != 0).sum(0) == np.arange(64)).all()
    assert (centroids.restored(t[:, order].astype(object)) == x).all()


@pytest.mark.parametrize("spread", [1, 3, 500, 2**40])
def test_search_equals_brute_force_with_ties(spread):
    rng = np.random.default_rng(spread % 97)
    x, c = rng.integers(-spread, spread, (300, 64)), rng.integers(-spread, spread, (40, 64))
    c[7] = c[31] = c[2]
    x[:20] = c[31]
    full = ((x[:, None].astype(object) - c.astype(object)) ** 2).sum(2)
    near, distance, work = centroids.nearest(centroids.walsh(x), centroids.walsh(c))
    assert (near == full.argmin(1)).all() and (distance == 64 * full.min(1)).all()
    assert (near[:20] == 2).all() or spread == 1
    assert work <= 2 * full.size * 64


def test_worse_centroids_are_given_up_early():
    rng = np.random.default_rng(4)
    c = rng.integers(-500, 500, (40, 64))
    x = c[rng.integers(0, 40, 2000)] + rng.integers(-40, 40, (2000, 64))
    order = centroids.sequency(64)
    near, _, work = centroids.nearest(centroids.walsh(x)[:, order], centroids.walsh(c)[:, order])
    assert work < 0.25 * 2000 * 40 * 64


def test_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(5)
    got = result(table)
    assert got == sorted(con.execute(centroids.oracle()).fetchall(), key=str)
    assert got == brute([(r.vec_id, r.embedding) for r in table.collect()], 64, 40, 5)
    assert len({r[1] for r in got}) > 20


def test_copies_ties_and_empty_clusters(spark):
    rows = [(i, [0.5, 0.25, -1.0, 2.0] if i % 3 == 0 else [float(i % 5), 1.0, -0.003, 0.001 * (i % 7)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = result(frame, size=4, count=30, rounds=3)
    as_float = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(as_float, 4, 30, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]),
            (None, [3.0, -0.001]), (8, [0.0, 0.0]), (9, [1e9, -1e9])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 AS cluster", "2 AS distance", "'x' AS t", "4 AS inertia", "5 AS label")
    got = result(frame, size=2, count=3, rounds=2)
    assert got == brute(rows, 2, 3, 2)
    assert centroids.clusters(frame.where("false")).collect() == []
    assert centroids.clusters(frame).collect() == []  # none with 64 components
