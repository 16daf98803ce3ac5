import hashlib
import itertools
import math

import duckdb
import numpy as np
import pytest

from crosstally.llm import codes


def brute(rows, parts, entries, rounds, scale=4096):
    """The same in Python integers over (vec_id, label, vector) rows of one length that ``parts`` divides."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(x, p) for _, _, x in first] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(cut(x, p), books[p]) for _, _, x in kept]
            books[p] = [[sum(c) // of.count(e) for c in zip(*(cut(x, p) for (_, _, x), a in zip(kept, of) if a == e))]
                        if e in of else entry for e, entry in enumerate(books[p])]
    out = []
    for i, label, x in kept:
        at = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e in at), sum(far(cut(x, p), books[p][e]) for p, e in enumerate(at))))
    name = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted(((i, code, e, sum(o[3] for o in out if o[1] == label), name) for i, label, code, e in out), key=str)


def result(frame, **more):
    return sorted(map(tuple, codes.codes(frame, **more).collect()), key=str)


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = codes.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_shortlist_never_loses_a_nearest_entry():
    rng = np.random.default_rng(2)
    shorter = 0
    for _ in range(300):
        x = rng.integers(-40, 40, 6) + rng.integers(-8, 8, (20, 6))
        entries = rng.integers(-50, 50, (16, 6))
        entries[9] = entries[4]
        short = codes.shortlist(x.min(0), x.max(0), entries)
        full = ((x[:, None] - entries) ** 2).sum(2)
        at, error = codes.nearest(x, entries, short)
        assert (at == full.argmin(1)).all() and (error == full.min(1)).all()
        shorter += len(short) < 16
    assert shorter > 250


def test_blocks_are_tight_and_some_need_no_kernel(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 16))
    rows = [(i, 0, (centres[i % 16] + 0.01 * rng.normal(size=16)).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(codes, "BLOCK", 16)
    single = []
    real = codes._sums

    def spied(blocks, books):
        for r in blocks.collect():
            single.append(len(codes.shortlist(np.array(r.low), np.array(r.high), books[r.part])) == 1)
        return real(blocks, books)

    monkeypatch.setattr(codes, "_sums", spied)
    assert result(frame) == brute(rows, 8, 16, 6)
    assert np.mean(single) > 0.5


def test_equals_sql_and_brute_force(spark, monkeypatch):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(5)
    want = sorted(con.execute(codes.oracle()).fetchall(), key=str)
    assert result(table) == want
    assert want == brute([(r.vec_id, r.label, r.embedding) for r in table.collect()], 8, 16, 6)
    monkeypatch.setattr(codes, "BLOCK", 7)
    assert result(table) == want


def test_copies_ties_and_null_labels(spark):
    rows = [(i, (None, 1, 2)[i % 3], [0.5] * 8 if i % 3 == 0 else [0.001 * (i % 5), -0.0001 * (i % 4)] * 4) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert result(frame, entries=8, rounds=3) == brute(rows, 8, 8, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, "a", [1.0, 0.0]), (3, "a", [1.0, 0.0]), (None, "b", [0.2, -0.3]), (5, None, [1e9, -1e9]), (6, None, [-1.0, 0.5])]
    bad = [(1, "a", None), (2, "a", []), (7, "b", [nan, 1.0]), (8, "b", [inf, 1.0]), (9, None, [None, 1.0]), (10, "c", [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(good + bad, "vec_id long, label string, embedding array<double>").selectExpr(
        "*", "1 AS row", "2 AS part", "'x' AS code", "4 AS error", "5 AS v", "6 AS _key", "7 AS _rows")
    assert result(frame, parts=2, entries=3, rounds=2) == brute(good, 2, 3, 2)
    # Filled up to one component a part.
    assert sorted(r.code for r in codes.codes(frame.where("vec_id = 3"), parts=4).collect()) == ["00000000"] * 2
    assert codes.codes(frame.where("false")).collect() == [] and codes.codes(frame.where("vec_id = 1")).collect() == []


def test_joined_evenly_keeps_all_rows(spark):
    from crosstally.llm.common import joined_evenly

    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, NULL, if(id % 3 = 1, -1, id)) AS k")
    facts = rows.groupBy("k").count().selectExpr("k", "count AS n", "count AS size")
    got = joined_evenly(rows, facts, "k", "size", share=10).collect()
    assert len(got) == 3000 and {r.n for r in got} == {1, 1000} and sum(r.n == 1000 for r in got) == 2000
