"""Bloom filters: no member is lost, few others pass, and a filter's size follows its set up to a bound."""

import pytest

import crosstally as ct
from crosstally.functions import KEY
from crosstally.operators import membership as m


@pytest.mark.parametrize("members", [1, 700, 60_000])
def test_members_pass_and_few_others_do(spark, members):
    hashes = spark.range(members).selectExpr("xxhash64(id) AS h")
    known = m.membership(hashes.unionAll(hashes.limit(10)))
    assert 32 * members <= max(1 << known.size, 32 * members)
    passed = known.rows_of(spark.range(members + 200_000), "xxhash64(id)")
    assert passed.filter(f"id < {members}").count() == members
    assert passed.filter(f"id >= {members}").count() <= 0.006 * 200_000
    assert passed.columns == ["id"]


def test_nothing_passes_an_empty_filter(spark):
    known = m.membership(spark.range(0).selectExpr("id AS h"))
    assert known.rows_of(spark.range(10), "id").collect() == []


def test_a_filter_of_bounded_size_loses_no_member(spark, monkeypatch):
    monkeypatch.setattr(m, "MOST", 6 + m._PIECE)
    known = m.membership(spark.range(300_000).selectExpr("xxhash64(id) AS h"))
    assert known.size == 6 + m._PIECE
    assert known.rows_of(spark.range(300_000), "xxhash64(id)").count() == 300_000


def test_places_use_all_pieces(spark):
    hashes = spark.range(200_000).selectExpr("xxhash64(id, 1) AS h")
    known = m.membership(hashes)
    pieces = known.words.selectExpr("size(words) AS pieces", "transform(words, p -> size(p)) AS words").first()
    assert pieces.pieces == 1 << (known.size - 6 - m._PIECE) > 1 and set(pieces.words) == {1 << m._PIECE}


def _side(spark, rows):
    return spark.createDataFrame(rows, f"{KEY} string, a string, b double")


def test_wide_details_equal_details_with_hot_keys_and_copies(spark):
    source = [(f"k{i}", f"text {i}", float(i)) for i in range(3000)] + [("hot", f"v{i % 900}", 1.0) for i in range(3000)] + [("hot", "w", 0.5)] * 50
    target = [(f"k{i}", f"text {i}" if i % 10 else None, float(i)) for i in range(5, 3100)] + [("hot", f"v{i % 901}", 1.0) for i in range(3000)]
    sides = _side(spark, source), _side(spark, target)
    want = sorted(map(tuple, ct.reconcile_details(*sides).collect()))
    assert sorted(map(tuple, ct.reconcile_details(*sides, wide=True).collect())) == want and len(want) > 300
    assert ct.reconcile_details(sides[0], sides[0], wide=True).collect() == []


def test_counting_mode_takes_the_greatest_payload_of_a_key(spark):
    source = [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "x", 1.0), ("c", "z", 1.0), ("d", "q", 1.0), ("d", "p", 1.0), ("s", None, None)]
    target = [("a", "y", 2.0), ("a", "w", 9.0), ("b", "x", 1.0), ("c", "z", 2.0), ("d", "p", 1.0), ("t", "x", 1.0), ("t", "y", 1.0)]
    got = ct.reconcile_counts(_side(spark, source), _side(spark, target)).first().asDict()
    # a and b match by their greatest payloads; c differs, d has a greater one on the source only.
    assert got == {"source_count": 5, "target_count": 5, "matched_count": 2, "mismatched_count": 2, "source_only_count": 1,
                   "target_only_count": 1, "source_rows": 8, "target_rows": 7}
    nothing = _side(spark, []), _side(spark, [])
    assert set(ct.reconcile_counts(*nothing).first()) == {0}
