from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crosstally.operators import (
    bag_difference,
    classify,
    classify_with_payloads,
    delta,
    duplicate_keys,
    except_all,
    field_rollup,
    reconcile_counts,
    reconcile_details,
    summary,
    unique_keys,
)
from crosstally.operators.compare import RECORD_COLUMNS

SIX = ("source_count", "target_count", "matched_count", "mismatched_count", "source_only_count", "target_only_count")


def six(df):
    row = df.first()
    return tuple(row[c] for c in SIX)


def by_key(records):
    return {r.migration_key: r for r in records.collect()}


def test_bag_difference_example(rows):
    source = rows([("1", "A"), ("2", "B"), ("3", "C")], "string")
    target = rows([("1", "A"), ("2", "X"), ("4", "D")], "string")
    assert six(summary(source, target)) == (3, 3, 1, 1, 1, 1)
    found = by_key(reconcile_details(source, target))
    assert {k: r.status for k, r in found.items()} == {"2": "MISMATCHED", "3": "SOURCE_ONLY", "4": "TARGET_ONLY"}
    assert found["2"].source_payload == '["B"]' and found["2"].target_payload == '["X"]'
    assert found["3"].target_hash is None and found["4"].source_hash is None
    assert unique_keys(source, target).first().unique_keys == 4


@pytest.mark.parametrize("strategy,expected", [("TypeLenient", (1, 1, 1, 0, 0, 0)), ("TypeStrict", (1, 1, 0, 1, 0, 0))])
def test_integer_against_double(rows, strategy, expected):
    source, target = rows([("1", 1)], "int"), rows([("1", 1.0)], "double")
    assert six(summary(source, target, strategy)) == expected
    assert six(reconcile_counts(source, target, strategy)) == expected
    assert reconcile_details(source, target, strategy=strategy).count() == expected[3]


def test_empty_sides(rows):
    empty = rows([], "string")
    assert six(summary(empty, empty)) == (0,) * 6
    assert six(reconcile_counts(empty, empty)) == (0,) * 6
    some = rows([("abc", "def")], "string")
    assert six(summary(some, empty)) == (1, 0, 0, 0, 1, 0)
    assert six(reconcile_counts(empty, some)) == (0, 1, 0, 0, 0, 1)


def test_duplicates_follow_bag_rules(rows):
    source = rows([("k", "a"), ("k", "a"), ("k", "b"), ("m", "x")], "string")
    target = rows([("k", "a"), ("k", "b"), ("m", "x"), ("m", "x")], "string")
    assert six(summary(source, target)) == (4, 4, 0, 0, 1, 1)
    # The counting mode sees one row per key.
    assert six(reconcile_counts(source, target)) == (2, 2, 2, 0, 0, 0)
    assert six(reconcile_counts(source, target, by_key=True)) == (2, 2, 2, 0, 0, 0)
    assert sorted(r.migration_key for r in except_all(source, target).collect()) == ["k"]
    found = {(r.migration_key, r.payload): (r.source_surplus, r.target_surplus) for r in bag_difference(source, target).collect()}
    assert found == {("k", '["a"]'): (1, 0), ("m", '["x"]'): (0, 1)}
    assert {r.migration_key for r in duplicate_keys(source, target).collect()} == {"k", "m"}


def test_field_details_and_rollup(rows):
    source = rows([("k", "Acme", "ACTIVE"), ("s", "One", "ACTIVE")], "string", "string")
    target = rows([("k", "Acme", "CLOSED")], "string", "string")
    records = reconcile_details(source, target, ["party_name", "status"], "FIELD_DETAILS")
    found = by_key(records)
    assert found["k"].field_diffs == '{"party_name":"MATCHED","status":"MISMATCHED"}'
    assert found["s"].field_diffs == '{"party_name":"SOURCE_ONLY","status":"SOURCE_ONLY"}'
    rolled = {(r.field, r.status): r.records for r in field_rollup(records).collect()}
    assert rolled[("status", "MISMATCHED")] == 1 and rolled[("party_name", "SOURCE_ONLY")] == 1


def test_field_details_show_only_conditions(rows):
    source, target = rows([("k", "a", "b")], "string", "string"), rows([("k", "a", "c")], "string", "string")
    only = by_key(reconcile_details(source, target, ["x", "y"], "FIELD_DETAILS", ["y"]))["k"].field_diffs
    assert only == '{"y":"MISMATCHED"}'
    # A condition that is no known field is reported as matched here.
    unknown = by_key(reconcile_details(source, target, ["x", "y"], "FIELD_DETAILS", ["z"]))["k"].field_diffs
    assert unknown == '{"z":"MATCHED"}'


def test_generated_names_follow_the_width_of_the_row(rows):
    source = rows([("k", "a", "b"), ("s", "a", "b")], "string", "string")
    target = rows([("k", "a", "b", "c"), ("t", "a", "b", "c")], "string", "string", "string")
    found = by_key(reconcile_details(source, target, [], "FIELD_DETAILS"))
    assert found["k"].field_diffs == '{"c0":"MATCHED","c1":"MATCHED","c2":"TARGET_ONLY"}'
    assert found["s"].field_diffs == '{"c0":"SOURCE_ONLY","c1":"SOURCE_ONLY"}'
    assert found["t"].field_diffs == '{"c0":"TARGET_ONLY","c1":"TARGET_ONLY","c2":"TARGET_ONLY"}'


def test_condition_fields_filter_mismatches_only(rows):
    source = rows([("k", "Acme", "ACTIVE"), ("s", "One", "ACTIVE")], "string", "string")
    target = rows([("k", "Acme", "CLOSED")], "string", "string")
    named = ["party_name", "status"]
    assert set(by_key(reconcile_details(source, target, named, condition_fields=["party_name"]))) == {"s"}
    assert set(by_key(reconcile_details(source, target, named, condition_fields=["status"]))) == {"k", "s"}
    assert set(by_key(reconcile_details(source, target, named, condition_fields=["other"]))) == {"k", "s"}
    # Without names the conditions stand for the leading positions.
    assert set(by_key(reconcile_details(source, target, [], condition_fields=["first"]))) == {"s"}


def test_null_text_equals_null_only_when_lenient(rows):
    source, target = rows([("k", None)], "string"), rows([("k", "<NULL>")], "string")
    assert six(summary(source, target)) == (1, 1, 1, 0, 0, 0)
    assert six(summary(source, target, "TypeStrict")) == (1, 1, 0, 1, 0, 0)


def test_values_compare_as_texts_across_types(rows):
    left = rows([("k", True, Decimal("10.50"), 3, "7")], "boolean", "decimal(8,2)", "tinyint", "string")
    right = rows([("k", 1, 10.5, 3, 7)], "int", "double", "bigint", "int")
    assert six(summary(left, right)) == (1, 1, 1, 0, 0, 0)
    assert reconcile_details(left, right).count() == 0


def test_negative_zero(rows):
    left, right = rows([("k", 0.0)], "double"), rows([("k", -0.0)], "double")
    assert six(summary(left, right)) == (1, 1, 1, 0, 0, 0)
    assert six(summary(left, right, "TypeStrict")) == (1, 1, 0, 1, 0, 0)


def test_payloads_can_be_left_out(rows):
    source, target = rows([("k", "a")], "string"), rows([("k", "b")], "string")
    record = reconcile_details(source, target, store_payloads=False).first()
    assert record.source_payload is None and record.source_hash is not None


def test_digest_variant_gives_the_same_records(spark, rows):
    source = rows([("1", "A", 1), ("2", "B", 2), ("2", "B", 2), ("2", "C", 3), ("3", "C", 3)], "string", "int")
    target = rows([("1", "A", 1), ("2", "B", 9), ("4", "D", 4)], "string", "int")
    expected = sorted(map(tuple, reconcile_details(source, target, mode="FIELD_DETAILS").collect()))
    assert sorted(map(tuple, reconcile_details(source, target, mode="FIELD_DETAILS", wide=True).collect())) == expected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, reconcile_details(source, target, mode="FIELD_DETAILS", wide=True).collect())) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_delta_keeps_new_and_changed(spark):
    schema = "migration_key string, source_hash string, target_hash string, status string, field_diffs string, source_payload string, target_payload string"
    baseline = spark.createDataFrame(
        [("same", "1", None, "SOURCE_ONLY", None, "p", None), ("changed", "1", "2", "MISMATCHED", None, "p", "q")], schema
    )
    current = spark.createDataFrame(
        [
            ("same", "1", None, "SOURCE_ONLY", None, "p", None),
            ("changed", "1", "3", "MISMATCHED", None, "p", "r"),
            ("new", None, "3", "TARGET_ONLY", None, None, "r"),
        ],
        schema,
    )
    kept = delta(current, baseline)
    assert kept.columns == list(RECORD_COLUMNS)
    assert {r.migration_key for r in kept.collect()} == {"changed", "new"}


def test_plans_shuffle_twice_and_never_broadcast(rows):
    source, target = rows([("1", "A")], "string"), rows([("1", "A")], "string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (classify(source, target), reconcile_details(source, target)):
        assert plan(df).count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan(df)
    assert plan(classify(source, target, by_key=True)).count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan(classify(source, target))


bags = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x", "y", None])), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=bags, right=bags)
def test_statuses_equal_counter_arithmetic(rows, left, right):
    source, target = rows(left, "string"), rows(right, "string")
    surplus_left, surplus_right = Counter(left) - Counter(right), Counter(right) - Counter(left)
    left_keys, right_keys = {k for k, _ in surplus_left}, {k for k, _ in surplus_right}
    expected = {}
    for key in {k for k, _ in left} | {k for k, _ in right}:
        on = (key in left_keys, key in right_keys)
        expected[key] = {(True, True): "MISMATCHED", (True, False): "SOURCE_ONLY", (False, True): "TARGET_ONLY"}.get(on, "MATCHED")
    assert {r.migration_key: r.status for r in classify(source, target).collect()} == expected
    with_payloads = classify_with_payloads(source, target)
    assert {r.migration_key: r.status for r in with_payloads.collect()} == expected
    differing = {k: v for k, v in expected.items() if v != "MATCHED"}
    assert {r.migration_key: r.status for r in reconcile_details(source, target).collect()} == differing
    rolled = Counter(expected.values())
    assert six(summary(source, target)) == (
        len(left),
        len(right),
        rolled["MATCHED"],
        rolled["MISMATCHED"],
        rolled["SOURCE_ONLY"],
        rolled["TARGET_ONLY"],
    )


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=bags, right=bags)
def test_counting_mode_equals_one_representative_per_key(spark, rows, left, right):
    source, target = rows(left, "string"), rows(right, "string")
    texts = {v: '["<NULL>"]' if v is None else f'["{v}"]' for v in ("x", "y", None)}
    top = lambda bag, key: max((texts[v] for k, v in bag if k == key), default=None)
    keys = {k for k, _ in left} | {k for k, _ in right}
    pairs = [(top(left, k), top(right, k)) for k in keys]
    in_both = [(a, b) for a, b in pairs if a is not None and b is not None]
    assert six(reconcile_counts(source, target)) == (
        sum(a is not None for a, _ in pairs),
        sum(b is not None for _, b in pairs),
        sum(a == b for a, b in in_both),
        sum(a != b for a, b in in_both),
        sum(b is None for _, b in pairs),
        sum(a is None for a, _ in pairs),
    )


def test_hot_key_is_counted_whole(spark):
    """One key with a third of all rows, all different, and one pair with many equal copies."""
    n = 3000
    hot = spark.range(n).select(F.lit("hot").alias("migration_key"), F.col("id").cast("string").alias("c0"))
    copies = spark.range(n).select(F.lit("copies").alias("migration_key"), F.lit("same").alias("c0"))
    rest = spark.range(n).select(F.col("id").cast("string").alias("migration_key"), F.lit("v").alias("c0"))
    source = hot.unionAll(copies).unionAll(rest)
    target = source.filter("NOT (migration_key = 'hot' AND c0 = '17')")
    assert six(summary(source, target)) == (3 * n, 3 * n - 1, n + 1, 0, 1, 0)
    record = reconcile_details(source, target).collect()
    assert [(r.migration_key, r.source_payload) for r in record] == [("hot", '["17"]')]
