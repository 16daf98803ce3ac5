"""Parts of a read by quantiles: every row once, and no part with most of the rows."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest

from crosstally import ConfigurationError, Datasource
from crosstally.sources import connectors
from crosstally.sources.bounds import partition_predicates, predicates, quantile_statement, read_in_parts


def parts_of(spark, values, dtype, parts=8):
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, k {dtype}").createOrReplaceTempView("store")
    if any(isinstance(v, (str, date)) for v in values):  # Spark as the store has quantiles of numbers only
        known = sorted((v for v in values if v is not None), key=lambda v: v.encode() if isinstance(v, str) else v)
        found = predicates("k", [known[len(known) * i // parts] for i in range(1, parts)])
    else:
        found = partition_predicates(spark.sql, "SELECT * FROM store", "k", parts)
    counts = [spark.sql(f"SELECT id FROM store WHERE {p}").collect() for p in found]
    assert sorted(r.id for part in counts for r in part) == list(range(len(values)))
    return found, [len(c) for c in counts]


def test_a_skewed_column_gives_even_parts(spark):
    rng = random.Random(1)
    values = [int(1.02 ** rng.randrange(1500)) for _ in range(3000)]
    found, counts = parts_of(spark, values, "long")
    assert max(counts) <= 1.3 * 3000 / 8 and len(found) <= 2 * 8 + 2


def test_a_hot_value_is_a_part_of_its_own(spark):
    values = [5] * 1500 + list(range(100, 2500)) + [None] * 100
    random.Random(2).shuffle(values)
    found, counts = parts_of(spark, values, "int")
    hot = next(p for p in found if p.startswith("k = 5"))
    assert counts[found.index(hot)] == 1500
    assert max(c for p, c in zip(found, counts) if p != hot) <= 1.5 * 4000 / 8


@pytest.mark.parametrize("values, dtype", [
    (["it's", "b", "Ü", "z", "", "a", None] * 5, "string"),
    ([date(2024, 1, 1 + i % 28) for i in range(60)], "date"),
    ([datetime(2024, 1, 1, i % 24, 0, 0, 250) for i in range(60)], "timestamp_ntz"),
    ([Decimal(i) / 7 for i in range(40)], "decimal(20,10)"),
    ([1.5, -2.25, float(10**6)] * 9, "double"),
    ([None] * 9, "int"), ([], "int"), ([3], "int"),
])
def test_every_type_and_few_rows(spark, values, dtype):
    parts_of(spark, values, dtype, 5)


def test_predicates_in_words():
    assert predicates("k", [1, 2, 2, 9]) == ["k IS NULL", "k <= 1", "k > 1 AND k < 2", "k = 2", "k > 2 AND k <= 9", "k > 9"]
    assert predicates("k", [None, None]) == ["k IS NULL", "k IS NOT NULL"]
    for odd in (lambda: quantile_statement("SELECT 1", "k; DROP", 4), lambda: quantile_statement("SELECT 1", "k", 1),
                lambda: quantile_statement("SELECT 1", "k", 5000), lambda: predicates("k", [b"x"])):
        with pytest.raises(ConfigurationError):
            odd()


def test_read_in_parts_has_a_task_a_part(spark):
    spark.range(100).selectExpr("id", "id % 10 AS k").createOrReplaceTempView("store")
    got = read_in_parts(spark.sql, "SELECT id, k FROM store", "k", 4)
    assert sorted(r.id for r in got.collect()) == list(range(100))


def test_options_ask_for_quantiles():
    partly = {"partitionColumn": "id", "numPartitions": 8}
    source = Datasource("p", "postgres", options=partly)
    assert connectors.by_quantiles(source) and connectors.jdbc_options(source, "SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ConfigurationError):
        connectors.jdbc_options(Datasource("p", "postgres", options={**partly, "lowerBound": 1}), "SELECT 1")
    whole = Datasource("p", "postgres", options={**partly, "lowerBound": 1, "upperBound": 9})
    assert not connectors.by_quantiles(whole) and "dbtable" in connectors.jdbc_options(whole, "SELECT 1")
