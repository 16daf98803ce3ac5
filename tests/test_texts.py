import hashlib
import json
import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from crosstally import ConfigurationError, keyed, normalize, reject_null_keys
from crosstally.functions import (
    Strategy,
    has_tag,
    keyed_payload,
    normalize_tags,
    payload_hash,
    with_field_hashes,
    with_payload,
    with_row_hash,
)


def plain(text: str) -> str:
    """Plain notation without trailing zeros of a number as the JVM prints it."""
    if text in ("NaN", "Infinity", "-Infinity"):
        return text
    number = Decimal(text)
    if number == 0:
        return "0"
    shown = format(number, "f")
    return shown.rstrip("0").rstrip(".") if "." in shown else shown


def test_doubles_and_floats_over_the_whole_range(spark):
    rng = random.Random(7)
    bits = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(1500)]
    values = bits + [0.0, -0.0, 1.0, 100.0, 1e7, 1.5e7, 1e21, 1e-3, 9.99e-4, 1e-7, 123456789.0, -2.5e-10, math.inf, math.nan]
    values += [rng.uniform(-1e9, 1e9) for _ in range(300)] + [round(rng.uniform(0, 1e5), 2) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").selectExpr(
        "x", "CAST(x AS FLOAT) AS y", "CAST(x AS STRING) AS xs", "CAST(CAST(x AS FLOAT) AS STRING) AS ys"
    )
    rows = normalize(df, ["x", "y"]).collect()
    assert len(rows) == len(values)
    wrong = [r for r in rows if (r.x, r.y) != (plain(r.xs), plain(r.ys))]
    assert not wrong, wrong[:5]


def test_lenient_texts(spark):
    df = spark.sql(
        """SELECT 10Y AS a, 10S AS b, 10.50BD AS c, CAST(3 AS FLOAT) AS d, true AS e, CAST(NULL AS INT) AS f,
                  DATE'2024-02-29' AS g, TIMESTAMP_NTZ'2024-01-01 10:05:00' AS h, TIMESTAMP_NTZ'2024-01-01 10:05:07.5' AS i,
                  TIMESTAMP'2024-01-01 00:00:00 UTC' AS j, TIMESTAMP'1969-12-31 23:59:59.000001 UTC' AS k, X'00FF' AS l,
                  array(1, NULL) AS m, named_struct('a', 'x"y', 'b', named_struct('c', 1.5D)) AS n, map('k', 1) AS o,
                  100BD AS p, ' kept ' AS q"""
    )
    assert list(normalize(df).first()) == [
        "10", "10", "10.5", "3", "1", "<NULL>", "2024-02-29", "2024-01-01T10:05", "2024-01-01T10:05:07.500",
        "2024-01-01T00:00:00Z", "1969-12-31T23:59:59.000001Z", "00ff", "[1, null]",
        '{"a": "x\\"y", "b": {"c": 1.5}}', '{"k":1}', "100", " kept ",
    ]


def test_instants_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-11-03 05:30:00 UTC' AS a, TIMESTAMP'2024-11-03 06:30:00.25 UTC' AS b")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert list(normalize(df).first()) == ["2024-11-03T05:30:00Z", "2024-11-03T06:30:00.250Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_strict_texts_carry_the_type(spark):
    df = spark.sql("SELECT 1 AS a, 1L AS b, 1.50BD AS c, false AS d, 'x' AS e, NULL AS f, 2.0D AS g")
    assert list(normalize(df, strategy="TypeStrict").first()) == [
        "java.lang.Integer:1", "java.lang.Long:1", "java.math.BigDecimal:1.50", "java.lang.Boolean:false",
        "java.lang.String:x", "<NULL>", "java.lang.Double:2.0",
    ]


@pytest.mark.parametrize("strategy", ["TypeLenient", "TypeStrict"])
def test_hash_bytes(spark, rows, strategy):
    df = rows([("k", "abc", "def"), ("m", "ab", "cdef"), ("n", None, "é")], "string", "string")
    tag = "" if strategy == "TypeLenient" else "java.lang.String:"
    sha = lambda *values: hashlib.sha256(b"".join((("<NULL>" if v is None else tag + v).encode() + b"\0") for v in values)).hexdigest()
    got = {r.migration_key: r for r in with_field_hashes(with_row_hash(df, strategy=strategy), ["c0", "c1"], strategy).collect()}
    for r in df.collect():
        assert got[r.migration_key].row_hash == sha(r.c0, r.c1)
        assert got[r.migration_key].field_hashes == {"c0": sha(r.c0), "c1": sha(r.c1)}
    assert got["k"].row_hash != got["m"].row_hash


def test_payload_is_json_and_hashes_as_one_string(rows):
    value = 'a/"é\\\n'
    df = keyed_payload(rows([("k", value, None)], "string", "string"))
    row = df.selectExpr("*", f"{payload_hash('payload')} AS h", f"{payload_hash('payload', 'TypeStrict')} AS s").first()
    assert json.loads(row.payload) == [value, "<NULL>"]
    assert row.h == hashlib.sha256(row.payload.encode() + b"\0").hexdigest()
    assert row.s == hashlib.sha256(b"java.lang.String:" + row.payload.encode() + b"\0").hexdigest()


def test_unknown_names_are_refused(rows):
    with pytest.raises(ConfigurationError):
        with_payload(rows([], "string"), ["nope"])
    with pytest.raises(ConfigurationError):
        Strategy.of("loose")
    assert Strategy.of(None) is Strategy.LENIENT and Strategy.of("strict") is Strategy.STRICT


def test_key_column(spark):
    df = spark.sql("SELECT 1 AS x, 7 AS MIGRATIONKEY, 'a' AS y")
    assert keyed(df).columns == ["migration_key", "x", "y"] and keyed(df).first().migration_key == "7"
    with pytest.raises(ConfigurationError, match="No column"):
        keyed(spark.sql("SELECT 1 AS x"))
    with pytest.raises(ConfigurationError, match="More than one"):
        keyed(spark.sql("SELECT 1 AS MigrationKey, 2 AS migration_key"))
    nulls = spark.sql("SELECT CAST(NULL AS STRING) AS MigrationKey, 1 AS x")
    with pytest.raises(Exception, match="null value"):
        keyed(nulls).collect()
    usable, rejected = reject_null_keys(nulls)
    assert (usable.count(), rejected.count()) == (0, 1)


def test_tags(spark):
    df = spark.sql("SELECT array(' Prod ', 'prod', '', NULL, 'Party') AS tags")
    assert df.select(normalize_tags(F.col("tags"))).first()[0] == ["prod", "party"]
    assert df.filter(has_tag(F.col("tags"), " PARTY ")).count() == 1
    assert df.filter(has_tag(F.col("tags"), "x")).count() == 0 and df.filter(has_tag(F.col("tags"), " ")).count() == 1
    assert spark.sql("SELECT CAST(NULL AS ARRAY<STRING>) AS tags").select(normalize_tags(F.col("tags"))).first()[0] == []
