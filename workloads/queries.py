"""One query per operator: callables from (session, table folder) to a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import crosstally as ct
from crosstally.functions import (
    KEY,
    keyed_payload,
    normalize_tags,
    reject_null_keys,
    with_field_hashes,
    with_row_hash,
    with_tags,
)
from crosstally.operators.compare import COUNTS
from crosstally.operators.incremental import latest_digests
from crosstally.operators.ledger import Ledger
from crosstally.sources.bounds import read_in_parts

from . import sides as S
from .workbooks import write_workbooks

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Windows of a full and of an incremental extract of the events table.
FULL = ct.Window(None, datetime(2024, 2, 1, tzinfo=timezone.utc))
LATEST = ct.Window(datetime(2024, 1, 20, tzinfo=timezone.utc), datetime(2024, 2, 1, tzinfo=timezone.utc))

EVENTS_WINDOW_SQL = """
SELECT CAST(event_id AS STRING) AS "MigrationKey", event_type, value, ts
FROM events WHERE ts > CAST(:since AS TIMESTAMP_NTZ) AND ts <= CAST(:until AS TIMESTAMP_NTZ) AND event_type <> ?
"""


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the session names for checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ct.ConfigurationError("Set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def tables(spark: SparkSession, folder: str) -> None:
    """Register the tables as views of the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def rows(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(S.for_spark(sql))


def pair(spark, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    return ct.keyed(rows(spark, source)), ct.keyed(rows(spark, target))


def orders(spark) -> tuple[DataFrame, DataFrame]:
    return pair(spark, S.ORDERS_SOURCE, S.ORDERS_TARGET)


def lineitem(spark) -> tuple[DataFrame, DataFrame]:
    return pair(spark, S.LINEITEM_SOURCE, S.LINEITEM_TARGET)


ORDER_FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

REGISTRY: dict[str, Callable[[SparkSession], DataFrame]] = {}


def query(build: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
    REGISTRY[build.__name__] = build
    return build


# -- extracting sides ---------------------------------------------------------------------------


@query
def extract_table(spark):
    side = ct.SideSpec(
        table="customer",
        key=ct.KeySpec.single("c_custkey"),
        identifiers=("c_nationkey",),
        fields=("c_name", "c_mktsegment", "c_nationkey"),
    )
    return ct.extract(spark, side)


@query
def extract_distinct(spark):
    side = ct.SideSpec(
        table="lineitem", key=ct.KeySpec.single("l_suppkey"), fields=("l_returnflag", "l_linestatus"), distinct=True
    )
    return ct.extract(spark, side)


@query
def extract_custom_sql(spark):
    side = ct.SideSpec(
        query="""SELECT c.c_custkey AS "MigrationKey", upper(c.c_name) AS c_name, n.n_name, r.r_name,
                        concat(n.n_name, '/', c.c_mktsegment) AS place
                 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                 JOIN region r ON n.n_regionkey = r.r_regionkey"""
    )
    return ct.extract(spark, side)


@query
def extract_params(spark):
    side = ct.SideSpec(
        query="""SELECT o_orderkey AS "MigrationKey", o_orderstatus, o_orderpriority, 'why?' AS note
                 FROM orders WHERE o_orderstatus = ? OR o_totalprice > ?""",
        query_params=("F", 250000.0),
    )
    return ct.extract(spark, side)


@query
def extract_conditional(spark):
    side = ct.SideSpec(
        query="""SELECT o_orderkey AS MigrationKey, o_custkey, o_orderstatus FROM orders
                 WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL
                   AND (o_orderdate IS NULL OR o_orderdate > CAST('1998-01-01' AS TIMESTAMP_NTZ))"""
    )
    return ct.extract(spark, side)


EVENT_FIELDS = ("event_type", "props.k", "value", "props.missing")


@query
def extract_document(spark):
    side = ct.SideSpec(collection="events", key=ct.KeySpec.single("event_id"), fields=EVENT_FIELDS)
    return ct.extract(spark, side)


@query
def extract_document_filter(spark):
    side = ct.SideSpec(
        collection="events",
        key=ct.KeySpec.composite(["user_id", "event_id"]),
        fields=EVENT_FIELDS,
        query="""{"event_type": {"$in": ["click", "view", "?"]}, "value": {"$gte": ?, "$lt": 300},
                  "$or": [{"props.k": {"$gt": 50}}, {"user_id": {"$lte": "?"}}], "props.gone": {"$exists": false},
                  "user_id": {"$nin": [3, 4]}, "event_id": {"$ne": null}}""",
        query_params=("signup", 2.5, 20),
    )
    return ct.extract(spark, side)


@query
def extract_document_window(spark):
    side = ct.SideSpec(
        collection="events",
        key=ct.KeySpec.single("event_id"),
        fields=("event_type", "value"),
        query='{"ts": {"$gt": ":since", "$lte": ":until"}, "event_type": "?"}',
        query_params=("purchase",),
    )
    return ct.extract(spark, side, window=LATEST)


def _events_in(spark, window):
    return ct.extract(spark, ct.SideSpec(query=EVENTS_WINDOW_SQL, query_params=("error",)), window=window)


@query
def extract_window_full(spark):
    return _events_in(spark, FULL)


@query
def extract_window_incremental(spark):
    return _events_in(spark, LATEST)


CUSTOMER_CELLS = """
SELECT c_custkey AS `customer no`, c_name AS name, CAST(c_acctbal AS DECIMAL(12,2)) AS `2nd_balance`,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '  ' ELSE concat('"', c_mktsegment, '", ', c_nationkey) END AS segment
FROM customer
"""


@query
def extract_csv(spark):
    folder = shared_dir(spark)
    cells = spark.sql(CUSTOMER_CELLS)
    cells.repartition(3).write.options(header=True, quote='"', escape='"', ignoreTrailingWhiteSpace=False,
                                       ignoreLeadingWhiteSpace=False).csv(folder)
    source = ct.Datasource("files", "file", options={"path": folder, "pattern": r"part-\d+-.*[.]csv", "table": "cells"})
    side = ct.SideSpec(datasource="files", query="SELECT customer_no AS MigrationKey, name, C_2nd_balance, segment FROM cells")
    return ct.extract(spark, side, {"files": source})


@query
def extract_xlsx(spark):
    """Workbooks as files, found by a name pattern and read by their header names."""
    folder = shared_dir(spark)
    cells = spark.sql("SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal > 0 AS in_credit FROM customer")
    write_workbooks(cells.repartition(3), folder)
    source = ct.Datasource("books", "file", options={"path": folder, "pattern": r"book-\d+-.*[.]xlsx", "sheet": "data", "table": "cells"})
    side = ct.SideSpec(datasource="books", table="cells", key=ct.KeySpec.single("c_custkey"),
                       fields=("c_name", "c_mktsegment", "c_nationkey", "in_credit"))
    return ct.extract(spark, side, {"books": source})


def spread(df: DataFrame, table: DataFrame) -> DataFrame:
    """The rows dealt over all tasks, unless the partitions of the table they come from keep all cores about equally busy."""
    spark = df.sparkSession
    sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    even = sum(sizes) >= max(sizes, default=0) * spark.sparkContext.defaultParallelism / 2
    return df if even else df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


# Date, date and time, elapsed time, percent, thousands with a section for negative numbers, fraction, exponent, text beside.
CELL_FORMATS = {
    "shipped": "yyyy-mm-dd", "received": 14, "at": 'dd"."mm"."yyyy hh:mm:ss', "lasted": "[h]:mm", "discount": 10, "tax": "0.0%",
    "price": '#,##0.00;[Red](#,##0.00);"-"', "quantity": '#,##0" pcs"', "eighths": "# ?/?", "exact": "0.000E+00",
}


@query
def extract_xlsx_formats(spark):
    """What cells show under dates, percents, thousands, sections by sign, fractions and exponents."""
    folder = shared_dir(spark)
    cells = spark.sql("""
      SELECT concat(l_orderkey, '-', l_linenumber) AS line, CAST(l_shipdate AS DATE) AS shipped, date_add(CAST(l_shipdate AS DATE), l_linenumber) AS received,
             CAST(l_shipdate AS TIMESTAMP_NTZ) + make_dt_interval(0, l_orderkey % 24, l_partkey % 60, l_suppkey % 60) AS at,
             l_partkey % 5000 / 48D AS lasted, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax,
             CAST(l_extendedprice AS DOUBLE) * (l_linenumber % 3 - 1) AS price, CAST(l_quantity * 1000 AS BIGINT) AS quantity,
             l_orderkey % 80 / 8D AS eighths, CAST(l_partkey AS DOUBLE) AS exact
      FROM lineitem""")
    write_workbooks(spread(cells, spark.table("lineitem")), folder, "lines", CELL_FORMATS)
    source = ct.Datasource("books", "file", options={"path": folder, "format": "xlsx", "sheet": "lines", "table": "lines"})
    side = ct.SideSpec(datasource="books", table="lines", key=ct.KeySpec.single("line"), fields=tuple(CELL_FORMATS))
    return ct.extract(spark, side, {"books": source})


@query
def pair_xlsx_table(spark):
    """A table against workbooks, in which some sizes are others and numbers have thousands separators."""
    folder = shared_dir(spark)
    cells = spark.sql("SELECT p_partkey, p_name, CASE WHEN p_size < 4 THEN p_size * 1000 ELSE p_size END AS p_size FROM part WHERE p_partkey % 19 <> 0")
    write_workbooks(cells, folder, formats={"p_size": 3})
    source = ct.Datasource("books", "file", options={"path": folder, "pattern": "book-.*[.]xlsx", "table": "cells"})
    return _paired(spark, PART, ct.SideSpec(datasource="books", table="cells", key=PART.key, fields=PART.fields), {"books": source})


@query
def extract_by_quantiles(spark):
    """A table that stands for a relational store, read in parts by quantiles of a skewed column, a view of its own each."""
    statement = """SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS "MigrationKey",
                          CASE WHEN l_partkey % 3 = 0 THEN 7 WHEN l_partkey % 11 > 0 THEN l_suppkey * l_suppkey END AS part, l_quantity FROM lineitem"""
    found = read_in_parts(lambda sql: spark.sql(sql.replace('"', "`")), statement, "part", 8)
    return ct.keyed(found.withColumn("part", F.col("part").cast("string")))


@query
def extract_document_inferred(spark):
    """Documents as JSON texts, with a path that only one has and one whose values are of two types."""
    spark.sql("""
      SELECT event_id, event_type,
             concat(left(props, length(props) - 1), ', "seen": ', if(event_id % 2 = 0, CAST(user_id AS STRING), concat('"', event_type, '"')),
                    if(event_id = last, concat(', "rare": {"only": [{"type": "', event_type, '"}]}'), ''), '}') AS props
      FROM events, (SELECT max(event_id) AS last FROM events)""").createOrReplaceTempView("event_texts")
    source = ct.Datasource("texts", "mongo", options={"document_column": "props"})
    side = ct.SideSpec(datasource="texts", collection="event_texts", key=ct.KeySpec.single("event_id"),
                       fields=("k", "seen", "rare.only", "event_type"), query='{"k": {"$gte": 20}}')
    return ct.extract(spark, side, {"texts": source})


@query
def pair_table_csv(spark):
    folder = shared_dir(spark)
    cells = spark.sql("SELECT p_partkey, p_name, CASE WHEN p_size > 48 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
    cells.write.option("header", True).csv(folder)
    return _paired(spark, PART, *_csv_side(folder))


PART = ct.SideSpec(table="part", key=ct.KeySpec.single("p_partkey"), fields=("p_name", "p_size"))


def _csv_side(folder: str) -> tuple[ct.SideSpec, dict[str, ct.Datasource]]:
    source = ct.Datasource("files", "file", options={"path": folder, "pattern": r"part-.*[.]csv", "table": "cells"})
    return ct.SideSpec(datasource="files", table="cells", key=PART.key, fields=PART.fields), {"files": source}


def _paired(spark, source: ct.SideSpec, target: ct.SideSpec, sources=None) -> DataFrame:
    return ct.reconcile_details(*(ct.extract(spark, side, sources) for side in (source, target)), mode="FIELD_DETAILS")


PART_DOCUMENTS = """
SELECT p_partkey AS _id, named_struct('p_name', p_name, 'size', CASE WHEN p_size < 3 THEN p_size + 1 ELSE p_size END) AS part,
       split(p_name, ' ') AS words, p_brand, array(named_struct('kind', p_type, 'size', p_size),
       named_struct('kind', 'any', 'size', p_size + 10)) AS offers
FROM part WHERE p_partkey % 17 <> 0
"""


def _documents(spark) -> ct.SideSpec:
    spark.sql(PART_DOCUMENTS).createOrReplaceTempView("part_documents")
    return ct.SideSpec(collection="part_documents", key=ct.KeySpec.single("_id"), fields=("part.p_name", "part.size"))


@query
def pair_document_table(spark):
    return _paired(spark, _documents(spark), PART)


@query
def pair_document_csv(spark):
    folder = shared_dir(spark)
    spark.sql("SELECT p_partkey, p_name, p_size FROM part").write.option("header", True).csv(folder)
    return _paired(spark, _documents(spark), *_csv_side(folder))


@query
def pair_sql_document(spark):
    custom = ct.SideSpec(query='SELECT p_partkey AS "MigrationKey", p_name, p_size FROM part WHERE p_size > ?', query_params=(5,))
    return _paired(spark, custom, _documents(spark))


@query
def extract_document_operators(spark):
    side = _documents(spark).patched(
        query="""{"p_brand": {"$not": {"$regex": "1$"}}, "words": {"$size": 2}, "offers": {"$elemMatch": {"size": {"$gt": 40},
                  "kind": {"$ne": "any"}}}, "part.p_name": {"$regex": "^[A-M]", "$options": "i"}, "offers.kind": {"$exists": false}}"""
    )
    return ct.extract(spark, side)


@query
def extract_document_all(spark):
    side = _documents(spark).patched(query='{"words": {"$all": ["?", "?"]}, "p_brand": {"$not": {"$in": ["Brand#1"]}}}',
                                     query_params=_two_words(spark))
    return ct.extract(spark, side)


def _two_words(spark) -> tuple[str, str]:
    """The words of the smallest part name."""
    return tuple(spark.sql("SELECT split(min(p_name), ' ') AS w FROM part").first().w[:2])


# -- keys ---------------------------------------------------------------------------------------


def _keys(spark, table: str, key: ct.KeySpec, *fields: str) -> DataFrame:
    return ct.extract(spark, ct.SideSpec(table=table, key=key, fields=fields))


@query
def key_single(spark):
    return _keys(spark, "orders", ct.KeySpec.single("o_orderkey"), "o_custkey")


@query
def key_composite(spark):
    return _keys(spark, "lineitem", ct.KeySpec.composite(["l_orderkey", "l_linenumber"], "#"), "l_partkey", "l_returnflag")


@query
def key_defined(spark):
    return _keys(spark, "part", ct.KeySpec.defined("concat(p_brand, '-', p_partkey + 1)"), "p_type", "p_size")


@query
def key_reject_nulls(spark):
    usable, rejected = reject_null_keys(rows(spark, S.SUPPLIER_NULL_KEYS))
    return usable.withColumn("rejected", F.lit(False)).unionAll(rejected.withColumn("rejected", F.lit(True)))


@query
def key_duplicates(spark):
    return ct.duplicate_keys(*lineitem(spark))


# -- canonical texts and hashes -----------------------------------------------------------------


@query
def normalize_lenient(spark):
    return ct.normalize(rows(spark, S.ORDERS_TARGET).withColumn("is_open", F.col("o_orderstatus") == "O"))


@query
def normalize_numbers(spark):
    df = spark.sql(
        """SELECT concat(l_orderkey, '|', l_linenumber) AS line, l_partkey, l_linenumber, l_quantity, l_extendedprice,
                  l_discount, l_tax, l_extendedprice * 1000 AS in_thousandths,
                  CAST(l_extendedprice AS DECIMAL(18,6)) AS long_decimal FROM lineitem"""
    )
    return ct.normalize(df)


@query
def normalize_temporal(spark):
    df = spark.sql(
        """SELECT event_id, ts AS local_ts, date_trunc('MINUTE', ts) AS local_minute,
                  CAST(date_trunc('SECOND', ts) AS TIMESTAMP_NTZ) AS local_second, CAST(ts AS DATE) AS day,
                  timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)) AS instant,
                  timestamp_seconds(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)) AS instant_second
           FROM events"""
    )
    return ct.normalize(df.withColumn("local_minute", F.col("local_minute").cast("timestamp_ntz")))


@query
def normalize_nested(spark):
    df = spark.sql(
        """SELECT p_partkey, split(p_name, ' ') AS words, array(p_size, NULL, p_size + 1) AS sizes,
                  named_struct('brand', p_brand, 'size', p_size, 'of', named_struct('type', p_type)) AS doc,
                  CAST(p_name AS BINARY) AS raw, p_retailprice > 1000 AS dear FROM part"""
    )
    return ct.normalize(df)


@query
def normalize_strict(spark):
    df = spark.sql(
        """SELECT p_partkey, p_size, p_name, CAST(p_size AS SMALLINT) AS small, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
                  p_size > 20 AS large, NULLIF(p_brand, 'Brand#1') AS brand FROM part"""
    )
    return ct.normalize(df, strategy="TypeStrict")


@query
def hash_rows(spark):
    documents = spark.sql("SELECT CAST(doc_id AS STRING) AS migration_key, text, lang, source, n_chars FROM documents")
    return with_row_hash(documents).select(KEY, "row_hash")


@query
def hash_fields(spark):
    hashed = with_field_hashes(rows(spark, S.ORDERS_TARGET))
    return hashed.select(KEY, F.explode("field_hashes").alias("field", "hash"))


@query
def payload_rows(spark):
    turns = spark.sql("SELECT concat(conv_id, '|', turn) AS migration_key, role, text, turn FROM conversations")
    return keyed_payload(turns)


# -- comparing ----------------------------------------------------------------------------------


@query
def recon_counts(spark):
    return ct.reconcile_counts(*orders(spark))


@query
def recon_counts_duplicates(spark):
    return ct.reconcile_counts(*lineitem(spark))


@query
def recon_collated(spark):
    """Texts are compared byte by byte, whatever collation their columns have."""
    names = "SELECT CAST(c_custkey AS STRING) AS migration_key, {} AS c_name FROM customer"
    side = lambda text: spark.sql(names.format(f"{text} COLLATE UTF8_LCASE"))
    source, target = side("c_name"), side("CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END")
    return ct.reconcile_details(ct.keyed(source), ct.keyed(target))


@query
def normalize_decimals(spark):
    """Canonical texts of decimals of many scales, small and negative ones too."""
    decimals = spark.sql("""
        SELECT l_orderkey || '|' || l_linenumber AS line, CAST(l_discount / 1000000 AS DECIMAL(18,10)) AS tiny,
               CAST(-l_extendedprice AS DECIMAL(12,2)) AS negative, CAST(0 AS DECIMAL(20,12)) AS zero,
               CAST(l_quantity AS DECIMAL(10,0)) AS whole FROM lineitem""")
    return ct.normalize(decimals, ["tiny", "negative", "zero", "whole"])


@query
def except_all_source(spark):
    return ct.except_all(*lineitem(spark))


@query
def except_all_target(spark):
    source, target = lineitem(spark)
    return ct.except_all(target, source)


@query
def bag_difference(spark):
    return ct.bag_difference(*lineitem(spark))


@query
def recon_status(spark):
    return ct.classify(*lineitem(spark))


@query
def unique_keys(spark):
    return ct.unique_keys(*lineitem(spark))


@query
def recon_summary(spark):
    return ct.summary(*orders(spark))


@query
def recon_mismatch_details(spark):
    return ct.reconcile_details(*orders(spark))


@query
def recon_wide_details(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        shared_dir(spark)
    documents = "SELECT CAST(doc_id AS STRING) AS migration_key, {} AS text, lang, n_chars FROM documents"
    source = spark.sql(documents.format("text"))
    target = spark.sql(documents.format("CASE WHEN n_chars < 300 THEN concat(text, ' (end)') ELSE text END"))
    return ct.reconcile_details(source, target, wide=True)


@query
def recon_condition_fields(spark):
    return ct.reconcile_details(*orders(spark), condition_fields=["o_orderstatus", "o_orderpriority"])


@query
def recon_field_details(spark):
    return ct.reconcile_details(*orders(spark), mode="FIELD_DETAILS")


@query
def recon_field_conditions(spark):
    return ct.reconcile_details(*orders(spark), mode="FIELD_DETAILS", condition_fields=["o_totalprice", "o_orderstatus"])


@query
def field_diff_rollup(spark):
    return ct.field_rollup(ct.reconcile_details(*orders(spark), mode="FIELD_DETAILS"))


@query
def recon_strict_vs_lenient(spark):
    source, target = pair(spark, S.PART_SOURCE, S.PART_TARGET)
    named = [ct.summary(source, target, s).withColumn("strategy", F.lit(s)) for s in ("TypeLenient", "TypeStrict")]
    return named[0].unionByName(named[1])


@query
def recon_composite_key(spark):
    return ct.reconcile_details(*pair(spark, S.CUSTOMER_SOURCE, S.CUSTOMER_TARGET), mode="FIELD_DETAILS")


@query
def recon_duplicates(spark):
    return ct.reconcile_details(*lineitem(spark))


# -- incremental runs ---------------------------------------------------------------------------


@query
def recon_incremental_delta(spark):
    baseline = ct.reconcile_details(*orders(spark))
    return ct.delta(ct.reconcile_details(*pair(spark, S.ORDERS_SOURCE, S.ORDERS_TARGET_LATER)), baseline)


@query
def baseline_chained(spark):
    return ct.chained_baseline(rows(spark, S.MONTHLY_RECORDS), rows(spark, S.MONTHLY_RUNS))


# -- ledger -------------------------------------------------------------------------------------


@query
def ledger_records(spark):
    ledger = Ledger(spark, shared_dir(spark))
    run = {"run_id": 42}
    ledger.write_records(run, ct.reconcile_details(*orders(spark), mode="FIELD_DETAILS"))
    return ledger.records().filter(F.col("run_id") == 42).drop("created_at", "created_by")


@query
def ledger_delta(spark):
    """Records of a later comparison that are new or differ from those of a stored run, which lie in buckets."""
    ledger = Ledger(spark, shared_dir(spark))
    ledger.write_records({"run_id": 1}, stored(spark, ct.reconcile_details(*orders(spark))))
    later = ct.reconcile_details(*pair(spark, S.ORDERS_SOURCE, S.ORDERS_TARGET_LATER))
    return ct.delta_by_digest(later, ledger.baseline([1]))


@query
def ledger_chained(spark):
    """The newest stored run of every key, where a later run stored only what changed."""
    ledger = Ledger(spark, shared_dir(spark))
    ledger.write_records({"run_id": 1}, stored(spark, ct.reconcile_details(*orders(spark))))
    later = ct.reconcile_details(*pair(spark, S.ORDERS_SOURCE, S.ORDERS_TARGET_LATER))
    with ledger.baseline_of([1]) as baseline:
        ledger.write_records({"run_id": 2}, stored(spark, ct.delta_by_digest(later, baseline)))
    return latest_digests(ledger.baseline([1, 2])).select(KEY, "run_id")


def stored(spark, df: DataFrame) -> DataFrame:
    """The frame, written below the shared folder and read again."""
    folder = shared_dir(spark)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@query
def ledger_page_offset(spark):
    """A page far down a run, read from the files that hold its ranks."""
    ledger = Ledger(spark, shared_dir(spark), file_rows=5000)
    found = ct.reconcile_details(*lineitem(spark), store_payloads=False)
    ledger.write_records({"run_id": 5}, stored(spark, found))
    total = sum(f.rows("MISMATCHED") for f in ledger._sorted_files(5)[1])
    return ledger.page_frame(5, "mismatched", limit=300, offset=total * 3 // 4)


def _runs(spark):
    return ct.current_runs(rows(spark, S.RUN_EVENTS))


@query
def ledger_runs(spark):
    return _runs(spark)


@query
def ledger_active(spark):
    return ct.active_runs(_runs(spark))


@query
def ledger_list(spark):
    return ct.list_runs(_runs(spark), domain="click", active=True)


@query
def ledger_list_parts(spark):
    return ct.list_runs(_runs(spark), domain_run=12)


@query
def domain_rollup(spark):
    return ct.domain_rollup(_runs(spark))


@query
def records_page(spark):
    return ct.records_page(rows(spark, S.SUPPLIER_RECORDS), run_id=7, status="target", limit=100, offset=20)


@query
def records_page_after(spark):
    found = rows(spark, S.SUPPLIER_RECORDS)
    after = ct.records_page(found, run_id=7, status="target", limit=3).agg(F.max(KEY)).first()[0]
    return ct.records_page(found, run_id=7, status="target", limit=100, after_key=after)


@query
def records_total(spark):
    return ct.records_total(rows(spark, S.SUPPLIER_RECORDS), run_id=7, status="TARGET_ONLY")


@query
def run_digest(spark):
    return ct.run_digest(rows(spark, S.SUPPLIER_RUNS), rows(spark, S.SUPPLIER_RECORDS))


@query
def domain_digest(spark):
    runs = rows(spark, S.SUPPLIER_RUNS)
    parents = spark.sql(
        """SELECT CAST(n_nationkey AS BIGINT) AS run_id, n_name AS domain_id, CAST(NULL AS STRING) AS profile_id,
                  'COMPLETED' AS status, CAST(n_regionkey AS BIGINT) AS matched_count, 0L AS mismatched_count,
                  0L AS source_only_count, 0L AS target_only_count FROM nation"""
    )
    return ct.domain_digest(runs.select("domain_run_id", *parents.columns).unionByName(parents, allowMissingColumns=True))


def _side(sql: str) -> ct.SideSpec:
    return ct.SideSpec(query=S.for_spark(sql))


@query
def recon_domain(spark):
    """Four profiles side by side; the one whose source has rows without a key fails alone."""
    profiles = {
        "orders": ct.Profile(_side(S.ORDERS_SOURCE), _side(S.ORDERS_TARGET)),
        "lines": ct.Profile(_side(S.LINEITEM_SOURCE), _side(S.LINEITEM_TARGET)),
        "parts": ct.Profile(_side(S.PART_SOURCE), _side(S.PART_TARGET), strategy="TypeStrict"),
        "suppliers": ct.Profile(_side(S.SUPPLIER_NULL_KEYS), _side(S.SUPPLIER_NULL_KEYS)),
    }
    catalog = ct.Catalog(domains=[ct.Domain("shop", profiles)])
    ledger = Ledger(spark, shared_dir(spark))
    ct.Runner(spark, catalog, ledger).run_domain("shop")
    return ledger.runs().select("domain_id", "profile_id", "status", "run_scope", *COUNTS)


@query
def recon_domain_files(spark):
    """Two profiles side by side whose files carry the same table name."""
    sources, profiles = {}, {}
    for name, sql in (("customers", "SELECT c_custkey AS id, c_name AS name FROM customer"),
                      ("suppliers", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0")):
        folder = shared_dir(spark)
        spark.sql(sql).write.option("header", True).csv(folder)
        sources[name] = ct.Datasource(name, "file", options={"path": folder, "pattern": r"part-.*[.]csv", "table": "party"})
        file = ct.SideSpec(datasource=name, query="SELECT id AS MigrationKey, name FROM party")
        profiles[name] = ct.Profile(_side(sql.replace(" AS id", " AS migration_key").split(" WHERE")[0]), file)
    ledger = Ledger(spark, shared_dir(spark))
    catalog = ct.Catalog(domains=[ct.Domain("files", profiles)], datasources=list(sources.values()))
    ct.Runner(spark, catalog, ledger).run_domain("files")
    return ledger.runs().select("domain_id", "profile_id", "status", *COUNTS)


# -- versioned tables ---------------------------------------------------------------------------


def _upserted(spark):
    return ct.upsert(
        rows(spark, S.CUSTOMER_HISTORY), rows(spark, S.ORDER_CHANGES), "customer_id", "sync", tie_break="change_no"
    )


@query
def scd2_upsert(spark):
    return _upserted(spark)


@query
def scd2_merge_files(spark):
    """The history in files by ranges of keys; only files that meet a change are written anew."""
    history = rows(spark, S.CUSTOMER_HISTORY)
    table = ct.HistoryTable(spark, shared_dir(spark), "customer_id", history.schema, file_rows=1000)
    table.write(history)
    table.upsert(rows(spark, S.ORDER_CHANGES), "sync", tie_break="change_no")
    return table.read()


@query
def scd2_active(spark):
    return ct.active_snapshot(_upserted(spark), "customer_id")


@query
def scd2_delete_cascade(spark):
    deleted = spark.sql("SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2")
    parents, children = ct.delete_cascade(
        rows(spark, S.NATION_HISTORY),
        rows(spark, S.NATION_CUSTOMERS),
        deleted,
        "n_nationkey",
        "admin",
        F.expr("CAST('2002-01-01' AS TIMESTAMP_NTZ)"),
    )
    return parents.unionByName(children)


@query
def scd2_patch_merge(spark):
    return ct.patch_merge(rows(spark, S.USER_PATCHES), "user_id", "event_id")


@query
def scd2_latest_patch(spark):
    return ct.latest_patch(rows(spark, S.USER_PATCHES), "user_id", "event_id")


@query
def tags_filter(spark):
    tagged = spark.sql(
        """SELECT p_partkey, array_union(array(concat(' ', p_type), lower(p_type), '', NULL), split(upper(p_name), ' '))
                  AS tags FROM part"""
    )
    return with_tags(tagged, " Red ").select("p_partkey", F.array_join(normalize_tags(F.col("tags")), ",").alias("tags"))


@query
def config_inherit(spark):
    return ct.fill_defaults(
        rows(spark, S.PROFILE_SETTINGS),
        rows(spark, S.DOMAIN_SETTINGS),
        {"strategy": "TypeLenient", "batch_size": 1000},
    )


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tables(spark, folder)
            return build(spark)

        return run

    return {name: bind(build) for name, build in REGISTRY.items()}
