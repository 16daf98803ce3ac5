"""Side definitions as SQL that Spark and the checking engine both run.

Targets are functions of the same tables: some rows get another key (one-sided on both sides),
some get other values. No side drops rows. ``{NTZ}`` is the engine's zone-less timestamp type and
``{K}`` reads member ``k`` of the JSON text ``props``.
"""

ORDERS_SOURCE = """
SELECT CAST(o_orderkey AS STRING) AS migration_key, o_custkey, o_orderstatus,
       CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders
"""

ORDERS_TARGET = """
SELECT CASE WHEN o_orderdate >= CAST('2001-06-01' AS {NTZ})
            THEN CONCAT(CAST(o_orderkey AS STRING), '-R') ELSE CAST(o_orderkey AS STRING) END AS migration_key,
       o_custkey,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CAST(CASE WHEN o_totalprice < 20000 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(12,2)) AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 130000 THEN NULL ELSE o_orderpriority END
           AS o_orderpriority
FROM orders
"""

# The same target one load later: more prices corrected, one earlier difference gone.
ORDERS_TARGET_LATER = """
SELECT CASE WHEN o_orderdate >= CAST('2001-07-01' AS {NTZ})
            THEN CONCAT(CAST(o_orderkey AS STRING), '-R') ELSE CAST(o_orderkey AS STRING) END AS migration_key,
       o_custkey,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CAST(CASE WHEN o_totalprice < 30000 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(12,2)) AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders
"""

LINEITEM_SOURCE = """
SELECT CONCAT(CAST(l_orderkey AS STRING), '|', CAST(l_linenumber AS STRING)) AS migration_key,
       CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice,
       l_returnflag, l_linestatus, l_shipdate
FROM lineitem
"""

LINEITEM_TARGET = """
SELECT CONCAT(CAST(l_orderkey AS STRING), '|', CAST(l_linenumber AS STRING),
              CASE WHEN l_discount >= 0.095 THEN '-R' ELSE '' END) AS migration_key,
       CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice,
       CASE WHEN l_tax < 0.003 THEN 'Z' ELSE l_returnflag END AS l_returnflag, l_linestatus, l_shipdate
FROM lineitem
"""

PART_SOURCE = """
SELECT CAST(p_partkey AS STRING) AS migration_key, p_name, p_brand, p_size,
       CAST(p_retailprice AS DECIMAL(12,2)) AS p_retailprice FROM part
"""

# Another store's types: sizes as decimals, prices with more digits.
PART_TARGET = """
SELECT CAST(p_partkey AS STRING) AS migration_key, p_name, p_brand,
       CAST(CASE WHEN p_size > 45 THEN p_size + 1 ELSE p_size END AS DECIMAL(8,2)) AS p_size,
       CAST(p_retailprice AS DECIMAL(14,4)) AS p_retailprice FROM part
"""

CUSTOMER_SOURCE = """
SELECT CONCAT(CAST(c_nationkey AS STRING), '/', CAST(c_custkey AS STRING)) AS migration_key, c_name,
       CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal, c_mktsegment FROM customer
"""

CUSTOMER_TARGET = """
SELECT CONCAT(CAST(c_nationkey AS STRING), '/', CAST(c_custkey AS STRING)) AS migration_key, UPPER(c_name) AS c_name,
       CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer
"""

SUPPLIER_NULL_KEYS = """
SELECT CASE WHEN s_acctbal < 3000 THEN NULL ELSE CAST(s_suppkey AS STRING) END AS migration_key, s_name, s_acctbal
FROM supplier
"""

# A run ledger told by the events table: an event is a run of profile (event type, user).
RUN_EVENTS = """
SELECT event_id AS run_id, CONCAT(event_type, '.u', CAST(user_id AS STRING)) AS dataset_id, event_type AS domain_id,
       CONCAT('u', CAST(user_id AS STRING)) AS profile_id, CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS domain_run_id,
       'RUNNING' AS status, ts AS started_at, CAST(NULL AS {NTZ}) AS completed_at,
       CAST(0 AS BIGINT) AS source_count, CAST(0 AS BIGINT) AS target_count, CAST(0 AS BIGINT) AS matched_count,
       CAST(0 AS BIGINT) AS mismatched_count, CAST(0 AS BIGINT) AS source_only_count,
       CAST(0 AS BIGINT) AS target_only_count, CAST(NULL AS STRING) AS error_message, ts AS event_ts
FROM events
UNION ALL
SELECT event_id, CONCAT(event_type, '.u', CAST(user_id AS STRING)), event_type,
       CONCAT('u', CAST(user_id AS STRING)), CAST(EXTRACT(DAY FROM ts) AS BIGINT),
       CASE WHEN value > 100 THEN 'FAILED' ELSE 'COMPLETED' END, ts, ts + INTERVAL '7' MINUTE,
       CASE WHEN value > 100 THEN 0 ELSE {K} * 3 + 2 END, CASE WHEN value > 100 THEN 0 ELSE {K} * 3 + 1 END,
       CASE WHEN value > 100 THEN 0 ELSE {K} * 2 END, CASE WHEN value > 100 THEN 0 ELSE {K} END,
       CASE WHEN value > 100 THEN 0 ELSE 2 END, CASE WHEN value > 100 THEN 0 ELSE 1 END,
       CASE WHEN value > 100 THEN 'extract failed' END, ts + INTERVAL '7' MINUTE
FROM events WHERE value >= 1
"""

# One run per supplier and its records from the lines it delivered.
SUPPLIER_RUNS = """
SELECT s_suppkey AS run_id, n_name AS domain_id, s_name AS profile_id,
       CASE WHEN s_acctbal < 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'FIELD_DETAILS' AS recon_mode,
       s_acctbal >= 0 AS active, CAST(s_nationkey AS BIGINT) AS domain_run_id,
       CAST(100 AS BIGINT) AS source_count, CAST(99 AS BIGINT) AS target_count, CAST(90 AS BIGINT) AS matched_count,
       CAST(s_nationkey AS BIGINT) AS mismatched_count, CAST(2 AS BIGINT) AS source_only_count,
       CAST(1 AS BIGINT) AS target_only_count,
       CASE WHEN s_acctbal < 0 THEN 'connection refused' END AS error_message
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

SUPPLIER_RECORDS = """
SELECT l_suppkey AS run_id,
       CONCAT(CAST(l_orderkey AS STRING), '|', CAST(l_linenumber AS STRING), '|', CAST(l_partkey AS STRING)) AS migration_key,
       CASE WHEN MAX(l_returnflag) = 'R' THEN 'MISMATCHED' WHEN MAX(l_returnflag) = 'N' THEN 'TARGET_ONLY'
            WHEN MAX(l_linestatus) = 'O' THEN 'SOURCE_ONLY' ELSE 'MATCHED' END AS status,
       CASE WHEN MAX(l_returnflag) = 'R' THEN '{{"l_tax":"MISMATCHED"}}' END AS field_diffs
FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber, l_partkey
"""

# Monthly runs per return flag: January is a full run, June failed.
MONTHLY_RUNS = """
SELECT DISTINCT 'ship' AS domain_id, l_returnflag AS profile_id,
       (CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) * 100 + EXTRACT(MONTH FROM l_shipdate)) * 10
           + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS run_id,
       CASE WHEN EXTRACT(MONTH FROM l_shipdate) = 6 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       CASE WHEN EXTRACT(MONTH FROM l_shipdate) = 1 THEN 'FULL' ELSE 'INCREMENTAL' END AS run_scope
FROM lineitem
"""

MONTHLY_RECORDS = """
SELECT (CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) * 100 + EXTRACT(MONTH FROM l_shipdate)) * 10
           + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS run_id,
       CAST(l_partkey AS STRING) AS migration_key,
       CASE WHEN MAX(l_linestatus) = 'O' THEN 'SOURCE_ONLY' ELSE 'TARGET_ONLY' END AS status,
       CAST(CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS STRING) AS source_payload
FROM lineitem
GROUP BY l_partkey, EXTRACT(YEAR FROM l_shipdate), EXTRACT(MONTH FROM l_shipdate), l_returnflag
"""

# Versioned customers: building firms were deleted once. Orders are changes to their customer.
CUSTOMER_HISTORY = """
SELECT c_custkey AS customer_id, c_mktsegment AS config, 1 AS version, c_mktsegment <> 'BUILDING' AS active,
       CAST('1994-01-01' AS {NTZ}) AS created_at, 'load' AS created_by,
       CAST('1994-01-01' AS {NTZ}) AS updated_at, 'load' AS updated_by
FROM customer
"""

ORDER_CHANGES = """
SELECT o_custkey AS customer_id, CONCAT(o_orderpriority, '/', o_orderstatus) AS config, o_orderdate AS changed_at,
       o_orderkey AS change_no
FROM orders
"""

NATION_HISTORY = """
SELECT n_nationkey, n_name AS config, 3 AS version, TRUE AS active, CAST('1994-01-01' AS {NTZ}) AS created_at,
       'load' AS created_by, CAST('1994-01-01' AS {NTZ}) AS updated_at, 'load' AS updated_by
FROM nation
"""

NATION_CUSTOMERS = """
SELECT c_nationkey AS n_nationkey, c_name AS config, 2 AS version, c_acctbal >= 0 AS active,
       CAST('1994-01-01' AS {NTZ}) AS created_at, 'load' AS created_by, CAST('1994-01-01' AS {NTZ}) AS updated_at,
       'load' AS updated_by
FROM customer
"""

USER_PATCHES = """
SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS mode,
       CASE WHEN event_type = 'click' THEN value END AS batch
FROM events
"""

PROFILE_SETTINGS = """
SELECT s_suppkey AS profile_no, s_nationkey AS domain_id,
       CASE WHEN s_acctbal > 5000 THEN 'TypeStrict' END AS strategy,
       CASE WHEN s_acctbal < 0 THEN 500 END AS batch_size,
       CASE WHEN s_acctbal > 2000 THEN s_name ELSE '  ' END AS datasource
FROM supplier
"""

DOMAIN_SETTINGS = """
SELECT n_nationkey AS domain_id, CASE WHEN n_regionkey = 1 THEN 'TypeStrict' END AS strategy,
       CASE WHEN n_regionkey >= 3 THEN 2000 END AS batch_size, CASE WHEN n_regionkey = 0 THEN n_name END AS datasource
FROM nation
"""


def for_spark(sql: str) -> str:
    return sql.replace("{{", "{").replace("}}", "}").replace("{NTZ}", "TIMESTAMP_NTZ").replace(
        "{K}", "CAST(get_json_object(props, '$.k') AS BIGINT)"
    )


def for_check(sql: str) -> str:
    return sql.replace("{{", "{").replace("}}", "}").replace("{NTZ}", "TIMESTAMP").replace(
        "{K}", "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    )
