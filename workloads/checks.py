"""The same results as plain SQL, written independently of the library."""

from __future__ import annotations

from . import sides as S

sql = S.for_check


def text(c: str) -> str:
    return f"COALESCE(CAST({c} AS VARCHAR), '<NULL>')"


def number(c: str) -> str:
    """A double or decimal: its text always has a point here."""
    return f"CASE WHEN {c} IS NULL THEN '<NULL>' WHEN {c} = 0 THEN '0' ELSE rtrim(rtrim(CAST({c} AS VARCHAR), '0'), '.') END"


def boolean(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '<NULL>' WHEN {c} THEN '1' ELSE '0' END"


def _fraction(c: str) -> str:
    us = f"(EXTRACT(MICROSECOND FROM {c}) % 1000000)"
    return f"CASE WHEN {us} = 0 THEN '' WHEN {us} % 1000 = 0 THEN strftime({c}, '.%g') ELSE strftime({c}, '.%f') END"


def instant(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '<NULL>' ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S') || {_fraction(c)} || 'Z' END"


def clock(c: str) -> str:
    seconds = f"CASE WHEN EXTRACT(MICROSECOND FROM {c}) = 0 THEN '' ELSE strftime({c}, ':%S') || {_fraction(c)} END"
    return f"CASE WHEN {c} IS NULL THEN '<NULL>' ELSE strftime({c}, '%Y-%m-%dT%H:%M') || {seconds} END"


def payload(*texts: str) -> str:
    return f"CAST(to_json([{', '.join(texts)}]) AS VARCHAR)"


def digest(*texts: str) -> str:
    return "sha256(" + " || ".join(f"{t} || chr(0)" for t in texts) + ")"


ORDER_TEXTS = {
    "o_custkey": text("o_custkey"),
    "o_orderstatus": text("o_orderstatus"),
    "o_totalprice": number("o_totalprice"),
    "o_orderdate": clock("o_orderdate"),
    "o_orderpriority": text("o_orderpriority"),
}
LINE_TEXTS = {
    "l_quantity": number("l_quantity"),
    "l_extendedprice": number("l_extendedprice"),
    "l_returnflag": text("l_returnflag"),
    "l_linestatus": text("l_linestatus"),
    "l_shipdate": clock("l_shipdate"),
}
PART_TEXTS = {
    "p_name": text("p_name"),
    "p_brand": text("p_brand"),
    "p_size": text("p_size"),
    "p_retailprice": number("p_retailprice"),
}
PART_TARGET_TEXTS = {**PART_TEXTS, "p_size": number("p_size")}
CUSTOMER_TEXTS = {"c_name": text("c_name"), "c_acctbal": number("c_acctbal"), "c_mktsegment": text("c_mktsegment")}


def compared(source: str, target: str, texts: dict, target_texts: dict | None = None, p: str = "") -> str:
    """CTEs: s, t (rows with payloads), se, te (EXCEPT ALL both ways), st (one row per key)."""
    target_texts = target_texts or texts
    return f"""
    {p}s AS (SELECT migration_key, {payload(*texts.values())} AS payload FROM ({sql(source)})),
    {p}t AS (SELECT migration_key, {payload(*target_texts.values())} AS payload FROM ({sql(target)})),
    {p}se AS (SELECT * FROM {p}s EXCEPT ALL SELECT * FROM {p}t),
    {p}te AS (SELECT * FROM {p}t EXCEPT ALL SELECT * FROM {p}s),
    {p}st AS (
      SELECT k.migration_key, a.source_payload, b.target_payload,
             CASE WHEN a.source_payload IS NOT NULL AND b.target_payload IS NOT NULL THEN 'MISMATCHED'
                  WHEN a.source_payload IS NOT NULL THEN 'SOURCE_ONLY'
                  WHEN b.target_payload IS NOT NULL THEN 'TARGET_ONLY' ELSE 'MATCHED' END AS status
      FROM (SELECT migration_key FROM {p}s UNION SELECT migration_key FROM {p}t) k
      LEFT JOIN (SELECT migration_key, max(payload) AS source_payload FROM {p}se GROUP BY 1) a USING (migration_key)
      LEFT JOIN (SELECT migration_key, max(payload) AS target_payload FROM {p}te GROUP BY 1) b USING (migration_key))
    """


def counts(p: str = "") -> str:
    status = lambda s: f"(SELECT count(*) FROM {p}st WHERE status = '{s}')"
    return f"""(SELECT count(*) FROM {p}s) AS source_count, (SELECT count(*) FROM {p}t) AS target_count,
      {status('MATCHED')} AS matched_count, {status('MISMATCHED')} AS mismatched_count,
      {status('SOURCE_ONLY')} AS source_only_count, {status('TARGET_ONLY')} AS target_only_count"""


def field_object(fields: dict) -> str:
    """JSON text of field statuses; ``fields`` maps a name to its position in the payloads."""
    parts = []
    for name, at in fields.items():
        l = f"json_extract_string(source_payload, '$[{at}]')"
        r = f"json_extract_string(target_payload, '$[{at}]')"
        parts.append(
            f"""'"{name}":"' || CASE WHEN {l} IS NULL THEN 'TARGET_ONLY' WHEN {r} IS NULL THEN 'SOURCE_ONLY'
                 WHEN {l} = {r} THEN 'MATCHED' ELSE 'MISMATCHED' END || '"'"""
        )
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def records(field_diffs: str = "CAST(NULL AS VARCHAR)", where: str = "TRUE", p: str = "") -> str:
    return f"""SELECT migration_key, sha256(source_payload || chr(0)) AS source_hash,
      sha256(target_payload || chr(0)) AS target_hash, status, {field_diffs} AS field_diffs, source_payload, target_payload
      FROM {p}st WHERE status <> 'MATCHED' AND {where}"""


ORDERS = compared(S.ORDERS_SOURCE, S.ORDERS_TARGET, ORDER_TEXTS)
LINES = compared(S.LINEITEM_SOURCE, S.LINEITEM_TARGET, LINE_TEXTS)
ORDER_FIELDS = {name: i for i, name in enumerate(ORDER_TEXTS)}


def _differs(*positions: int) -> str:
    test = "json_extract_string(source_payload, '$[{0}]') <> json_extract_string(target_payload, '$[{0}]')"
    return "(status <> 'MISMATCHED' OR " + " OR ".join(test.format(i) for i in positions) + ")"


CHECKS: dict[str, str] = {}


def _extracts() -> None:
    c = CHECKS
    c["extract_table"] = "SELECT CAST(c_custkey AS VARCHAR) AS migration_key, c_nationkey, c_name, c_mktsegment FROM customer"
    c["extract_distinct"] = (
        "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS migration_key, l_returnflag, l_linestatus FROM lineitem"
    )
    c["extract_custom_sql"] = """
      SELECT CAST(c_custkey AS VARCHAR) AS migration_key, upper(c_name) AS c_name, n_name, r_name,
             n_name || '/' || c_mktsegment AS place
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
    c["extract_params"] = """
      SELECT CAST(o_orderkey AS VARCHAR) AS migration_key, o_orderstatus, o_orderpriority, 'why?' AS note
      FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 250000"""
    c["extract_conditional"] = """
      SELECT CAST(o_orderkey AS VARCHAR) AS migration_key, o_custkey, o_orderstatus FROM orders
      WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL
        AND (o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1998-01-01')"""
    document = """event_type, json_extract_string(props, '$.k') AS "props.k", value, CAST(NULL AS VARCHAR) AS "props.missing"
      FROM events"""
    c["extract_document"] = f"SELECT CAST(event_id AS VARCHAR) AS migration_key, {document}"
    c["extract_document_filter"] = f"""
      SELECT user_id || '|' || event_id AS migration_key, {document}
      WHERE event_type IN ('click', 'view', 'signup') AND value >= 2.5 AND value < 300
        AND (CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 OR user_id <= 20) AND user_id NOT IN (3, 4)"""
    c["extract_document_window"] = """
      SELECT CAST(event_id AS VARCHAR) AS migration_key, event_type, value FROM events
      WHERE ts > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-02-01' AND event_type = 'purchase'"""
    window = """
      SELECT CAST(event_id AS VARCHAR) AS migration_key, event_type, value, ts FROM events
      WHERE ts > TIMESTAMP '{}' AND ts <= TIMESTAMP '2024-02-01' AND event_type <> 'error'"""
    c["extract_document_operators"] = """
      SELECT CAST(p_partkey AS VARCHAR) AS migration_key, p_name AS "part.p_name", CASE WHEN p_size < 3 THEN p_size + 1 ELSE p_size END AS "part.size"
      FROM part WHERE p_partkey % 17 <> 0 AND NOT p_brand LIKE '%1' AND len(string_split(p_name, ' ')) = 2 AND p_size > 40
        AND p_type <> 'any' AND lower(p_name) < 'n' AND lower(p_name) >= 'a'"""
    c["extract_document_all"] = """
      WITH w AS (SELECT string_split(min(p_name), ' ') AS w FROM part)
      SELECT CAST(p_partkey AS VARCHAR) AS migration_key, p_name AS "part.p_name", CASE WHEN p_size < 3 THEN p_size + 1 ELSE p_size END AS "part.size"
      FROM part, w WHERE p_partkey % 17 <> 0 AND list_has_all(string_split(p_name, ' '), w[1:2]) AND p_brand <> 'Brand#1'"""
    c["extract_by_quantiles"] = """
      SELECT l_orderkey || '-' || l_linenumber AS migration_key, l_quantity,
             CAST(CASE WHEN l_partkey % 3 = 0 THEN 7 WHEN l_partkey % 11 > 0 THEN l_suppkey * l_suppkey END AS VARCHAR) AS part
      FROM lineitem"""
    c["extract_document_inferred"] = """
      SELECT CAST(event_id AS VARCHAR) AS migration_key, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
             CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS seen,
             CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN '[{"type":"' || event_type || '"}]' END AS "rare.only", event_type
      FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 20"""
    c["extract_window_full"] = window.format("1970-01-01")
    c["extract_window_incremental"] = window.format("2024-01-20")
    c["extract_csv"] = """
      SELECT CAST(c_custkey AS VARCHAR) AS migration_key, c_name AS name,
             CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS "C_2nd_balance",
             CASE WHEN c_mktsegment <> 'BUILDING' THEN '"' || c_mktsegment || '", ' || c_nationkey END AS segment
      FROM customer"""
    c["extract_xlsx"] = """
      SELECT CAST(c_custkey AS VARCHAR) AS migration_key, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
             CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS in_credit
      FROM customer"""
    c["extract_xlsx_formats"] = """
      WITH lines AS (
        SELECT *, l_shipdate + to_days(l_linenumber) AS l_receiptdate, l_partkey % 5000 * 30 AS minutes, l_orderkey % 80 // 8 AS wholes, l_orderkey % 8 AS parts,
               l_extendedprice * (l_linenumber % 3 - 1) AS signed FROM lineitem)
      SELECT l_orderkey || '-' || l_linenumber AS migration_key, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
             month(l_receiptdate) || '/' || day(l_receiptdate) || strftime(l_receiptdate, '/%y') AS received,
             strftime(l_shipdate, '%d.%m.%Y ') || format('{:02d}:{:02d}:{:02d}', l_orderkey % 24, l_partkey % 60, l_suppkey % 60) AS at,
             (minutes // 60) || ':' || format('{:02d}', minutes % 60) AS lasted,
             CAST(CAST(l_discount * 100 AS DECIMAL(9,2)) AS VARCHAR) || '%' AS discount,
             CAST(CAST(l_tax * 100 AS DECIMAL(9,1)) AS VARCHAR) || '%' AS tax,
             CASE WHEN signed = 0 THEN '-' WHEN signed > 0 THEN format('{:,.2f}', signed) ELSE '(' || format('{:,.2f}', -signed) || ')' END AS price,
             format('{:,d}', CAST(l_quantity * 1000 AS BIGINT)) || ' pcs' AS quantity,
             CASE WHEN parts = 0 THEN CAST(wholes AS VARCHAR)
                  ELSE CASE WHEN wholes > 0 THEN wholes || ' ' ELSE '' END || parts // gcd(parts, 8) || '/' || 8 // gcd(parts, 8) END AS eighths,
             upper(format('{:.3e}', CAST(l_partkey AS DOUBLE))) AS exact
      FROM lines"""
    part = "SELECT CAST(p_partkey AS STRING) AS migration_key, p_name, {} AS p_size FROM part"
    texts = {"p_name": text("p_name"), "p_size": text("p_size")}
    c["pair_table_csv"] = (
        "WITH "
        + compared(part.format("p_size"), part.format("CASE WHEN p_size > 48 THEN p_size + 1 ELSE p_size END"), texts)
        + records(field_object({"p_name": 0, "p_size": 1}))
    )


    document = part.format("CASE WHEN p_size < 3 THEN p_size + 1 ELSE p_size END") + " WHERE p_partkey % 17 <> 0"
    shown = "CASE WHEN p_size < 4 THEN p_size || ',000' ELSE CAST(p_size AS VARCHAR) END"
    for name, source, target, fields in (
        ("pair_xlsx_table", part.format("p_size"), part.format(shown) + " WHERE p_partkey % 19 <> 0", ("p_name", "p_size")),
        ("pair_document_table", document, part.format("p_size"), ("part.p_name", "part.size")),
        ("pair_document_csv", document, part.format("p_size"), ("part.p_name", "part.size")),
        ("pair_sql_document", part.format("p_size") + " WHERE p_size > 5", document, ("p_name", "p_size")),
    ):
        c[name] = "WITH " + compared(source, target, texts) + records(field_object({f: i for i, f in enumerate(fields)}))


def _keys_and_texts() -> None:
    c = CHECKS
    c["normalize_decimals"] = f"""
      SELECT l_orderkey || '|' || l_linenumber AS line, {number('CAST(l_discount / 1000000 AS DECIMAL(18,10))')} AS tiny,
             {number('CAST(-l_extendedprice AS DECIMAL(12,2))')} AS negative, '0' AS zero,
             CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS whole FROM lineitem"""
    names = "SELECT CAST(c_custkey AS STRING) AS migration_key, {} AS c_name FROM customer"
    c["recon_collated"] = "WITH " + compared(
        names.format("c_name"), names.format("CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END"),
        {"c_name": text("c_name")}) + records()
    c["key_single"] = "SELECT CAST(o_orderkey AS VARCHAR) AS migration_key, o_custkey FROM orders"
    c["key_composite"] = """
      SELECT l_orderkey || '#' || l_linenumber AS migration_key, l_partkey, l_returnflag FROM lineitem"""
    c["key_defined"] = "SELECT p_brand || '-' || (p_partkey + 1) AS migration_key, p_type, p_size FROM part"
    c["key_reject_nulls"] = f"SELECT *, migration_key IS NULL AS rejected FROM ({sql(S.SUPPLIER_NULL_KEYS)})"
    c["key_duplicates"] = f"""
      SELECT migration_key, CAST(sum(s) AS BIGINT) AS source_rows, CAST(sum(t) AS BIGINT) AS target_rows FROM (
        SELECT migration_key, 1 AS s, 0 AS t FROM ({sql(S.LINEITEM_SOURCE)})
        UNION ALL SELECT migration_key, 0, 1 FROM ({sql(S.LINEITEM_TARGET)})) GROUP BY 1
      HAVING sum(s) > 1 OR sum(t) > 1"""
    orders = ", ".join(f"{t} AS {n}" for n, t in ORDER_TEXTS.items())
    c["normalize_lenient"] = f"""
      SELECT migration_key, {orders}, {boolean("o_orderstatus = 'O'")} AS is_open FROM ({sql(S.ORDERS_TARGET)})"""
    numbers = ", ".join(f"{number(n)} AS {n}" for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    c["normalize_numbers"] = f"""
      SELECT l_orderkey || '|' || l_linenumber AS line, {text('l_partkey')} AS l_partkey,
             {text('l_linenumber')} AS l_linenumber, {numbers},
             {number('(l_extendedprice * 1000)')} AS in_thousandths,
             {number('CAST(l_extendedprice AS DECIMAL(18,6))')} AS long_decimal FROM lineitem"""
    c["normalize_temporal"] = f"""
      SELECT {text('event_id')} AS event_id, {clock('ts')} AS local_ts, {clock("date_trunc('minute', ts)")} AS local_minute,
             {clock("date_trunc('second', ts)")} AS local_second, strftime(ts, '%Y-%m-%d') AS day,
             {instant('ts')} AS instant, {instant("date_trunc('second', ts)")} AS instant_second FROM events"""
    c["normalize_nested"] = f"""
      SELECT {text('p_partkey')} AS p_partkey, '[' || array_to_string(string_split(p_name, ' '), ', ') || ']' AS words,
             '[' || p_size || ', null, ' || (p_size + 1) || ']' AS sizes,
             '{{"brand": "' || p_brand || '", "size": ' || p_size || ', "of": {{"type": "' || p_type || '"}}}}' AS doc,
             lower(hex(encode(p_name))) AS raw, {boolean('p_retailprice > 1000')} AS dear FROM part"""
    c["normalize_strict"] = """
      SELECT 'java.lang.Long:' || p_partkey AS p_partkey, 'java.lang.Integer:' || p_size AS p_size,
             'java.lang.String:' || p_name AS p_name, 'java.lang.Short:' || p_size AS small,
             'java.math.BigDecimal:' || CAST(p_retailprice AS DECIMAL(12,2)) AS price,
             'java.lang.Boolean:' || CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END AS large,
             CASE WHEN p_brand = 'Brand#1' THEN '<NULL>' ELSE 'java.lang.String:' || p_brand END AS brand FROM part"""
    c["hash_rows"] = f"""
      SELECT CAST(doc_id AS VARCHAR) AS migration_key,
             {digest(*[text(n) for n in ('text', 'lang', 'source', 'n_chars')])} AS row_hash FROM documents"""
    c["hash_fields"] = " UNION ALL ".join(
        f"SELECT migration_key, '{n}' AS field, {digest(t)} AS hash FROM ({sql(S.ORDERS_TARGET)})"
        for n, t in ORDER_TEXTS.items()
    )
    c["payload_rows"] = f"""
      SELECT conv_id || '|' || turn AS migration_key, {payload(text('role'), text('text'), text('turn'))} AS payload
      FROM conversations"""


def _comparisons() -> None:
    c = CHECKS
    c["recon_counts"] = f"""
      WITH a AS (SELECT migration_key, {payload(*ORDER_TEXTS.values())} AS x FROM ({sql(S.ORDERS_SOURCE)})),
           b AS (SELECT migration_key, {payload(*ORDER_TEXTS.values())} AS y FROM ({sql(S.ORDERS_TARGET)})),
           j AS (SELECT x, y FROM a FULL JOIN b USING (migration_key))
      SELECT count(x) AS source_count, count(y) AS target_count, count(*) FILTER (x = y) AS matched_count,
             count(*) FILTER (x <> y) AS mismatched_count, count(*) FILTER (y IS NULL) AS source_only_count,
             count(*) FILTER (x IS NULL) AS target_only_count,
             (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders) AS target_rows FROM j"""
    c["recon_counts_duplicates"] = f"""
      WITH {LINES}, a AS (SELECT migration_key, count(*) AS x, max(payload) AS p FROM s GROUP BY 1),
           b AS (SELECT migration_key, count(*) AS y, max(payload) AS q FROM t GROUP BY 1),
           j AS (SELECT x, y, p, q FROM a FULL JOIN b USING (migration_key))
      SELECT count(x) AS source_count, count(y) AS target_count, count(*) FILTER (y IS NULL) AS source_only_count,
             count(*) FILTER (x IS NULL) AS target_only_count, CAST(sum(x) AS BIGINT) AS source_rows,
             CAST(sum(y) AS BIGINT) AS target_rows, count(*) FILTER (p = q) AS matched_count,
             count(*) FILTER (p <> q) AS mismatched_count FROM j"""
    c["except_all_source"] = f"WITH {LINES} SELECT * FROM se"
    c["except_all_target"] = f"WITH {LINES} SELECT * FROM te"
    c["bag_difference"] = f"""WITH {LINES}
      SELECT migration_key, payload, CAST(sum(a) AS BIGINT) AS source_surplus, CAST(sum(b) AS BIGINT) AS target_surplus
      FROM (SELECT *, 1 AS a, 0 AS b FROM se UNION ALL SELECT *, 0, 1 FROM te) GROUP BY 1, 2"""
    c["recon_status"] = f"""WITH {LINES}
      SELECT st.migration_key, status, coalesce(n, 0) AS source_rows, coalesce(m, 0) AS target_rows FROM st
      LEFT JOIN (SELECT migration_key, count(*) AS n FROM s GROUP BY 1) USING (migration_key)
      LEFT JOIN (SELECT migration_key, count(*) AS m FROM t GROUP BY 1) USING (migration_key)"""
    c["unique_keys"] = f"WITH {LINES} SELECT count(*) AS unique_keys FROM st"
    c["recon_summary"] = f"WITH {ORDERS} SELECT {counts()}"
    c["recon_mismatch_details"] = f"WITH {ORDERS} {records()}"
    documents = "SELECT CAST(doc_id AS STRING) AS migration_key, {} AS text, lang, n_chars FROM documents"
    wide = compared(
        documents.format("text"),
        documents.format("CASE WHEN n_chars < 300 THEN concat(text, ' (end)') ELSE text END"),
        {n: text(n) for n in ("text", "lang", "n_chars")},
    )
    c["recon_wide_details"] = f"WITH {wide} {records()}"
    c["recon_condition_fields"] = f"WITH {ORDERS} {records(where=_differs(1, 4))}"
    c["recon_field_details"] = f"WITH {ORDERS} {records(field_object(ORDER_FIELDS))}"
    c["recon_field_conditions"] = f"WITH {ORDERS} {records(field_object({'o_totalprice': 2, 'o_orderstatus': 1}))}"
    per_field = " UNION ALL ".join(
        f"""SELECT '{n}' AS field, CASE WHEN source_payload IS NULL THEN 'TARGET_ONLY' WHEN target_payload IS NULL
              THEN 'SOURCE_ONLY' WHEN json_extract_string(source_payload, '$[{i}]') = json_extract_string(target_payload, '$[{i}]')
              THEN 'MATCHED' ELSE 'MISMATCHED' END AS status FROM st WHERE status <> 'MATCHED'"""
        for n, i in ORDER_FIELDS.items()
    )
    c["field_diff_rollup"] = f"WITH {ORDERS} SELECT field, status, count(*) AS records FROM ({per_field}) GROUP BY 1, 2"
    tagged = lambda tags, texts: {
        n: f"CASE WHEN {n} IS NULL THEN '<NULL>' ELSE '{tag}:' || {n} END" for n, tag in zip(texts, tags)
    }
    string, integer, decimal = "java.lang.String", "java.lang.Integer", "java.math.BigDecimal"
    strict = compared(
        S.PART_SOURCE,
        S.PART_TARGET,
        tagged((string, string, integer, decimal), PART_TEXTS),
        tagged((string, string, decimal, decimal), PART_TEXTS),
        "x",
    )
    lenient = compared(S.PART_SOURCE, S.PART_TARGET, PART_TEXTS, PART_TARGET_TEXTS)
    c["recon_strict_vs_lenient"] = f"""WITH {lenient}, {strict}
      SELECT {counts()}, 'TypeLenient' AS strategy UNION ALL SELECT {counts('x')}, 'TypeStrict'"""
    customers = compared(S.CUSTOMER_SOURCE, S.CUSTOMER_TARGET, CUSTOMER_TEXTS)
    fields = field_object({n: i for i, n in enumerate(CUSTOMER_TEXTS)})
    c["recon_composite_key"] = f"WITH {customers} {records(fields)}"
    c["recon_duplicates"] = f"WITH {LINES} {records()}"
    c["ledger_page_offset"] = f"""
      WITH {LINES}, found AS ({records(where="status = 'MISMATCHED'")}),
      ranked AS (SELECT *, row_number() OVER (ORDER BY migration_key) - 1 AS place, count(*) OVER () * 3 // 4 AS skipped FROM found)
      SELECT * EXCLUDE (place, skipped) REPLACE (CAST(NULL AS VARCHAR) AS source_payload, CAST(NULL AS VARCHAR) AS target_payload)
      FROM ranked WHERE place >= skipped AND place < skipped + 300"""
    later = compared(S.ORDERS_SOURCE, S.ORDERS_TARGET_LATER, ORDER_TEXTS, p="n")
    c["recon_incremental_delta"] = f"""WITH {ORDERS}, {later}
      SELECT n.* FROM ({records(p='n')}) n LEFT JOIN ({records()}) o ON n.migration_key = o.migration_key
      WHERE o.migration_key IS NULL OR n.status <> o.status OR n.source_payload IS DISTINCT FROM o.source_payload
         OR n.target_payload IS DISTINCT FROM o.target_payload"""
    c["ledger_delta"] = c["recon_incremental_delta"]
    c["ledger_chained"] = f"""
      SELECT migration_key, CAST(max(run_id) AS BIGINT) AS run_id FROM (
        SELECT migration_key, 2 AS run_id FROM ({c["recon_incremental_delta"]})
        UNION ALL SELECT migration_key, 1 FROM (WITH {ORDERS} {records()})) GROUP BY 1"""
    c["baseline_chained"] = f"""
      WITH runs AS ({sql(S.MONTHLY_RUNS)}), records AS ({sql(S.MONTHLY_RECORDS)}),
      chain AS (SELECT * FROM runs r WHERE status = 'COMPLETED' AND run_id >= (
        SELECT max(run_id) FROM runs f WHERE f.profile_id = r.profile_id AND f.status = 'COMPLETED' AND f.run_scope = 'FULL'))
      SELECT domain_id, profile_id, migration_key, run_id, status, source_payload FROM (
        SELECT c.domain_id, c.profile_id, d.*, row_number() OVER (PARTITION BY c.profile_id, d.migration_key
               ORDER BY d.run_id DESC) AS rn FROM records d JOIN chain c ON d.run_id = c.run_id) WHERE rn = 1"""


def _ledger() -> None:
    c = CHECKS
    current = f"""
      events_of_runs AS ({sql(S.RUN_EVENTS)}),
      runs AS (SELECT * EXCLUDE (event_ts, rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_ts DESC)
               AS rn FROM events_of_runs) WHERE rn = 1),
      newest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, profile_id
                 ORDER BY completed_at DESC, run_id DESC) AS rn FROM runs WHERE status = 'COMPLETED') WHERE rn = 1)"""
    c["ledger_records"] = f"WITH {ORDERS} SELECT *, CAST(42 AS BIGINT) AS run_id FROM ({records(field_object(ORDER_FIELDS))})"
    c["ledger_runs"] = f"WITH {current} SELECT * FROM runs"
    c["ledger_active"] = f"WITH {current} SELECT * FROM newest"
    c["ledger_list"] = f"""WITH {current} SELECT *, TRUE AS active FROM newest
      WHERE domain_id = 'click' ORDER BY run_id DESC"""
    c["ledger_list_parts"] = f"WITH {current} SELECT * FROM runs WHERE domain_run_id = 12 OR run_id = 12 ORDER BY run_id DESC"
    six = ", ".join(
        f"CAST(sum({n}) AS BIGINT) AS {n}"
        for n in ("source_count", "target_count", "matched_count", "mismatched_count", "source_only_count", "target_only_count")
    )
    c["domain_rollup"] = f"""WITH {current}
      SELECT domain_run_id, count(*) AS profiles, {six},
             CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM runs GROUP BY 1"""
    of_run = f"FROM ({sql(S.SUPPLIER_RECORDS)}) WHERE run_id = 7 AND status = 'TARGET_ONLY'"
    c["records_page"] = f"SELECT migration_key, status, field_diffs {of_run} ORDER BY migration_key LIMIT 100 OFFSET 20"
    c["records_page_after"] = f"SELECT migration_key, status, field_diffs {of_run} ORDER BY migration_key LIMIT 100 OFFSET 3"
    c["records_total"] = f"SELECT count(*) AS total {of_run}"
    c["run_digest"] = f"""
      WITH runs AS ({sql(S.SUPPLIER_RUNS)}), records AS ({sql(S.SUPPLIER_RECORDS)}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY migration_key) AS rn FROM records
                 WHERE status <> 'MATCHED'),
      shown AS (SELECT run_id, count(*) AS n, string_agg('- key=' || migration_key || ' status=' || status
                || CASE WHEN field_diffs IS NULL THEN '' ELSE ' fieldDiffs=' || field_diffs END || chr(10), ''
                ORDER BY rn) AS lines FROM ranked WHERE rn <= 50 GROUP BY 1),
      totals AS (SELECT run_id, count(*) AS rows FROM records GROUP BY 1)
      SELECT run_id, 'Outcome of one profile run, to be summarized.' || chr(10) || 'domain=' || domain_id || ' profile=' || profile_id
        || ' runId=' || run_id || ' status=' || status || ' mode=' || recon_mode || ' active='
        || CASE WHEN active THEN 'true' ELSE 'false' END || chr(10) || 'sourceCount=' || source_count || ' targetCount='
        || target_count || ' matched=' || matched_count || ' mismatched=' || mismatched_count || ' sourceOnly='
        || source_only_count || ' targetOnly=' || target_only_count || chr(10)
        || CASE WHEN error_message IS NULL THEN '' ELSE 'error=' || error_message || chr(10) END
        || 'detailRows=' || coalesce(rows, 0) || ' sampledNonMatches=' || coalesce(n, 0) || chr(10) || coalesce(lines, '')
        AS digest
      FROM runs LEFT JOIN totals USING (run_id) LEFT JOIN shown USING (run_id)"""
    c["domain_digest"] = f"""
      WITH runs AS ({sql(S.SUPPLIER_RUNS)}),
      parts AS (SELECT domain_run_id, string_agg('profile=' || profile_id || ' runId=' || run_id || ' status=' || status
          || ' matched=' || matched_count || ' mismatched=' || mismatched_count || ' sourceOnly=' || source_only_count
          || ' targetOnly=' || target_only_count, chr(10) ORDER BY run_id) AS lines FROM runs GROUP BY 1)
      SELECT CAST(n_nationkey AS BIGINT) AS run_id, 'Outcome of a domain run and its profiles, to be summarized.' || chr(10) || 'domain='
          || n_name || ' domainRunId=' || n_nationkey || ' status=COMPLETED matched=' || n_regionkey
          || ' mismatched=0 sourceOnly=0 targetOnly=0' || chr(10) || coalesce(lines, '') AS digest
      FROM nation LEFT JOIN parts ON n_nationkey = domain_run_id"""
    tagged = "CASE WHEN {0} IS NULL THEN '<NULL>' ELSE '{1}:' || {0} END"
    typed = lambda size: {
        "p_name": tagged.format("p_name", "java.lang.String"),
        "p_brand": tagged.format("p_brand", "java.lang.String"),
        "p_size": tagged.format("p_size", size),
        "p_retailprice": tagged.format("p_retailprice", "java.math.BigDecimal"),
    }
    parts = compared(S.PART_SOURCE, S.PART_TARGET, typed("java.lang.Integer"), typed("java.math.BigDecimal"), "p")
    orders = compared(S.ORDERS_SOURCE, S.ORDERS_TARGET, ORDER_TEXTS, p="o")
    lines = compared(S.LINEITEM_SOURCE, S.LINEITEM_TARGET, LINE_TEXTS, p="l")
    one = lambda name, p: f"SELECT 'shop' AS domain_id, '{name}' AS profile_id, 'COMPLETED' AS status, 'FULL' AS run_scope, {counts(p)}"
    zeros = ", ".join(["CAST(0 AS BIGINT)"] * 6)
    c["recon_domain"] = f"""WITH {orders}, {lines}, {parts}
      {one('orders', 'o')} UNION ALL {one('lines', 'l')} UNION ALL {one('parts', 'p')}
      UNION ALL SELECT 'shop', 'suppliers', 'FAILED', 'FULL', {zeros}
      UNION ALL SELECT 'shop', NULL, 'FAILED', 'FULL', {zeros}"""

    c["recon_domain_files"] = """
      WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s,
                        (SELECT count(*) FROM supplier WHERE s_suppkey % 7 <> 0) AS k)
      SELECT 'files' AS domain_id, profile_id, 'COMPLETED' AS status, CAST(source_count AS BIGINT) AS source_count,
             CAST(target_count AS BIGINT) AS target_count, CAST(matched_count AS BIGINT) AS matched_count,
             CAST(0 AS BIGINT) AS mismatched_count, CAST(source_only_count AS BIGINT) AS source_only_count, CAST(0 AS BIGINT) AS target_only_count
      FROM (SELECT 'customers' AS profile_id, c AS source_count, c AS target_count, c AS matched_count, 0 AS source_only_count FROM n
            UNION ALL SELECT 'suppliers', s, k, k, s - k FROM n UNION ALL SELECT NULL, c + s, c + k, c + k, s - k FROM n)"""


def _versioned() -> None:
    c = CHECKS
    history = f"""
      h AS ({sql(S.CUSTOMER_HISTORY)}), ch AS ({sql(S.ORDER_CHANGES)}),
      firsts AS (SELECT customer_id, min(changed_at) AS f FROM ch GROUP BY 1),
      kept AS (SELECT h.customer_id, config, version, active AND f IS NULL AS active, created_at, created_by,
                 CASE WHEN active AND f IS NOT NULL THEN f ELSE updated_at END AS updated_at,
                 CASE WHEN active AND f IS NOT NULL THEN 'sync' ELSE updated_by END AS updated_by
               FROM h LEFT JOIN firsts USING (customer_id)),
      numbered AS (SELECT *, row_number() OVER w AS n, lead(changed_at) OVER w AS nx FROM ch
                   WINDOW w AS (PARTITION BY customer_id ORDER BY changed_at, change_no)),
      added AS (SELECT c.customer_id, c.config, CAST(coalesce(l.version, 0) + n AS INTEGER) AS version, nx IS NULL AS active,
                  coalesce(l.created_at, f) AS created_at, coalesce(l.created_by, 'sync') AS created_by,
                  coalesce(nx, changed_at) AS updated_at, 'sync' AS updated_by
                FROM numbered c JOIN firsts USING (customer_id)
                LEFT JOIN (SELECT * FROM h WHERE active) l ON c.customer_id = l.customer_id),
      total AS (SELECT * FROM kept UNION ALL SELECT * FROM added)"""
    c["scd2_upsert"] = f"WITH {history} SELECT * FROM total"
    c["scd2_merge_files"] = c["scd2_upsert"]
    c["scd2_active"] = f"WITH {history} SELECT * FROM total WHERE active ORDER BY customer_id"
    closed = """SELECT r.n_nationkey, config, version, active AND NOT gone AS active, created_at, created_by,
        CASE WHEN active AND gone THEN TIMESTAMP '2002-01-01' ELSE updated_at END AS updated_at,
        CASE WHEN active AND gone THEN 'admin' ELSE updated_by END AS updated_by
      FROM ({}) r JOIN (SELECT n_nationkey, n_regionkey = 2 AS gone FROM nation) d ON r.n_nationkey = d.n_nationkey"""
    c["scd2_delete_cascade"] = closed.format(sql(S.NATION_HISTORY)) + " UNION ALL " + closed.format(sql(S.NATION_CUSTOMERS))
    filled = f"""SELECT user_id, event_id,
        last_value(mode IGNORE NULLS) OVER w AS mode, last_value(batch IGNORE NULLS) OVER w AS batch
      FROM ({sql(S.USER_PATCHES)})
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    c["scd2_patch_merge"] = filled
    c["scd2_latest_patch"] = f"""
      SELECT * FROM ({filled}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
    c["tags_filter"] = """
      WITH cleaned AS (SELECT p_partkey, list_concat([lower(p_type)], string_split(lower(p_name), ' ')) AS l FROM part)
      SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags
      FROM cleaned WHERE list_contains(l, 'red')"""
    c["config_inherit"] = f"""
      SELECT p.profile_no, p.domain_id, coalesce(p.strategy, d.strategy, 'TypeLenient') AS strategy,
             coalesce(p.batch_size, d.batch_size, 1000) AS batch_size,
             coalesce(nullif(trim(p.datasource), ''), d.datasource) AS datasource
      FROM ({sql(S.PROFILE_SETTINGS)}) p LEFT JOIN ({sql(S.DOMAIN_SETTINGS)}) d ON p.domain_id = d.domain_id"""


for _build in (_extracts, _keys_and_texts, _comparisons, _ledger, _versioned):
    _build()
