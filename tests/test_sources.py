import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

import crosstally as ct
from crosstally import Catalog, ConfigurationError, Datasource, Domain, KeySpec, Profile, SideSpec, Window
from crosstally.plans.spec import SourceKind
from crosstally.sources import FileTable, bind_filter, bind_sql, column_names, extract, inline_sql, matching_files, read_file_table
from crosstally.sources import connectors, stored_statement
from crosstally.sources.binding import filter_needs_window, needs_window
from crosstally.sources.documents import extract_documents, inferred_schema, parsed_documents
from workloads.workbooks import workbook

SINCE = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
UNTIL = datetime(2024, 2, 2, tzinfo=timezone.utc)
WINDOW = Window(SINCE, UNTIL)


# -- binding ------------------------------------------------------------------------------------


def test_markers_in_quotes_are_left_alone():
    sql, args = bind_sql("""SELECT '?', ':since', "a?b" FROM t WHERE x = ? AND y > :SINCE AND z < ? AND :since_x""", (1, 2), WINDOW)
    assert sql == """SELECT '?', ':since', `a?b` FROM t WHERE x = :p1 AND y > :since AND z < :p2 AND :since_x"""
    assert args == {"p1": 1, "p2": 2, "since": SINCE}


def test_marker_counts_are_checked():
    for bad in ((), (1, 2)):
        with pytest.raises(ConfigurationError, match="1 \\? placeholder"):
            bind_sql("SELECT ?", bad)
        with pytest.raises(ConfigurationError):
            bind_filter('{"a": "?"}', bad)


def test_window_tokens_are_found_outside_quotes():
    assert needs_window("a > :since") and not needs_window("a > ':since'") and not needs_window("a > :sincere")
    assert filter_needs_window('{"a": ":until"}') and filter_needs_window('{"a": :since}') and not filter_needs_window('{"a": "x"}')


def test_bound_statement_runs(spark):
    side = SideSpec(
        query="""SELECT id AS "MigrationKey", '?' AS mark FROM range(10) WHERE id > ? AND :until > :since AND id < ?""",
        query_params=(3, 6),
    )
    assert [tuple(r) for r in extract(spark, side, window=WINDOW).orderBy("migration_key").collect()] == [("4", "?"), ("5", "?")]


def test_literals_for_pushed_down_text():
    text = inline_sql("x = ? AND y = ? AND t > :since AND s = '?'", ("O'Neil", None), WINDOW)
    assert text == "x = 'O''Neil' AND y = NULL AND t > TIMESTAMP '2024-01-02 03:04:05.000000+00:00' AND s = '?'"
    with pytest.raises(ConfigurationError):
        inline_sql("x = ?", ("back\\slash",))


def test_filter_binding_in_text_order():
    bound = bind_filter('{"a": "?", "t": {"$gt": ":since", "$lte": :until}, "b": {"$in": [?, "x?"]}}', ("v", 2), WINDOW)
    assert bound == {
        "a": "v",
        "t": {"$gt": "2024-01-02T03:04:05Z", "$lte": "2024-02-02T00:00:00Z"},
        "b": {"$in": [2, "x?"]},
    }
    assert bind_filter(None) == {} and bind_filter("  ") == {}
    with pytest.raises(ConfigurationError, match="JSON filter"):
        bind_filter("{broken")


def test_windows():
    assert Window(None, UNTIL).since == ct.plans.EPOCH
    assert Window(UNTIL, SINCE).until == UNTIL
    run = {"run_id": 5, "status": "COMPLETED", "window_until": SINCE, "completed_at": UNTIL, "started_at": SINCE}
    assert ct.plans.resolve_window(run, UNTIL) == Window(SINCE, UNTIL)
    assert ct.plans.resolve_scope(run) == (ct.plans.RunScope.INCREMENTAL, 5)
    assert ct.plans.resolve_scope(run, force_full=True) == (ct.plans.RunScope.FULL, None)
    assert ct.plans.resolve_scope({**run, "status": "FAILED"})[0] is ct.plans.RunScope.FULL


# -- tables and statements ----------------------------------------------------------------------


def test_generated_select():
    side = SideSpec(schema="landing", table="party", key=KeySpec.single("party_id"), identifiers=("cc",), fields=("name", " ", "cc"))
    assert side.generated_sql(SourceKind.postgres) == 'SELECT party_id AS "MigrationKey", cc, name FROM landing.party'
    composite = side.patched(key=KeySpec.composite(["a", "b"], "'"), distinct=True)
    assert composite.generated_sql(SourceKind.postgres).startswith(
        """SELECT DISTINCT CAST(a AS TEXT) || '''' || CAST(b AS TEXT) AS "MigrationKey\""""
    )
    assert "CONCAT(CAST(a AS STRING), '|', CAST(b AS STRING)) AS MigrationKey" in side.patched(
        key=KeySpec.composite(["a", "b"])
    ).generated_sql(SourceKind.bigquery)
    with pytest.raises(ConfigurationError, match="key"):
        SideSpec(table="t", fields=("a",)).generated_sql(SourceKind.postgres)
    with pytest.raises(ConfigurationError, match="fields"):
        SideSpec(table="t", key="a").generated_sql(SourceKind.postgres)
    with pytest.raises(ConfigurationError, match="identifier"):
        SideSpec(table="t; drop", key="a", fields=("b",)).generated_sql(SourceKind.postgres)


def test_query_files(tmp_path, spark):
    (tmp_path / "d.p-source.sql").write_text("SELECT 1 AS MigrationKey, 2 AS a")
    side = SideSpec()
    df = extract(spark, side, dataset_id="d.p", role="SOURCE", query_dir=tmp_path)
    assert tuple(df.first()) == ("1", 2)
    assert stored_statement(side, SourceKind.table, "d.p", "source", tmp_path) == "SELECT 1 AS MigrationKey, 2 AS a"
    assert stored_statement(SideSpec(collection="c"), SourceKind.mongo, "d.p", "target", tmp_path) == "{}"
    with pytest.raises(ConfigurationError, match="query file"):
        extract(spark, side, dataset_id="d.q", role="source", query_dir=tmp_path)


def test_kind_is_inferred():
    sources = {"docs": Datasource("docs", "mongo"), "pg": Datasource("pg", "postgres")}
    assert SideSpec(datasource="docs").resolved_kind(sources) is SourceKind.mongo
    assert SideSpec(collection="c").resolved_kind() is SourceKind.mongo
    assert SideSpec(table="t").resolved_kind() is SourceKind.table
    assert SideSpec(datasource="pg", kind="file").resolved_kind(sources) is SourceKind.file
    with pytest.raises(ConfigurationError, match="Unknown datasource"):
        SideSpec(datasource="nope", table="t").resolved_kind(sources)


def test_readers_can_be_replaced(spark):
    own = {SourceKind.postgres: lambda spark, side, source, statement, window: spark.sql("SELECT 1 AS MigrationKey, 'x' AS a")}
    side = SideSpec(datasource="pg", table="t", key="k", fields=("a",))
    df = extract(spark, side, {"pg": Datasource("pg", "postgres")}, readers=own)
    assert tuple(df.first()) == ("1", "x")


# -- keys ---------------------------------------------------------------------------------------


def test_key_kinds(spark):
    df = spark.sql("SELECT 'P1' AS a, 'US' AS b, CAST(NULL AS STRING) AS n")
    one = lambda key: df.select(key.column()).first()[0]
    assert one(KeySpec.single("a")) == "P1"
    assert one(KeySpec.composite(["a", "b"])) == "P1|US" and one(KeySpec.composite(["a", "n"])) is None
    assert one(KeySpec.defined("concat(a, '-', b)")) == "P1-US"
    assert KeySpec(("a", "b")).kind.value == "COMPOSITE" and KeySpec(expression="x").kind.value == "DEFINED"
    for bad in (
        lambda: KeySpec.composite(["a"]),
        lambda: KeySpec.single("a b"),
        lambda: KeySpec.defined("a; drop"),
        lambda: KeySpec.defined("a -- b"),
        lambda: KeySpec.defined(" "),
        lambda: KeySpec(()),
    ):
        with pytest.raises(ConfigurationError):
            bad()


# -- documents ----------------------------------------------------------------------------------


@pytest.fixture
def party(spark):
    spark.sql(
        """SELECT * FROM VALUES
           ('1', 'Acme', 10.50BD, named_struct('cc', 'US', 'tags', array('a', 'b')), TIMESTAMP'2024-01-10 00:00:00 UTC', '{"k": 5, "s": "x"}'),
           ('2', 'Beta', 7.00BD, named_struct('cc', 'IN', 'tags', array()), TIMESTAMP'2023-01-10 00:00:00 UTC', '{"k": 50}'),
           ('3', NULL, NULL, NULL, NULL, NULL) AS t(id, name, amount, address, changed, extra)"""
    ).createOrReplaceTempView("party")
    return SideSpec(collection="party", key=KeySpec.single("id"), fields=("name", "amount", "address.cc", "address.tags", "extra.k"))


def ids(spark, side, **changes):
    return [r.migration_key for r in extract(spark, side.patched(**changes), window=WINDOW).orderBy("migration_key").collect()]


def test_document_paths(spark, party):
    rows = [tuple(r) for r in extract(spark, party).orderBy("migration_key").collect()]
    assert rows[0][1:] == ("Acme", rows[0][2], "US", "[a, b]", "5") and str(rows[0][2]) == "10.50"
    assert rows[1][4] == "[]" and rows[2][1:] == (None,) * 5
    lost = extract(spark, party.patched(fields=("nope.x", "name.deeper", "amount.y")))
    assert {tuple(r)[1:] for r in lost.collect()} == {(None, None, None)}
    assert ct.reconcile_details(extract(spark, party), extract(spark, party), mode="FIELD_DETAILS").count() == 0


@pytest.mark.parametrize(
    "text,expected",
    [
        ("{}", "123"),
        ('{"name": "Acme"}', "1"),
        ('{"name": null}', "3"),
        ('{"name": {"$ne": "Acme"}}', "23"),
        ('{"amount": {"$gt": 7, "$lte": 10.5}}', "1"),
        ('{"address.cc": {"$in": ["US", "XX"]}}', "1"),
        ('{"address.cc": {"$nin": ["US"]}}', "23"),
        ('{"address": {"$exists": false}}', "3"),
        ('{"address.tags": "b"}', "1"),
        ('{"extra.k": {"$gte": 50}}', "2"),
        ('{"extra.k": 5}', "1"),
        ('{"changed": {"$gt": ":since"}}', "1"),
        ('{"changed": {"$lt": {"$date": "2024-01-01T00:00:00Z"}}}', "2"),
        ('{"$or": [{"name": "Beta"}, {"id": "3"}]}', "23"),
        ('{"$and": [{"name": "Beta"}, {"id": "3"}]}', ""),
        ('{"$nor": [{"name": "Beta"}, {"id": "3"}]}', "1"),
        ('{"id": {"$eq": {"$oid": "2"}}}', "2"),
    ],
)
def test_document_filters(spark, party, text, expected):
    assert "".join(ids(spark, party, query=text)) == expected


def test_document_side_errors(spark, party):
    for side, message in (
        (SideSpec(collection="party", key="id"), "fields"),
        (SideSpec(collection="party", fields=("name",)), "key"),
        (party.patched(key=KeySpec.defined("upper(id)")), "field path"),
        (party.patched(query='{"a": {"$where": "x"}}'), "Unsupported"),
    ):
        with pytest.raises(ConfigurationError, match=message):
            extract(spark, side)


def test_json_documents_from_files(spark, tmp_path):
    (tmp_path / "party.json").write_text('{"id": 1, "a": {"b": "x"}}\n{"id": 2}\n')
    source = Datasource("docs", "mongo", options={"path": str(tmp_path), "document_schema": "id INT, a STRUCT<b: STRING>"})
    side = SideSpec(datasource="docs", collection="party.json", key="id", fields=("a.b",))
    assert sorted(tuple(r) for r in extract(spark, side, {"docs": source}).collect()) == [("1", "x"), ("2", None)]


# -- files --------------------------------------------------------------------------------------

HEADER = "party_id,party_name,country_code,status\n"


def test_csv_files_make_one_table(spark, tmp_path):
    (tmp_path / "party_20240101.csv").write_text("﻿" + HEADER + 'P1,"Acme, ""Inc""",US,ACTIVE,extra\n\n', encoding="utf-8")
    (tmp_path / "party_20240102.csv").write_text(HEADER + "P2, \t\u2003,IN\n", encoding="utf-8")
    (tmp_path / "other.csv").write_text("party_id\nX\n")
    table = FileTable("csv", str(tmp_path), r"party_\d+[.]csv")
    assert [p.rsplit("/", 1)[1] for p in matching_files(spark, table)] == ["party_20240101.csv", "party_20240102.csv"]
    rows = sorted(tuple(r) for r in read_file_table(spark, table).collect())
    assert rows == [("P1", 'Acme, "Inc"', "US", "ACTIVE"), ("P2", None, "IN", None)]
    assert spark.table("party").count() == 3  # a view of that name stays what it is


def test_csv_without_header_and_other_delimiter(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1;a\n2;b\n")
    df = read_file_table(spark, FileTable("x", str(tmp_path / "x.csv"), delimiter=";", header=False, table="plain"))
    assert df.columns == ["COL1", "COL2"] and df.count() == 2


def test_nested_folders_match_by_relative_path(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p.csv").write_text("k\n1\n")
    (tmp_path / "p.csv").write_text("k\n1\n")
    assert len(matching_files(spark, FileTable("n", str(tmp_path), "a/p[.]csv"))) == 1


def test_file_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n1\n")
    for table, message in (
        (FileTable("f", str(tmp_path), "("), "can't be compiled"),
        (FileTable("f", str(tmp_path), "zzz[.]csv"), "fits pattern"),
        (FileTable("f", str(tmp_path / "nope")), "does not exist"),
        (FileTable("f", ""), "No folder or file"),
        (FileTable("f", str(tmp_path), format="pdf"), "can't be read"),
    ):
        with pytest.raises(ConfigurationError, match=message):
            matching_files(spark, table)


def test_column_names():
    assert column_names([" id ", "", "2nd", "a-b"]) == ["id", "COL2", "C_2nd", "a_b"]
    assert column_names(["x", "y"], header=False) == ["COL1", "COL2"]
    with pytest.raises(ConfigurationError):
        column_names(["a", "a"])


def test_formats_and_names():
    assert FileTable("f", "p", r"x.*[.]xlsx").resolved_format == "xlsx" and FileTable("f", "p", format="Excel").resolved_format == "xlsx"
    assert FileTable("f", "p", r"party_\d+[.]csv").view_name([]) == "party"
    assert FileTable("f", "p").view_name(["/x/my-file.csv"]) == "my_file"


@pytest.mark.parametrize("shared", [True, False])
def test_workbooks_make_one_table(spark, tmp_path, shared):
    head = ["party_id", "party_name", "country_code", "amount", "flag"]
    (tmp_path / "a.xlsx").write_bytes(workbook([head, ["P1", "Acme <&>", "US", 10.0, True], [None, " "]], "party", shared))
    (tmp_path / "b.xlsx").write_bytes(workbook([head, ["P2", None, "IN", 2.5, False]], "party", shared))
    source = Datasource("books", "file", options={"path": str(tmp_path), "pattern": ".*[.]xlsx", "sheet": "party", "table": "books"})
    side = SideSpec(datasource="books", table="books", key="party_id", fields=tuple(head[1:]))
    rows = sorted(tuple(r) for r in extract(spark, side, {"books": source}).collect())
    assert rows == [("P1", "Acme <&>", "US", "10", "TRUE"), ("P2", None, "IN", "2.5", "FALSE")]
    with pytest.raises(Exception, match="no sheet named"):
        read_file_table(spark, FileTable("b", str(tmp_path), ".*[.]xlsx", sheet="nope", table="b")).count()


# -- pairs and connectors -----------------------------------------------------------------------


def test_every_kind_of_source_pairs_with_every_other(spark, tmp_path):
    row = ("P1", "Acme", "US", "ACTIVE")
    names = HEADER.strip().split(",")
    stored = spark.createDataFrame([row], names)
    stored.createOrReplaceTempView("party_t")
    (tmp_path / "party_f.csv").write_text(HEADER + ",".join(row) + "\n")
    sources = {
        "pg": Datasource("pg", "postgres"),
        "bq": Datasource("bq", "bigquery"),
        "csv": Datasource("csv", "file", options={"path": str(tmp_path), "table": "party_f"}),
    }
    fields = tuple(names[1:])
    stub = lambda spark, side, source, statement, window: stored.withColumnRenamed("party_id", "MigrationKey")
    readers = {SourceKind.postgres: stub, SourceKind.bigquery: stub}
    kinds = [
        SideSpec(datasource="pg", table="party_t", key="party_id", fields=fields),
        SideSpec(datasource="bq", table="party_t", key="party_id", fields=fields),
        SideSpec(datasource="csv", table="party_f", key="party_id", fields=fields),
        SideSpec(collection="party_t", key="party_id", fields=fields),
    ]
    sides = [extract(spark, side, sources if side.datasource else None, readers=readers) for side in kinds]
    for source in sides:
        for target in sides:
            got = ct.reconcile_counts(source, target).first()
            assert (got.matched_count, got.source_count, got.target_count) == (1, 1, 1)


def test_relational_options():
    source = Datasource("pg", "postgres", options={"uri": "r2dbc:postgresql://h:5432/data?schema=landing", "username": "u", "password": "p"})
    assert source.schema == "landing"
    options = connectors.jdbc_options(source, "SELECT 1")
    assert options["url"] == "jdbc:postgresql://h:5432/data?currentSchema=landing"
    assert options["query"] == "SELECT 1" and options["user"] == "u"
    split = Datasource("pg", "postgres", options={"partitionColumn": "id", "lowerBound": 1, "upperBound": 9, "numPartitions": 4})
    options = connectors.jdbc_options(split, "SELECT 1")
    assert options["dbtable"] == "(SELECT 1) side" and options["numPartitions"] == "4" and "query" not in options
    with pytest.raises(ConfigurationError, match="Parallel"):
        connectors.jdbc_options(Datasource("pg", "postgres", options={"numPartitions": 4}), "SELECT 1")


def test_warehouse_and_document_options():
    warehouse = Datasource("bq", "bigquery", options={"project_id": "p", "dataset": "master"})
    assert connectors.warehouse_options(warehouse, "SELECT 1") == (
        "bigquery",
        {"query": "SELECT 1", "viewsEnabled": "true", "parentProject": "p", "materializationDataset": "master"},
    )
    driven = Datasource("bq", "bigquery", options={"project_id": "p", "driver": "x.Driver", "credentials_file": "/k.json"})
    form, options = connectors.warehouse_options(driven, "SELECT 1")
    assert form == "jdbc" and options["url"].endswith(";ProjectId=p;OAuthType=0;OAuthPvtKeyPath=/k.json")
    with pytest.raises(ConfigurationError):
        connectors.warehouse_url(Datasource("bq", "bigquery"))
    documents = Datasource("m", "mongo", options={"uri": "mongodb://h", "database": "d"})
    side = SideSpec(collection="party", key=KeySpec.composite(["id", "cc"]), fields=("name", "cc"), query_params=("A",))
    options = connectors.document_options(documents, side, '{"status": "?"}', None)
    assert options["aggregation.pipeline"] == '[{"$match": {"status": "A"}}, {"$project": {"id": 1, "cc": 1, "name": 1, "status": 1}}]'
    with pytest.raises(ConfigurationError, match="uri"):
        connectors.document_options(Datasource("m", "mongo"), side, "{}", None)


def test_store_filter_is_not_applied_again(spark):
    """A store that has filtered gives key, fields and filter paths; a filter path need not be a compared field."""
    source = Datasource("m", "mongo", options={"uri": "mongodb://h", "document_schema": "id INT, name STRING, ts STRING"})
    side = SideSpec(datasource="m", collection="party", key="id", fields=("name",), query='{"ts": {"$gt": ":since"}, "$or": [{"k.z": 1}]}')
    window = Window(datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 2, 1, tzinfo=timezone.utc))
    pipeline = json.loads(connectors.document_options(source, side, side.query, window)["aggregation.pipeline"])
    assert pipeline[0]["$match"]["ts"] == {"$gt": "2024-01-01T00:00:00Z"} and set(pipeline[1]["$project"]) == {"id", "name", "ts", "k.z"}
    projected = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, name STRING")
    assert extract_documents(projected, side, filtered=True).count() == 2
    with pytest.raises(ConfigurationError, match="document_schema"):
        extract(spark, side, {"m": Datasource("m", "mongo", options={"uri": "mongodb://h"})}, window)


@pytest.mark.parametrize("text, expected", [
    ('{"tags": {"$size": 2}}', "1"), ('{"tags": {"$all": ["a", "b"]}}', "1"), ('{"tags": {"$all": ["a"]}}', "13"),
    ('{"name": {"$regex": "^A"}}', "1"), ('{"name": {"$regex": "^a", "$options": "i"}}', "1"), ('{"name": {"$not": "^A"}}', "23"),
    ('{"name": {"$not": {"$eq": "Bo"}}}', "13"), ('{"items": {"$elemMatch": {"n": {"$gte": 2}, "k": "x"}}}', "3"),
    ('{"items": {"$elemMatch": {"$or": [{"n": 1}, {"n": 9}]}}}', "13"), ('{"tags": {"$elemMatch": {"$gt": "a"}}}', "12"),
    ('{"raw.list": {"$size": 3}}', "2"), ('{"raw.list": {"$all": ["5"]}}', "2"),
])
def test_operators_on_lists_and_patterns(spark, text, expected):
    rows = [(1, "Ann", ["a", "b"], [(1, "x")], None), (2, "Bo", ["c"], [], '{"list": [5, 6, 7]}'), (3, None, ["a"], [(1, "y"), (2, "x")], "{}")]
    schema = "id INT, name STRING, tags ARRAY<STRING>, items ARRAY<STRUCT<n: INT, k: STRING>>, raw STRING"
    side = SideSpec(collection="c", key="id", fields=("id",), query=text)
    got = extract_documents(spark.createDataFrame(rows, schema), side)
    assert "".join(sorted(r.MigrationKey for r in got.collect())) == expected


def test_side_by_side_files_of_one_name(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "party.csv").write_text(f"id,v\n1,{name}\n")
    sources = {n: Datasource(n, "file", options={"path": str(tmp_path / n), "table": "party"}) for n in ("a", "b")}
    side = lambda n: SideSpec(datasource=n, query="WITH w AS (SELECT * FROM party) SELECT id AS MigrationKey, v FROM w WHERE v <> ? -- end",
                              query_params=("?",))
    one = lambda n: extract(spark, side(n), sources).first().v
    with ThreadPoolExecutor(8) as pool:
        names = ["a", "b"] * 20
        assert list(pool.map(one, names)) == names
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ct_")]


def test_window_literals_of_stores():
    since = datetime(2024, 1, 1, tzinfo=timezone.utc)
    window, side = Window(since, since), SideSpec(query="SELECT :since")
    assert connectors.pushed_statement(side, SourceKind.postgres, side.query, window) == (
        "SELECT TIMESTAMP WITH TIME ZONE '2024-01-01 00:00:00.000000+00:00'")
    assert connectors.pushed_statement(side, SourceKind.bigquery, side.query, window) == "SELECT TIMESTAMP '2024-01-01 00:00:00.000000+00:00'"


def test_batch_size_reaches_the_reader():
    catalog = Catalog(domains=[Domain("d", {"p": Profile(SideSpec(query="q"), SideSpec(query="q", batch_size=3))}, batch_size=77)])
    profile = catalog.profile("d", "p")
    assert (profile.source.batch_size, profile.target.batch_size) == (77, 3)
    source = Datasource("p", "postgres", options={"url": "jdbc:postgresql://h/d"})
    assert connectors.jdbc_options(source, "SELECT 1", profile.source.batch_size)["fetchsize"] == "77"


# -- schemas of documents -----------------------------------------------------------------------


def test_a_schema_has_every_path_of_every_document(spark):
    texts = ['{"k":1,"a b":{"x":[1,"q"]},"n":null,"d":1.50}', '{"k":"t","o":{"OBJECT<":1}}', "broken {", "{broken", None, "[1]", "", "7",
             ' {"k":2,"d":2.25e3,"l":[{"y":1},{"z":true}],"big":123456789012345678901234567890}', '{"l":[],"k.dot":1,"q`t":2,"v":"VARIANT"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(5)
    assert inferred_schema(rows, "t") == (
        "STRUCT<`a b`: STRUCT<x: ARRAY<STRING>>, big: DECIMAL(30,0), d: DOUBLE, k: STRING, `k.dot`: BIGINT, "
        "l: ARRAY<STRUCT<y: BIGINT, z: BOOLEAN>>, n: STRING, o: STRUCT<`OBJECT<`: BIGINT>, `q``t`: BIGINT, v: STRING>")
    parsed = {r.id: r for r in parsed_documents(rows, "t").collect()}
    assert len(parsed) == len(texts)
    assert (parsed[0].k, parsed[0].d, parsed[0]["a b"].x, parsed[1].k) == ("1", 1.5, ["1", "q"], "t")
    assert parsed[8].big == 123456789012345678901234567890 and parsed[8].l[1].z is True
    assert all(v is None for i in (2, 3, 4, 5, 6, 7) for v in parsed[i].asDict().values() if v != i)
    assert parsed_documents(rows.filter("id IN (4, 5)"), "t").columns == ["id"]
    assert parsed_documents(rows.filter("id = 1"), "t", "k STRING").first().asDict() == {"id": 1, "k": "t"}
    with pytest.raises(ConfigurationError, match="named as fields"):
        parsed_documents(rows.withColumn("K", F.lit(1)), "t")


def test_the_schema_is_merged_in_each_task(spark):
    rows = spark.range(100).selectExpr("concat('{\"f', id % 7, '\":', id, '}') AS t")
    merged = rows.agg(F.schema_of_variant_agg(F.try_parse_json("t")))
    assert "partial_schema_of_variant_agg" in merged._jdf.queryExecution().executedPlan().toString()
    assert inferred_schema(rows, "t").count(":") == 7
