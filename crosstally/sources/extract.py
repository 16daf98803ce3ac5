"""One side of a comparison as a DataFrame: key first, then the comparable columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.keys import KEY_ALIAS, keyed
from ..plans.spec import Datasource, SideSpec, SourceKind, blank
from ..plans.window import Window
from . import connectors
from .binding import bind_sql
from .bounds import partition_predicates
from .documents import extract_documents, parsed_documents, read_json_documents
from .files import FileTable, read_named_table

Reader = Callable[[SparkSession, SideSpec, "Datasource | None", "str | None", "Window | None"], DataFrame]


def statement_of(
    side: SideSpec,
    kind: SourceKind,
    dataset_id: str | None = None,
    role: str | None = None,
    query_dir: str | Path = "queries",
) -> str | None:
    """Query text of a side; None when its table columns say it all.

    Order: inline query, then table columns, then the query file, by default
    ``<dataset>-<role>.sql`` (``.json`` for documents, and no file means no filter).
    """
    if not blank(side.query):
        return side.query.strip()
    documents = kind is SourceKind.mongo
    if not documents and not blank(side.table):
        return None
    path = None if side.query_file is None else Path(side.query_file)
    if path is None:
        path = Path(query_dir) / f"{dataset_id}-{(role or '').lower()}{'.json' if documents else '.sql'}"
        if documents and not path.exists():
            return "{}"
    try:
        return path.read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigurationError(f"Unable to read query file {path}") from e


def stored_statement(side: SideSpec, kind: SourceKind, dataset_id=None, role=None, query_dir="queries") -> str | None:
    """Query text to keep with a run: what was given, else the SELECT the table columns stand for."""
    try:
        statement = statement_of(side, kind, dataset_id, role, query_dir)
        return side.generated_sql(kind) if statement is None else statement
    except ConfigurationError:
        return "{}" if kind is SourceKind.mongo else None


def select_side(df: DataFrame, side: SideSpec) -> DataFrame:
    """Key and comparable columns of a frame; only these reach the scan."""
    key, names = side.require_table_columns()
    selected = df.select(key.column().alias(KEY_ALIAS), *[F.col(n) for n in names])
    return selected.distinct() if side.distinct else selected


def run_query(
    spark: SparkSession,
    side: SideSpec,
    statement: str,
    window: Window | None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run a side's SQL. ``tables`` are known to this statement only, whatever else bears their names."""
    sql, args = bind_sql(statement, side.query_params, window)
    if not tables:
        return spark.sql(sql, args=args)
    views = {name: f"ct_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(views[name])
        known = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"WITH {known} SELECT * FROM (\n{sql.rstrip().rstrip(';')}\n)", args=args)
    finally:
        for view in views.values():  # the statement has been resolved
            spark.catalog.dropTempView(view)


def _read_table(spark, side, source, statement, window):
    if statement is not None:
        return run_query(spark, side, statement, window)
    return select_side(spark.table(side.relation), side)


def _read_files(spark, side, source, statement, window):
    if source is None:
        raise ConfigurationError("File sides require a file datasource")
    name, table = read_named_table(spark, FileTable.of(source))
    return run_query(spark, side, statement, window, {name: table}) if statement is not None else select_side(table, side)


def _read_jdbc(spark, side, source, statement, window):
    if source is None:
        raise ConfigurationError("Relational sides require a datasource")
    pushed = connectors.pushed_statement(side, SourceKind.postgres, statement, window)
    read = lambda sql: spark.read.format("jdbc").options(**connectors.jdbc_options(source, sql, side.batch_size)).load()
    if not connectors.by_quantiles(source):
        return read(pushed)
    options = connectors.jdbc_options(source, pushed, side.batch_size)
    parts = partition_predicates(read, pushed, source.options["partitionColumn"], int(source.options["numPartitions"]))
    properties = {k: v for k, v in options.items() if k not in ("url", "query")}
    return spark.read.jdbc(options["url"], f"({pushed}) side", predicates=parts, properties=properties)


def _read_warehouse(spark, side, source, statement, window):
    if source is None:
        raise ConfigurationError("Warehouse sides require a datasource")
    pushed = connectors.pushed_statement(side, SourceKind.bigquery, statement, window)
    reader_format, options = connectors.warehouse_options(source, pushed)
    return spark.read.format(reader_format).options(**options).load()


def _read_documents(spark, side, source, statement, window):
    """Collections: a JSON path of the datasource, a table or view of that name (of documents, or with a column of JSON
    texts), or the store itself."""
    options = source.options if source is not None else {}
    if not blank(options.get("path")):
        documents = read_json_documents(spark, f"{options['path'].rstrip('/')}/{side.collection}", options.get("document_schema"))
    elif not blank(options.get("uri")):
        if options.get("document_schema") is None:
            # The reader would infer a schema from a sample, and a path the sample lacks would read as NULL.
            raise ConfigurationError(f"Datasource [{source.name}] needs document_schema: the types of its key and fields")
        read = connectors.document_options(source, side, statement, window)
        documents = spark.read.format("mongodb").schema(options["document_schema"]).options(**read).load()
        return extract_documents(documents, side, filtered=True)  # the store has filtered
    elif blank(side.collection):
        raise ConfigurationError("Document sides require collection")
    else:
        documents = spark.table(side.collection)
        if not blank(options.get("document_column")):
            documents = parsed_documents(documents, options["document_column"], options.get("document_schema"))
    return extract_documents(documents, side, statement, window)


READERS: dict[SourceKind, Reader] = {
    SourceKind.table: _read_table,
    SourceKind.file: _read_files,
    SourceKind.postgres: _read_jdbc,
    SourceKind.bigquery: _read_warehouse,
    SourceKind.mongo: _read_documents,
}


def extract(
    spark: SparkSession,
    side: SideSpec,
    sources: Mapping[str, Datasource] | None = None,
    window: Window | None = None,
    readers: Mapping[SourceKind, Reader] | None = None,
    dataset_id: str | None = None,
    role: str | None = None,
    query_dir: str | Path = "queries",
    check_key: bool = True,
) -> DataFrame:
    """Read a side. ``readers`` replaces or adds the way a kind of datasource is read.

    ``check_key=False`` leaves the key column as it comes, for callers that split off rows without
    a key (``reject_null_keys``) instead of failing on them.
    """
    kind = side.resolved_kind(sources)
    source = (sources or {}).get(side.datasource) if side.datasource else None
    statement = statement_of(side, kind, dataset_id, role, query_dir)
    read = {**READERS, **(readers or {})}[kind]
    df = read(spark, side, source, statement, window)
    return keyed(df) if check_key else df
