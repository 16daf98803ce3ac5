"""Reader options for relational, warehouse and document stores.

The drivers are not part of this package; these functions only describe the read, so that the
store does the filtering and projection and Spark reads in parallel.
"""

from __future__ import annotations

import json
import re
from typing import Any

from ..errors import ConfigurationError
from ..plans.spec import Datasource, SideSpec, SourceKind, blank
from ..plans.window import Window
from .binding import bind_filter, inline_sql
from .documents import filter_paths

# Relational stores ignore the zone in a plain timestamp literal; the warehouse's plain literal has one.
_ZONED = {SourceKind.postgres: "TIMESTAMP WITH TIME ZONE"}
_PARALLEL = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def jdbc_url(source: Datasource) -> str:
    """JDBC URL of a relational datasource, also from a reactive-driver URL or host and port."""
    given = source.options.get("url") or source.options.get("uri")
    if not blank(given):
        url = re.sub(r"^r2dbc:", "jdbc:", given.strip())
        url = re.sub(r"^postgres(ql)?://", "jdbc:postgresql://", url)
        url = re.sub(r"^jdbc:postgres://", "jdbc:postgresql://", url)
        return re.sub(r"([?&])schema=", r"\1currentSchema=", url)
    host, port = source.options.get("host", "localhost"), source.options.get("port", 5432)
    return f"jdbc:postgresql://{host}:{port}/{source.options.get('database', 'data')}"


def by_quantiles(source: Datasource) -> bool:
    return [k for k in _PARALLEL if source.options.get(k) is not None] == ["partitionColumn", "numPartitions"]


def jdbc_options(source: Datasource, statement: str, fetch_size: int | None = None) -> dict[str, str]:
    """Options of ``format("jdbc")``.

    With ``partitionColumn`` and its bounds on the datasource the read is split into parallel range
    queries; large tables need that, or everything passes through one connection. With ``partitionColumn`` and
    ``numPartitions`` alone the store is asked for quantiles (see ``bounds``), and the read goes by predicates.
    """
    opts: dict[str, Any] = {"url": jdbc_url(source), "driver": source.options.get("driver", "org.postgresql.Driver")}
    for name, option in (("username", "user"), ("password", "password")):
        if not blank(source.options.get(name)):
            opts[option] = source.options[name]
    opts["fetchsize"] = fetch_size or 10_000
    given = [k for k in _PARALLEL if source.options.get(k) is not None]
    if given and not by_quantiles(source):
        if len(given) != len(_PARALLEL):
            raise ConfigurationError(f"Parallel reads need all of {', '.join(_PARALLEL)}, or the first and the last")
        opts.update({k: source.options[k] for k in _PARALLEL})
        opts["dbtable"] = f"({statement}) side"
    else:
        opts["query"] = statement
    return {k: str(v) for k, v in opts.items()}


def warehouse_url(source: Datasource) -> str:
    given = source.options.get("jdbc_url")
    if not blank(given):
        return given
    project = source.options.get("project_id")
    if blank(project):
        raise ConfigurationError(f"Give datasource [{source.name}] a project_id or a jdbc_url")
    # Host, port and authentication codes of the warehouse's JDBC URL.
    parts = ["jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443", f"ProjectId={project}"]
    key_file = source.options.get("credentials_file")
    if blank(key_file):
        parts.append(f"OAuthType={source.options.get('oauth_type', 3)}")
    else:
        parts += ["OAuthType=0", f"OAuthPvtKeyPath={key_file}"]
    return ";".join(parts)


def warehouse_options(source: Datasource, statement: str) -> tuple[str, dict[str, str]]:
    """(format, options): the native connector by default, JDBC when a driver class is configured."""
    driver = source.options.get("driver")
    if driver:
        return "jdbc", {"url": warehouse_url(source), "driver": driver, "query": statement}
    opts = {"query": statement, "viewsEnabled": "true"}
    if not blank(source.options.get("project_id")):
        opts["parentProject"] = source.options["project_id"]
    if not blank(source.schema):
        opts["materializationDataset"] = source.schema
    if not blank(source.options.get("credentials_file")):
        opts["credentialsFile"] = source.options["credentials_file"]
    return "bigquery", opts


def document_options(source: Datasource, side: SideSpec, filter_text: str | None, window: Window | None) -> dict[str, str]:
    """Options of ``format("mongodb")``: filter and projection run in the store as a pipeline."""
    if blank(source.options.get("uri")):
        raise ConfigurationError(f"Give datasource [{source.name}] the uri of its store")
    if blank(side.collection):
        raise ConfigurationError("A document side names its collection")
    if side.key is None:
        raise ConfigurationError("Document sides need a key")
    bound = bind_filter(filter_text, side.query_params, window)
    paths = [*(side.key.columns or (side.key.expression,)), *side.comparable_fields, *filter_paths(bound)]
    projection = {path: 1 for path in dict.fromkeys(paths)}
    pipeline = ([{"$match": bound}] if bound else []) + [{"$project": projection}]
    return {
        "connection.uri": source.options["uri"],
        "database": source.options.get("database", "data"),
        "collection": side.collection,
        "aggregation.pipeline": json.dumps(pipeline, default=str),
    }


def pushed_statement(side: SideSpec, kind: SourceKind, statement: str | None, window: Window | None) -> str:
    """SQL text for a store: the side's own query with escaped literals, else the generated SELECT."""
    if statement is None:
        return side.generated_sql(kind)
    return inline_sql(statement, side.query_params, window, _ZONED.get(kind, "TIMESTAMP"))
