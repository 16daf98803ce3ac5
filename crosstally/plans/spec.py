"""Declarations of what to compare: keys, sides, profiles, domains and datasources."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.normalize import Strategy
from .settings import CompareSettings

# Fixed value: text between the parts of a composite key.
DEFAULT_SEPARATOR = "|"

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_FIELD_PATH = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


def blank(text: str | None) -> bool:
    return text is None or not str(text).strip()


def simple_identifier(what: str, value: str | None) -> str:
    if value is None or not _IDENTIFIER.fullmatch(value):
        raise ConfigurationError(f"{what} must be a simple SQL identifier, got: {value}")
    return value


def valid_name(what: str, value: str | None) -> str:
    if value is None or not _NAME.fullmatch(value):
        raise ConfigurationError(f"{what} [{value}] must match {_NAME.pattern}")
    return value


def normalized_tags(tags: Sequence[str] | None) -> tuple[str, ...]:
    cleaned = (str(t).strip().lower() for t in tags or () if t is not None)
    return tuple(dict.fromkeys(t for t in cleaned if t))


class KeyKind(str, Enum):
    SINGLE = "SINGLE"
    COMPOSITE = "COMPOSITE"
    DEFINED = "DEFINED"


@dataclass(frozen=True)
class KeySpec:
    """How a side forms its business key: one column, several joined, or an expression."""

    columns: tuple[str, ...] = ()
    expression: str | None = None
    separator: str = DEFAULT_SEPARATOR
    kind: KeyKind | None = None

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        put("columns", tuple(self.columns or ()))
        put("separator", self.separator or DEFAULT_SEPARATOR)
        put("expression", None if blank(self.expression) else self.expression.strip())
        if self.kind is None:
            several = KeyKind.COMPOSITE if len(self.columns) > 1 else KeyKind.SINGLE
            put("kind", KeyKind.DEFINED if self.expression else several)
        else:
            put("kind", KeyKind(self.kind))
        self._check()

    def _check(self):
        if self.kind is KeyKind.DEFINED:
            if self.expression is None:
                raise ConfigurationError("A defined key lacks its SQL expression")
            if any(mark in self.expression for mark in (";", "--", "/*")):
                raise ConfigurationError("The SQL expression of a key is one expression: no semicolon, no comment")
            return
        if self.kind is KeyKind.SINGLE and len(self.columns) != 1:
            raise ConfigurationError(f"A single key has one column, not {len(self.columns)}")
        if self.kind is KeyKind.COMPOSITE and len(self.columns) < 2:
            raise ConfigurationError(f"A composite key joins at least two columns, not {len(self.columns)}")
        for column in self.columns:
            simple_identifier("key column", column)

    @classmethod
    def single(cls, column: str) -> "KeySpec":
        return cls((column,), kind=KeyKind.SINGLE)

    @classmethod
    def composite(cls, columns: Sequence[str], separator: str = DEFAULT_SEPARATOR) -> "KeySpec":
        return cls(tuple(columns), separator=separator, kind=KeyKind.COMPOSITE)

    @classmethod
    def defined(cls, expression: str) -> "KeySpec":
        return cls(expression=expression, kind=KeyKind.DEFINED)

    @classmethod
    def of(cls, value: "KeySpec | str | None") -> "KeySpec | None":
        return cls.single(value) if isinstance(value, str) else value

    def column(self, resolve: Callable[[str], Column] = F.col) -> Column:
        """The key as a string column; NULL as soon as one part is NULL."""
        if self.kind is KeyKind.DEFINED:
            return F.expr(self.expression).cast("string")
        parts = [resolve(c).cast("string") for c in self.columns]
        spaced = [part for p in parts for part in (F.lit(self.separator), p)][1:]
        return F.concat(*spaced) if len(spaced) > 1 else spaced[0]

    def document_column(self, resolve: Callable[[str], Column]) -> Column:
        """Key over document paths; expressions are limited to one path."""
        if self.kind is KeyKind.DEFINED:
            if not _FIELD_PATH.fullmatch(self.expression):
                raise ConfigurationError("Document keys take columns or one field path, not an SQL expression")
            return resolve(self.expression).cast("string")
        return self.column(resolve)

    def sql(self, text_type: str = "TEXT", as_function: bool = False) -> str:
        """SQL text for stores that take a pushed-down statement."""
        if self.kind is KeyKind.DEFINED:
            return self.expression
        if self.kind is KeyKind.SINGLE:
            return self.columns[0]
        quoted = "'" + self.separator.replace("'", "''") + "'"
        casts = [f"CAST({c} AS {text_type})" for c in self.columns]
        if as_function:
            return f"CONCAT({f', {quoted}, '.join(casts)})"
        return f" || {quoted} || ".join(casts)


class SourceKind(str, Enum):
    """Kinds of datasource. ``table`` is whatever the Spark catalog or a temp view resolves."""

    table = "table"
    postgres = "postgres"
    mongo = "mongo"
    bigquery = "bigquery"
    file = "file"


@dataclass(frozen=True)
class Datasource:
    """A named connection. ``options`` hold the settings of its kind."""

    name: str
    kind: SourceKind
    schema: str | None = None
    tags: tuple[str, ...] = ()
    options: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        valid_name("datasource", self.name)
        object.__setattr__(self, "kind", SourceKind(self.kind))
        object.__setattr__(self, "tags", normalized_tags(self.tags))
        object.__setattr__(self, "options", dict(self.options))
        object.__setattr__(self, "schema", self._default_schema())

    def _default_schema(self) -> str | None:
        if not blank(self.schema):
            return self.schema.strip()
        if self.kind is SourceKind.postgres:
            for text in (self.options.get("url"), self.options.get("uri")):
                found = re.search(r"[?&](?:schema|currentSchema)=([^&]+)", text or "")
                if found:
                    return found.group(1)
        if self.kind is SourceKind.bigquery and not blank(self.options.get("dataset")):
            return self.options["dataset"].strip()
        return None


@dataclass(frozen=True)
class SideSpec:
    """One side of a comparison. ``query`` wins over ``query_file`` only when set, both over table columns.

    ``fields`` and ``identifiers`` name the comparable columns in order; they are compared by position.
    """

    datasource: str | None = None
    kind: SourceKind | None = None
    query: str | None = None
    query_file: str | Path | None = None
    query_params: tuple[Any, ...] = ()
    collection: str | None = None
    schema: str | None = None
    table: str | None = None
    key: KeySpec | None = None
    identifiers: tuple[str, ...] | None = None
    fields: tuple[str, ...] = ()
    distinct: bool = False
    batch_size: int | None = None  # rows a relational reader fetches at once

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        put("kind", None if self.kind is None else SourceKind(self.kind))
        put("key", KeySpec.of(self.key))
        put("query_params", tuple(self.query_params or ()))
        put("identifiers", None if self.identifiers is None else tuple(self.identifiers))
        put("fields", tuple(self.fields or ()))

    @property
    def comparable_fields(self) -> tuple[str, ...]:
        """Identifiers, then fields: trimmed, blanks dropped, first mention kept."""
        named = (*(self.identifiers or ()), *self.fields)
        return tuple(dict.fromkeys(n.strip() for n in named if not blank(n)))

    @property
    def relation(self) -> str:
        table = simple_identifier("table", self.table)
        return table if blank(self.schema) else f"{simple_identifier('schema', self.schema)}.{table}"

    def resolved_kind(self, sources: Mapping[str, Datasource] | None = None) -> SourceKind:
        """Explicit kind, else that of the datasource, else documents if a collection is named, else table."""
        if self.kind is not None:
            return self.kind
        if self.datasource and sources is not None and self.datasource in sources:
            return sources[self.datasource].kind
        if not blank(self.collection):
            return SourceKind.mongo
        if self.datasource and sources is not None:
            raise ConfigurationError(f"Unknown datasource [{self.datasource}]; known: {sorted(sources)}")
        return SourceKind.table

    def require_table_columns(self) -> tuple[KeySpec, tuple[str, ...]]:
        if self.key is None:
            raise ConfigurationError(f"Table [{self.relation}] needs a key (SINGLE, COMPOSITE or DEFINED)")
        if not self.comparable_fields:
            raise ConfigurationError(f"Table [{self.relation}] needs fields and/or identifiers")
        return self.key, self.comparable_fields

    def generated_sql(self, kind: SourceKind) -> str:
        """The SELECT a table side stands for, in the dialect of the store it is pushed to."""
        key, names = self.require_table_columns()
        warehouse = kind is SourceKind.bigquery
        text_type = {SourceKind.bigquery: "STRING", SourceKind.file: "VARCHAR"}.get(kind, "TEXT")
        alias = "MigrationKey" if warehouse else '"MigrationKey"'
        columns = ", ".join(simple_identifier("fields", n) for n in names)
        head = "SELECT DISTINCT" if self.distinct else "SELECT"
        return f"{head} {key.sql(text_type, warehouse)} AS {alias}, {columns} FROM {self.relation}"

    def patched(self, **changes: Any) -> "SideSpec":
        """A copy where every value that is not None replaces the old one."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class Profile:
    """A source/target pair inside a domain, with optional overrides of the domain's settings."""

    source: SideSpec
    target: SideSpec
    key: KeySpec | None = None
    identifiers: tuple[str, ...] | None = None
    settings: CompareSettings = CompareSettings()
    strategy: Strategy | None = None
    source_datasource: str | None = None
    target_datasource: str | None = None
    query_dir: str | Path | None = None
    batch_size: int | None = None
    by_key: bool = False  # no key holds a large share of the rows
    tags: tuple[str, ...] = ()
    domain_id: str | None = None
    profile_id: str | None = None

    def __post_init__(self):
        if self.source is None or self.target is None:
            raise ConfigurationError(f"Profile {self.profile_id} requires source and target")
        object.__setattr__(self, "key", KeySpec.of(self.key))
        object.__setattr__(self, "tags", normalized_tags(self.tags))
        if self.strategy is not None:
            object.__setattr__(self, "strategy", Strategy.of(self.strategy))

    @property
    def qualified_id(self) -> str:
        return f"{self.domain_id}.{self.profile_id}"


@dataclass(frozen=True)
class Domain:
    """A group of profiles and the settings they inherit."""

    id: str
    profiles: Mapping[str, Profile] = field(default_factory=dict)
    settings: CompareSettings = CompareSettings()
    strategy: Strategy | None = None
    source_datasource: str | None = None
    target_datasource: str | None = None
    query_dir: str | Path | None = None
    batch_size: int | None = None
    tags: tuple[str, ...] = ()

    def __post_init__(self):
        valid_name("domain", self.id)
        object.__setattr__(self, "profiles", dict(self.profiles))
        object.__setattr__(self, "tags", normalized_tags(self.tags))
        if self.strategy is not None:
            object.__setattr__(self, "strategy", Strategy.of(self.strategy))
