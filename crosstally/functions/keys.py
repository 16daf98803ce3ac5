"""The business key that pairs rows of the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import ConfigurationError
from .normalize import document_text, is_binary

# Fixed value: the alias a custom query gives its key column (any letter case).
KEY_ALIAS = "MigrationKey"
# Name of the key column in every frame of this package.
KEY = "migration_key"

_ACCEPTED = {KEY_ALIAS.lower(), KEY}
_NULL_KEY = f"{KEY_ALIAS} has null value somewhere in dataset"


def key_column_of(df: DataFrame) -> str:
    """The one column that carries the key."""
    found = [c for c in df.columns if c.lower() in _ACCEPTED]
    if len(found) > 1:
        raise ConfigurationError(f"More than one column named {KEY_ALIAS} found in dataset")
    if not found:
        raise ConfigurationError(f"No column named {KEY_ALIAS} found in dataset")
    return found[0]


def _inexact(dtype: T.DataType) -> bool:
    """Types whose plain cast depends on the session's mode, or is not compared byte by byte."""
    return isinstance(dtype, T.DecimalType) or (isinstance(dtype, T.StringType) and not is_binary(dtype))


def _key_first(df: DataFrame) -> tuple[str, list[str]]:
    name = key_column_of(df)
    quote = lambda c: "`" + c.replace("`", "``") + "`"
    return document_text(quote(name), df.schema[name].dataType) if _inexact(df.schema[name].dataType) else f"CAST({quote(name)} AS STRING)", [quote(c) for c in df.columns if c != name]


def keyed(df: DataFrame) -> DataFrame:
    """Key first, as text, then the comparable columns. A NULL key fails the job when it is met."""
    key, rest = _key_first(df)
    return df.selectExpr(f"coalesce({key}, CAST(raise_error('{_NULL_KEY}') AS STRING)) AS {KEY}", *rest)


def reject_null_keys(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (usable rows, rows without a key) instead of failing."""
    key, rest = _key_first(df)
    split = df.selectExpr(f"{key} AS {KEY}", *rest)
    return split.filter(f"{KEY} IS NOT NULL"), split.filter(f"{KEY} IS NULL")
