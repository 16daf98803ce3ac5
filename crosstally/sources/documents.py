"""Documents: reading nested values by dotted path and filtering with JSON filter documents."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..functions.keys import KEY_ALIAS
from ..functions.normalize import document_text, literal, quoted
from ..plans.spec import SideSpec
from ..plans.window import Window
from .binding import bind_filter


def path_sql(df: DataFrame, path: str) -> tuple[str, T.DataType]:
    """SQL of the value at a dotted path, and its type; a path that leads nowhere is NULL.

    Struct members keep their type. Below a text column the rest of the path is read as JSON text,
    below a variant column as variant text.
    """
    nothing = "CAST(NULL AS STRING)", T.StringType()
    parts = path.split(".")
    fields = {f.name: f.dataType for f in df.schema.fields}
    if parts[0] not in fields:
        return nothing
    value, dtype = quoted(parts[0]), fields[parts[0]]
    for i, part in enumerate(parts[1:], start=1):
        rest = literal("$" + "".join(f"['{p}']" for p in parts[i:]))
        if isinstance(dtype, T.StructType):
            members = {f.name: f.dataType for f in dtype.fields}
            if part not in members:
                return nothing
            value, dtype = f"{value}.{quoted(part)}", members[part]
        elif isinstance(dtype, T.MapType):
            value, dtype = f"{value}[{literal(part)}]", dtype.valueType
        elif isinstance(dtype, T.StringType):
            return f"get_json_object({value}, {rest})", T.StringType()
        elif isinstance(dtype, T.VariantType):
            return f"try_variant_get({value}, {rest}, 'string')", T.StringType()
        else:
            return nothing
    if isinstance(dtype, T.VariantType):
        return f"try_variant_get({value}, '$', 'string')", T.StringType()
    return value, dtype


def path_column(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    value, dtype = path_sql(df, path)
    return F.expr(value), dtype


def _plain(value: Any) -> Any:
    """Unwrap extended JSON scalars."""
    if isinstance(value, Mapping) and len(value) == 1:
        (tag, inner), = value.items()
        if tag == "$date":
            return datetime.fromisoformat(str(inner).replace("Z", "+00:00"))
        if tag in ("$numberLong", "$numberInt"):
            return int(inner)
        if tag == "$numberDecimal":
            return Decimal(inner)
        if tag == "$numberDouble":
            return float(inner)
        if tag in ("$oid", "$uuid"):
            return str(inner)
    return value


def _literal(value: Any, dtype: T.DataType) -> Column:
    """A literal of the column's kind, so that the comparison stays a plain, pushable predicate."""
    value = _plain(value)
    if isinstance(dtype, T.StringType) and value is not None and not isinstance(value, str):
        # Values read from JSON text are text: numbers compare by their text form.
        return F.lit("true" if value is True else "false" if value is False else str(value))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, (str, datetime)):
        moment = F.to_timestamp(F.lit(value)) if isinstance(value, str) else F.lit(value)
        if isinstance(dtype, T.TimestampNTZType):
            return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
        return moment.cast(dtype)
    return F.lit(value)


def _number_of(column: Column, value: Any, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """Text that is compared with a number is read as a number; other text never matches."""
    if isinstance(dtype, T.StringType) and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return column.try_cast("double"), T.DoubleType()
    return column, dtype


def _on_items(column: Column, dtype: T.DataType, test) -> Column:
    """A list matches when one of its items does."""
    if isinstance(dtype, T.ArrayType):
        return F.exists(column, lambda item: test(item, dtype.elementType))
    return test(column, dtype)


def _equals(column: Column, value: Any, dtype: T.DataType) -> Column:
    value = _plain(value)
    if value is None:
        return column.isNull()

    def test(c, t):
        c, t = _number_of(c, value, t)
        return c == _literal(value, t)

    return _on_items(column, dtype, test)


def _ordered(column: Column, value: Any, dtype: T.DataType, operator: str) -> Column:
    value = _plain(value)
    if value is None:
        return F.lit(False)

    def test(c, t):
        c, t = _number_of(c, value, t)
        other = _literal(value, t)
        return {"$gt": c > other, "$gte": c >= other, "$lt": c < other, "$lte": c <= other}[operator]

    return _on_items(column, dtype, test)


def _any_of(column: Column, values: Any, dtype: T.DataType) -> Column:
    if not isinstance(values, list):
        raise ConfigurationError("$in and $nin take a list")
    values = [_plain(v) for v in values]
    present = [v for v in values if v is not None]
    numbers = [v for v in present if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)]
    if isinstance(dtype, T.ArrayType) or (isinstance(dtype, T.StringType) and numbers):
        tests = [_equals(column, v, dtype) for v in present]
    else:
        tests = [column.isin(*[_literal(v, dtype) for v in present])] if present else []
    if len(present) < len(values):
        tests.append(column.isNull())
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _list_of(column: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """A list column; JSON text that holds a list is read as one, anything else has none."""
    if isinstance(dtype, T.ArrayType):
        return column, dtype.elementType
    if isinstance(dtype, T.StringType):
        return F.when(F.ltrim(column).startswith("["), F.from_json(column, "array<string>")), T.StringType()
    return F.lit(None).cast("array<string>"), T.StringType()


def _matches(column: Column, pattern: Any, options: str, dtype: T.DataType) -> Column:
    flags = "".join(o for o in options if o in "imsx")
    if not isinstance(pattern, str) or len(flags) < len(options):
        raise ConfigurationError("$regex takes a text, and options out of i, m, s, x")
    text = f"(?{flags}){pattern}" if flags else pattern
    return _on_items(column, dtype, lambda c, t: c.rlike(text) if isinstance(t, T.StringType) else F.lit(False))


def _member(column: Column, dtype: T.DataType, path: str) -> tuple[Column, T.DataType]:
    """The value at a dotted path below a list item."""
    for part in path.split("."):
        members = {f.name: f.dataType for f in dtype.fields} if isinstance(dtype, T.StructType) else {}
        if isinstance(dtype, T.StringType):
            column = F.get_json_object(column, f"$['{part}']")
        elif part in members:
            column, dtype = column.getField(part), members[part]
        else:
            return F.lit(None).cast("string"), T.StringType()
    return column, dtype


def _any_item(column: Column, dtype: T.DataType, condition: Any) -> Column:
    if not isinstance(condition, Mapping):
        raise ConfigurationError("$elemMatch takes a document")
    items, kind = _list_of(column, dtype)
    on_value = bool(condition) and all(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in condition)

    def test(item: Column) -> Column:
        if on_value:
            return _test(item, kind, condition)
        return _joined(condition, lambda path, inner: _test(*_member(item, kind, path), inner))

    return F.exists(items, test)


def _condition(df: DataFrame, path: str, condition: Any) -> Column:
    return _test(*path_column(df, path), condition)


def _test(column: Column, dtype: T.DataType, condition: Any) -> Column:
    operators = isinstance(condition, Mapping) and condition and all(k.startswith("$") for k in condition)
    if not operators or _plain(condition) is not condition:
        return _equals(column, condition, dtype)
    # NULL is an absent value here: it fails every test but $ne, $nin and $exists: false.
    settled = lambda test: F.coalesce(test, F.lit(False))
    tests = []
    for operator, value in condition.items():
        if operator == "$eq":
            tests.append(_equals(column, value, dtype))
        elif operator == "$ne":
            tests.append(~settled(_equals(column, value, dtype)))
        elif operator in ("$gt", "$gte", "$lt", "$lte"):
            tests.append(_ordered(column, value, dtype, operator))
        elif operator == "$in":
            tests.append(_any_of(column, value, dtype))
        elif operator == "$nin":
            tests.append(~settled(_any_of(column, value, dtype)))
        elif operator == "$exists":
            tests.append(column.isNotNull() if value else column.isNull())
        elif operator == "$not":
            inner = {"$regex": value} if isinstance(value, str) else value
            if not isinstance(inner, Mapping):
                raise ConfigurationError("$not takes operators or a pattern")
            tests.append(~settled(_test(column, dtype, inner)))
        elif operator == "$regex":
            tests.append(_matches(column, value, condition.get("$options", ""), dtype))
        elif operator == "$options" and "$regex" in condition:
            continue
        elif operator == "$size":
            tests.append(F.size(_list_of(column, dtype)[0]) == F.lit(_plain(value)))
        elif operator == "$all":
            if not isinstance(value, list):
                raise ConfigurationError("$all takes a list")
            items, kind = _list_of(column, dtype)
            alone = F.lit(False) if isinstance(dtype, T.ArrayType) else settled(_equals(column, value[0], dtype)) if len(
                value) == 1 else F.lit(False)
            held = lambda wanted: settled(F.exists(items, lambda i: settled(_equals(i, wanted, kind))))
            each = [held(v) for v in value]
            tests.append(alone | reduce(lambda a, b: a & b, each, F.lit(bool(value))))
        elif operator == "$elemMatch":
            tests.append(_any_item(column, dtype, value))
        else:
            raise ConfigurationError(f"Unsupported filter operator: {operator}")
    return reduce(lambda a, b: a & b, tests)


def filter_column(df: DataFrame, document: Mapping[str, Any]) -> Column:
    """Predicate for a bound filter document; an empty document keeps everything."""
    return _joined(document, lambda path, condition: _condition(df, path, condition))


def filter_paths(document: Mapping[str, Any]) -> list[str]:
    """Paths that a bound filter document looks at."""
    paths: list[str] = []
    for name, condition in document.items():
        if name in ("$and", "$or", "$nor"):
            paths += [p for branch in condition for p in filter_paths(branch)]
        elif not name.startswith("$"):
            paths.append(name)
    return list(dict.fromkeys(paths))


def _joined(document: Mapping[str, Any], test) -> Column:
    tests = []
    for name, condition in document.items():
        if name in ("$and", "$or", "$nor"):
            if not isinstance(condition, list) or not condition:
                raise ConfigurationError(f"{name} takes a non-empty list")
            branches = [_joined(branch, test) for branch in condition]
            join = (lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b)
            joined = reduce(join, branches)
            tests.append(~F.coalesce(joined, F.lit(False)) if name == "$nor" else joined)
        elif name.startswith("$"):
            raise ConfigurationError(f"Unsupported filter operator: {name}")
        else:
            tests.append(test(name, condition))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def extract_documents(
    df: DataFrame, side: SideSpec, filter_text: str | None = None, window: Window | None = None, filtered: bool = False
) -> DataFrame:
    """Filter documents (unless the store has ``filtered`` them), then project the key and the comparable paths.

    Document types become text here, so that a list or a nested document compares with the text
    another store holds for it.
    """
    if not side.comparable_fields:
        raise ConfigurationError("Document sides need fields and/or identifiers, in the order of the other side")
    if side.key is None:
        raise ConfigurationError("Document sides need a key")
    bound = {} if filtered else bind_filter(side.query if filter_text is None else filter_text, side.query_params, window)
    kept = df.filter(filter_column(df, bound)) if bound else df

    def key_part(path: str) -> Column:
        return F.expr(document_text(*path_sql(df, path)))

    columns = [side.key.document_column(key_part).alias(KEY_ALIAS)]
    for path in side.comparable_fields:
        value, dtype = path_sql(df, path)
        nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))
        columns.append(F.expr(document_text(value, dtype) if nested else value).alias(path))
    return kept.select(*columns)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Newline-delimited JSON files; give the schema to avoid the pass that infers it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


# Names of types in a merged variant schema, and the column types that hold them. Paths that hold values of
# several types hold texts.
_COLUMN_TYPES = {"OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING"}
_SCHEMA_PARTS = re.compile(r"`(?:[^`]|``)*`|DECIMAL\(\d+,(\d+)\)|\w+|.")


def column_schema(merged: str) -> str:
    """Struct type, in DDL, of documents whose merged schema this is; empty if none was an object."""

    def part(match: re.Match) -> str:
        if match[1] is not None:
            return match[0] if match[1] == "0" else "DOUBLE"
        return _COLUMN_TYPES.get(match[0], match[0])

    typed = _SCHEMA_PARTS.sub(part, merged)
    return typed if typed.startswith("STRUCT<") else ""


def inferred_schema(df: DataFrame, column: str) -> str:
    """Struct type, in DDL, of all paths that any document in a column of JSON texts has.

    Schemas are merged by an aggregation over all documents, in every task before one row a task is shuffled; none is
    sampled. Texts that are no JSON objects add nothing.
    """
    text = F.col(column)
    objects = df.filter(F.ltrim(text).startswith("{")).select(F.try_parse_json(text).alias("document"))
    merged = objects.filter(F.col("document").isNotNull()).agg(F.schema_of_variant_agg("document")).first()[0]
    return column_schema(merged)


def parsed_documents(df: DataFrame, column: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows with their documents' fields as columns in place of the column of JSON texts.

    Without a schema that of all documents is found first, which reads them once more. A text that is no JSON object has NULL fields.
    """
    schema = inferred_schema(df, column) if schema is None else schema
    others = [c for c in df.columns if c != column]
    if not schema:
        return df.select(*others)
    parsed = df.withColumn(column, F.from_json(F.col(column), schema))
    fields = parsed.schema[column].dataType.names
    shared = sorted({c.lower() for c in others} & {f.lower() for f in fields})
    if shared:
        raise ConfigurationError(f"Columns beside the documents are named as fields are: {shared}")
    return parsed.select(*others, *[F.col(column).getField(f).alias(f) for f in fields])
