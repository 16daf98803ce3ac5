"""Canonical text of a value, as built-in SQL expressions picked from the schema.

Two strategies:

* ``TypeLenient`` - values that mean the same compare equal across stores:
  ``10`` = ``10.00`` = ``10.0``, ``true`` = ``1``, timestamps as UTC instants.
* ``TypeStrict`` - the text is prefixed with the boxed class name of the type,
  so ``int 10`` and ``bigint 10`` differ.

There is no UDF, so everything stays in the JVM next to the scan. Expressions are put together as
SQL text: a table with hundreds of columns then costs the driver one call, not thousands.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError

# Fixed value: the text that stands for SQL NULL in payloads and hashes.
NULL_TEXT = "<NULL>"

# Class names that prefix strict texts, by Spark type name.
STRICT_TAGS = {
    "boolean": "java.lang.Boolean",
    "tinyint": "java.lang.Byte",
    "smallint": "java.lang.Short",
    "int": "java.lang.Integer",
    "bigint": "java.lang.Long",
    "float": "java.lang.Float",
    "double": "java.lang.Double",
    "decimal": "java.math.BigDecimal",
    "date": "java.time.LocalDate",
    "time": "java.time.LocalTime",
    "timestamp": "java.time.Instant",
    "timestamp_ntz": "java.time.LocalDateTime",
    "string": "java.lang.String",
}


class Strategy(str, Enum):
    LENIENT = "TypeLenient"
    STRICT = "TypeStrict"

    @classmethod
    def of(cls, value: "Strategy | str | None") -> "Strategy":
        """Resolve a name; nothing given means lenient."""
        if value is None or isinstance(value, cls):
            return value or cls.LENIENT
        name = str(value).strip().lower()
        for member in cls:
            if name in (member.value.lower(), member.name.lower()):
                return member
        raise ConfigurationError(f"Unknown hashing strategy: {value}; use TypeLenient or TypeStrict")


def quoted(name: str) -> str:
    """A column name as SQL."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text value as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _type_name(dtype: T.DataType) -> str:
    return dtype.simpleString().split("(")[0].split(" ")[0]


def _trimmed_zeros(text: str) -> str:
    """Drop the zeros that end a fraction, and the point if nothing is left behind it.

    Only for texts with a decimal point, or none that end in zero (``NaN``, ``Infinity``).
    """
    return f"rtrim('.', rtrim('0', {text}))"


# ``1.25E-5`` -> ``0.0000125``, ``-1.5E7`` -> ``-15000000``. In exponent form there is always one digit
# before the point. ``x`` is the text, ``d`` its digits, ``e`` its exponent, ``m`` its sign.
_SHIFTED = r"""
CASE WHEN x.e < 0 THEN concat(x.m, '0.', repeat('0', -x.e - 1), x.d)
     WHEN x.e + 1 >= length(x.d) THEN concat(x.m, rpad(x.d, x.e + 1, '0'))
     ELSE concat(x.m, substr(x.d, 1, x.e + 1), '.', substr(x.d, x.e + 2)) END
"""
_SPLIT = r"""
named_struct('m', IF(startswith(t, '-'), '-', ''), 'd', regexp_replace(t, '-|[.]0E.*|E.*|[.]', ''),
             'e', try_cast(substring_index(t, 'E', -1) AS INT))
"""


def is_binary(dtype: T.DataType) -> bool:
    """Is this the plain text type, compared byte by byte?"""
    return dtype == T.StringType()


def _without_exponent(text: str, otherwise: str) -> str:
    """The text of a number that may have an exponent; ``otherwise`` is what it is without one.

    The exponent form is rare. As a lambda its long expression is not unrolled into the generated
    code of every number column, which would outgrow what the JIT compiles.
    """
    shifted = f"transform(transform(array({text}), t -> {_SPLIT}), x -> {_SHIFTED})[0]"
    return f"CASE WHEN contains({text}, 'E') THEN {shifted} ELSE {otherwise} END"


def plain_decimal(value: str) -> str:
    """All digits of a decimal. Without ANSI mode Spark writes small ones with an exponent."""
    text = f"CAST({value} AS STRING)"
    return _without_exponent(text, text)


def _number_text(text: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return text
    if isinstance(dtype, T.DecimalType):
        return _trimmed_zeros(_without_exponent(text, text)) if dtype.scale > 0 else text
    return _without_exponent(text, _trimmed_zeros(text))


def _iso_clock(text: str, keep_zero_seconds: bool) -> str:
    """ISO text from Spark's own: ``T`` separator, fraction in groups of three digits."""
    joined = f"replace({text}, ' ', 'T')"
    whole = joined
    if not keep_zero_seconds:
        whole = f"IF(endswith({text}, ':00'), left({joined}, length({text}) - 3), {joined})"
    digits = f"length(substring_index({text}, '.', -1))"
    missing = f"IF({digits} <= 3, 3, 6) - {digits}"
    return f"CASE WHEN contains({text}, '.') THEN concat({joined}, repeat('0', {missing})) ELSE {whole} END"


def _utc_clock(value: str) -> str:
    """Spark's text of an instant in UTC, whatever the session time zone is."""
    seconds = f"CAST(CAST(unix_micros({value}) AS DECIMAL(20,0)) / 1000000 AS DECIMAL(18,6))"
    return f"CAST(TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}) AS STRING)"


def _instant(value: str) -> str:
    return f"concat({_iso_clock(_utc_clock(value), keep_zero_seconds=True)}, 'Z')"


def _json_string(value: str) -> str:
    """A quoted and escaped JSON string."""
    boxed = f"to_json(array({value}))"
    return f"substr({boxed}, 2, length({boxed}) - 2)"


def _member(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '": '


def _document_json(value: str, dtype: T.DataType, depth: int) -> str:
    """JSON text of a value inside a document, in the spaced form document stores print."""
    if isinstance(dtype, T.StructType):
        members = []
        for field in dtype.fields:
            inner = f"{value}.{quoted(field.name)}"
            text = f"concat({literal(_member(field.name))}, {_document_json(inner, field.dataType, depth)})"
            members.append(f"IF({inner} IS NOT NULL, {text}, NULL)")
        return f"concat('{{', concat_ws(', ', {', '.join(members) or literal('')}), '}}')"
    if isinstance(dtype, T.ArrayType):
        item = f"i{depth}"
        text = _document_json(item, dtype.elementType, depth + 1)
        return f"concat('[', array_join(transform({value}, {item} -> coalesce({text}, 'null')), ', '), ']')"
    if isinstance(dtype, T.DecimalType):
        return f"""concat('{{"$numberDecimal": "', {plain_decimal(value)}, '"}}')"""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return f"CAST({value} AS STRING)"
    if isinstance(dtype, T.TimestampType):
        return f"""concat('{{"$date": "', {_instant(value)}, '"}}')"""
    if isinstance(dtype, T.MapType):
        return _map_json(value)
    return _json_string(document_text(value, dtype, depth))


def _map_json(value: str) -> str:
    return f"to_json(map_from_entries(array_sort(map_entries({value}))))"


def document_text(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """Flatten document types to text: binary to hex, nested documents to JSON, lists to ``[a, b]``.

    Takes and gives SQL. Plain types keep their own text. Absent members and NULL members are the
    same thing.
    """
    if isinstance(dtype, T.BinaryType):
        return f"lower(hex({value}))"
    if isinstance(dtype, T.StructType):
        return f"IF({value} IS NOT NULL, {_document_json(value, dtype, depth)}, NULL)"
    if isinstance(dtype, T.ArrayType):
        item = f"i{depth}"
        text = document_text(item, dtype.elementType, depth + 1)
        return f"concat('[', array_join(transform({value}, {item} -> coalesce({text}, 'null')), ', '), ']')"
    if isinstance(dtype, T.MapType):
        return _map_json(value)
    if isinstance(dtype, T.TimestampType):
        return _instant(value)
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return plain_decimal(value)
    if isinstance(dtype, T.StringType) and not is_binary(dtype):
        return f"collate({value}, 'UTF8_BINARY')"
    return f"CAST({value} AS STRING)"


def _base(value: str, dtype: T.DataType, strategy: Strategy) -> str | None:
    """First step for types whose text is inspected several times; None when one step is enough."""
    name = _type_name(dtype)
    if name == "timestamp":
        return _utc_clock(value)
    if name in ("timestamp_ntz", "time"):
        return f"CAST({value} AS STRING)"
    if strategy is Strategy.LENIENT and isinstance(dtype, T.DecimalType):
        return f"CAST({value} AS STRING)"
    if strategy is Strategy.LENIENT and isinstance(dtype, T.FractionalType):
        # Adding zero turns negative zero into zero and changes nothing else.
        return f"CAST({value} + CAST(0 AS {name}) AS STRING)"
    return None


def _finished(value: str, base: str | None, dtype: T.DataType, strategy: Strategy) -> str:
    name = _type_name(dtype)
    if name == "void":
        return literal(NULL_TEXT)
    if name == "timestamp":
        text = f"concat({_iso_clock(base, keep_zero_seconds=True)}, 'Z')"
    elif name in ("timestamp_ntz", "time"):
        text = _iso_clock(base, keep_zero_seconds=False)
    elif strategy is Strategy.LENIENT and isinstance(dtype, T.BooleanType):
        text = f"CASE WHEN {value} THEN '1' WHEN NOT {value} THEN '0' END"
    elif strategy is Strategy.LENIENT and isinstance(dtype, T.NumericType):
        text = _number_text(base or f"CAST({value} AS STRING)", dtype)
    else:
        text = document_text(value, dtype)
    if strategy is Strategy.STRICT:
        text = f"concat({literal(STRICT_TAGS.get(name, STRICT_TAGS['string']) + ':')}, {text})"
    return f"coalesce({text}, {literal(NULL_TEXT)})"


def normalized(column: str, dtype: T.DataType, strategy: Strategy | str | None = None) -> Column:
    """Canonical text of one named column; never NULL."""
    strategy = Strategy.of(strategy)
    value = quoted(column)
    return F.expr(_finished(value, _base(value, dtype, strategy), dtype, strategy))


def staged_texts(
    df: DataFrame,
    columns: Sequence[str],
    strategy: Strategy | str | None = None,
) -> tuple[DataFrame, list[str]]:
    """The canonical texts of several columns, as SQL, in two projections.

    Numbers and timestamps are cast to text in the first projection and tidied in the second, so
    the cast is evaluated once per value and the generated code stays small enough to be compiled
    and JIT-ed on wide tables. The returned frame holds the original columns and the helpers the
    returned expressions read; select what you need from it.
    """
    strategy = Strategy.of(strategy)
    types = {f.name: f.dataType for f in df.schema.fields}
    unknown = [c for c in columns if c not in types]
    if unknown:
        raise ConfigurationError(f"Unknown columns: {unknown}")
    helpers, texts = [], []
    for i, name in enumerate(columns):
        value = quoted(name)
        base = _base(value, types[name], strategy)
        if base is not None:
            helpers.append(f"{base} AS __text{i}")
            base = f"__text{i}"
        texts.append(_finished(value, base, types[name], strategy))
    return (df.selectExpr("*", *helpers) if helpers else df), texts


def normalize(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    strategy: Strategy | str | None = None,
) -> DataFrame:
    """Replace the given columns (all of them by default) with their canonical text."""
    wanted = df.columns if columns is None else list(columns)
    staged, texts = staged_texts(df, wanted, strategy)
    by_name = {c: f"{text} AS {quoted(c)}" for c, text in zip(wanted, texts)}
    return staged.selectExpr(*[by_name.get(c, quoted(c)) for c in df.columns])
