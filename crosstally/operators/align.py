"""Putting two sides on common ground before they are compared.

Equality of canonical texts is what counts, but writing every value as text is most of the CPU cost
of a comparison. Where both sides hold a column in the same type, equal values are equal texts, so
the values are compared as they are and only rows that differ are ever written as text. Columns
whose types differ between the sides are turned into canonical text first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.hashing import comparable, keyed_payload, payload_of
from ..functions.keys import KEY
from ..functions.normalize import NULL_TEXT, Strategy, is_binary, literal, quoted, staged_texts

_COMPARED_AS_IS = (
    T.BooleanType,
    T.IntegralType,
    T.FractionalType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.StringType,
    T.BinaryType,
)


def common_type(left: T.DataType, right: T.DataType, strategy: Strategy) -> T.DataType | None:
    """Type in which equality of values is equality of canonical texts; None if there is none."""
    if isinstance(left, T.StringType) and isinstance(right, T.StringType):
        return T.StringType()
    if strategy is Strategy.STRICT:
        # Strict texts tell 0.0 from -0.0, grouping does not.
        floating = isinstance(left, (T.FloatType, T.DoubleType))
        return left if left == right and isinstance(left, _COMPARED_AS_IS) and not floating else None
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return T.LongType()
    if isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType):
        return T.DecimalType(max(left.precision, right.precision), left.scale) if left.scale == right.scale else None
    return left if left == right and isinstance(left, _COMPARED_AS_IS) else None


@dataclass(frozen=True)
class Aligned:
    """Both sides as (key, v0, v1, ...) with equal column types, and how to write the values as text."""

    source: DataFrame
    target: DataFrame
    values: tuple[str, ...]
    strategy: Strategy
    # Positions that hold canonical text already; None when v0 is a whole payload.
    written: frozenset[int] | None

    def with_payload(self, df: DataFrame, only: str | None = None) -> DataFrame:
        """Replace the value columns of a derived frame with the JSON payload.

        Rows for which ``only`` does not hold get no payload, and no text is written for them.
        """
        kept = [c for c in df.columns if c not in self.values]
        wanted = lambda value: value if only is None else f"CASE WHEN {only} THEN {value} END"
        if self.written is None:
            return df.selectExpr(*kept, f"{wanted(self.values[0])} AS payload")
        if only is not None:
            df = df.selectExpr(*kept, *[f"{wanted(v)} AS {v}" for v in self.values])
        open_values = [v for i, v in enumerate(self.values) if i not in self.written]
        staged, texts = staged_texts(df, open_values, self.strategy)
        by_value = dict(zip(open_values, texts))
        payload = payload_of([by_value.get(v, v) for v in self.values])
        return staged.selectExpr(*kept, f"{wanted(payload)} AS payload")


def _side(df: DataFrame, names: Sequence[str], common: Sequence[T.DataType | None], strategy: Strategy) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    written = [n for n, c in zip(names, common) if c is None]
    staged, texts = staged_texts(df, written, strategy)
    by_name = dict(zip(written, texts))

    def value(name: str, dtype: T.DataType | None) -> str:
        if dtype is None:
            return by_name[name]
        if isinstance(dtype, T.StringType):
            # Texts are equal byte by byte, whatever collation a column has.
            text = quoted(name) if is_binary(types[name]) else f"collate({quoted(name)}, 'UTF8_BINARY')"
            return f"coalesce({text}, {literal(NULL_TEXT)})" if strategy is Strategy.LENIENT else text
        return quoted(name) if types[name] == dtype else f"CAST({quoted(name)} AS {dtype.simpleString()})"

    return staged.selectExpr(KEY, *[f"{value(n, c)} AS v{i}" for i, (n, c) in enumerate(zip(names, common))])


def align(source: DataFrame, target: DataFrame, strategy: Strategy | str | None = None) -> Aligned:
    strategy = Strategy.of(strategy)
    names = comparable(source), comparable(target)
    if len(names[0]) != len(names[1]) or not names[0]:
        # Rows of different width are never equal; their payload texts tell them apart.
        sides = [keyed_payload(df, strategy).withColumnRenamed("payload", "v0") for df in (source, target)]
        return Aligned(*sides, ("v0",), strategy, None)
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (source, target)]
    common = [common_type(types[0][a], types[1][b], strategy) for a, b in zip(*names)]
    texts_already = {
        i
        for i, dtype in enumerate(common)
        if dtype is None or (isinstance(dtype, T.StringType) and strategy is Strategy.LENIENT)
    }
    return Aligned(
        _side(source, names[0], common, strategy),
        _side(target, names[1], common, strategy),
        tuple(f"v{i}" for i in range(len(common))),
        strategy,
        frozenset(texts_already),
    )
