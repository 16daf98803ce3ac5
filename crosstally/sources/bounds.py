"""Predicates that cut a store's rows into parts of about equal size, by quantiles of a column.

The store computes the quantiles, one row for all of them. A value that spans several quantiles (a hot key) gets a part of its
own, so equal ranges of a skewed column don't leave one connection with most of the rows. Every row meets exactly one
predicate; rows without a value are a part of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from ..errors import ConfigurationError
from ..plans.spec import simple_identifier

#: Parts of a read at most: each is a query and a connection.
MOST_PARTS = 1000


def quantile_statement(statement: str, column: str, parts: int) -> str:
    """One row: the values at the borders between ``parts`` equal shares of the statement's rows, in order.

    Written in SQL that relational stores and Spark share.
    """
    simple_identifier("partition column", column)
    if not 2 <= parts <= MOST_PARTS:
        raise ConfigurationError(f"A read has 2 to {MOST_PARTS} parts, not {parts}")
    borders = ", ".join(f"percentile_disc({i / parts:.6f}) WITHIN GROUP (ORDER BY {column}) AS q{i}" for i in range(1, parts))
    return f"SELECT {borders} FROM ({statement}) side"


def _literal(value: Any) -> str:
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal, str, date)):
        raise ConfigurationError(f"A partition column holds numbers, texts, dates or times, not {type(value).__name__}")
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def predicates(column: str, borders: Sequence[Any]) -> list[str]:
    """Conditions that hold for each row once. ``borders`` are in order and may repeat; None are left out.

    A value that repeats stands for more than one share of the rows and becomes a part of its own.
    """
    known = [b for b in borders if b is not None]
    values = list(dict.fromkeys(known))
    out, low = [f"{column} IS NULL"], None
    for value in values:
        hot = known.count(value) > 1
        own = _literal(value)
        above = "" if low is None else f"{column} > {low} AND "
        out.append(f"{above}{column} {'<' if hot else '<='} {own}")
        if hot:
            out.append(f"{column} = {own}")
        low = own
    out.append(f"{column} > {low}" if low is not None else f"{column} IS NOT NULL")
    return out


def partition_predicates(run: Callable[[str], DataFrame], statement: str, column: str, parts: int) -> list[str]:
    """Predicates for a statement of a store that ``run`` sends SQL to."""
    row = run(quantile_statement(statement, column, parts)).first()
    return predicates(column, list(row) if row is not None else [])


def read_in_parts(run: Callable[[str], DataFrame], statement: str, column: str, parts: int) -> DataFrame:
    """The statement's rows, read part by part: a stand-in for a parallel read where ``run`` is not JDBC."""
    found = None
    for condition in partition_predicates(run, statement, column, parts):
        part = run(f"SELECT * FROM ({statement}) side WHERE {condition}")
        found = part if found is None else found.unionAll(part)
    return found
