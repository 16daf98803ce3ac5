"""Binding of positional parameters and of the run window into SQL and document filters.

Values are always bound as values. Only the parameter markers in the text are renamed, so that
positional (``?``) and window (``:since`` / ``:until``) markers can appear in one statement,
which Spark does not accept by itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from ..errors import ConfigurationError
from ..plans.window import Window

_QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`"
_MARKERS = re.compile(rf"(?P<quoted>{_QUOTED})|(?P<mark>\?)|(?<!:):(?P<token>since|until)(?![A-Za-z0-9_])", re.I | re.S)
_JSON_MARKERS = re.compile(r'(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<mark>\?)|:(?P<token>since|until)(?![A-Za-z0-9_])', re.I | re.S)
_WINDOW_TEXT = re.compile(r":(since|until)", re.I)


def needs_window(statement: str | None) -> bool:
    """Does the SQL carry ``:since`` or ``:until`` outside quotes?"""
    return any(m["token"] for m in _MARKERS.finditer(statement or ""))


def filter_needs_window(statement: str | None) -> bool:
    for m in _JSON_MARKERS.finditer(statement or ""):
        if m["token"] or (m["quoted"] and _WINDOW_TEXT.fullmatch(m["quoted"][1:-1])):
            return True
    return False


def count_markers(statement: str) -> int:
    return sum(1 for m in _MARKERS.finditer(statement) if m["mark"])


def _check_count(what: str, markers: int, params: Sequence[Any]) -> None:
    if markers != len(params):
        raise ConfigurationError(f"{what} has {markers} ? placeholder(s) but {len(params)} value(s) were given")


def bind_sql(
    statement: str,
    params: Sequence[Any] = (),
    window: Window | None = None,
    ansi_quotes: bool = True,
) -> tuple[str, dict[str, Any]]:
    """Statement with named markers only, and the arguments for ``spark.sql``.

    With ``ansi_quotes`` a double-quoted name (``AS "MigrationKey"``) is an identifier, as in the
    stores these statements come from.
    """
    _check_count("Query", count_markers(statement), params)
    args: dict[str, Any] = {}

    def rename(match: re.Match) -> str:
        if match["quoted"]:
            text = match["quoted"]
            if ansi_quotes and text.startswith('"'):
                return "`" + text[1:-1].replace('""', '"').replace("`", "``") + "`"
            return text
        if match["mark"]:
            name = f"p{sum(k.startswith('p') for k in args) + 1}"
            args[name] = params[int(name[1:]) - 1]
            return f":{name}"
        if window is None:
            return match.group(0)
        name = match["token"].lower()
        args[name] = getattr(window, name)
        return f":{name}"

    return _MARKERS.sub(rename, statement), args


def _sql_literal(value: Any, zoned: str = "TIMESTAMP") -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        moment = value.astimezone(timezone.utc) if value.tzinfo else value
        kind, suffix = (zoned, "+00:00") if value.tzinfo else ("TIMESTAMP", "")
        return f"{kind} '{moment.strftime('%Y-%m-%d %H:%M:%S.%f')}{suffix}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    text = str(value)
    if "\\" in text or "\0" in text:
        raise ConfigurationError("Backslash and NUL are not accepted in pushed-down parameter values")
    return "'" + text.replace("'", "''") + "'"


def inline_sql(
    statement: str, params: Sequence[Any] = (), window: Window | None = None, zoned: str = "TIMESTAMP"
) -> str:
    """Statement with escaped literals, for stores that take text only (``query`` option of a reader).

    ``zoned`` is what the store calls a timestamp literal whose zone counts.
    """
    _check_count("Query", count_markers(statement), params)
    values = iter(params)

    def literal(match: re.Match) -> str:
        if match["quoted"]:
            return match["quoted"]
        if match["mark"]:
            return _sql_literal(next(values), zoned)
        return match.group(0) if window is None else _sql_literal(getattr(window, match["token"].lower()), zoned)

    return _MARKERS.sub(literal, statement)


def instant_text(moment: datetime) -> str:
    """UTC text with no, three or six digits of fraction, as document stores write it."""
    moment = moment.astimezone(timezone.utc) if moment.tzinfo else moment
    if moment.microsecond == 0:
        return moment.strftime("%Y-%m-%dT%H:%M:%SZ")
    spec = "milliseconds" if moment.microsecond % 1000 == 0 else "microseconds"
    return moment.replace(tzinfo=None).isoformat(timespec=spec) + "Z"


def bind_filter(statement: str | None, params: Sequence[Any] = (), window: Window | None = None) -> dict[str, Any]:
    """JSON filter document with its placeholders replaced by values, in text order.

    A placeholder is ``?`` or the whole string ``"?"``; ``:since`` and ``:until`` likewise.
    """
    text = "{}" if statement is None or not statement.strip() else statement.strip()

    def quote(match: re.Match) -> str:
        if match["quoted"]:
            return match["quoted"]
        return '"?"' if match["mark"] else f'":{match["token"].lower()}"'

    try:
        document = json.loads(_JSON_MARKERS.sub(quote, text))
    except ValueError as e:
        raise ConfigurationError(f"Document query must be a JSON filter document: {text}") from e
    if not isinstance(document, dict):
        raise ConfigurationError(f"Document query must be a JSON filter document: {text}")

    used = 0

    def walk(node: Any) -> Any:
        nonlocal used
        if isinstance(node, Mapping):
            return {k: walk(v) for k, v in node.items()}
        if isinstance(node, list):
            return [walk(v) for v in node]
        if node == "?":
            used += 1
            return params[used - 1] if used <= len(params) else None
        if window is not None and isinstance(node, str) and _WINDOW_TEXT.fullmatch(node):
            return instant_text(getattr(window, node[1:].lower()))
        return node

    bound = walk(document)
    _check_count("Document query", used, params)
    return bound
