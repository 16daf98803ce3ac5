"""Row hashes, field hashes and JSON payloads over canonical texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .keys import KEY
from .normalize import STRICT_TAGS, Strategy, literal, quoted, staged_texts

# Fixed value: every hashed value is followed by one zero byte, so ["ab", "c"] and ["a", "bc"] differ.
_ZERO = "char(0)"


def comparable(df: DataFrame) -> list[str]:
    """All columns but the key, in order."""
    return [c for c in df.columns if c != KEY]


def hash_of(texts: Sequence[str]) -> str:
    """SHA-256, lower hex, over the texts in order (SQL in, SQL out, as below)."""
    parts = [part for text in texts for part in (text, _ZERO)]
    return f"sha2(concat({', '.join(parts)}), 256)" if parts else "sha2('', 256)"


def payload_of(texts: Sequence[str]) -> str:
    """JSON array of the texts in order."""
    return f"to_json(array({', '.join(texts)}))" if texts else "'[]'"


def payload_digest(payload: str) -> str:
    """32 bytes that stand for a payload while it is shuffled."""
    return f"unhex(sha2({payload}, 256))"


def payload_hash(payload: str, strategy: Strategy | str | None = None) -> str:
    """Hash of a payload text, hashed as one string value; NULL for no payload."""
    if Strategy.of(strategy) is Strategy.STRICT:
        payload = f"concat({literal(STRICT_TAGS['string'] + ':')}, {payload})"
    return f"sha2(concat({payload}, {_ZERO}), 256)"


def _added(df: DataFrame, columns, strategy, name: str, build) -> DataFrame:
    names = comparable(df) if columns is None else list(columns)
    staged, texts = staged_texts(df, names, strategy)
    return staged.selectExpr(*map(quoted, df.columns), f"{build(names, texts)} AS {quoted(name)}")


def with_row_hash(df, columns=None, strategy=None, name: str = "row_hash") -> DataFrame:
    """Add the hash of the given columns (all but the key by default)."""
    return _added(df, columns, strategy, name, lambda names, texts: hash_of(texts))


def with_field_hashes(df, columns=None, strategy=None, name: str = "field_hashes") -> DataFrame:
    """Add a map from column name to the hash of that single value."""

    def build(names, texts):
        return f"map({', '.join(f'{literal(n)}, {hash_of([t])}' for n, t in zip(names, texts))})"

    return _added(df, columns, strategy, name, build)


def with_payload(df, columns=None, strategy=None, name: str = "payload") -> DataFrame:
    """Add the JSON payload of the given columns (all but the key by default)."""
    return _added(df, columns, strategy, name, lambda names, texts: payload_of(texts))


def keyed_payload(df: DataFrame, strategy=None) -> DataFrame:
    """(key, payload): a side as a detail comparison stores it."""
    return with_payload(df, None, strategy).select(KEY, "payload")
