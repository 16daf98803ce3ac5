"""Ordered per-entity work that does not need a whole entity in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an entity that one window holds; larger entities are cut.
ROWS_PER_SEGMENT = 100_000
_LEVELS, _MOST = 3, 1 << 20


def _position(column: str, dtype: str) -> Column | None:
    """Where a value lies, as a double; None for types that have no distance."""
    value = F.col(column)
    if dtype in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if dtype == "date":
        return F.unix_date(value).cast("double")
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return value.cast("double")
    return None


def with_segment(
    df: DataFrame,
    ids: Sequence[str],
    order: str,
    tie_break: str | None = None,
    rows: int = ROWS_PER_SEGMENT,
    name: str = "segment",
) -> DataFrame:
    """Number the segments of each entity's rows along ``order``, then ``tie_break``.

    An entity (or segment) of more than ``rows`` rows is cut into about n / rows stretches of equal length, and this
    is repeated for stretches that are still too full. Rows of one moment are cut along ``tie_break``, if that is a
    number, date or timestamp. What cuts depend on is aggregated and there is at most one such row for every
    ``rows`` rows, so entities of ordinary size cost a left join with an almost empty side. Building the frame runs no
    job. ``order`` must be a number, date or timestamp.
    """
    ids, types = list(ids), dict(df.dtypes)
    places = [_position(order, types[order]), None if tie_break is None else _position(tie_break, types[tie_break])]
    places = [F.lit(0.0) if p is None else p for p in places]
    out = df.withColumn(name, F.lit(0).cast("long"))
    for _ in range(_LEVELS):
        full = (
            out.groupBy(*ids, name)
            .agg(F.count(F.lit(1)).alias("__n"), *[f(p).alias(f"__{f.__name__}{i}") for i, p in enumerate(places) for f in (F.min, F.max)])
            .where(F.col("__n") > rows)
        )
        parts = F.least(F.ceil(F.col("__n") / rows), F.lit(_MOST - 1))

        def stretch(i: int) -> Column:
            low, high = F.col(f"__min{i}"), F.col(f"__max{i}")
            return F.least(F.floor((places[i] - low) / (high - low) * parts), parts - 1)

        cut = F.coalesce(
            F.when(F.col("__max0") > F.col("__min0"), stretch(0)).when(F.col("__max1") > F.col("__min1"), stretch(1)), F.lit(0)
        )
        out = out.join(full, [*ids, name], "left").select(*df.columns, (F.col(name) * _MOST + cut).cast("long").alias(name))
    return out
