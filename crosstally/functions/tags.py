"""Free-form tags on catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_tags(tags: Column) -> Column:
    """Trim, lower-case, drop blanks and repeats, keep order; never NULL."""
    cleaned = F.transform(tags, lambda tag: F.lower(F.trim(tag)))
    kept = F.filter(cleaned, lambda tag: tag.isNotNull() & (tag != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def has_tag(tags: Column, wanted: str | None) -> Column:
    """Does the list hold the tag? A blank tag matches everything."""
    needle = (wanted or "").strip().lower()
    return F.array_contains(normalize_tags(tags), needle) if needle else F.lit(True)


def with_tags(df: DataFrame, wanted: str | None = None, column: str = "tags") -> DataFrame:
    """Rows that hold the tag, with their tags normalised."""
    return df.filter(has_tag(F.col(column), wanted)).withColumn(column, normalize_tags(F.col(column)))
