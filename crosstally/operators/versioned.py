"""Versioned catalog tables: every change adds a version and closes the one before.

History rows: entity columns, ``version``, ``active``, ``created_at``, ``created_by``,
``updated_at``, ``updated_by``, and any payload columns (tags, configuration).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.segments import ROWS_PER_SEGMENT, with_segment

AUDIT = ("version", "active", "created_at", "created_by", "updated_at", "updated_by")


def _ids(ids: str | Sequence[str]) -> list[str]:
    return [ids] if isinstance(ids, str) else list(ids)


def upsert(
    history: DataFrame,
    changes: DataFrame,
    ids: str | Sequence[str],
    actor: str,
    changed_at: str = "changed_at",
    tie_break: str | None = None,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """History after applying all changes in time order.

    Each change becomes a version; the version before it is closed at that moment by ``actor``.
    Versions go on counting from the entity's active row and keep its ``created_*``; an entity
    without an active row starts at version 1.

    Order within an entity is worked out per segment of time, then of ``tie_break``, and carried over between
    segments, so an entity with most of the changes is spread over as many tasks as its rows ask for.
    """
    ids = _ids(ids)
    payload = [c for c in changes.columns if c not in (*ids, changed_at, tie_break)]
    at = F.col(changed_at)
    ordered = with_segment(changes, ids, changed_at, tie_break, rows_per_segment)
    places = [at] if tie_break is None else [at, F.col(tie_break)]

    # One row per entity and segment: how many changes came before it, and when the next one follows.
    per_segment = ordered.groupBy(*ids, "segment").agg(
        F.count(F.lit(1)).alias("changes"), F.min(at).alias("first_at")
    )
    of_entity = W.partitionBy(*ids).orderBy("segment")
    live = history.filter("active").select(
        *ids,
        F.col("version").alias("live_version"),
        F.col("created_at").alias("live_created_at"),
        F.col("created_by").alias("live_created_by"),
    )
    per_segment = per_segment.select(
        *ids,
        "segment",
        (F.sum("changes").over(of_entity) - F.col("changes")).alias("earlier"),
        F.lead("first_at").over(of_entity).alias("next_first_at"),
        F.min("first_at").over(W.partitionBy(*ids)).alias("entity_first_at"),
    ).join(live, ids, "left")
    within = W.partitionBy(*ids, "segment").orderBy(*places)
    numbered = (
        ordered.withColumn("place", F.row_number().over(within))
        .withColumn("next_at", F.lead(at).over(within))
        .join(per_segment, [*ids, "segment"])
        .withColumn("place", F.col("place") + F.col("earlier"))
        .withColumn("next_at", F.coalesce("next_at", "next_first_at"))
    )
    added = numbered.select(
        *ids,
        *payload,
        (F.coalesce("live_version", F.lit(0)) + F.col("place")).cast("int").alias("version"),
        F.col("next_at").isNull().alias("active"),
        F.coalesce("live_created_at", "entity_first_at").alias("created_at"),
        F.coalesce("live_created_by", F.lit(actor)).alias("created_by"),
        F.coalesce("next_at", at).alias("updated_at"),
        F.lit(actor).alias("updated_by"),
    )
    first = per_segment.groupBy(*ids).agg(F.min("entity_first_at").alias("closed_at"))
    closing = F.col("active") & F.col("closed_at").isNotNull()
    kept = history.join(first, ids, "left").withColumns(
        {
            "updated_at": F.when(closing, F.col("closed_at")).otherwise(F.col("updated_at")),
            "updated_by": F.when(closing, F.lit(actor)).otherwise(F.col("updated_by")),
            "active": F.col("active") & ~closing,
        }
    )
    return kept.select(*added.columns).unionByName(added)


def soft_delete(
    rows: DataFrame,
    deleted: DataFrame,
    on: str | Sequence[str],
    actor: str,
    at: Column,
) -> DataFrame:
    """Close the active rows whose ``on`` columns appear in ``deleted``.

    Call it with the parents and again with the children: both go by the parent's id. A left join
    that keeps the large side in place; adaptive execution splits a parent that owns many children.
    """
    on = _ids(on)
    marked = rows.join(deleted.select(*on).distinct().withColumn("__deleted", F.lit(True)), on, "left")
    hit = F.col("active") & F.col("__deleted").isNotNull()
    return marked.withColumns(
        {
            "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
            "updated_by": F.when(hit, F.lit(actor)).otherwise(F.col("updated_by")),
            "active": F.col("active") & ~hit,
        }
    ).select(*rows.columns)


def delete_cascade(
    parents: DataFrame, children: DataFrame, deleted: DataFrame, on: str | Sequence[str], actor: str, at: Column
) -> tuple[DataFrame, DataFrame]:
    """Parents and their children after deleting the given parents."""
    return soft_delete(parents, deleted, on, actor, at), soft_delete(children, deleted, on, actor, at)


def active_snapshot(history: DataFrame, ids: str | Sequence[str]) -> DataFrame:
    """Live rows in id order."""
    return history.filter("active").orderBy(*_ids(ids))


def patch_merge(
    patches: DataFrame,
    ids: str | Sequence[str],
    order: str,
    columns: Sequence[str] | None = None,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Configuration after every patch: a NULL in a patch keeps the value that was set before it.

    The value carried into a segment comes from one summary row per entity and segment, so that no
    task needs all patches of an entity.
    """
    ids = _ids(ids)
    columns = [c for c in patches.columns if c not in (*ids, order)] if columns is None else list(columns)
    ordered = with_segment(patches, ids, order, rows=rows_per_segment)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__last_{c}") for c in columns]
    earlier = W.partitionBy(*ids).orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        ordered.groupBy(*ids, "segment")
        .agg(*last)
        .select(
            *ids,
            "segment",
            *[F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__carried_{c}") for c in columns],
        )
    )
    within = W.partitionBy(*ids, "segment").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = ordered.withColumns({f"__here_{c}": F.last(c, ignorenulls=True).over(within) for c in columns})
    joined = filled.join(carried, [*ids, "segment"])
    merged = {c: F.coalesce(f"__here_{c}", f"__carried_{c}").alias(c) for c in columns}
    return joined.select(*[merged.get(c, F.col(c)) for c in patches.columns])


def latest_patch(patches: DataFrame, ids: str | Sequence[str], order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Only the configuration after the last patch of each entity: one aggregation, no window."""
    ids = _ids(ids)
    columns = [c for c in patches.columns if c not in (*ids, order)] if columns is None else list(columns)
    merged = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return patches.groupBy(*ids).agg(F.max(order).alias(order), *merged)


def fill_defaults(
    profiles: DataFrame,
    domains: DataFrame,
    defaults: Mapping[str, object],
    on: str = "domain_id",
) -> DataFrame:
    """Each setting from the profile, else its domain, else the default; blank text counts as unset.

    ``domains`` has one row per domain. Columns are settings where both frames have them.
    """
    settings = [c for c in profiles.columns if c in domains.columns and c != on]
    renamed = domains.select(on, *[F.col(c).alias(f"__domain_{c}") for c in settings])

    def value(name: str) -> Column:
        levels = [F.col(name), F.col(f"__domain_{name}")]
        if dict(profiles.dtypes)[name] == "string":
            levels = [F.when(F.trim(c) != "", c) for c in levels]
        if defaults.get(name) is not None:
            levels.append(F.lit(defaults[name]))
        return F.coalesce(*levels).alias(name)

    joined = profiles.join(renamed, on, "left")
    return joined.select(*[value(c) if c in settings else F.col(c) for c in profiles.columns])
