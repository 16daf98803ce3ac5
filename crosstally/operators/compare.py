"""Comparing two keyed sides.

How the work is laid out
------------------------
Both sides are brought to common types (``align``) and put on top of each other, so the comparison
is an aggregation, not a join:

1. ``GROUP BY key, values`` counts the copies of each side. Partial aggregation folds copies before
   the shuffle, and the shuffle hashes key *and* values, so a key that holds a large share of all
   rows is spread over all tasks.
2. ``GROUP BY key`` over those groups decides the status. Partial aggregation leaves at most one row
   per key and task, so a hot key costs one row per task here.

No step needs a group of rows in one place, none collects, none broadcasts. Values become JSON
payloads only after equal copies have cancelled out, and plans that need no payloads aggregate
nothing but numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.hashing import comparable, keyed_payload, payload_digest, payload_hash
from ..functions.keys import KEY
from ..functions.normalize import Strategy, literal
from ..plans.settings import CompareMode
from .align import align
from .membership import membership

# Statuses of a key, and of a field inside a record.
MATCHED = "MATCHED"
MISMATCHED = "MISMATCHED"
SOURCE_ONLY = "SOURCE_ONLY"
TARGET_ONLY = "TARGET_ONLY"
STATUSES = (MATCHED, MISMATCHED, SOURCE_ONLY, TARGET_ONLY)

# Names of the six counts, as a run keeps them.
COUNTS = (
    "source_count",
    "target_count",
    "matched_count",
    "mismatched_count",
    "source_only_count",
    "target_only_count",
)

RECORD_COLUMNS = (KEY, "source_hash", "target_hash", "status", "field_diffs", "source_payload", "target_payload")


# Copies the source has beyond the target's; negative the other way round.
_MORE = "(source_rows - target_rows)"


def _stacked(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of both sides, marked with the side they count for."""
    return source.selectExpr("*", "1L AS s", "0L AS t").unionAll(target.selectExpr("*", "0L AS s", "1L AS t"))


def _grouped(df: DataFrame, keys: Sequence[str], *aggregates: str) -> DataFrame:
    return df.groupBy(*keys).agg(*map(F.expr, aggregates))


def _copies(source: DataFrame, target: DataFrame, by_key: bool = False) -> DataFrame:
    """Step 1: copies of each (key, values) on both sides."""
    stacked = _stacked(source, target)
    if by_key:
        stacked = stacked.repartition(KEY)
    return _grouped(stacked, source.columns, "sum(s) AS source_rows", "sum(t) AS target_rows")


def _status(source_left: str, target_left: str) -> str:
    return f"""CASE WHEN {source_left} AND {target_left} THEN '{MISMATCHED}' WHEN {source_left} THEN '{SOURCE_ONLY}'
                    WHEN {target_left} THEN '{TARGET_ONLY}' ELSE '{MATCHED}' END AS status"""


_PAYLOAD_STATUS = _status("source_payload IS NOT NULL", "target_payload IS NOT NULL")


def bag_difference(source: DataFrame, target: DataFrame, strategy: Strategy | str | None = None) -> DataFrame:
    """(key, payload) pairs with more copies on one side, and how many more.

    ``source_surplus`` and ``target_surplus`` are both directions of EXCEPT ALL in one shuffle.
    """
    both = align(source, target, strategy)
    surplus = _copies(both.source, both.target).filter(f"{_MORE} <> 0").selectExpr(
        KEY, *both.values, f"greatest({_MORE}, 0L) AS source_surplus", f"greatest(-{_MORE}, 0L) AS target_surplus"
    )
    return both.with_payload(surplus).select(KEY, "payload", "source_surplus", "target_surplus")


def except_all(left: DataFrame, right: DataFrame, strategy: Strategy | str | None = None) -> DataFrame:
    """Rows of ``left`` without their counterparts in ``right``, copies counted, as (key, payload)."""
    both = align(left, right, strategy)
    return both.with_payload(both.source.exceptAll(both.target))


def unique_keys(source: DataFrame, target: DataFrame) -> DataFrame:
    """Number of distinct keys over both sides, one row."""
    keys = source.select(KEY).unionAll(target.select(KEY)).distinct()
    return keys.agg(F.count(F.lit(1)).alias("unique_keys"))


def duplicate_keys(source: DataFrame, target: DataFrame) -> DataFrame:
    """Keys that occur more than once on a side, with their row counts."""
    stacked = _stacked(source.select(KEY), target.select(KEY))
    counted = _grouped(stacked, [KEY], "sum(s) AS source_rows", "sum(t) AS target_rows")
    return counted.filter("source_rows > 1 OR target_rows > 1")


def classify(
    source: DataFrame,
    target: DataFrame,
    strategy: Strategy | str | None = None,
    by_key: bool = False,
) -> DataFrame:
    """Status and row counts of every key.

    ``by_key=True`` lays both steps out on the key alone and so saves one shuffle. Use it when no key
    holds a large share of the rows, such as for keys that are unique on each side.
    """
    both = align(source, target, strategy)
    per_key = _grouped(
        _copies(both.source, both.target, by_key),
        [KEY],
        "sum(source_rows) AS source_rows",
        "sum(target_rows) AS target_rows",
        f"max({_MORE} > 0) AS source_left",
        f"max({_MORE} < 0) AS target_left",
    )
    return per_key.selectExpr(KEY, _status("source_left", "target_left"), "source_rows", "target_rows")


def _folded(groups: DataFrame, source_left: str, target_left: str, *more: str) -> DataFrame:
    """Step 2 with payloads: what is left over of each key, and the status it implies.

    When several payloads of a key are left over on a side, the greatest text stands for them.
    """
    return _grouped(
        groups,
        [KEY],
        f"max(CASE WHEN {source_left} THEN payload END) AS source_payload",
        f"max(CASE WHEN {target_left} THEN payload END) AS target_payload",
        *more,
    ).selectExpr("*", _PAYLOAD_STATUS)


def classify_with_payloads(
    source: DataFrame,
    target: DataFrame,
    strategy: Strategy | str | None = None,
    by_key: bool = False,
) -> DataFrame:
    """Like ``classify``, and the payloads left over of keys that differ; the others have none.

    Both parts come from one set of copies: numbers of all keys by hash aggregation, texts of differing keys only.
    """
    per_key, differing = numbers_and_leftovers(source, target, strategy, by_key)
    return per_key.filter(f"status = '{MATCHED}'").selectExpr(
        KEY, "CAST(NULL AS STRING) AS source_payload", "CAST(NULL AS STRING) AS target_payload", "source_rows", "target_rows", "status"
    ).unionByName(per_key.filter(f"status <> '{MATCHED}'").drop("status").join(differing, KEY))


def numbers_and_leftovers(
    source: DataFrame, target: DataFrame, strategy: Strategy | str | None = None, by_key: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``classify`` and ``leftovers`` over the same copies, so that their shuffle is planned once."""
    return classify(source, target, strategy, by_key), leftovers(source, target, strategy, by_key)


def leftovers(source: DataFrame, target: DataFrame, strategy: Strategy | str | None = None, by_key: bool = False) -> DataFrame:
    """Key, status and payloads of the keys that differ; equal copies leave after step 1."""
    both = align(source, target, strategy)
    copies = _copies(both.source, both.target, by_key)
    return _folded(both.with_payload(copies.filter(f"{_MORE} <> 0")), f"{_MORE} > 0", f"{_MORE} < 0")


def _digested(df: DataFrame, strategy) -> DataFrame:
    return keyed_payload(df, strategy).selectExpr("*", f"{payload_digest('payload')} AS digest")


def leftovers_by_digest(
    source: DataFrame,
    target: DataFrame,
    strategy: Strategy | str | None = None,
) -> DataFrame:
    """Same result as ``leftovers`` for wide rows: digests are shuffled, payloads only of keys that differ.

    The differing (key, digest) pairs are computed once, into the checkpoint folder. The second scan meets a Bloom filter of
    them before anything is shuffled, so only rows that differ, and about one in 250 others, go on to the exact join.
    """
    spark = source.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ConfigurationError("Set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(shared)
    digests = [_digested(side, strategy).select(KEY, "digest") for side in (source, target)]
    copies = _copies(*digests)
    open_pairs = copies.filter(f"{_MORE} <> 0").selectExpr(KEY, "digest", f"{_MORE} > 0 AS on_source").checkpoint()
    pair = f"xxhash64({KEY}, digest)"
    known = membership(open_pairs.selectExpr(f"{pair} AS h"))

    def payloads(side: DataFrame, on_source: bool) -> DataFrame:
        pairs = open_pairs.filter("on_source" if on_source else "NOT on_source").select(KEY, "digest")
        near = known.rows_of(_digested(side, strategy), pair)
        # Copies fold before they travel: equal digests of a key are equal payloads.
        near = near.groupBy(KEY, "digest").agg(F.max("payload").alias("payload"))
        return near.join(pairs, [KEY, "digest"], "left_semi").selectExpr(KEY, "payload", f"{str(on_source).lower()} AS on_source")

    found = payloads(source, True).unionAll(payloads(target, False))
    return _folded(found, "on_source", "NOT on_source")


def status_counts() -> list[Column]:
    """The six counts, as aggregates over a frame of classified keys."""
    of = lambda status: f"count_if(status = '{status}')"
    differing = " - ".join(of(s) for s in (MISMATCHED, SOURCE_ONLY, TARGET_ONLY))
    counts = (
        "coalesce(sum(source_rows), 0L)",
        "coalesce(sum(target_rows), 0L)",
        f"greatest(count(1) - {differing}, 0L)",
        of(MISMATCHED),
        of(SOURCE_ONLY),
        of(TARGET_ONLY),
    )
    return [F.expr(f"{count} AS {name}") for count, name in zip(counts, COUNTS)]


def summary(source: DataFrame, target: DataFrame, strategy: Strategy | str | None = None, by_key: bool = False) -> DataFrame:
    """The six counts of a detail comparison: rows per side, keys per status."""
    return classify(source, target, strategy, by_key).agg(*status_counts())


def reconcile_counts(
    source: DataFrame,
    target: DataFrame,
    strategy: Strategy | str | None = None,
    by_key: bool = False,
) -> DataFrame:
    """Counts with one row per key and side: the counting mode.

    A key that repeats on a side is counted once and represented by its row with the greatest payload, as
    in the detail modes. Copies need not be counted for that, so this is one aggregation by key: each task hands on
    at most one payload a key and side, whatever share of the rows a key has, and ``by_key`` makes no difference.
    ``source_rows`` and ``target_rows`` tell how many rows there were.
    """
    both = align(source, target, strategy)
    per_key = _grouped(
        both.with_payload(_stacked(both.source, both.target)),
        [KEY],
        "max(CASE WHEN s = 1 THEN payload END) AS source_payload",
        "max(CASE WHEN t = 1 THEN payload END) AS target_payload",
        "sum(s) AS source_rows",
        "sum(t) AS target_rows",
    )
    in_source, in_target, same = "source_rows > 0", "target_rows > 0", "source_payload = target_payload"
    counts = (
        f"count_if({in_source})",
        f"count_if({in_target})",
        f"count_if({in_source} AND {in_target} AND {same})",
        f"count_if({in_source} AND {in_target} AND NOT {same})",
        f"count_if(NOT {in_target})",
        f"count_if(NOT {in_source})",
        "coalesce(sum(source_rows), 0L)",
        "coalesce(sum(target_rows), 0L)",
    )
    return per_key.agg(
        *[F.expr(f"{count} AS {name}") for count, name in zip(counts, (*COUNTS, "source_rows", "target_rows"))]
    )


def _value(side: str, at: int | None) -> str:
    """Text at a position of a parsed payload; NULL beyond its end."""
    return "CAST(NULL AS STRING)" if at is None else f"get({side}_values, {at})"


def condition_differs(conditions: Sequence[str], fields: Sequence[str]) -> str:
    """Does one of the condition fields differ between the two payloads?

    A condition that names no known field counts as a difference. Without known fields the
    conditions are the names of the leading positions.
    """
    names = list(fields) or list(conditions)
    if any(c not in names for c in conditions):
        return "TRUE"
    at = [names.index(c) for c in conditions]
    return " OR ".join(f"NOT ({_value('source', i)} <=> {_value('target', i)})" for i in at)


def field_diffs(conditions: Sequence[str], fields: Sequence[str], width: int) -> str:
    """JSON object from field name to status, in field order; NULL when there are no fields.

    Fields are the conditions if given, else the declared names, else ``c0, c1, ...`` for as many
    positions as the longer of the two payloads has (``width`` at most).
    """
    shown = list(dict.fromkeys(conditions)) or list(fields)
    generated = not shown
    shown = shown or [f"c{i}" for i in range(width)]
    positions = list(fields) or shown
    if not shown:
        return "CAST(NULL AS STRING)"
    members = []
    for name in shown:
        at = positions.index(name) if name in positions else None
        left, right = _value("source", at), _value("target", at)
        label = '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":"'
        status = f"""CASE WHEN {left} <=> {right} THEN '{MATCHED}' WHEN {left} IS NULL THEN '{TARGET_ONLY}'
                         WHEN {right} IS NULL THEN '{SOURCE_ONLY}' ELSE '{MISMATCHED}' END"""
        member = f"""concat({literal(label)}, {status}, '"')"""
        if generated:
            # Every value of a payload is a text, so a position is beyond both ends when both are NULL.
            member = f"CASE WHEN {left} IS NOT NULL OR {right} IS NOT NULL THEN {member} END"
        members.append(member)
    return f"concat('{{', concat_ws(',', {', '.join(members)}), '}}')"


def records_of(
    differing: DataFrame,
    mode: CompareMode | str = CompareMode.MISMATCH_DETAILS,
    fields: Sequence[str] = (),
    condition_fields: Sequence[str] = (),
    strategy: Strategy | str | None = None,
    width: int = 0,
    store_payloads: bool = True,
) -> DataFrame:
    """Records of keys that differ (``leftovers`` or the differing part of ``classify_with_payloads``)."""
    mode = CompareMode.of(mode)
    sides = ("source", "target")
    # Payloads are parsed once per record, in a projection of their own, however many fields are looked at.
    differing = differing.selectExpr(
        "*", *[f"from_json({side}_payload, 'array<string>') AS {side}_values" for side in sides]
    )
    if mode is CompareMode.COUNTS:
        differing = differing.limit(0)
    elif mode is CompareMode.MISMATCH_DETAILS and condition_fields:
        differing = differing.filter(f"status <> '{MISMATCHED}' OR {condition_differs(condition_fields, fields)}")
    absent = "CAST(NULL AS STRING)"
    diffs = field_diffs(condition_fields, fields, width) if mode is CompareMode.FIELD_DETAILS else absent
    return differing.selectExpr(
        KEY,
        *[f"{payload_hash(f'{side}_payload', strategy)} AS {side}_hash" for side in sides],
        "status",
        f"{diffs} AS field_diffs",
        *[f"{f'{side}_payload' if store_payloads else absent} AS {side}_payload" for side in sides],
    )


def reconcile_details(
    source: DataFrame,
    target: DataFrame,
    fields: Sequence[str] | None = None,
    mode: CompareMode | str = CompareMode.MISMATCH_DETAILS,
    condition_fields: Sequence[str] = (),
    strategy: Strategy | str | None = None,
    store_payloads: bool = True,
    wide: bool = False,
    by_key: bool = False,
) -> DataFrame:
    """One record per key that differs.

    ``fields`` names the compared positions; by default the names of the source columns.
    ``wide=True`` shuffles digests instead of payloads (see ``leftovers_by_digest``).
    """
    names = comparable(source) if fields is None else list(fields)
    if wide:
        differing = leftovers_by_digest(source, target, strategy)
    else:
        differing = leftovers(source, target, strategy, by_key)
    width = max(len(comparable(source)), len(comparable(target)))
    return records_of(differing, mode, names, condition_fields, strategy, width, store_payloads)


def field_rollup(records: DataFrame) -> DataFrame:
    """How often each field has each status over a set of records."""
    pairs = records.filter(F.col("field_diffs").isNotNull()).select(
        F.explode(F.from_json("field_diffs", "map<string,string>")).alias("field", "status")
    )
    return pairs.groupBy("field", "status").agg(F.count(F.lit(1)).alias("records"))
