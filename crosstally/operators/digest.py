"""Text digests of runs: counts, statuses and keys, never business values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import KEY
from .compare import MATCHED

# Fixed value: how many differing keys a digest shows unless told otherwise.
SHOWN_BY_DEFAULT = 50

# Labels of the digest, in the order they are written.
_RUN_LABELS = {
    "domain": "domain_id",
    "profile": "profile_id",
    "runId": "run_id",
    "status": "status",
    "mode": "recon_mode",
    "active": "active",
}
_COUNT_LABELS = {
    "sourceCount": "source_count",
    "targetCount": "target_count",
    "matched": "matched_count",
    "mismatched": "mismatched_count",
    "sourceOnly": "source_only_count",
    "targetOnly": "target_only_count",
}


def _labelled(labels: dict[str, str]) -> Column:
    parts = [
        F.concat(F.lit(f"{label}="), F.coalesce(F.col(column).cast("string"), F.lit("null")))
        for label, column in labels.items()
    ]
    return F.concat_ws(" ", *parts)


def run_digest(runs: DataFrame, records: DataFrame, shown: int = SHOWN_BY_DEFAULT) -> DataFrame:
    """(run_id, digest): header, counts, and the first ``shown`` differing keys in key order.

    ``runs`` carry ``active`` (see ``with_active``). Every task keeps the first ``shown`` differing records of each run it
    meets and shuffles no others, so a run's records are never in one task, however many there are.
    """
    shown = max(1, shown)
    diffs = F.when(
        F.trim(F.coalesce("field_diffs", F.lit(""))) != "", F.concat(F.lit(" fieldDiffs="), F.col("field_diffs"))
    ).otherwise("")
    line = F.concat(F.lit("- key="), F.col(KEY), F.lit(" status="), F.col("status"), diffs, F.lit("\n"))
    counted = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("detail_rows"))
    # A limit on a rank alone is applied before the shuffle as well as after it.
    place = F.row_number().over(W.partitionBy("run_id").orderBy("key", "line"))
    first = (
        records.filter(F.col("status") != MATCHED).select("run_id", F.col(KEY).alias("key"), line.alias("line"))
        .withColumn("place", place).filter(F.col("place") <= shown)
        .groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("entries"))
    )
    merged = counted.join(first, "run_id", "left")
    joined = runs.filter(F.col("profile_id").isNotNull()).join(merged, "run_id", "left")
    entries = F.coalesce("entries", F.expr("CAST(array() AS array<struct<key:string,line:string>>)"))
    error = F.when(
        F.trim(F.coalesce("error_message", F.lit(""))) != "", F.concat(F.lit("error="), F.col("error_message"), F.lit("\n"))
    ).otherwise("")
    text = F.concat(
        F.lit("Outcome of one profile run, to be summarized.\n"),
        _labelled(_RUN_LABELS),
        F.lit("\n"),
        _labelled(_COUNT_LABELS),
        F.lit("\n"),
        error,
        F.lit("detailRows="),
        F.coalesce("detail_rows", F.lit(0)).cast("string"),
        F.lit(" sampledNonMatches="),
        F.size(entries).cast("string"),
        F.lit("\n"),
        F.array_join(F.transform(entries, lambda e: e["line"]), ""),
    )
    return joined.select("run_id", text.alias("digest"))


def domain_digest(runs: DataFrame) -> DataFrame:
    """(run_id, digest) of domain runs: their counts and one line per profile run, in id order.

    The lines of one domain run are as many as the domain has profiles.
    """
    statuses = {"status": "status"}
    counts = {k: v for k, v in _COUNT_LABELS.items() if k not in ("sourceCount", "targetCount")}
    line = _labelled({"profile": "profile_id", "runId": "run_id", **statuses, **counts})
    lines = (
        runs.filter(F.col("profile_id").isNotNull() & F.col("domain_run_id").isNotNull())
        .select(F.col("domain_run_id").alias("parent"), F.struct(F.col("run_id").alias("place"), line.alias("line")).alias("entry"))
        .groupBy("parent")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    )
    parents = runs.filter(F.col("profile_id").isNull())
    joined = parents.join(lines, F.col("run_id") == F.col("parent"), "left")
    text = F.concat(
        F.lit("Outcome of a domain run and its profiles, to be summarized.\n"),
        _labelled({"domain": "domain_id", "domainRunId": "run_id", **statuses, **counts}),
        F.lit("\n"),
        F.coalesce(F.array_join(F.transform("entries", lambda e: e["line"]), "\n"), F.lit("")),
    )
    return joined.select("run_id", text.alias("digest"))
