"""What changed since a baseline run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KEY
from .layout import WATCHED, record_digest


def delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Records that are new, or differ from the baseline's record of the same key.

    Keys are unique on both sides, so this is an ordinary equi-join without skew; the optimizer
    broadcasts the baseline if its measured size allows.
    """
    before = baseline.select(
        F.col(KEY).alias("__key"), *[F.col(c).alias(f"__{c}") for c in WATCHED]
    )
    same = F.lit(True)
    for c in WATCHED:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = current.join(before, F.col(KEY) == F.col("__key"), "left")
    return joined.filter(F.col("__key").isNull() | ~same).select(*current.columns)


def delta_by_digest(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``delta`` against (key, digest, run_id) rows of one or more runs (``Ledger.baseline``); a key's newest run counts.

    The baseline is neither shuffled nor are its payloads read: the current records come to its buckets.
    """
    before = latest_digests(baseline).select(F.col(KEY).alias("__key"), F.col("digest").alias("__digest"))
    joined = current.withColumn("__now", F.expr(record_digest())).join(before, F.col(KEY) == F.col("__key"), "left")
    return joined.filter(F.col("__key").isNull() | (F.col("__now") != F.col("__digest"))).select(*current.columns)


def latest_digests(baseline: DataFrame) -> DataFrame:
    """The newest run's digest of every key."""
    return baseline.groupBy(KEY).agg(F.max_by("digest", "run_id").alias("digest"), F.max("run_id").alias("run_id"))


def chain_of_runs(runs: DataFrame) -> DataFrame:
    """(run_id, domain_id, profile_id) of the completed runs since, and with, each profile's last full run."""
    profile = ["domain_id", "profile_id"]
    completed = runs.filter((F.col("status") == "COMPLETED") & F.col("profile_id").isNotNull())
    last_full = (
        completed.filter(F.coalesce("run_scope", F.lit("FULL")) == "FULL")
        .groupBy(*profile)
        .agg(F.max("run_id").alias("first_run"))
    )
    return completed.join(last_full, profile).filter(F.col("run_id") >= F.col("first_run")).select("run_id", *profile)


def latest_records(records: DataFrame, *by: str) -> DataFrame:
    """The record of the newest run for every key (and ``by`` columns); a run has one record a key.

    Each task folds its rows before they are shuffled, once.
    """
    rest = [c for c in records.columns if c not in (*by, KEY)]
    newest = records.groupBy(*by, KEY).agg(F.max_by(F.struct(*rest), F.col("run_id")).alias("_newest"))
    return newest.select(*by, KEY, *[F.col("_newest").getField(c).alias(c) for c in rest])


def chained_baseline(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest record of every key over all runs since, and with, each profile's last full run.

    ``runs`` are current run rows; only completed profile runs count.
    """
    return latest_records(records.join(chain_of_runs(runs), "run_id"), "domain_id", "profile_id")
