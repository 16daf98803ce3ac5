"""How a run's records lie on storage: in key order with a list of files for pages, and their keys in buckets for baselines.

*Records* are sorted by key over all files. A list of files, one row each with its first and last key and its number of records
by status, tells which files hold the records of given ranks, so a page reads those alone.

A *baseline* holds each record's key and the digest of what is compared, clustered by key into a fixed number of buckets. Joins
and aggregations by key find it partitioned, so only the other side of a join is shuffled. Buckets should be no
fewer than ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import KEY

# Columns whose change makes a record worth storing again.
WATCHED = ("status", "source_hash", "target_hash", "source_payload", "target_payload")
#: Records of a file at most.
FILE_ROWS = 500_000
FILES_SCHEMA = "file string, first_key string, last_key string, by_status map<string,long>"


def record_digest() -> str:
    """SQL of 32 bytes that differ as soon as one watched column does."""
    return f"unhex(sha2(to_json(array({', '.join(WATCHED)})), 256))"


# -- records in key order -----------------------------------------------------------------------


def write_sorted(records: DataFrame, folder: str, rows: int = FILE_ROWS) -> None:
    """Ranges of keys, a task each, in order; no file has more than ``rows``. The records are read twice (sampled first)."""
    ordered = records.repartitionByRange(KEY).sortWithinPartitions(KEY)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(folder)


def write_file_list(spark: SparkSession, schema, folder: str, to: str) -> None:
    """One row for each file of the folder, counted from the files themselves."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    files = (
        spark.read.schema(schema).parquet(folder).select(name, KEY, "status").groupBy("file", "status")
        .agg(F.min(KEY).alias("first_key"), F.max(KEY).alias("last_key"), F.count(F.lit(1)).alias("n"))
        .groupBy("file").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"),
                             F.map_from_entries(F.collect_list(F.struct(F.coalesce("status", F.lit("")), "n"))).alias("by_status"))
    )
    files.coalesce(1).write.mode("overwrite").parquet(to)


@dataclass(frozen=True)
class SortedFile:
    file: str
    first_key: str
    last_key: str
    by_status: dict[str, int]

    def rows(self, status: str | None) -> int:
        return sum(self.by_status.values()) if status is None else self.by_status.get(status, 0)


def files_of_page(
    files: Sequence[SortedFile], status: str | None, limit: int, offset: int = 0, after_key: str | None = None
) -> tuple[list[SortedFile], int]:
    """The files, in key order, that hold a page, and how many of their records with the status come before it.

    Behind ``after_key`` ranks are unknown within the first file; it counts with what it is sure to have: nothing.
    """
    chosen, skip, need = [], offset, limit
    for at in sorted(files, key=lambda f: (f.first_key, f.last_key)):
        # Python orders strings by code points, as UTF-8 bytes are ordered.
        if after_key is not None and at.last_key <= after_key:
            continue
        rows = at.rows(status)
        sure = 0 if after_key is not None and at.first_key <= after_key else rows
        if not rows:
            continue
        if not chosen and skip >= rows and sure == rows:
            skip -= rows
            continue
        chosen.append(at)
        need -= sure - (skip if len(chosen) == 1 else 0) if sure else 0
        if need <= 0:
            break
    return chosen, skip


# -- baselines in buckets -----------------------------------------------------------------------


def write_baseline(records: DataFrame, folder: str, buckets: int) -> None:
    """Key and digest of every record, one file a bucket; the table that the writer asks for is forgotten at once."""
    spark, name = records.sparkSession, f"crosstally_{uuid.uuid4().hex}"
    narrow = records.selectExpr(KEY, f"{record_digest()} AS digest").repartition(buckets, KEY)
    writer = narrow.write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY).option("path", folder).mode("overwrite")
    try:
        writer.saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its path was given, so the files stay


def baseline_table(spark: SparkSession, folders: Sequence[tuple[int, str]], buckets: int) -> str:
    """Name of a table over (run_id, folder) pairs, whose scan is partitioned by key. Whoever asked drops it."""
    name = f"crosstally_{uuid.uuid4().hex}"
    place = folders[0][1].replace("'", "\\'")
    spark.sql(f"""CREATE TABLE {name} ({KEY} STRING, digest BINARY, run_id BIGINT) USING parquet PARTITIONED BY (run_id)
                  CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{place}'""")
    for run_id, folder in folders:
        at = folder.replace("'", "\\'")
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (run_id={run_id}) LOCATION '{at}'")
    return name
