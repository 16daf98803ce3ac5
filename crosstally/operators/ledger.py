"""Run and record ledger on plain folders of which a commit log tells what counts.

A run is a series of event rows (started, then completed or failed), each carrying the full row.
The current state and the active run of a profile are derived, never updated, so a crash cannot
leave two active runs behind. A run's end and its records appear with one log entry.
"""

from __future__ import annotations

import functools
import hashlib
import json
import random
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..functions.keys import KEY
from .commits import CommitLog, Folder
from .compare import COUNTS, STATUSES
from .layout import FILE_ROWS, FILES_SCHEMA, SortedFile, baseline_table, files_of_page, write_baseline, write_file_list, write_sorted

_text, _long, _time = T.StringType(), T.LongType(), T.TimestampType()

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", _long, False),
        T.StructField("dataset_id", _text),
        T.StructField("domain_id", _text),
        T.StructField("profile_id", _text),
        T.StructField("domain_run_id", _long),
        T.StructField("status", _text),
        T.StructField("started_at", _time),
        T.StructField("completed_at", _time),
        *[T.StructField(name, _long) for name in COUNTS],
        T.StructField("error_message", _text),
        T.StructField("recon_mode", _text),
        T.StructField("source_query", _text),
        T.StructField("target_query", _text),
        T.StructField("condition_fields", _text),
        T.StructField("run_scope", _text),
        T.StructField("baseline_run_id", _long),
        T.StructField("window_until", _time),
        T.StructField("created_at", _time),
        T.StructField("created_by", _text),
        T.StructField("event_ts", _time, False),
    ]
)

RECORD_SCHEMA = T.StructType(
    [
        T.StructField(KEY, _text),
        T.StructField("source_hash", _text),
        T.StructField("target_hash", _text),
        T.StructField("status", _text),
        T.StructField("field_diffs", _text),
        T.StructField("source_payload", _text),
        T.StructField("target_payload", _text),
        T.StructField("created_at", _time),
        T.StructField("created_by", _text),
        T.StructField("run_id", _long),
    ]
)

# Short names accepted for statuses.
STATUS_ALIASES = {"SOURCE": "SOURCE_ONLY", "TARGET": "TARGET_ONLY"}

# Rows a page holds at most; asking for more is an error.
PAGE_LIMIT = 1000


def normalize_status(status: str | None) -> str | None:
    if status is None or not status.strip():
        return None
    name = status.strip().upper()
    name = STATUS_ALIASES.get(name, name)
    if name not in STATUSES:
        raise ConfigurationError(
            f"Unknown status '{status}': records are {', '.join(STATUSES)} (or {', '.join(STATUS_ALIASES)} for short)"
        )
    return name


def current_runs(events: DataFrame) -> DataFrame:
    """Latest row of every run. One row per run and task is shuffled."""
    latest = events.groupBy("run_id").agg(F.max_by(F.struct(*events.columns), F.col("event_ts")).alias("run"))
    return latest.select("run.*").drop("event_ts")


def _newest_completed(runs: DataFrame) -> DataFrame:
    """Per profile (per domain, for domain runs) the completed run that finished last."""
    rows = runs.filter(F.col("status") == "COMPLETED")
    finished = F.struct("completed_at", "run_id")
    newest = rows.groupBy("domain_id", "profile_id").agg(F.max_by(F.struct(*rows.columns), finished).alias("run"))
    return newest.select("run.*")


def with_active(runs: DataFrame) -> DataFrame:
    """Mark the active run of each profile: the last one to complete."""
    newest = _newest_completed(runs).select(F.col("run_id").alias("active_run_id"))
    joined = runs.join(newest, F.col("run_id") == F.col("active_run_id"), "left")
    return joined.withColumn("active", F.col("active_run_id").isNotNull()).drop("active_run_id")


def active_runs(runs: DataFrame) -> DataFrame:
    """The active run of each profile; failed and running ones never take its place."""
    return _newest_completed(runs)


def list_runs(
    runs: DataFrame,
    domain: str | None = None,
    profile: str | None = None,
    dataset: str | None = None,
    domain_run: int | None = None,
    active: bool | None = None,
) -> DataFrame:
    """Runs that fit all given filters, newest first. A domain run lists itself and its parts."""
    listed = with_active(runs) if active is not None and "active" not in runs.columns else runs
    for column, value in (("domain_id", domain), ("profile_id", profile), ("dataset_id", dataset), ("active", active)):
        if value is not None:
            listed = listed.filter(F.col(column) == value)
    if domain_run is not None:
        listed = listed.filter((F.col("domain_run_id") == domain_run) | (F.col("run_id") == domain_run))
    return listed.orderBy(F.desc("run_id"))


def domain_rollup(runs: DataFrame) -> DataFrame:
    """Counts of every domain run, summed over its profiles; failed if one of them failed."""
    parts = runs.filter(F.col("domain_run_id").isNotNull() & F.col("profile_id").isNotNull())
    failed = F.max(F.col("status") == "FAILED")
    return parts.groupBy("domain_run_id").agg(
        F.count(F.lit(1)).alias("profiles"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS],
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"),
    )


def _of_run(records: DataFrame, run_id: int, status: str | None) -> DataFrame:
    kept = records.filter(F.col("run_id") == run_id)
    wanted = normalize_status(status)
    return kept if wanted is None else kept.filter(F.col("status") == wanted)


def _check_page(limit: int, offset: int, most: int) -> None:
    if not 1 <= limit <= most:
        raise ConfigurationError(f"A page holds 1 to {most} records, not {limit}")
    if offset < 0:
        raise ConfigurationError(f"A page can't start at record {offset}")


def records_page(
    records: DataFrame,
    run_id: int,
    status: str | None = None,
    limit: int = PAGE_LIMIT,
    offset: int = 0,
    after_key: str | None = None,
    most: int = PAGE_LIMIT,
) -> DataFrame:
    """One page of a run's records in key order, of ``limit`` rows (1 to ``most``).

    ``after_key`` starts behind the last key of the page before: a filter that reaches the scan, while an
    ``offset`` has to gather all rows it skips and suits the first pages only.
    """
    _check_page(limit, offset, most)
    columns = [c for c in records.columns if c not in ("run_id", "created_at", "created_by")]
    kept = _of_run(records, run_id, status)
    if after_key is not None:
        kept = kept.filter(F.col(KEY) > after_key)
    page = kept.select(*columns).orderBy(KEY)
    return (page.offset(offset) if offset else page).limit(limit)


def records_total(records: DataFrame, run_id: int, status: str | None = None) -> DataFrame:
    """How many records the pages of a run run through, one row."""
    return _of_run(records, run_id, status).agg(F.count(F.lit(1)).alias("total"))


def _message(error: BaseException) -> str:
    return str(error).strip() or type(error).__name__


def failure_text(error: BaseException) -> str:
    """Message of an error, and of its root cause where that is another one."""
    root, seen = error, {id(error)}
    while (cause := root.__cause__ or root.__context__) is not None and id(cause) not in seen:
        seen.add(id(cause))
        root = cause
    return _message(error) if root is error else f"{_message(error)}, rootCause=[{_message(root)}]"


def new_run_id() -> int:
    """Ids that grow with time, without asking a shared counter."""
    return (time.time_ns() // 1_000_000 << 20) | random.getrandbits(20)


def _owner(domain_id: str, profile_id: str | None) -> str:
    """Folder name of whose runs these are: a digest, so that any id makes a plain name and prunes exactly."""
    text = json.dumps([domain_id, profile_id])
    return "h" + hashlib.sha256(text.encode()).hexdigest()[:24]


class Ledger:
    """Run events, records and baselines below one folder that all executors share.

    What readers see is decided by the commit log; everything else lies in folders that are written once. ``buckets`` is the
    number that baselines are clustered into, ``file_rows`` the most records of a file.
    """

    def __init__(self, spark: SparkSession, path: str, actor: str = "crosstally", buckets: int = 64, file_rows: int = FILE_ROWS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.actor = actor
        self.buckets = buckets
        self.file_rows = file_rows
        self.log = CommitLog(spark, self.path)
        self._tables: list[str] = []

    def _new(self, kind: str, place: str, **facts: Any) -> Folder:
        return Folder(f"{kind}/{place}/{uuid.uuid4().hex}", kind, facts)

    def _at(self, folder: Folder) -> str:
        return f"{self.path}/{folder.path}"

    # -- events ---------------------------------------------------------------------------------

    def _append(self, row: Mapping[str, Any], also: Iterable[Folder] = ()) -> dict[str, Any]:
        """One event, seen together with the folders ``also``. Runs side by side share no committer."""
        event = {**row, "event_ts": datetime.now(timezone.utc)}
        values = tuple(event.get(f.name) for f in RUN_SCHEMA.fields)
        owner = _owner(row["domain_id"], row["profile_id"])
        folder = self._new("runs", f"owner={owner}", owner=owner, runs={str(row["run_id"]): row["status"]})
        self.spark.createDataFrame([values], RUN_SCHEMA).coalesce(1).write.parquet(self._at(folder))
        also = list(also)
        self.log.commit([folder, *also], self._replaced(also))
        return dict(row)

    def _replaced(self, new: Sequence[Folder]) -> list[str]:
        """Folders of the same runs that a retry leaves behind."""
        runs = {(f.kind, f.facts["run_id"]) for f in new}
        if not runs:
            return []
        return [f.path for f in self.log.state()[1].values() if (f.kind, f.facts.get("run_id")) in runs]

    def compact(self, domain_id: str, profile_id: str | None = None) -> int:
        """Put the finished runs of a profile (or of a domain's own runs) into one folder; the number of folders replaced.

        The new folder takes the place of the old ones with one log entry, and these stay until ``vacuum``. If another
        writer compacted them meanwhile, nothing is replaced. Runs that haven't ended keep their folders.
        """
        owner = _owner(domain_id, profile_id)
        own = [f for f in self.log.folders("runs") if f.facts["owner"] == owner]
        ended = {run for f in own for run, status in f.facts["runs"].items() if status != "RUNNING"}
        old = [f for f in own if ended.issuperset(f.facts["runs"])]
        if len(old) < 2:
            return 0
        last = {}
        for f in old:
            last |= {run: status for run, status in f.facts["runs"].items() if last.get(run, "RUNNING") == "RUNNING"}
        new = self._new("runs", f"owner={owner}", owner=owner, runs=last)
        self._rows(old, RUN_SCHEMA).coalesce(1).write.parquet(self._at(new))
        paths = [f.path for f in old]
        return len(old) if self.log.commit([new], paths, needs=paths) is not None else 0

    def vacuum(self, older_than: float = 7 * 86400) -> int:
        """Delete folders that were replaced more than ``older_than`` seconds ago, longer than any reader works."""
        return self.log.vacuum(older_than)

    def start(self, domain_id: str, profile_id: str | None = None, **details: Any) -> dict[str, Any]:
        """Open a run; ``details`` are further columns of the run row."""
        now = datetime.now(timezone.utc)
        return self._append(
            {
                "run_id": new_run_id(),
                "dataset_id": domain_id if not profile_id else f"{domain_id}.{profile_id}",
                "domain_id": domain_id,
                "profile_id": profile_id or None,
                "status": "RUNNING",
                "started_at": now,
                "created_at": now,
                "created_by": self.actor,
                "run_scope": "FULL",
                **dict.fromkeys(COUNTS, 0),
                **details,
            }
        )

    def complete(self, run: Mapping[str, Any], counts: Mapping[str, int], records: Iterable[Folder] = ()) -> dict[str, Any]:
        """End a run; its staged ``records`` are seen from the same moment on."""
        done = {"status": "COMPLETED", "completed_at": datetime.now(timezone.utc)}
        return self._append({**run, **done, **{c: int(counts[c] or 0) for c in COUNTS}}, records)

    def fail(self, run: Mapping[str, Any], error: BaseException) -> dict[str, Any]:
        done = {"status": "FAILED", "completed_at": datetime.now(timezone.utc), "error_message": failure_text(error)}
        return self._append({**run, **done})

    def _rows(self, folders: Sequence[Folder], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*map(self._at, folders))

    def _events(self, folders: Sequence[Folder]) -> DataFrame:
        """Events of these folders, with the partition column ``owner``."""
        schema = T.StructType([*RUN_SCHEMA.fields, T.StructField("owner", _text)])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/runs").parquet(*map(self._at, folders))

    def events(self) -> DataFrame:
        """All events."""
        return self._events(self.log.folders("runs")).drop("owner")

    def _events_of(self, domain_id: str, profile_id: str | None) -> DataFrame:
        """One profile's events; other profiles' folders are not read."""
        owner = _owner(domain_id, profile_id)
        own = (F.col("domain_id") == domain_id) & F.col("profile_id").eqNullSafe(F.lit(profile_id)) & (F.col("owner") == owner)
        return self._events([f for f in self.log.folders("runs") if f.facts["owner"] == owner]).filter(own).drop("owner")

    def runs(self) -> DataFrame:
        return current_runs(self.events())

    def runs_of(self, domain_id: str, profile_id: str | None) -> DataFrame:
        return current_runs(self._events_of(domain_id, profile_id))

    def run(self, run_id: int) -> dict[str, Any] | None:
        folders = [f for f in self.log.folders("runs") if str(run_id) in f.facts["runs"]]
        row = current_runs(self._rows(folders, RUN_SCHEMA)).filter(F.col("run_id") == run_id).first()
        return None if row is None else row.asDict()

    def active(self, domain_id: str, profile_id: str | None) -> dict[str, Any] | None:
        row = active_runs(self.runs_of(domain_id, profile_id)).first()
        return None if row is None else row.asDict()

    # -- records --------------------------------------------------------------------------------

    def stage_records(self, run: Mapping[str, Any], records: DataFrame) -> list[Folder]:
        """Write a run's records, their list of files and their baseline; nobody sees them before they are committed.

        The records are read several times, so give a frame that is cheap to read, such as a written one.
        """
        run_id = run["run_id"]
        sorted_, files, baseline = (
            self._new(kind, f"run_id={run_id}", run_id=run_id, **facts)
            for kind, facts in (("records", {}), ("files", {}), ("baseline", {"buckets": self.buckets})))
        stamped = records.withColumns(
            {"created_at": F.lit(datetime.now(timezone.utc)), "created_by": F.lit(self.actor)}
        )
        write_sorted(stamped, self._at(sorted_), self.file_rows)
        written = self.spark.read.schema(stamped.schema).parquet(self._at(sorted_))
        write_file_list(self.spark, stamped.schema, self._at(sorted_), self._at(files))
        write_baseline(written, self._at(baseline), self.buckets)
        return [sorted_, files, baseline]

    def write_records(self, run: Mapping[str, Any], records: DataFrame) -> None:
        """Store the records of a run. Records that the run had before are replaced."""
        new = self.stage_records(run, records)
        self.log.commit(new, self._replaced(new))

    def records(self, run_ids: Sequence[int] | None = None) -> DataFrame:
        """Records of all runs, or of these."""
        wanted = [f for f in self.log.folders("records") if run_ids is None or f.facts["run_id"] in run_ids]
        fields = T.StructType([f for f in RECORD_SCHEMA.fields if f.name != "run_id"])
        # The folder names the run: one column from the path, however many runs are read.
        of_run = F.regexp_extract(F.col("_metadata.file_path"), r"run_id=(\d+)/[0-9a-f]+/[^/]*$", 1).cast("long")
        if not wanted:
            return self.spark.createDataFrame([], RECORD_SCHEMA)
        return self._rows(wanted, fields).select(*[f.name for f in fields], of_run.alias("run_id"))

    def _baseline(self, run_ids: Sequence[int]) -> tuple[DataFrame, str | None]:
        folders = [f for f in self.log.folders("baseline") if f.facts["run_id"] in set(run_ids)]
        if not folders:
            return self.spark.createDataFrame([], f"{KEY} string, digest binary, run_id long"), None
        buckets = {f.facts["buckets"] for f in folders}
        if len(buckets) == 1:
            name = baseline_table(self.spark, [(f.facts["run_id"], self._at(f)) for f in folders], buckets.pop())
            return self.spark.table(name), name
        # Written with different numbers of buckets: rows as they lie.
        parts = [self.spark.read.parquet(self._at(f)).withColumn("run_id", F.lit(f.facts["run_id"]).cast("long")) for f in folders]
        return functools.reduce(DataFrame.unionByName, parts), None

    @contextmanager
    def baseline_of(self, run_ids: Sequence[int]) -> Iterator[DataFrame]:
        """migration_key, digest and run_id of these runs' records, partitioned by key: a join or an aggregation by key
        doesn't shuffle it. The frame is good until the block ends."""
        frame, name = self._baseline(run_ids)
        try:
            yield frame
        finally:
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def baseline(self, run_ids: Sequence[int]) -> DataFrame:
        """As ``baseline_of``, for frames that are used later; the table behind it stays until ``release``."""
        frame, name = self._baseline(run_ids)
        self._tables += [name] if name else []
        return frame

    def release(self) -> None:
        """Forget the tables behind ``baseline`` frames; their files stay."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")

    def _sorted_files(self, run_id: int) -> tuple[str | None, list[SortedFile]]:
        _, folders = self.log.state()
        of_run = {f.kind: f for f in folders.values() if f.facts.get("run_id") == run_id}
        if "records" not in of_run:
            return None, []
        files = self.spark.read.schema(FILES_SCHEMA).parquet(self._at(of_run["files"])).collect()
        return self._at(of_run["records"]), [SortedFile(**r.asDict()) for r in files]

    def page_frame(
        self, run_id: int, status: str | None = None, limit: int = PAGE_LIMIT, offset: int = 0, after_key: str | None = None
    ) -> DataFrame:
        """A page of a run's records in key order, read from the files that hold its ranks, usually one or two."""
        _check_page(limit, offset, PAGE_LIMIT)
        wanted = normalize_status(status)
        folder, files = self._sorted_files(run_id)
        chosen, skip = files_of_page(files, wanted, limit, offset, after_key)
        fields = T.StructType([f for f in RECORD_SCHEMA.fields if f.name not in ("run_id", "created_at", "created_by")])
        if not chosen:
            return self.spark.createDataFrame([], fields)
        found = self.spark.read.schema(fields).parquet(*[f"{folder}/{f.file}" for f in chosen])
        if wanted is not None:
            found = found.filter(F.col("status") == wanted)
        if after_key is not None:
            found = found.filter(F.col(KEY) > after_key)
        page = found.orderBy(KEY)
        return (page.offset(skip) if skip else page).limit(limit)

    def page(
        self, run_id: int, status: str | None = None, limit: int = PAGE_LIMIT, offset: int = 0, after_key: str | None = None
    ) -> dict[str, Any]:
        """A page of records with the total, as plain Python values; ``next_key`` is the ``after_key`` of the next one."""
        rows = [r.asDict() for r in self.page_frame(run_id, status, limit, offset, after_key).collect()]
        wanted = normalize_status(status)
        return {
            "run_id": run_id,
            "status": wanted,
            "limit": limit,
            "offset": offset,
            "next_key": rows[-1][KEY] if len(rows) == limit else None,
            "total": sum(f.rows(wanted) for f in self._sorted_files(run_id)[1]),
            "page_size": len(rows),
            "records": rows,
        }
