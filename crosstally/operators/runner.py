"""Running profiles and domains: extract, compare, keep what changed, write the ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import comparable
from ..functions.keys import KEY
from ..plans.catalog import Catalog
from ..plans.settings import CompareMode, CompareSettings
from ..plans.spec import Profile
from ..plans.window import RunScope, Window, resolve_scope, resolve_window
from ..sources.extract import extract, stored_statement
from .commits import Folder
from .compare import COUNTS, numbers_and_leftovers, reconcile_counts, records_of, status_counts
from .incremental import chain_of_runs, delta_by_digest
from .ledger import Ledger


class Runner:
    """Runs the profiles of a catalog against a ledger.

    ``baseline="previous"`` compares an incremental run with the records of the active run alone;
    ``"chained"`` with the latest record of each key since the last full run.
    ``by_key`` is handed to every comparison (see ``compare.classify``); set it on a profile to say that this
    profile's keys are nearly unique.
    """

    def __init__(
        self,
        spark: SparkSession,
        catalog: Catalog,
        ledger: Ledger,
        baseline: str = "previous",
        store_payloads: bool = True,
        by_key: bool = False,
        readers: Mapping | None = None,
    ):
        if baseline not in ("previous", "chained"):
            raise ValueError("baseline is 'previous' or 'chained'")
        self.spark = spark
        self.catalog = catalog
        self.ledger = ledger
        self.baseline = baseline
        self.store_payloads = store_payloads
        self.by_key = by_key
        self.readers = readers

    def sides(self, profile: Profile, window: Window) -> tuple[DataFrame, DataFrame]:
        extracted = [
            extract(
                self.spark,
                side,
                self.catalog.datasources,
                window,
                self.readers,
                profile.qualified_id,
                role,
                profile.query_dir or self.catalog.defaults.query_dir,
            )
            for side, role in ((profile.source, "source"), (profile.target, "target"))
        ]
        return extracted[0], extracted[1]

    def run_profile(
        self,
        ref: str,
        domain: str | None = None,
        mode: CompareMode | str | None = None,
        condition_fields: Sequence[str] | None = None,
        force_full: bool = False,
        domain_run_id: int | None = None,
    ) -> dict[str, Any]:
        """Run one profile and return its final run row. Any failure ends as a FAILED run."""
        profile = self.catalog.resolve_profile(ref, domain)
        settings = profile.settings.overlay(mode, condition_fields)
        active = self.ledger.active(profile.domain_id, profile.profile_id)
        scope, baseline_id = resolve_scope(active, force_full)
        window = resolve_window(active if scope is RunScope.INCREMENTAL else None)
        run = self.ledger.start(
            profile.domain_id,
            profile.profile_id,
            domain_run_id=domain_run_id,
            recon_mode=settings.resolved_mode.value,
            condition_fields=",".join(settings.condition_fields) or None,
            run_scope=scope.value,
            baseline_run_id=baseline_id,
            window_until=window.until,
            source_query=self._stored(profile, profile.source, "source"),
            target_query=self._stored(profile, profile.target, "target"),
        )
        try:
            counts, records = self._compare(run, profile, settings, window, scope, baseline_id)
        except Exception as error:
            return self.ledger.fail(run, error)
        return self.ledger.complete(run, counts, records)

    def _stored(self, profile: Profile, side, role: str) -> str | None:
        try:
            kind = side.resolved_kind(self.catalog.datasources)
        except ValueError:
            return side.query
        query_dir = profile.query_dir or self.catalog.defaults.query_dir
        return stored_statement(side, kind, profile.qualified_id, role, query_dir)

    def _compare(self, run, profile: Profile, settings: CompareSettings, window, scope, baseline_id) -> tuple[Mapping[str, int], list[Folder]]:
        source, target = self.sides(profile, window)
        if settings.resolved_mode is CompareMode.COUNTS:
            return reconcile_counts(source, target, profile.strategy, profile.by_key or self.by_key).first().asDict(), []
        # Numbers of all keys and texts of differing ones come from one shuffle of copies. The numbers are
        # observed in the stage that writes, after the last shuffle, so recomputed tasks are not counted twice;
        # their branch adds no row.
        observation = Observation()
        per_key, differing = numbers_and_leftovers(source, target, profile.strategy, profile.by_key or self.by_key)
        observed = per_key.observe(observation, *status_counts()).filter("source_rows < 0")
        absent = [f"CAST(NULL AS STRING) AS {side}_payload" for side in ("source", "target")]
        differing = differing.unionByName(observed.selectExpr(KEY, *absent, "status"))
        width = max(len(comparable(source)), len(comparable(target)))
        names = profile.source.comparable_fields or profile.target.comparable_fields
        records = records_of(
            differing,
            settings.resolved_mode,
            names,
            settings.condition_fields,
            profile.strategy,
            width,
            self.store_payloads,
        )
        # Records are written as they come first: the counts stay in that stage, and what sorts, samples or joins them
        # later reads files.
        staged = self._staging_path(run)
        try:
            records.write.mode("overwrite").parquet(staged)
            kept = self.spark.read.schema(records.schema).parquet(staged)
            if scope is RunScope.INCREMENTAL:
                changed = f"{staged}-changed"
                with self.ledger.baseline_of(self._baseline_runs(profile, baseline_id)) as baseline:
                    delta_by_digest(kept, baseline).write.mode("overwrite").parquet(changed)
                kept = self.spark.read.schema(records.schema).parquet(changed)
            return observation.get, self.ledger.stage_records(run, kept)
        finally:
            for path in (staged, f"{staged}-changed"):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _staging_path(self, run: Mapping[str, Any]) -> str:
        shared = self.spark.conf.get("spark.checkpoint.dir", None) or self.ledger.path
        return f"{shared.rstrip('/')}/staging/run_id={run['run_id']}"

    def _baseline_runs(self, profile: Profile, baseline_id: int) -> list[int]:
        """Ids of the runs an incremental run is compared with."""
        if self.baseline == "previous":
            return [baseline_id]
        own = self.ledger.runs_of(profile.domain_id, profile.profile_id)
        # The ids of one profile's runs since its last full run; they select folders to read.
        return [r.run_id for r in chain_of_runs(own).select("run_id").collect()]

    def run_domain(
        self,
        domain_id: str,
        mode: CompareMode | str | None = None,
        condition_fields: Sequence[str] | None = None,
        force_full: bool = False,
        parallel: int = 4,
    ) -> dict[str, Any]:
        """Run all profiles of a domain side by side; a profile that fails does not stop the others."""
        domain = self.catalog.domain(domain_id)
        parent = self.ledger.start(domain_id)
        if not domain.profiles:
            return {"run": self.ledger.complete(parent, dict.fromkeys(COUNTS, 0)), "profiles": {}}

        def one(profile_id: str) -> dict[str, Any] | BaseException:
            # With the FAIR scheduler every profile gets its own pool, so a large one does not hold up the rest.
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{domain_id}.{profile_id}")
            try:
                return self.run_profile(
                    profile_id, domain_id, mode, condition_fields, force_full, parent["run_id"]
                )
            except Exception as error:
                return error

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            results = dict(zip(domain.profiles, pool.map(one, domain.profiles)))
        broken = [r for r in results.values() if isinstance(r, BaseException) or r["status"] == "FAILED"]
        if broken:
            done = self.ledger.fail(parent, RuntimeError("One or more profiles failed"))
        else:
            done = self.ledger.complete(parent, {c: sum(r[c] or 0 for r in results.values()) for c in COUNTS})
        return {"run": done, "profiles": results}
