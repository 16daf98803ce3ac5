"""Scope of a run and the time window its extracts are bound to."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from enum import Enum
from typing import Any

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class RunScope(str, Enum):
    FULL = "FULL"
    INCREMENTAL = "INCREMENTAL"


@dataclass(frozen=True)
class Window:
    """``since`` and ``until`` as bound into the extracts; ``until`` never precedes ``since``."""

    since: datetime = EPOCH
    until: datetime | None = None

    def __post_init__(self):
        since = _utc(self.since) if self.since is not None else EPOCH
        until = _utc(self.until) if self.until is not None else datetime.now(timezone.utc)
        object.__setattr__(self, "since", since)
        object.__setattr__(self, "until", max(since, until))


def _utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment


def resolve_scope(active_run: Mapping[str, Any] | None, force_full: bool = False) -> tuple[RunScope, int | None]:
    """Incremental when a completed active run exists and no full run is forced."""
    if force_full or active_run is None or active_run["status"] != "COMPLETED":
        return RunScope.FULL, None
    return RunScope.INCREMENTAL, active_run["run_id"]


def resolve_window(baseline: Mapping[str, Any] | None, until: datetime | None = None) -> Window:
    """Epoch to now for a full run; else from where the baseline's own window ended.

    Starting at the end of the baseline's window, not at its completion time, keeps rows that
    changed while the baseline was running.
    """
    if baseline is None:
        return Window(EPOCH, until)
    since = baseline["window_until"] or baseline["completed_at"] or baseline["started_at"] or EPOCH
    return Window(since, until)
