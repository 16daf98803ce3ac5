from .compare import (
    COUNTS,
    MATCHED,
    MISMATCHED,
    SOURCE_ONLY,
    TARGET_ONLY,
    bag_difference,
    classify,
    classify_with_payloads,
    duplicate_keys,
    except_all,
    field_rollup,
    leftovers,
    leftovers_by_digest,
    reconcile_counts,
    reconcile_details,
    records_of,
    summary,
    unique_keys,
)
from .digest import domain_digest, run_digest
from .history import HistoryTable
from .incremental import chained_baseline, delta, delta_by_digest
from .ledger import (
    RECORD_SCHEMA,
    RUN_SCHEMA,
    Ledger,
    active_runs,
    current_runs,
    domain_rollup,
    list_runs,
    normalize_status,
    records_page,
    records_total,
    with_active,
)
from .runner import Runner
from .versioned import (
    active_snapshot,
    delete_cascade,
    fill_defaults,
    latest_patch,
    patch_merge,
    soft_delete,
    upsert,
)

__all__ = [name for name in dir() if not name.startswith("_")]
