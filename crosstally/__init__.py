"""Table reconciliation on Spark: extract two sides, pair them by key, tell what differs."""

from .errors import ConfigurationError
from .functions import KEY, KEY_ALIAS, Strategy, keyed, normalize, reject_null_keys
from .operators import *  # noqa: F401,F403
from .plans import (
    Catalog,
    CompareMode,
    CompareSettings,
    Datasource,
    Defaults,
    Domain,
    KeySpec,
    Profile,
    SideSpec,
    SourceKind,
    Window,
)
from .sources import extract
