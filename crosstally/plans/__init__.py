from .settings import CompareMode, CompareSettings
from .spec import Datasource, Domain, KeyKind, KeySpec, Profile, SideSpec, SourceKind
from .catalog import Catalog, Defaults
from .window import EPOCH, RunScope, Window, resolve_scope, resolve_window

__all__ = [
    "Catalog",
    "CompareMode",
    "CompareSettings",
    "Datasource",
    "Defaults",
    "Domain",
    "EPOCH",
    "KeyKind",
    "KeySpec",
    "Profile",
    "RunScope",
    "SideSpec",
    "SourceKind",
    "Window",
    "resolve_scope",
    "resolve_window",
]
