"""What a comparison stores: counts, per-key records, or records with field statuses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from ..errors import ConfigurationError


class CompareMode(str, Enum):
    COUNTS = "COUNTS"
    MISMATCH_DETAILS = "MISMATCH_DETAILS"
    FIELD_DETAILS = "FIELD_DETAILS"

    @classmethod
    def of(cls, value: "CompareMode | str") -> "CompareMode":
        try:
            return value if isinstance(value, cls) else cls(str(value).strip().upper())
        except ValueError:
            raise ConfigurationError(f"Unknown mode: {value}; use {', '.join(m.value for m in cls)}") from None


@dataclass(frozen=True)
class CompareSettings:
    """Mode and condition fields; a level that sets nothing leaves both to the level above."""

    mode: CompareMode | None = None
    condition_fields: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode is not None:
            object.__setattr__(self, "mode", CompareMode.of(self.mode))
        object.__setattr__(self, "condition_fields", tuple(self.condition_fields or ()))

    def overlay(self, mode: CompareMode | str | None = None, condition_fields: Sequence[str] | None = None):
        """Settings of one run: given values win, an empty list of fields clears them."""
        return CompareSettings(
            self.mode if mode is None else mode,
            self.condition_fields if condition_fields is None else condition_fields,
        )

    def inherit(self, parent: "CompareSettings | None", default_mode: CompareMode) -> "CompareSettings":
        """Fill what is unset from the parent level, then from the default."""
        parent = parent or CompareSettings()
        return CompareSettings(
            self.mode or parent.mode or default_mode,
            self.condition_fields or parent.condition_fields,
        )

    @property
    def resolved_mode(self) -> CompareMode:
        return self.mode or CompareMode.MISMATCH_DETAILS
