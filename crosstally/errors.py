"""Errors raised while a comparison is being described, before any data is read."""


class ConfigurationError(ValueError):
    """A side, key, datasource or setting is missing, contradictory or malformed."""
