"""Families of errors."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class ConfigurationError(EngineError):
    """Roots or settings are invalid or ambiguous."""


class CapabilityError(EngineError):
    """Something that is asked for isn't available here."""


class SourceError(EngineError):
    """A source can't be read or parsed; what was indexed of it stays."""


class StaleResult(EngineError):
    """The source has changed since it was indexed."""


class AmbiguousResult(EngineError):
    """An identity has more than one target."""


class QueryError(EngineError):
    """A query, mode or filter is invalid."""
