"""Error taxonomy: what the caller did, what the data holds, what broke inside."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors raised by this library."""


class UserError(EngineError):
    """The call can't be carried out as asked."""


class ParameterError(UserError):
    """An argument is missing, out of range or contradicts another."""


class DataError(UserError):
    """The data does not have the shape an operator needs."""


class InternalError(EngineError):
    """A broken invariant of the library itself."""


class GenerationError(EngineError):
    """Generation stopped: too many invalid records."""
