"""Errors raised by operations, metadata and stores."""


class ToolError(Exception):
    """Base of all errors of this library."""


class ArgumentError(ToolError, ValueError):
    """An argument is missing, of the wrong kind or contradicts another one."""


class MetadataError(ToolError):
    """Field metadata contradict each other."""


class FieldError(MetadataError):
    """A field can't be used as asked."""


class NoSuchFieldError(FieldError):
    """A field isn't there."""


class OperationError(ToolError):
    """An operation can't be applied."""


class NoSuchObjectError(ToolError):
    """A store has no object of that name."""


class ConsistencyError(ToolError):
    """A pipeline graph doesn't hold together."""


class ProbeAssertionError(ToolError):
    """An assertion about data failed. ``reason`` is a short code."""

    def __init__(self, message: str, reason: str | None = None):
        super().__init__(message)
        self.reason = reason


class SkipPipeline(ToolError):
    """A pipeline's gate says that it needn't run."""
