"""Named table operations on Spark DataFrames: preparation, auditing, change detection and pipelines.

``ops`` is the registry of operations; ``Pipeline`` records them as a graph.
"""

from .errors import (
    ArgumentError,
    FieldError,
    MetadataError,
    NoSuchFieldError,
    NoSuchObjectError,
    OperationError,
    ProbeAssertionError,
    ToolError,
)
from .metadata import Field, FieldFilter, FieldList
from .registry import ops

__all__ = [
    "ArgumentError", "Field", "FieldError", "FieldFilter", "FieldList", "MetadataError", "NoSuchFieldError",
    "NoSuchObjectError", "OperationError", "ProbeAssertionError", "ToolError", "ops",
]
