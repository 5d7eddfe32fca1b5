"""Assertions: each looks at the data at once, and returns it or raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ProbeAssertionError
from ..metadata import prepare_key
from ..registry import operation
from .audit import count_duplicates
from .util import col, present


@operation
def assert_unique(df: DataFrame, key=None) -> DataFrame:
    """No key (no whole row without one) occurs twice."""
    if not count_duplicates(df, key).limit(1).isEmpty():
        raise ProbeAssertionError(f"{prepare_key(key) or 'rows'} aren't unique", "duplicate")
    return df


def _has(df: DataFrame, field: str, value) -> bool:
    (name,) = present(df, [field])
    return not df.filter(col(name).eqNullSafe(F.lit(value))).limit(1).isEmpty()


@operation
def assert_contains(df: DataFrame, field: str, value) -> DataFrame:
    if not _has(df, field, value):
        raise ProbeAssertionError(f"{field!r} nowhere is {value!r}", "missing")
    return df


@operation
def assert_missing(df: DataFrame, field: str, value) -> DataFrame:
    if _has(df, field, value):
        raise ProbeAssertionError(f"{field!r} somewhere is {value!r}", "contains")
    return df
